"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one aggregation, which is written, and a join of the links to it: a node with very many links is reduced on the map side, and as both
sides of the join are plain tables adaptive execution can split its rows. Nothing but a count per round reaches the driver, and rounds end when
the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node that has a link to another."""
    now = materialise(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        wide = _large_star(now)
        after = _small_star(wide)
        release(wide)
        mark = _mark(after)
        release(now)
        now = after
        if mark == before:
            break
        before = mark
    tops = now.select(F.col("b").alias("node")).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    done = materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
    release(least)
    return done


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = materialise(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    near = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    done = materialise(near.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    release(least)
    return done
