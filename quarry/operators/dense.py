"""Exact cosine search over array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import blocks
from quarry.runtime import materialise


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column, length: Column | None = None) -> Column:
    """Null for a vector of length 0; `length` is that of b, where it is known."""
    both = F.sqrt(dot(a, a)) * (F.sqrt(dot(b, b)) if length is None else length)
    return dot(a, b) / F.nullif(both, F.lit(0.0))


def _length(vector: list[float]) -> float:
    return math.sqrt(sum(float(x) ** 2 for x in vector))


def search_one(chunks: DataFrame, vector: list[float], limit: int, key: str = "chunk_key", where: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The best `limit` rows (of each group) for one vector; the filter stands below the limit, so a partitioned table is pruned by it."""
    rows = chunks if where is None else chunks.where(where)
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]), F.lit(_length(vector)))
    scored = rows.select(*[c for c in rows.columns if c != "embedding"], F.coalesce(score, F.lit(0.0)).alias("score"))
    if not by:
        return scored.orderBy(F.desc("score"), key).limit(limit)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    return scored.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= limit).drop("__nth")


def search(chunks: DataFrame, queries: DataFrame, limit: int, key: str = "chunk_key") -> DataFrame:
    """(query_id, key, score, rank) for all queries (query_id, embedding) against all rows, exactly: one job, blocks of queries against blocks of rows.

    Rows and queries without a whole vector take no part; a vector of length 0 has the score 0; only vectors of a query's length are met.
    """
    asked, rows = queries.where(blocks.whole("embedding")), chunks.where(blocks.whole("embedding"))
    with blocks.batches(chunks.sparkSession):
        found = blocks.nearest(asked.select(F.col("query_id").alias("query"), F.col("embedding").alias("v")), rows.select(F.col(key).alias("key"), F.col("embedding").alias("v")), limit, cosine=True)
        return materialise(found.select(F.col("query").alias("query_id"), F.col("key").alias(key), "score", "rank"), "nearest")
