"""Audit of the interaction of five text filters, from a histogram of failure masks.

Every document gets a mask of five bits, one for each filter that it fails (`CONDITIONS`; bit 4 is filter E, the duplicates). Documents with equal masks
behave alike in every order of the filters, so the counts of the 32 masks of a part say all that any order does. What a filter removes in an
order depends only on the set of the filters before it: 80 pairs of a filter and a set are added up from the cells of each part, and the 120 orders look them up. The text is read
once; what is shuffled are rows of a digest, an id and a mask, and only DataFrame functions are used.

Filter E fails where a smaller doc_id has the same text (same SHA-256 and number of bytes). Texts are grouped with a partial minimum, and the smallest id joins back by
digest and id together, so a text that a third of all documents share makes no hot key.

Defined results: a null text is empty, a null lang is the part ''; a null doc_id is neither smaller nor larger than another, so it never fails E and makes no other
document fail; repeated rows (same doc_id and text) count each and don't fail E by one another; a document that has several rows in `labels` is good (toxic) if
one of them says so; null labels count as 0; an empty table has no parts and gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise

FILTERS = "ABCDE"
#: Maximal runs of these are words.
WORD = r"[^\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
LEAST_WORDS = 100
#: Per cent: distinct words of all words, at least; capital letters of all code points, at most.
LEAST_DISTINCT, MOST_CAPITALS = 80, 10


def conditions(text: Column) -> list[Column]:
    """The failure conditions A to D, which a text decides alone, in this order."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("bigint")
    return [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > MOST_CAPITALS * F.length(text).cast("bigint"),
        text.rlike(MARKS),
    ]


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask, n): the masks of A to D, with repeated rows as one."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"], F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("text")))]
    # Bytes of the digest and the length: 32 bytes in place of a text, wherever it goes.
    digest = F.concat(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.octet_length("text").cast("string").cast("binary"))
    keyed = rows.select("doc_id", "part", digest.alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    return keyed.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))


def label_flags(labels: DataFrame) -> DataFrame:
    """(labelled, good, toxic): one row for each doc_id that has labels."""
    said = lambda name: F.max(F.when(labels[name] == 1, 1).otherwise(0))
    return labels.groupBy(labels["doc_id"].alias("labelled")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, all of them and those that labels call good or toxic; at most 32 rows a part."""
    held = materialise(masks(docs), "masks")
    first = held.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.where(F.col("doc_id").isNotNull()).select("doc_id", "digest", F.lit(True).alias("first"))
    flags = materialise(label_flags(labels), "flags")
    marked = held.join(first, ["doc_id", "digest"], "left").join(flags, F.col("doc_id") == F.col("labelled"), "left")
    last = F.when(F.col("doc_id").isNull() | F.col("first"), 0).otherwise(1 << (len(FILTERS) - 1))
    both = lambda name: F.sum(F.col("n") * F.coalesce(F.col(name), F.lit(0))).alias(name)
    return marked.groupBy("part", (F.col("mask") + last).alias("mask")).agg(F.sum("n").alias("n"), both("good"), both("toxic"))


def _orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, bit, before): the steps of all orders; `before` is the set of filters that stand before the step."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        rows += [(name, step + 1, 1 << i, sum(1 << j for j in order[:step])) for step, i in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def _pairs() -> Column:
    """(bit, before, times): every filter with every set of others before it, and the number of orders in which it stands just behind this set."""
    found = []
    for i in range(len(FILTERS)):
        for before in (s for s in range(1 << len(FILTERS)) if not s >> i & 1):
            times = factorial(before.bit_count()) * factorial(len(FILTERS) - 1 - before.bit_count())
            found.append(F.struct(F.lit(1 << i).alias("bit"), F.lit(before).alias("before"), F.lit(times).alias("times")))
    return F.array(*found)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step."""
    steps = materialise(histogram(docs, labels), "cells").select("*", F.inline(_pairs()))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    add = lambda which, what="n": F.sum(F.when(which, F.col(what)).otherwise(0))
    sums = steps.groupBy("part", "bit", "before", "times").agg(
        add(~fails & ~earlier).alias("kept"),
        add(fails & ~earlier).alias("removed"),
        add(fails & earlier).alias("redundant"),
        add(F.col("mask") == F.col("bit")).alias("unique_fails"),
        add(fails & ~earlier, "good").alias("good_lost"),
        add(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    every = Window.partitionBy("part", "bit")
    found = sums.withColumn("shapley", F.sum(F.col("removed") * F.col("times")).over(every)).join(F.broadcast(_orders(docs.sparkSession)), ["bit", "before"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
