"""Contexts of queries with any number of hits."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quarry.operators import answer

SCHEMA = "query_id string, rank int, source string, page int, text string"


def test_digest_of_contexts(spark, monkeypatch):
    rows = [("a", i, f"/x/{i % 3}.txt" if i % 4 else None, i % 2 or None, None if i % 7 == 0 else f"é text {i} " * (i % 5)) for i in range(1, 400)]
    rows += [("b", 1, "/x/y.txt", None, ""), (None, 1, "", 3, "without an id"), (None, 3, "/", 3, "ranks may skip")]
    hits = spark.createDataFrame(rows, SCHEMA).repartition(5, "text")
    want = {r["query_id"]: hashlib.md5(r["context"].encode()).hexdigest() for r in answer.context(hits).collect()}
    assert dict(map(tuple, answer.context_digest(hits).collect())) == want and len(want) == 3
    assert answer.context_digest(hits.limit(0)).collect() == []


def test_few_hits_of_a_query_come_to_its_task(spark):
    rows = [("a", i, "/", None, "") for i in range(1, 300)] + [("b", 1, "/x", None, "long" * 100), ("b", 2, "/x", None, "short")]
    found = answer.trimmed_context(spark.createDataFrame(rows, SCHEMA), 100)
    # A block of these is []\n and its line end, and another line end stands between two.
    assert dict(map(tuple, found.collect())) == {"a": "\n\n".join(["[]\n"] * 25).strip(), "b": ""}
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()
    assert answer.trimmed_context(spark.createDataFrame(rows, SCHEMA).where(F.col("rank") == 2), 100).count() == 2
