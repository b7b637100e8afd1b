"""Blocks of vectors and the inverted file, against all rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import blocks, dense, ivf
from quarry.plans.catalogue import QUERIES

ROWS = "chunk_key string, embedding array<float>, kind int"


@pytest.fixture(scope="module")
def held(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(15)]
    rows = [(f"k{i:04}", [c + rng.gauss(0, 0.4) for c in centres[rng.randrange(15) if i % 3 else 0]], i % 2) for i in range(900)]
    rows += [("same-a", rows[0][1], 0), ("same-b", rows[0][1], 1)]
    odd = [("none", None, 0), ("zero", [0.0] * 12, 0), ("nan", [math.nan] * 12, 0), ("null", [None] * 12, 0), ("inf", [math.inf] * 12, 0)]
    return rows, spark.createDataFrame(rows + odd, ROWS)


def nearest(rows, vector, k):
    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    return [key for _, key in sorted((-round(cos(v, vector), 6), key) for key, v, _ in rows)[:k]]


@pytest.fixture(scope="module")
def index(spark, held, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('ivf')}/one"
    ivf.build(held[1], path)
    return ivf.Index.read(spark, path)


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["chunk_key"])
    return out


def test_every_row_with_a_vector_has_a_list(spark, held, index):
    assert index.rows(spark).count() == len(held[0]) and len(index.centroids) > 10
    assert index.rows(spark).select("list").distinct().count() > 10


def test_recall_and_exact_path(spark, held, index):
    rows, frame = held
    asked = frame.where("chunk_key like 'k%5'").selectExpr("chunk_key as query_id", "embedding")
    want = {q: nearest(rows, v, 10) for q, v, _ in rows if q.endswith("5") and q.startswith("k")}
    assert found(ivf.search(index, asked, 10, probes=0)) == want == found(dense.search(frame.where("chunk_key <> 'zero'"), asked, 10))
    got = found(ivf.search(index, asked, 10))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)
    assert 1 <= index.probes < len(index.centroids)


def test_a_question_reads_its_lists_only(spark, held, index):
    rows, frame = held
    one = ivf.search_one(spark, index, rows[7][1], 5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "list" in plan.split("PartitionFilters: [", 1)[1].split("]")[0], "folders of other lists are not read"
    assert len(one.inputFiles()) <= len(index.rows(spark).inputFiles())
    assert [r["chunk_key"] for r in ivf.search_one(spark, index, rows[7][1], 5, probes=0).collect()] == nearest(rows, rows[7][1], 5)
    assert {r["kind"] for r in ivf.search_one(spark, index, rows[7][1], 5, where=F.col("kind") == 1).collect()} == {1}


def test_few_rows(spark, tmp_path):
    for n in (0, 1, 3):
        frame = spark.createDataFrame([(f"k{i}", [1.0 + i, 2.0], 0) for i in range(n)], ROWS)
        built = ivf.build(frame, f"file://{tmp_path}/few{n}")
        asked = spark.createDataFrame([("q", [1.0, 1.0]), ("none", None), ("long", [1.0] * 5)], "query_id string, embedding array<float>")
        assert len(found(ivf.search(ivf.Index.read(spark, built.path), asked, 2)).get("q", [])) == min(n, 2)
    with pytest.raises(ValueError):
        ivf.build(spark.createDataFrame([("a", [1.0], 0), ("b", [1.0, 2.0], 0)], ROWS), f"file://{tmp_path}/mixed")


def test_many_blocks_and_states(spark, held, monkeypatch):
    rows, frame = held
    monkeypatch.setattr(blocks, "QUERIES", 4)
    monkeypatch.setattr(blocks, "STATES", 2)
    asked = frame.where("chunk_key like 'k%7'").selectExpr("chunk_key as query_id", "embedding")
    want = {q: nearest(rows, v, 3) for q, v, _ in rows if q.endswith("7") and q.startswith("k")}
    assert found(dense.search(frame.where("chunk_key <> 'zero'"), asked, 3)) == want


def test_recall_of_the_query(spark, duck, sf_dir):
    want: dict = {}
    for q, v in duck.sql("SELECT q.vec_id, e.vec_id FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) <= 10").fetchall():
        want.setdefault(q, set()).add(v)
    got: dict = {}
    for r in QUERIES["ivf_topk_batch"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))
