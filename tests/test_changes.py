"""Tables by changes, the segmented index and the embedding cache, against what a rebuild gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import bm25, segments, store
from quarry.operators.embeddings import EmbeddingCache
from quarry.operators.ingest import KnowledgeBase
from quarry.providers import HashEmbedder
from quarry.settings import Cutting, Settings

CHUNK = "kb_id string, doc_id string, chunk_key string, text string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_equal_a_plain_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FEW", 1)
    rng = random.Random(1)
    held = store.Deltas(store.Table(spark, f"file://{tmp_path}/t", "k string, part int, v int"), ("k", "part"))
    plain: list[tuple] = []
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    for step in range(8):
        gone = [(rng.choice(["a", "b", None]), rng.randrange(3)) for _ in range(rng.randrange(3))]
        fresh = [(rng.choice(["a", "b", None]), rng.randrange(3), step) for _ in range(rng.randrange(1, 4))]
        held.change(frame(fresh, "k string, part int, v int"), frame(gone, "k string, part int"), "one")
        plain = [r for r in plain if r[:2] not in gone] + fresh
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted((tuple(r) for r in held.read("one").collect()), key=key) == sorted(plain, key=key)
        some = [("a", 1), (None, 2)]
        assert sorted((tuple(r) for r in held.of(frame(some, "k string, part int"), "one").collect()), key=key) == sorted([r for r in plain if r[:2] in some], key=key)
    assert len(held.sizes("one")) <= 5, "changes are folded"
    assert held.read("other").collect() == []


def test_folding_by_size(monkeypatch):
    assert store.to_fold([1] * store.FEW) == 0 and store.to_fold([1] * (store.FEW + 1)) == store.FEW + 1
    monkeypatch.setattr(store, "FEW", 1)
    assert store.to_fold([]) == store.to_fold([5]) == 0 and store.to_fold([5, 1]) == 0
    assert store.to_fold([5, 5]) == 2 and store.to_fold([100, 3, 2, 1]) == 0 and store.to_fold([100, 3, 2, 2]) == 3
    sizes: list[int] = []
    written = 0
    for _ in range(500):
        sizes.append(1)
        n = store.to_fold(sizes)
        if n:
            written += sum(sizes[-n:])
            sizes[-n:] = [sum(sizes[-n:])]
    assert len(sizes) <= 10 and written <= 500 * 10


def test_of_two_writers_one_goes_again(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    table, other = (store.Table(spark, f"file://{tmp_path}/t", "k string, v int") for _ in range(2))
    table.write(rows(("a", 1)), "a")

    def meanwhile(name):
        def write(folder):
            other.write(rows((name, 2)), name)
            rows(("a", 3)).write.parquet(folder)

        return write

    table.publish(meanwhile("b"), "a")
    assert rows_of(table.read()) == [("a", 3), ("b", 2)], "a change of another key is kept"
    with pytest.raises(RuntimeError):
        table.publish(meanwhile("a"), "a")
    assert rows_of(table.read("a")) == [("a", 2)]


def test_an_unfinished_pointer_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LOOKS", 2)
    table = store.Table(spark, f"file://{tmp_path}/t", "k string, v int")
    table.write(spark.createDataFrame([("a", 1)], "k string, v int"), "a")
    (tmp_path / "t" / "pointer-000000000001.json").write_text('{"a": ["v-')
    assert rows_of(table.read()) == [("a", 1)]
    table.append(spark.createDataFrame([("a", 2)], "k string, v int"), "a")
    assert rows_of(table.read()) == [("a", 1), ("a", 2)]


WORDS = [f"word{i}" for i in range(60)]


def text(rng):
    return " ".join(rng.choice(WORDS[: rng.choice([3, 20, 60])]) for _ in range(rng.randrange(0, 40)))


@pytest.mark.parametrize("seed", [1])
def test_segments_score_as_a_new_index(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(segments, "RANGE", 4)
    monkeypatch.setattr(store, "FEW", 1)
    monkeypatch.setattr(store, "to_fold", lambda sizes: 2 if len(sizes) > 2 else 0)
    rng = random.Random(seed)
    held = segments.Indexed(store.Table(spark, f"file://{tmp_path}/t", CHUNK), ("doc_id",))
    plain: dict = {}
    questions = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=5))) for i in range(8)] + [(8, "unknown"), (9, "")], "query_id int, text string")
    for step in range(4):
        for kb in ("x", "y"):
            if kb == "y" and step % 2:
                continue
            gone = rng.sample(sorted(d for k, d in plain if k == kb), min(3, sum(k == kb for k, _ in plain)))
            fresh = [d for d in gone if rng.random() < 0.5] + [f"{kb}{step}-{i}" for i in range(rng.choice([1, 6, 30]))]
            rows = [(kb, d, f"{d}#{i}", text(rng)) for d in fresh for i in range(2)]
            held.change(spark.createDataFrame(rows, CHUNK), spark.createDataFrame([(d,) for d in gone], "doc_id string"), kb)
            plain = {k: v for k, v in plain.items() if k[0] != kb or k[1] not in gone} | {(kb, d): [r for r in rows if r[1] == d] for d in fresh}
    now = spark.createDataFrame([r for rows in plain.values() for r in rows], CHUNK)
    assert rows_of(held.read()) == rows_of(now)
    anew = bm25.build(now)
    scored = lambda df: [(*r[:3], round(r[3], 8), r[4]) for r in rows_of(df.select("query_id", "kb_id", "chunk_key", "score", "rank"))]
    want = {per_kb: scored(bm25.search(anew, questions, 5, per_kb)) for per_kb in (False, True)}
    counts = lambda df: {tuple(r) for r in df.collect()}
    for whole in (False, True):
        if whole:
            monkeypatch.setattr(store, "to_fold", len)
            for kb in ("x", "y"):
                held._fold(kb)
        assert [len(held.table.held(kb)) for kb in ("x", "y")] == ([1, 1] if whole else [2, 2])
        for per_kb, first in ((False, 1), (True, 3)):
            assert scored(segments.search(held.index("x", "y"), questions, 5, per_kb, first=first)) == want[per_kb]
        assert counts(held.index().term_stats().select("kb_id", "term", "df")) == counts(anew.term_stats.select("kb_id", "term", "df"))
        assert rows_of(held.read()) == rows_of(now)
    assert held.index("x", "z") is None


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path):
    rng = random.Random(3)
    rows = [("kb", f"d{i}", f"c{i:04}", f"word{i % 50} " + " ".join(rng.choices(WORDS[:10], k=20)) + (" alpha beta gamma" * 3 if i in (17, 401, 402) else " alpha" if i % 9 == 0 else "")) for i in range(1500)]
    held = segments.Indexed(store.Table(spark, f"file://{tmp_path}/t", CHUNK), ("doc_id",))
    held.change(spark.createDataFrame(rows, CHUNK), spark.createDataFrame([], "doc_id string"), "kb")
    index = held.index("kb")
    terms = bm25.query_terms(spark.createDataFrame([(0, "alpha beta gamma")], "query_id int, text string"))
    read = segments._reading(index, terms, index.term_stats(terms), 3, ["query_id"], 4)
    every = read.bounds.count()
    assert read.first.count() == 4 and read.rest.count() + 4 < every / 4
    bounds = {(r["segment"], r["range"]): r["most"] for r in read.bounds.collect()}
    exact = segments.score(index, terms, index.term_stats(terms), read.bounds)
    placed = {r["chunk_key"]: (r["segment"], r["range"]) for r in index.blocks.select("segment", "range", F.inline("postings")).collect()}
    assert all(r["score"] <= bounds[placed[r["chunk_key"]]] + segments.SLACK for r in exact.collect()), "no chunk exceeds the bound of its range"
    assert [r["chunk_key"] for r in segments.search(index, spark.createDataFrame([(0, "alpha beta gamma")], "query_id int, text string"), 3).orderBy("rank").collect()] == ["c0017", "c0401", "c0402"]


class Counting:
    """Writes down every text that it is given."""

    def __init__(self, path):
        self.path = path

    def __call__(self, texts):
        with open(self.path, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return HashEmbedder(8)(texts)


def test_a_text_is_embedded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.touch()
    cache = EmbeddingCache(store.Table(spark, f"file://{tmp_path}/v", EmbeddingCache.SCHEMA), "p", "m")
    rows = spark.createDataFrame([(i, ["one", "two", None, ""][i % 4]) for i in range(40)], "id int, text string")
    got = cache.embed(rows, Counting(calls))
    assert sorted(calls.read_text().split("\n")[:-1]) == ["", "one", "two"] and got.where("embedding is null").count() == 0
    assert {r["id"]: list(r["embedding"]) for r in got.collect()}[1] == [pytest.approx(x) for x in HashEmbedder(8)(["two"])[0]]
    cache.embed(rows.unionByName(spark.createDataFrame([(99, "three")], rows.schema)), Counting(calls)).collect()
    assert calls.read_text().count("\n") == 4
    other = EmbeddingCache(cache.held.table, "p", "m2")
    other.embed(rows.where("id < 2"), Counting(calls)).collect()
    assert calls.read_text().count("\n") == 6, "another model has vectors of its own"
    assert EmbeddingCache(cache.held.table, "pm", "").missing(rows).count() == 3


def test_a_sync_writes_and_reads_what_changed(spark, tmp_path):
    kb = KnowledgeBase(spark, Settings(root=f"file://{tmp_path}/kb", cutting=Cutting(60, 5)))
    docs, calls = tmp_path / "docs", tmp_path / "calls"
    docs.mkdir()
    calls.touch()
    for i in range(30):
        (docs / f"f{i:02}[x].txt").write_text(f"text number {i} " + "filler words of this file " * 8)
    kb.ingest(str(docs), provider=Counting(calls))
    sent, before = calls.read_text().count("\n"), kb.chunks.table.held("docs")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "kb" / "tables" / "chunks" / before[0]).rglob("*.parquet")}
    (docs / "f03[x].txt").write_text("wholly new apples")
    (docs / "f04[x].txt").rename(docs / "renamed.txt")
    report = kb.report(kb.ingest(str(docs), provider=Counting(calls))).first()
    assert sorted(r["abs_path"].rsplit("/", 1)[1] for r in report["ingested"]) == ["f03[x].txt", "renamed.txt"]
    assert calls.read_text().count("\n") == sent + 1, "only the new text is embedded, not that of the renamed file"
    after = kb.chunks.table.held("docs")
    assert after[0] == before[0] and len(after) == 2 and kb.chunks.sizes("docs")[1] < 15, "one small folder beside the old one"
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "kb" / "tables" / "chunks" / before[0]).rglob("*.parquet")}, "which is untouched"
    anew = bm25.build(kb.chunks.read("docs"))
    asked = spark.createDataFrame([(0, "apples text number"), (1, "filler 4")], "query_id int, text string")
    score = lambda df: [(r["query_id"], r["chunk_key"], round(r["score"], 8)) for r in df.orderBy("query_id", "rank").collect()]
    assert score(segments.search(kb.index("docs"), asked, 8)) == score(bm25.search(anew, asked, 8))
    assert kb.texts.read("docs").count() == 31


def test_many_questions_read_blocks_once(spark, tmp_path, monkeypatch):
    """Questions in several blocks, over several knowledge bases and changes, give what ranges chosen for each question and an index built anew give."""
    rows = [("xy"[i % 2], i, " ".join(f"w{(i * j) % (5 + j)}" for j in range(1, 9)) if i % 11 else "w1 w1 w2") for i in range(300)]
    chunks = spark.createDataFrame(rows, "kb_id string, chunk_key int, text string")
    segments.write(f"file://{tmp_path}/1", 1, chunks, chunks.limit(0))
    segments.write(f"file://{tmp_path}/2", 2, chunks.limit(0), chunks.where("chunk_key % 5 = 0"))
    index = segments.Segments.read(spark, [f"file://{tmp_path}/{i}" for i in (1, 2)])
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} w2 nowhere") for i in range(7)] + [("none", "zzz"), ("blank", "")], "query_id string, text string")
    rows_of = lambda df: sorted((r["query_id"], r["kb_id"], r["chunk_key"], r["rank"], round(r["score"], 6)) for r in df.collect())
    now = chunks.where("chunk_key % 5 <> 0")
    monkeypatch.setattr(bm25, "QUESTIONS", 5)
    monkeypatch.setattr(bm25, "STEP", 7)
    for per_kb in (False, True):
        found = segments.search(index, asked, 4, per_kb)
        order = Window.partitionBy("query_id", *["kb_id"] * per_kb).orderBy(F.desc("score"), "chunk_key")
        plain = bm25.score(bm25.build(now), asked).withColumn("rank", F.row_number().over(order)).where("rank <= 4")
        assert rows_of(found) == rows_of(bm25.search_chunks(now, asked, 4, per_kb=per_kb)) == rows_of(plain)
    # What is ranked are the few rows that tasks have kept, and no pairs of questions and chunks.
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
