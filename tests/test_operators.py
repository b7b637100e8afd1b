"""Operators on small tables: goldens, ties, empty inputs and plans."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.operators import answer, bm25, chunking, dense, facets, fusion, inspect, manifest, retrieve, store
from quarry.settings import Search, Settings

TEXTS = ["apple banana apple", "banana", "", "苹果香蕉 apple"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([("kb", i, t) for i, t in enumerate(TEXTS)], "kb_id string, chunk_key int, text string")


def test_bm25_numbers(spark, chunks):
    index = bm25.build(chunks)
    assert [r["dl"] for r in index.doc_stats.orderBy("chunk_key").collect()] == [3, 1, 0, 6]
    assert index.corpus_stats.first()["avgdl"] == 2.5
    idf = {r["term"]: round(r["idf"], 6) for r in index.term_stats.collect()}
    assert idf["apple"] == 0.693147 and idf["苹果"] == 1.203973
    for question, wanted in (("apple", {0: 0.902322, 3: 0.440729}), ("apple 苹果", {0: 0.902322, 3: 1.206261})):
        one = {r["chunk_key"]: round(r["score"], 6) for r in bm25.search_one(chunks, question, 10).collect()}
        asked = spark.createDataFrame([(1, question)], "query_id int, text string")
        batch = {r["chunk_key"]: round(r["score"], 6) for r in bm25.search(index, asked, 10).collect()}
        assert one == batch == wanted


def test_bm25_limits(spark, chunks):
    assert bm25.search_one(chunks, "apple", 0).count() == 0
    assert bm25.search_one(chunks, "nothing", 5).count() == 0
    assert bm25.search_one(chunks.limit(0), "apple", 5).count() == 0
    asked = spark.createDataFrame([(1, "banana")], "query_id int, text string")
    got = bm25.search(bm25.build(chunks), asked, 5, where=F.col("chunk_key") != 1).collect()
    assert [r["chunk_key"] for r in got] == [0]


def test_index_round_trip(spark, chunks, tmp_path):
    index = bm25.build(chunks)
    index.write(f"file://{tmp_path}/one")
    asked = spark.createDataFrame([(1, "apple")], "query_id int, text string")
    stored = bm25.Index.read(spark, [f"file://{tmp_path}/one"])
    assert bm25.search(stored, asked, 5).count() == 2
    for per_kb in (False, True):
        plain = sorted(map(tuple, bm25.search_one(chunks, "apple pie", 3, per_kb=per_kb).collect()))
        assert plain and sorted(map(tuple, bm25.search_index(stored, "apple pie", 3, per_kb).collect())) == plain
    assert "EqualTo(term,apple)" in bm25.search_index(stored, "apple", 3)._jdf.queryExecution().executedPlan().toString()


def test_tables_keep_what_others_hold(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}/t", "k string, v int")
    rows = lambda *made: spark.createDataFrame(list(made), "k string, v int")
    held = lambda *keys: sorted(tuple(r) for r in table.read(*keys).collect())
    assert held() == [] and not table.exists()
    table.write(rows(("a", 1)), "a")
    table.write(rows(("b", 2)), "b")
    before = table.read()
    table.append(rows(("a", 3)), "a")
    assert held() == [("a", 1), ("a", 3), ("b", 2)] and held("b") == [("b", 2)] and held("c") == []
    table.write(rows(("a", 4)), "a")
    assert held("a") == [("a", 4)] and sorted(tuple(r) for r in before.collect()) == [("a", 1), ("b", 2)], "a plan made before still reads what it saw"
    for i in range(4):
        table.write(rows(("a", i)), "a")
    kept = {p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")}
    assert sum(n.startswith("pointer-") for n in kept) == store.KEPT and sum(n.startswith("v-") for n in kept) == store.KEPT + 1
    def dies(folder):
        rows(("a", 9)).write.parquet(folder)
        raise OSError
    with pytest.raises(OSError):
        table.publish(dies, "a")
    assert held() == [("a", 3), ("b", 2)], "a writer that dies leaves the old state"


def test_dense_top_k_takes_ordered(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "chunk_key int, embedding array<float>")
    found = dense.search_one(rows, [1.0, 0.0], 2)
    assert [(r["chunk_key"], r["score"]) for r in found.collect()] == [(1, 1.0), (3, 1.0)]
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(7, [0.0, 2.0])], "query_id int, embedding array<float>")
    assert [r["chunk_key"] for r in dense.search(rows.where("chunk_key < 4"), asked, 1).collect()] == [2]


def test_fusion_golden(spark):
    near = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.7)], "sig string, score double")
    words = spark.createDataFrame([("b", 4.0), ("d", 2.0)], "sig string, score double")
    got = [(r["sig"], round(r["score"], 6)) for r in fusion.fuse(fusion.merge(near, words, ["sig"]), "sig", 0).orderBy("rank").collect()]
    assert got == [("a", 0.7), ("c", 0.35), ("b", 0.3), ("d", 0.0)]
    single = fusion.fuse(fusion.merge(near.limit(1), words.limit(1), ["sig"]), "sig", 5)
    assert {r["score"] for r in single.collect()} == {0.0}


def test_hybrid_without_sparse_hits_is_dense(spark):
    rows = spark.createDataFrame([("kb", 1, "x1", [1.0, 0.0]), ("kb", 2, "x2", [0.6, 0.8])], "kb_id string, chunk_key int, text string, embedding array<float>")
    got = retrieve.hybrid(rows, "zebra", [1.0, 0.0], "kb", top_k=1).collect()
    assert [(r["chunk_key"], r["score"]) for r in got] == [(1, 1.0)]
    assert retrieve.hybrid(rows, "  ", [1.0, 0.0]).count() == 0
    off = Settings(search=Search(words=False))
    assert [r["chunk_key"] for r in retrieve.hybrid(rows, "x2", [1.0, 0.0], settings=off).orderBy("rank").collect()] == [1, 2]


def test_across_shares(spark):
    assert retrieve.share(10, 3) == 4 and retrieve.share(10, 0) == 0
    rows = spark.createDataFrame([(k, r) for k in ("a", "b", "c") for r in range(1, 7)], "kb_id string, rank int")
    got = [tuple(r)[:2] for r in retrieve.across(rows, ["b", "a", "c"], 10).collect()]
    assert got == [("b", 1), ("b", 2), ("b", 3), ("b", 4), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("c", 1), ("c", 2)]
    assert retrieve.across(rows, [], 10).count() == 0


HITS = "query_id int, rank int, source string, page int, doc_id string, text string"


def test_citations_and_context(spark):
    hits = spark.createDataFrame([(1, 1, "s1", 1, "d", "aaa"), (1, 2, "s1", 1, "d", "bbb"), (1, 3, "s1", None, "d", "c"), (1, 4, "s2", None, "e", "d")], HITS)
    got = answer.citations(hits).orderBy("rank").collect()
    assert [(r["source"], r["page"]) for r in got] == [("s1", 1), ("s1", None), ("s2", None)]
    blocks = spark.createDataFrame([(1, i, "x", None, "d", "t") for i in (1, 2, 3)], HITS)  # "[x]\nt\n" is 6 characters
    assert answer.trimmed_context(blocks, 13).first()["context"] == "[x]\nt\n\n[x]\nt"
    assert answer.trimmed_context(blocks, 0).first()["context"] == "[x]\nt\n\n[x]\nt\n\n[x]\nt"
    assert answer.trimmed_context(blocks, 3).first()["context"] == ""


def test_answer_falls_back(spark):
    hits = spark.createDataFrame([(1, "s1", 1, "d", "aaa")], "rank int, source string, page int, doc_id string, text string")

    def broken(question, context):
        raise RuntimeError

    assert answer.answer("q", hits.limit(0), None) == answer.Answer(answer.FALLBACK)
    assert answer.answer("q", hits, None).answer == answer.FALLBACK
    got = answer.answer("q", hits, broken)
    assert got.answer == answer.FALLBACK and got.citations[0]["source"] == "s1" and "aaa" in got.context
    assert answer.answer("q", hits, lambda q, c: f" {q}! ").answer == "q!"


def test_facets_and_names(spark):
    rows = spark.createDataFrame([(1, "/x/a.txt"), (2, "/y/a.txt"), (3, "/x/b.txt"), (4, "")], "pos int, source string")
    assert [tuple(r) for r in facets.facet_files(rows).collect()] == [("a.txt", 2), ("b.txt", 1), ("unknown", 1)]
    assert [r["name"] for r in facets.source_names(rows).collect()] == ["a.txt", "b.txt"]
    assert facets.filter_files(rows, ["A.TXT"]).count() == 2 and facets.filter_files(rows, []).count() == 4


def test_suggestions(spark):
    schema = "kb_id string, abs_path string, status string, source_deleted boolean, updated_at timestamp"
    rows = spark.sql("SELECT 'k' kb_id, '/r/report.xlsx' abs_path, 'indexed' status, false source_deleted, timestamp'2024-01-01' updated_at UNION ALL SELECT 'k', '/r/other.txt', 'indexed', false, timestamp'2024-02-01' UNION ALL SELECT 'k', '/r/gone.txt', 'deleted', true, timestamp'2024-03-01'")
    assert facets.suggest_files(rows, ["k"], "open report.xlsx") == (["report.xlsx"], None)
    assert facets.suggest_files(rows, ["k"], "zz") == (["other.txt", "report.xlsx"], facets.RECENT)
    assert facets.suggest_files(rows, ["k"], " ") == ([], facets.ASK_FIRST)
    assert facets.suggest_files(spark.createDataFrame([], schema), ["k"], "x") == ([], facets.NO_FILES)


def test_plan_of_changes(spark):
    listing = spark.createDataFrame([("a", "a", ".txt", "h1", 1), ("d", "d", ".txt", "h", 1), ("e", "e", ".mp3", "h", 1)], "abs_path string, rel_path string, suffix string, hash string, mtime bigint")
    schema = "abs_path string, hash string, mtime bigint, status string, source_deleted boolean"
    records = spark.createDataFrame([("a", "h1", 1, "indexed", False), ("b", "h", 1, "indexed", False), ("c", "h", 1, "deleted", True)], schema)
    got = {r["abs_path"]: (r["action"], r["reason"]) for r in manifest.plan(listing, records).collect()}
    assert got == {"a": ("unchanged", "unchanged"), "b": ("deleted", "source_missing"), "c": ("gone", None), "d": ("parse", None), "e": ("unsupported", "unsupported")}
    touched = records.withColumn("mtime", F.lit(2).cast("bigint"))
    assert manifest.plan(listing, touched).where("abs_path = 'a'").first()["action"] == "parse"


def test_store_versions(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}/t", "a int, b string")
    assert not table.exists() and table.read().count() == 0
    table.write(spark.createDataFrame([(1, "x")], "a int, b string"))
    table.write(table.read().unionByName(spark.createDataFrame([(2, "y")], "a int, b string")))
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "x"), (2, "y")]
    table.drop()
    assert not table.exists()


def test_dimension_check(spark):
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>")
    with pytest.raises(ValueError, match="dimensions"):
        store.check_dimension(rows)
    assert store.check_dimension(rows.limit(1)) == 1


def test_chunk_rows_and_sections(spark):
    schema = "doc_id string, doc_pos int, text string, source_type string, sheet string, row int"
    docs = spark.createDataFrame([("f", 0, "Chapter 1\nbody\n\nChapter 2", "txt", None, None), ("g", 0, "x\t2024-01-05", "xlsx", "s", 2), ("g", 1, "y", "xlsx", "s", 3), ("h", 0, " ", "txt", None, None)], schema)
    got = sorted((r["doc_id"], r["chunk_id"], r["text"]) for r in chunking.chunk(docs).collect())
    assert got == [("f", 0, "Chapter 1\nbody"), ("f", 1, "Chapter 2"), ("g", 0, "x\t2024-01-05 [DATE=2024-01] [DATE=2024-01-05]"), ("g", 1, "y")]


def test_json_types(spark, duck):
    texts = ['{"a": 1, "b": "x"}', '{"a": 1.5, "c": null, "d": [1], "n": {"a": {"b": "2"}}}', '{"a": "12", "b": "true", "d": "[x", "e": 1e5, "f": 1.0, "g": -3, "h": "null", "i": "", "n": {"a": 1}}', '{"j": {}, "k": [], "l": [[1, "a"], {"x": 0.5}], "m": 18446744073709551615}']
    rows = spark.createDataFrame([(t,) for t in [*texts, "no json", "[1]", "7", None]], "props string")
    names = {"UBIGINT": "int", "BIGINT": "int", "DOUBLE": "float", "BOOLEAN": "bool", "ARRAY": "list", "OBJECT": "dict", "NULL": "null", "VARCHAR": "str"}
    want: dict = {}
    for t in texts:
        for path, kind in duck.execute(r"SELECT regexp_replace(substr(fullkey, 3), '\[\d+\]', '[]', 'g'), type FROM json_tree(?) WHERE fullkey <> '$'", [t]).fetchall():
            want.setdefault(path, set()).add(names[kind])
    want = {k: ",".join(sorted(v)) for k, v in want.items()}
    assert {r["key"]: r["types"] for r in inspect.json_types(rows, "props", nested=True).collect()} == want
    assert {r["key"]: r["types"] for r in inspect.json_types(rows, "props").collect()} == {k: v for k, v in want.items() if not {".", "["} & set(k)}
    big = spark.createDataFrame([('{"a": 18446744073709551616, "b": 123456789012345678901234567890.0}',)], "props string")
    assert {r["key"]: r["types"] for r in inspect.json_types(big, "props").collect()}["a"] == "int"


def test_point_ids():
    assert inspect.point_id("12") == 12 and inspect.point_id("x1") == "x1"


def test_names_of_many_roots(spark):
    roots = [("/a/docs", None), ("/b/docs", None), ("/c/Docs", ""), ("/d/other", "mine"), ("/e/known", None), ("/f/docs", None), ("/g/---", None), ("/b/docs", None)]
    digits = lambda root: hashlib.sha1(root.encode()).hexdigest()[:6]
    taken = [("/z/1", "docs"), ("/z/2", f"docs_{digits('/b/docs')}"), ("/z/3", f"docs_{digits('/f/docs')}"), ("/z/4", f"docs_{digits('/f/docs')}_2"), ("/e/known", "bound")]
    got = manifest.resolve_kb_ids(spark.createDataFrame(roots, "root string, wanted string"), spark.createDataFrame(taken, "root string, kb_id string")).collect()
    want = {"/a/docs": f"docs_{digits('/a/docs')}", "/b/docs": f"docs_{digits('/b/docs')}_2", "/c/Docs": f"docs_{digits('/c/Docs')}", "/d/other": "mine", "/e/known": "bound", "/f/docs": f"docs_{digits('/f/docs')}_3", "/g/---": "kb"}
    assert dict(map(tuple, got)) == want and len(got) == len(roots)
    free = manifest.resolve_kb_ids(spark.createDataFrame(roots[:3], "root string, wanted string"), spark.createDataFrame([], "root string, kb_id string"))
    assert dict(map(tuple, free.collect())) == {"/a/docs": "docs", "/b/docs": f"docs_{digits('/b/docs')}", "/c/Docs": f"docs_{digits('/c/Docs')}"}


def test_names_of_roots_asked_alone(spark):
    roots = ["/r3775/Taken", "/r6231/Taken"]  # their SHA-1 begins with the same six digits
    asked = spark.createDataFrame([(r, None) for r in roots], "root string, wanted string")
    taken = spark.createDataFrame([("/z", "taken")], "root string, kb_id string")
    assert dict(map(tuple, manifest.resolve_kb_ids(asked, taken, together=False).collect())) == dict.fromkeys(roots, "taken_34bc16")
    assert dict(map(tuple, manifest.resolve_kb_ids(asked, taken).collect())) == {roots[0]: "taken_34bc16", roots[1]: "taken_34bc16_2"}


def test_a_folder_as_a_tree_of_digests(spark):
    names = spark.range(1_000_000).select(F.concat(F.lit("folder/file_"), F.col("id").cast("string")).alias("rel"), F.col("id").alias("mtime"), (F.col("id") % 7).alias("size"))
    digest = lambda df: manifest.tree_fingerprint(df).first()["fingerprint"]
    whole = digest(names)
    assert whole == digest(names.repartition(3, F.reverse("rel"))), "whatever the partitions"
    assert len({whole, digest(names.where("mtime <> 77")), digest(names.withColumn("size", F.when(F.col("mtime") == 77, 100).otherwise(F.col("size"))))}) == 3
    assert digest(names.limit(0)) == "" and digest(names.limit(1)) != ""
