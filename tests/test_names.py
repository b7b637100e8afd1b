"""The n-gram index of file names, against scoring each name for each question."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import facets, names, ordinal

NAMES = ["Report_2024.PDF", "report.txt", "年度报告.docx", "a.txt", "ab.csv", ".hidden", "x", "no match here.xls", "3月份账单.xlsx", "Straße.txt", "tmp"]
QUESTIONS = ["what is in report_2024.pdf?", "open the Report", "年度报告在哪里", "3月的账单", "A", "zzz qqq", "STRASSE Straße.txt", "ab", "?", "", "the file .hidden and tmp", "x"]


def test_equals_scoring_every_name(spark):
    held = spark.createDataFrame([(n, i % 4) for i, n in enumerate(NAMES)], "name string, at int").select("name", F.timestamp_seconds("at").alias("updated_at"))
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, text string")
    for limit in (3, 8):
        got: dict = {}
        for r in sorted(names.suggest_all(held, asked, limit).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["name"], r["score"], r["message"], r["rank"]))
        want = {i: [(r["name"], r["score"], r["message"], r["rank"]) for r in facets.suggest(held, q, limit).orderBy("rank").collect()] for i, q in enumerate(QUESTIONS) if q}
        assert got == want
    assert names.suggest_all(held.limit(0), asked).collect() == []


def test_containment_by_rarest_gram(spark):
    parts = ["", "a", "ab", "abc", "bcde", "zz", "abcabc", "é", None]
    wholes = ["abc", "xabcde", "", "abcabcabc", "é", None, "a"]
    got = {tuple(r) for r in names.contained(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string")).collect()}
    assert got == {(p, w) for p in parts for w in wholes if p and w is not None and p in w}


def test_frequent_words(spark):
    """Words that most names hold: sets of one to four words, and questions of more."""
    words = ["the", "of", "he", "and", "a", "tx"]
    made = [f"{a}_{b}{'' if i % 5 else '_' + c}.TXT" for i, (a, b, c) in enumerate((a, b, c) for a in words for b in words for c in words)]
    kept = sorted({n: i % 7 for i, n in enumerate(made)}.items())
    held = spark.createDataFrame(kept, "name string, at int").select("name", F.timestamp_seconds("at").alias("updated_at"))
    asked = ["the", "the of", "of_the and", "the_of.txt", "he and tx the", "the of he and tx", "txt", "zz", "zz the", "and the and", "the of he and tx zz the_of"]
    got: dict = {}
    for r in sorted(names.suggest_all(held, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), 4).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["name"], r["score"], r["message"], r["rank"]))
    assert got == {i: [(r["name"], r["score"], r["message"], r["rank"]) for r in facets.suggest(held, q, 4).orderBy("rank").collect()] for i, q in enumerate(asked)}


def test_candidates_do_not_grow_with_the_square(spark):
    n = 400
    held = spark.range(n).select(F.concat(F.lit("the_w"), F.col("id"), F.lit("x.txt")).alias("name"), F.timestamp_seconds("id").alias("updated_at"))
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("the w"), F.col("id"), F.lit("x")).alias("text")).withColumn("tokens", names.question_tokens(F.col("text")))
    assert names.candidates(held, asked, 8).count() <= n * 3 * 8


def test_numbers_over_partitions(spark):
    rows = [(g, i) for g, m in (("a", 700), ("b", 1), (None, 300)) for i in range(m)]
    found = ordinal.numbered(spark.createDataFrame(rows, "g string, i int").repartition(7), ("g",), ("i",))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((g, i, i + 1) for g, i in rows), key=repr)
