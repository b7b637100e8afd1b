"""Goldens of scalar functions, with the cases that the driver's tables lack."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import dates, encoding, pages, text


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'binary' if isinstance(v, bytes) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given_", "wanted"),
    [
        ("RAG知识库好 a 中 BM25 检索 BM25", ["知识", "识库", "库好", "知识库", "识库好", "检索", "rag", "bm25", "bm25"]),
        ("é!", []),
        ("", []),
        (None, []),
        ("中 文", []),
    ],
)
def test_bm25_tokens(spark, given_, wanted):
    assert one(spark, text.bm25_tokens(F.col("t")), t=given_) == wanted


def test_token_cap_takes_cjk_first(spark):
    assert one(spark, text.bm25_tokens(F.col("t"), 3), t="ab cd 知识库") == ["知识", "识库", "知识库"]


def test_normalize_and_garbled(spark):
    assert one(spark, text.normalize(F.col("t")), t=" \t　a\r\nb\rc  ") == "a\nb\nc"
    assert one(spark, text.garbled_score(F.col("t")), t="é�ü中") == 4
    assert one(spark, text.looks_garbled(F.col("t")), t="é" * 20) is True
    assert one(spark, text.looks_garbled(F.col("t")), t="é" * 20 + "中" * 10) is False
    assert one(spark, text.looks_garbled(F.col("t")), t="") is False


def test_keywords(spark):
    assert one(spark, text.cjk_ngrams(F.col("t")), t="知识库 知识") == ["知识", "识库", "知识库"]
    assert one(spark, text.latin_keywords(F.col("t")), t="Ab ab x CD") == ["ab", "cd"]
    score = text.keyword_score(F.col("t"), F.array(F.lit("知识")), F.array(F.lit("ab"), F.lit("zz")))
    assert one(spark, score, t="xABx 知识知识") == 4


def test_names(spark):
    assert one(spark, text.sanitize_kb_id(F.col("t")), t="  My Docs-v2 知识! ") == "my_docs_v2_知识"
    assert one(spark, text.sanitize_kb_id(F.col("t")), t="!!") == "kb"
    assert one(spark, text.parse_file_filters(F.col("t")), t="A.pdf, a.PDF；b.txt｜c") == ["A.pdf", "b.txt｜c"]
    assert one(spark, text.mentions(F.col("t")), t="see a.xlsx, b.tiff and 报告.docx") == ["a.xlsx", "b.tiff", "报告.docx"]
    asked = F.lit("report.pdf 2024")
    assert one(spark, text.score_file_name(asked, F.col("t"), F.array(F.lit("report"), F.lit("pdf"), F.lit("2024"))), t="report.pdf") == 54
    assert one(spark, text.stem(F.col("t")), t=".bashrc") == ".bashrc"
    assert one(spark, text.suffix(F.col("t")), t="/a.b/c.TXT") == ".txt"
    assert one(spark, text.basename(F.col("t")), t="C:\\x\\y.doc") == "y.doc"


def test_signature_treats_zero_as_missing(spark):
    sig = text.signature(F.col("d"), F.col("s"), F.col("p"), F.col("c"), F.lit(None), F.col("t"))
    assert one(spark, sig, d="0", s="a", p=0, c=0, t="x") == "0|a|||"
    assert one(spark, sig, d=None, s=None, p=0, c=0, t="x").startswith("content:")


@pytest.mark.parametrize(
    ("given_", "wanted"),
    [
        ("2024-01-05", "2024-01-05 [DATE=2024-01] [DATE=2024-01-05]"),
        ("1998年5月", "1998年5月 [DATE=2098-05]"),
        ("45000", "45000 [DATE=2023-03] [DATE=2023-03-15]"),
        ("日期2024-01-05日", "日期2024-01-05日 [DATE=2024-01] [DATE=2024-01-05]"),
        ("2024-13-01", "2024-13-01"),
        ("2024-02-31 and 2024-02-45", "2024-02-31 and 2024-02-45 [DATE=2024-02] [DATE=2024-02-31]"),
        ("none", "none"),
        ("", ""),
    ],
)
def test_dates(spark, given_, wanted):
    assert one(spark, dates.append_date_tokens(F.col("t")), t=given_) == wanted


def test_sections(spark):
    t = "\n intro\n\n第一章 总则\nbody\n1.2 Title\nz\nChapter two\n附件3 x"
    assert one(spark, pages.split_sections(F.col("t")), t=t) == ["intro", "第一章 总则\nbody", "1.2 Title\nz", "Chapter two", "附件3 x"]
    assert one(spark, pages.split_sections(F.col("t")), t="") == []
    assert one(spark, pages.split_sections(F.col("t")), t="Chapter 1\nChapter 2") == ["Chapter 1", "Chapter 2"]
    assert one(spark, pages.is_heading(F.col("t")), t="1.2 " + "x" * 120) is False


def test_pages(spark):
    assert one(spark, pages.split_pages(F.col("t")), t="lost === Page 1 ===\n\nA\n\n=== Page 7 ===\n\nB") == ["", "A", "B"]
    assert one(spark, pages.split_pages(F.col("t")), t="no marks") == ["no marks"]
    assert one(spark, pages.split_pages(F.col("t")), t="  ") == []
    assert one(spark, pages.ensure_marks(F.col("t")), t="") == ""


def test_windows(spark):
    assert [len(w) for w in one(spark, pages.split_windows(F.col("t"), 800, 100), t="x" * 800)] == [800, 100]
    assert one(spark, pages.split_windows(F.col("t"), 0, 100), t="abc") == ["abc"]
    assert one(spark, pages.split_windows(F.col("t"), 5, 9), t="abc") == ["abc", "bc", "c"]
    assert one(spark, pages.split_windows(F.col("t"), 5, 0), t="") == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), st.integers(1, 9), st.integers(-2, 9))
def test_windows_cover_the_text(spark, t, size, overlap):
    got = one(spark, pages.split_windows(F.col("t"), size, overlap), t=t)
    step = max(1, size - max(0, overlap))
    assert got == [t[i : i + size] for i in range(0, len(t), step)]


def test_decoding(spark):
    assert one(spark, encoding.decode(F.col("b")), b="知识".encode()) == "知识"
    assert one(spark, encoding.decode(F.col("b")), b="检索知识库".encode("gb18030")) == "检索知识库"
    assert "�" in one(spark, encoding.decode(F.col("b")), b=b"\xff\xff\xff abc")
    broken = ("知识库检索" * 5).encode().decode("latin-1")
    assert one(spark, encoding.repair(F.col("t")), t=broken) == "知识库检索" * 5
    assert one(spark, encoding.repair(F.col("t")), t="naïve café") == "naïve café"
