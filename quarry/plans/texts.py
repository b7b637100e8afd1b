"""Queries of scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates, pages, text
from quarry.plans.registry import query, table

CJK, LATIN = r"[\x{4e00}-\x{9fff}]+", "[A-Za-z0-9]+"


def grams_sql(t: str, most: int) -> str:
    return (
        f"flatten(list_transform(list_filter(regexp_extract_all({t}, '{CJK}'), lambda r: length(r) >= 2), lambda r: flatten(list_transform(range(2, least({most}, length(r)) + 1), "
        "lambda n: list_transform(range(1, length(r) - n + 2), lambda i: substring(r, i, n))))))"
    )


def words_sql(t: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({t}, '{LATIN}'), lambda w: length(w) > 1), lambda w: lower(w))"


def tokens_sql(t: str, most: int) -> str:
    return f"(list_concat({grams_sql(t, 3)}, {words_sql(t)}))[1:{most}]"


def first_seen_sql(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def joined(items: Column) -> Column:
    return F.array_join(items, " ")


#: Documents have no CJK, so every third gets some.
MIXED_SQL = "(SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN concat('第', doc_id, '章 知识库检索，混合 RAG系统9月 ', text) ELSE text END AS t FROM documents)"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cjk = F.concat(F.lit("第"), F.col("doc_id").cast("string"), F.lit("章 知识库检索，混合 RAG系统9月 "), F.col("text"))
    return docs.select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, cjk).otherwise(F.col("text")).alias("t"))


@query(f"SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, md5(array_to_string(k, ' ')) AS tokens FROM (SELECT doc_id, {tokens_sql('t', 1024)} AS k FROM {MIXED_SQL})")
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(spark, sf_dir).select("doc_id", text.bm25_tokens(F.col("t"), 1024).alias("k"))
    return found.select("doc_id", F.size("k").alias("n_tokens"), F.md5(joined(F.col("k")).cast("binary")).alias("tokens"))


@query(f"SELECT doc_id, array_to_string({first_seen_sql(grams_sql('t', 5))}, ' ') AS grams FROM {MIXED_SQL}")
def cjk_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).select("doc_id", joined(text.cjk_ngrams(F.col("t"))).alias("grams"))


@query(f"SELECT item_id, array_to_string(k, ' ') AS words, array_to_string(k[1:32], ' ') AS latin_terms FROM (SELECT item_id, {first_seen_sql(words_sql('text'))} AS k FROM benchmark)")
def latin_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", joined(text.latin_keywords(F.col("text"))).alias("words"), joined(text.query_terms(F.col("text"))[1]).alias("latin_terms"))


_QUESTION_SQL = f"""
WITH q AS (SELECT item_id, concat('第', item_id, '章 知识库检索 ', item_id % 12 + 1, '月份 ', text) AS t FROM benchmark),
k AS (SELECT item_id, unnest(list_concat(list_concat(
    list_filter(list_transform(regexp_extract_all(t, '{LATIN}|{CJK}'), lambda w: lower(w)), lambda w: length(w) >= 2), {grams_sql('t', 3)}),
    flatten(list_transform(regexp_extract_all(t, '([0-9]{{1,2}})月(?:份)?', 1), lambda m: [concat(m, '月'), concat(m, '月份')])))) AS w FROM q)
SELECT item_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS tokens FROM k GROUP BY item_id
"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("item_id").cast("string")
    asked = F.concat(F.lit("第"), at, F.lit("章 知识库检索 "), (F.col("item_id") % 12 + 1).cast("string"), F.lit("月份 "), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", asked.alias("t"))


@query(_QUESTION_SQL)
def question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("item_id", joined(F.array_sort(text.question_tokens(F.col("t")))).alias("tokens"))


@query(
    f"""
WITH q AS (SELECT {first_seen_sql(words_sql('text'))}[1:32] AS k FROM benchmark WHERE item_id = 0)
SELECT doc_id, CAST(coalesce(list_sum(list_transform(list_filter(['知识', '检索'], lambda w: contains(t, w)), lambda w: length(w))), 0)
    + coalesce(list_sum(list_transform(list_filter(k, lambda w: contains(lower(t), w)), lambda w: length(w))), 0) AS INTEGER) AS score
FROM {MIXED_SQL}, q
"""
)
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").where("item_id = 0").select(text.query_terms(F.col("text"))[1].alias("k"))
    cjk = F.array(F.lit("知识"), F.lit("检索"))
    return mixed(spark, sf_dir).crossJoin(F.broadcast(asked)).select("doc_id", text.keyword_score(F.col("t"), cjk, F.col("k")).alias("score"))


_GARBLED_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('��ÿÀ知', text) ELSE text END AS t FROM documents),
s AS (SELECT doc_id, t, 2 * len(regexp_extract_all(t, '\\x{FFFD}')) + len(regexp_extract_all(t, '[\\x{C0}-\\x{FF}]')) AS g, len(regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}]')) AS c FROM d)
SELECT doc_id, CAST(g AS INTEGER) AS garbled, CAST(c AS INTEGER) AS cjk, length(t) > 0 AND g >= 20 AND (c = 0 OR g > 2 * c) AS looks_garbled FROM s
"""


@query(_GARBLED_SQL)
def garbled_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("��ÿÀ知"), F.col("text"))).otherwise(F.col("text"))
    marked = docs.select("doc_id", t.alias("t"))
    return marked.select("doc_id", text.garbled_score(F.col("t")).alias("garbled"), text.cjk_count(F.col("t")).alias("cjk"), text.looks_garbled(F.col("t")).alias("looks_garbled"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(concat(' \t　', text, chr(13), chr(10), 'x', chr(13), '  '), '\\r\\n?', '\n', 'g'), '^[\\s\\x{3000}\\x{2003}]+|[\\s\\x{3000}\\x{2003}]+$', '', 'g')) AS clean FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit(" \t　"), F.col("text"), F.lit("\r\nx\r  "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(dirty).cast("binary")).alias("clean"))


_DATES_SQL = r"""
WITH e AS (
    SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(event_id % 8 AS INTEGER) AS k FROM events
), t AS (
    SELECT event_id, CASE k
        WHEN 0 THEN printf('on %04d-%d-%d ok', y, m, d) WHEN 1 THEN printf('in %04d/%02d ok', y, m) WHEN 2 THEN printf('于%04d年%d月%d日', y, m, d)
        WHEN 3 THEN printf('%04d年%d月', y, m) WHEN 4 THEN printf('x %02d/%02d/%02d y', y % 100, m, d) WHEN 5 THEN printf('id %04d%02d%02d z', y, m, d)
        WHEN 6 THEN printf('per %04d%02d.', y, m) ELSE printf('serial %d end', date_diff('day', DATE '1899-12-30', make_date(y, m, d))) END AS text,
        CASE WHEN k IN (0, 2, 4, 5, 7) THEN printf('[DATE=%04d-%02d] [DATE=%04d-%02d-%02d]', y, m, y, m, d) ELSE printf('[DATE=%04d-%02d]', y, m) END AS tokens
    FROM e)
SELECT event_id, concat(text, ' ', tokens) AS dated FROM t
"""


@query(_DATES_SQL)
def date_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, m, d, k = F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.col("event_id") % 8
    serial = F.date_diff(F.col("ts").cast("date"), F.lit("1899-12-30").cast("date"))
    written = (
        F.when(k == 0, F.format_string("on %04d-%d-%d ok", y, m, d))
        .when(k == 1, F.format_string("in %04d/%02d ok", y, m))
        .when(k == 2, F.format_string("于%04d年%d月%d日", y, m, d))
        .when(k == 3, F.format_string("%04d年%d月", y, m))
        .when(k == 4, F.format_string("x %02d/%02d/%02d y", y % 100, m, d))
        .when(k == 5, F.format_string("id %04d%02d%02d z", y, m, d))
        .when(k == 6, F.format_string("per %04d%02d.", y, m))
        .otherwise(F.format_string("serial %d end", serial))
    )
    return table(spark, sf_dir, "events").select("event_id", dates.append_date_tokens(written).alias("dated"))


#: Text with headings of all kinds, made from each document's number and its text.
_LINES = ["intro {0}", "", "  第{0}章 总则", "{1}", "附件3 {0}", "CHAPTER {0}", "body", "{0}.2.1 Title {0}", "{0}.2no title", "", "Sections are many"]
_LINED_SQL = "concat_ws(chr(10), " + ", ".join("concat('" + line.replace("{0}", "', doc_id, '").replace("{1}", "', text, '") + "')" for line in _LINES) + ")"
_HEADING_SQL = r"(l <> '' AND length(l) <= 120 AND (regexp_matches(l, '^第[一二三四五六七八九十百千0-9]+[章节条款].*$') OR regexp_matches(l, '^附件[一二三四五六七八九十0-9]+.*$') OR regexp_matches(l, '(?i)^(chapter|section|article|appendix)\b.*$') OR regexp_matches(l, '^\d+(?:\.\d+){0,3}\s+\S+.*$')))"


def lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("doc_id").cast("string")

    def line(pattern: str) -> Column:
        parts: list[Column] = []
        for i, piece in enumerate(pattern.replace("{1}", "\0{1}\0").replace("{0}", "\0{0}\0").split("\0")):
            parts.append({"{0}": at, "{1}": F.col("text")}.get(piece, F.lit(piece)))
        return F.concat(*parts)

    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", *[line(x) for x in _LINES]).alias("t"))


_LINES_CTE = f"""
WITH d AS (SELECT doc_id, {_LINED_SQL} AS t FROM documents),
x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
s AS (SELECT doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS l FROM x),
h AS (SELECT *, {_HEADING_SQL} AS heading, min(CASE WHEN l <> '' THEN pos END) OVER (PARTITION BY doc_id) AS first FROM s)
"""


@query(_LINES_CTE + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, heading FROM h")
def heading_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(lined(spark, sf_dir))


def flagged(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split("t", "\n")).alias("pos", "l"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("pos"), pages.is_heading(text.strip(F.col("l"))).alias("heading"))


_SECTIONS_CTE = (
    _LINES_CTE
    + """
, n AS (SELECT *, sum(CASE WHEN heading AND pos > first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM h WHERE pos >= first),
sections AS (SELECT doc_id, nth, regexp_replace(string_agg(l, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS section FROM n GROUP BY doc_id, nth)
"""
)


@query(_SECTIONS_CTE + "SELECT doc_id, CAST(nth AS INTEGER) AS nth, section FROM sections WHERE section <> ''")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lined(spark, sf_dir).select("doc_id", F.posexplode_outer(pages.split_sections(F.col("t"))).alias("nth", "section")).where("section IS NOT NULL")


@query("SELECT doc_id, CAST(i AS INTEGER) AS nth, CAST(length(substring(text, CAST(i * 700 + 1 AS BIGINT), 800)) AS INTEGER) AS chars, md5(substring(text, CAST(i * 700 + 1 AS BIGINT), 800)) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 700.0) AS BIGINT))) AS i FROM documents)")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(pages.split_windows(F.col("text"), 800, 100)).alias("nth", "piece")).where("piece IS NOT NULL")
    return cut.select("doc_id", "nth", F.length("piece").alias("chars"), F.md5(F.col("piece").cast("binary")).alias("piece"))


_PAGED_SQL = "concat('lost === Page 1 ===', chr(10), chr(10), text, chr(10), '=== Page 7 ===', chr(10), doc_id, chr(10), '=== Page 8 === ')"


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("lost === Page 1 ===\n\n"), F.col("text"), F.lit("\n=== Page 7 ===\n"), F.col("doc_id").cast("string"), F.lit("\n=== Page 8 === "))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))


_PAGES_SQL = f"""
WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace({_PAGED_SQL}, '\\s+$', ''), '=== Page '), lambda b: trim(b, ' ' || chr(10) || chr(9)) <> '') AS b FROM documents),
x AS (SELECT doc_id, unnest(b) AS b, generate_subscripts(b, 1) AS page FROM p)
SELECT doc_id, CAST(page AS INTEGER) AS page, s AS text FROM (SELECT doc_id, page, CASE WHEN contains(b, '===') THEN regexp_replace(substring(b, instr(b, '===') + 3), '^\\s+|\\s+$', '', 'g') ELSE '' END AS s FROM x) WHERE s <> ''
"""


@query(_PAGES_SQL)
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.chunking import pages_to_documents

    return pages_to_documents(paged(spark, sf_dir), "text", marked=True).select("doc_id", "page", "text")


_JOIN_SQL = "SELECT doc_id, concat('=== Page 1 ===', chr(10), chr(10), regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), chr(10), '=== Page 2 ===', chr(10), chr(10), doc_id) AS pages, concat('=== Page 1 ===', chr(10), chr(10), doc_id) AS marked FROM documents"


@query(_JOIN_SQL)
def page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", pages.join_pages(F.array(F.col("text"), at)).alias("pages"), pages.ensure_marks(at).alias("marked"))


@query(
    """
WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat(' My Docs-v', doc_id, ' 知识! ') WHEN 1 THEN source WHEN 2 THEN '--!' ELSE concat('Été ', source) END AS v FROM documents)
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(v)), '[^\\p{L}\\p{N}]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'kb') AS kb_id FROM n
"""
)
def sanitize_kb_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    v = F.when(k == 0, F.concat(F.lit(" My Docs-v"), at, F.lit(" 知识! "))).when(k == 1, F.col("source")).when(k == 2, F.lit("--!")).otherwise(F.concat(F.lit("Été "), F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize_kb_id(v).alias("kb_id"))


@query(
    """
WITH d AS (SELECT doc_id, concat('/kb/', source, '/doc_', doc_id, '.txt') AS s, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 END AS page, doc_id % 2 AS c, text FROM documents)
SELECT doc_id, concat('doc_', doc_id, '.txt', coalesce('#p' || page, '')) AS label,
    CASE WHEN doc_id % 7 = 0 THEN concat('content:', sha256(text)) ELSE concat_ws('|', CAST(doc_id AS VARCHAR), s, coalesce(CAST(nullif(page, 0) AS VARCHAR), ''), coalesce(CAST(nullif(c, 0) AS VARCHAR), ''), '') END AS signature
FROM d
"""
)
def doc_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    source, page, c = source_path(), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2), F.col("doc_id") % 2
    bare = F.col("doc_id") % 7 == 0
    none = F.lit(None)
    sig = F.when(bare, text.signature(none, none, none.cast("int"), none.cast("int"), none, F.col("text"))).otherwise(text.signature(F.col("doc_id"), source, page, c, none, F.col("text")))
    return docs.select("doc_id", text.format_source(source, page).alias("label"), sig.alias("signature"))


def source_path() -> Column:
    return F.concat(F.lit("/kb/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


@query(
    """
WITH f AS (SELECT doc_id, concat('Doc_', doc_id, '.TXT') AS a, concat('doc_', doc_id, '.txt') AS b, source FROM documents)
SELECT doc_id, concat(a, '#', '/KB/', source, '/', b, '#x｜y') AS filters, true AS by_name, true AS by_path, false AS by_other FROM f
"""
)
def match_file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, path = F.col("doc_id").cast("string"), source_path()
    raw = F.concat(F.lit(" Doc_"), at, F.lit(".TXT ,doc_"), at, F.lit(".txt；/KB/"), F.col("source"), F.lit("/doc_"), at, F.lit(".txt\n\n;x｜y|"))
    parsed = text.parse_file_filters(raw)
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), parsed.alias("f"))
    other = F.array(F.lit("other.txt"), F.lit("kb"), F.lit(""))
    return docs.select("doc_id", F.array_join("f", "#").alias("filters"), text.matches_filter(F.col("path"), F.slice("f", 1, 1)).alias("by_name"), text.matches_filter(F.col("path"), F.slice("f", 2, 1)).alias("by_path"), text.matches_filter(F.col("path"), other).alias("by_other"))


@query(
    """
WITH f AS (SELECT doc_id, lower(concat('Report_', source, '.pdf')) AS name, lower(concat('report_', source)) AS base, 'see report_src1.pdf and src2 report' AS q FROM documents)
SELECT doc_id, CAST((CASE WHEN contains(q, name) THEN 30 ELSE 0 END) + (CASE WHEN contains(q, base) THEN 20 ELSE 0 END)
    + list_sum(list_transform(['report', 'src1', 'pdf', 'and', 'see', 'src2'], lambda t: CASE WHEN contains(base, t) THEN 3 WHEN contains(name, t) THEN 1 ELSE 0 END)) AS INTEGER) AS score FROM f
"""
)
def file_name_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.lit("see report_src1.pdf and src2 report")
    name = F.concat(F.lit("Report_"), F.col("source"), F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select("doc_id", text.score_file_name(asked, name, text.question_tokens(asked)).alias("score"))
