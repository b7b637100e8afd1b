"""Queries of chunking, row documents and inspection."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, inspect, store
from quarry.plans.registry import query, table
from quarry.plans.texts import _SECTIONS_CTE, lined, source_path
from quarry.sources import office


_CHUNK_IDS = """
, w AS (SELECT doc_id, nth, unnest(range(0, CAST(ceil(length(section) / 50.0) AS BIGINT))) AS i, section FROM sections WHERE section <> ''),
p AS (SELECT doc_id, nth, i, regexp_replace(substring(section, CAST(i * 50 + 1 AS BIGINT), 60), '^\\s+|\\s+$', '', 'g') AS text FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth, i) - 1 AS INTEGER) AS chunk_id, text FROM p WHERE text <> ''
"""


@query(_SECTIONS_CTE + _CHUNK_IDS)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lined_chunks(lined(spark, sf_dir))


def lined_chunks(made: DataFrame) -> DataFrame:
    none = F.lit(None)
    docs = made.select("doc_id", F.lit(0).alias("doc_pos"), F.col("t").alias("text"), F.lit("txt").alias("source_type"), none.cast("string").alias("sheet"), none.cast("int").alias("row"))
    return chunking.chunk(docs, 60, 10).select("doc_id", "chunk_id", "text")


def order_chunks(orders: DataFrame) -> DataFrame:
    text = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    docs = orders.select(F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"), F.lit(".xlsx")).alias("doc_id"), F.col("o_orderkey").alias("doc_pos"), text.alias("text"), F.lit("xlsx").alias("source_type"), F.lit("s").alias("sheet"), F.col("o_orderkey").cast("int").alias("row"))
    return chunking.chunk(docs).select("doc_id", "chunk_id", "text")


@query(
    """
WITH r AS (SELECT o_orderkey AS o, o_custkey, concat(o_orderkey, chr(9), o_orderpriority, chr(9), strftime(o_orderdate, '%Y-%m-%d')) AS t, CASE WHEN year(o_orderdate) >= 2000 THEN o_orderdate END AS d,
    CASE WHEN o_orderkey BETWEEN 30000 AND 60000 THEN DATE '1899-12-30' + CAST(o_orderkey AS INTEGER) END AS s, CASE WHEN o_orderkey BETWEEN 200001 AND 209912 AND o_orderkey % 100 BETWEEN 1 AND 12 THEN printf('%d-%02d', o_orderkey // 100, o_orderkey % 100) END AS m FROM orders),
k AS (SELECT *, list_sort(list_distinct([strftime(d, '%Y-%m'), strftime(d, '%Y-%m-%d'), strftime(s, '%Y-%m'), strftime(s, '%Y-%m-%d'), m])) AS dates FROM r),
z AS (SELECT *, CASE WHEN len(dates) > 0 THEN concat(t, ' ', array_to_string(list_transform(dates, lambda x: concat('[DATE=', x, ']')), ' ')) ELSE t END AS text FROM k)
SELECT concat('cust_', o_custkey, '.xlsx') AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o) - 1 AS INTEGER) AS chunk_id, text FROM z
"""
)
def chunk_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as spreadsheet rows. Dates before 2000 get no token; order numbers that read as serial days or months get theirs."""
    return order_chunks(table(spark, sf_dir, "orders"))


@query(
    """
WITH c AS (SELECT s_nationkey, s_suppkey, concat(s_suppkey, chr(9), s_name) AS line, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first, lag(s_nationkey) OVER (ORDER BY s_nationkey, s_suppkey) AS before FROM supplier)
SELECT CAST(s_nationkey AS INTEGER) AS sheet, s_suppkey AS row, s_suppkey = first AS is_header, CASE WHEN before IS DISTINCT FROM s_nationkey THEN concat('[Sheet: ', s_nationkey, ']', chr(10), line) ELSE line END AS text FROM c
"""
)
def excel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a workbook with one sheet for each nation, through the reader's own shaping: the first row of a sheet is its header, and a sheet is announced where it begins."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("sheet"), F.col("s_suppkey").cast("long").alias("row"), F.array(F.col("s_suppkey").cast("string"), "s_name").alias("cells"))

    def shape(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        name = str(key[0].as_py())
        ordered = found.sort_by("row")
        shaped = list(office.shaped_rows(name, zip(ordered.column("row").to_pylist(), ordered.column("cells").to_pylist(), strict=True)))
        texts = office.rows_to_text(shaped).split("\n")
        lines = ["\n".join(texts[:2]), *texts[2:]]
        return pa.table({"sheet": pa.array([int(name)] * len(shaped), pa.int32()), "row": pa.array([r["row"] for r in shaped], pa.int64()), "is_header": [r["is_header"] for r in shaped], "text": lines})

    return rows.groupBy("sheet").applyInArrow(shape, "sheet int, row bigint, is_header boolean, text string")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("kb_id"), F.lit("/kb").alias("root"), F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 3).cast("int").alias("chunk_id"), source_path().alias("source"), F.lit("txt").alias("source_type"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 9).cast("int")).alias("page"), "text")
    return store.keyed(rows)


_CHUNKS = "t AS (SELECT source AS kb_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id % 3 AS INTEGER) AS chunk_id, concat('/kb/', source, '/doc_', doc_id, '.txt') AS source, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 9 AS INTEGER) END AS page, text, sha256(concat_ws('|', source, '/kb', doc_id, doc_id % 3)) AS chunk_key FROM documents)"


@query("SELECT count(*) AS chunks, CAST(min(length(text)) AS INTEGER) AS least, CAST(max(length(text)) AS INTEGER) AS most, round(avg(length(text)), 6) AS mean FROM documents")
def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.size_stats(chunk_table(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("SELECT count(*) AS n FROM documents")
def count_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.count(chunk_table(spark, sf_dir))


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id FROM documents")
def distinct_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.doc_ids(chunk_table(spark, sf_dir))


@query(f"WITH {_CHUNKS} SELECT chunk_key, doc_id, chunk_id FROM t WHERE doc_id LIKE '%12%' AND chunk_id = 1")
def filter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_table(spark, sf_dir)
    return rows.where(inspect.matches_doc(F.col("doc_id"), "12", contains=True) & inspect.matches_chunk(F.col("chunk_id"), 1)).select("chunk_key", "doc_id", "chunk_id")


@query(f"WITH {_CHUNKS} SELECT chunk_key, kb_id, doc_id FROM t WHERE kb_id = 'src3' AND doc_id = '3'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(spark, sf_dir).where(store.is_doc("src3", "3")).select("chunk_key", "kb_id", "doc_id")


@query(
    f"""
WITH {_CHUNKS}
SELECT concat(regexp_extract(source, '[^/]+$'), coalesce('#p' || page, '')) AS label, concat_ws(' ', concat('kb_id=', kb_id), concat('doc_id=', doc_id), concat('chunk_id=', chunk_id), 'source_type=txt', CASE WHEN page IS NOT NULL THEN concat('page=', page) END) AS meta,
    CASE WHEN length(text) > 80 THEN concat(substring(text, 1, 80), '...') ELSE text END AS text FROM t
"""
)
def inspect_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.show(chunk_table(spark, sf_dir), limit=None, width=80)


@query(
    """
WITH e AS (SELECT unnest(json_keys(props)) AS key, props FROM events),
v AS (SELECT key, json_type(json_extract(props, concat('$."', key, '"'))) AS t FROM e)
SELECT key, array_to_string(list_sort(list(DISTINCT CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN t = 'DOUBLE' THEN 'float' WHEN t = 'BOOLEAN' THEN 'bool' WHEN t = 'ARRAY' THEN 'list' WHEN t = 'OBJECT' THEN 'dict' WHEN t = 'NULL' THEN 'null' ELSE 'str' END)), ',') AS types FROM v GROUP BY key
"""
)
def metadata_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.json_types(table(spark, sf_dir, "events"), "props")


#: Events with nested values, of types that differ from event to event; texts that look like numbers and words of JSON.
_NESTED_SQL = """concat('{"id":', event_id, ',"text":"', event_id, '","flag":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '"true"' END, ',"n":{"x":', event_id % 7, CASE event_id % 3 WHEN 0 THEN '.5' WHEN 1 THEN 'e2' ELSE '' END, ',"y":{"z":[1,"[x",{"w":null}]}},"p":', props, '}')"""


@query(
    f"""
WITH v AS (SELECT regexp_replace(substr(t.fullkey, 3), '\\[\\d+\\]', '[]', 'g') AS key, t.type AS t FROM (SELECT {_NESTED_SQL} AS j FROM events) e, json_tree(e.j) t WHERE t.fullkey <> '$')
SELECT key, array_to_string(list_sort(list(DISTINCT CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN t = 'DOUBLE' THEN 'float' WHEN t = 'BOOLEAN' THEN 'bool' WHEN t = 'ARRAY' THEN 'list' WHEN t = 'OBJECT' THEN 'dict' WHEN t = 'NULL' THEN 'null' ELSE 'str' END)), ',') AS types FROM v GROUP BY key
"""
)
def metadata_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id")
    text, lit = at.cast("string"), F.lit
    flag = F.when(at % 2 == 0, "true").otherwise('"true"')
    more = F.when(at % 3 == 0, ".5").when(at % 3 == 1, "e2").otherwise("")
    j = F.concat(lit('{"id":'), text, lit(',"text":"'), text, lit('","flag":'), flag, lit(',"n":{"x":'), (at % 7).cast("string"), more, lit(',"y":{"z":[1,"[x",{"w":null}]}},"p":'), F.col("props"), lit("}"))
    return inspect.json_types(table(spark, sf_dir, "events").select(j.alias("j")), "j", nested=True)


@query("SELECT 'embedding' AS name, CAST(min(len(embedding)) AS INTEGER) AS least, CAST(max(len(embedding)) AS INTEGER) AS most, 'cosine' AS distance FROM embeddings")
def vector_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.vector_config(table(spark, sf_dir, "embeddings"))


@query(f"WITH {_CHUNKS} SELECT doc_id, source, page, chunk_id, coalesce(text, '') AS content FROM t")
def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.all_documents(chunk_table(spark, sf_dir)).select("doc_id", "source", "page", "chunk_id", F.col("text").alias("content"))
