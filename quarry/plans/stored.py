"""Queries of what is written and read back: versioned tables, the stored index, full texts and index manifests."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import bm25, ivf, manifest, retrieve, segments, store
from quarry.operators.embeddings import EmbeddingCache
from quarry.plans.registry import query, table
from quarry.plans.search import COSINE, FUSED, NEAR_BATCH_SQL, asked, chunks, scored_sql, with_vectors
from quarry.runtime import materialise, shared_root
from quarry.sources import files


def _drop(held: store.Table) -> None:
    with suppress(Exception):  # the session may have ended before the program
        held.drop()


def written(spark: SparkSession, name: str, schema: str = "") -> store.Table:
    """A new table in the folder that driver and executors share, deleted when the program ends."""
    held = store.Table(spark, f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}", schema)
    atexit.register(_drop, held)
    return held


@query("SELECT doc_id, n_chars + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents UNION ALL SELECT doc_id, 0 AS n_chars FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT -doc_id AS doc_id, n_chars FROM documents WHERE doc_id % 2 = 1")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under two keys: the rows of one are replaced, those of the other added to; all of them, and one key alone, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    held = written(spark, "versions", "doc_id bigint, n_chars bigint")
    held.write(even, "even")
    held.write(odd, "odd")
    before = held.read("odd").withColumn("doc_id", -F.col("doc_id"))
    held.write(even.withColumn("n_chars", F.col("n_chars") + 1), "even")
    held.append(odd.withColumn("n_chars", F.lit(0)), "odd")
    return held.read().unionByName(before)


@query(scored_sql("source", "true") + ", z AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, chunk_key) AS rank FROM r) SELECT query_id, kb_id, chunk_key, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM z WHERE rank <= 5")
def stored_index_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions against an index that was written and read back, the best five of each knowledge base."""
    held = written(spark, "bm25")
    held.publish(bm25.build(chunks(spark, sf_dir, None)).write, "all")
    found = bm25.search(bm25.Index.read(spark, held.folders("all")), asked(spark, sf_dir), 5, per_kb=True)
    return found.select("query_id", "kb_id", "chunk_key", "rank", F.round("score", 6).alias("score"))


@query(
    """
WITH o AS (SELECT o_custkey, o_orderkey, concat(o_orderkey, chr(9), o_orderpriority) AS line, o_orderstatus AS sheet, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
p AS (SELECT o_custkey, o_orderkey, CASE WHEN before IS DISTINCT FROM sheet THEN concat('[Sheet: ', sheet, ']', chr(10), line) ELSE line END AS part FROM o)
SELECT concat('/kb/cust_', o_custkey, '.xlsx') AS abs_path, sha256(string_agg(part, chr(10) ORDER BY o_orderkey)) AS text_sha256 FROM p GROUP BY o_custkey
UNION ALL
SELECT concat('/kb/supplier_', s_nationkey, '.pdf') AS abs_path, sha256(string_agg(concat('=== Page ', s_suppkey, ' ===', chr(10), chr(10), s_name), concat(chr(10), chr(10)) ORDER BY s_suppkey)) AS text_sha256 FROM supplier GROUP BY s_nationkey
"""
)
def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the rows of a workbook for each customer, and suppliers as the pages of a PDF file for each nation, joined to the text of each file."""
    none = lambda kind: F.lit(None).cast(kind)
    orders, suppliers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    rows = orders.select(
        F.concat(F.lit("/kb/cust_"), F.col("o_custkey").cast("string"), F.lit(".xlsx")).alias("abs_path"), F.col("o_orderkey").alias("doc_pos"), F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("text"),
        none("int").alias("page"), F.col("o_orderstatus").alias("sheet"), none("string").alias("error"),
    )
    pages = suppliers.select(
        F.concat(F.lit("/kb/supplier_"), F.col("s_nationkey").cast("string"), F.lit(".pdf")).alias("abs_path"), F.col("s_suppkey").alias("doc_pos"), F.col("s_name").alias("text"),
        F.col("s_suppkey").cast("int").alias("page"), none("string").alias("sheet"), none("string").alias("error"),
    )
    return files.full_texts(rows.unionByName(pages)).select("abs_path", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT sha256(string_agg(concat(source, '/doc_', doc_id, ':', n_chars, ':', strlen(text)), chr(10) ORDER BY concat(source, '/doc_', doc_id))) AS fingerprint, 'm' AS embedding_model, 800 AS chunk_size, 100 AS chunk_overlap FROM documents")
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"))
    held = table(spark, sf_dir, "documents").select(rel.alias("rel"), F.col("n_chars").alias("mtime"), F.octet_length("text").alias("size"))
    return manifest.index_manifest(held, "m", 800, 100)


@query(
    "SELECT source AS kb_id, CASE WHEN doc_id % 2 = 0 THEN 'm' ELSE '' END AS embedding_model, CAST(CASE WHEN doc_id % 3 = 0 THEN 800 ELSE 0 END AS INTEGER) AS chunk_size, 0 AS chunk_overlap, doc_id AS doc_count, CAST(0 AS BIGINT) AS chunk_count, '' AS updated_at FROM documents"
)
def coerce_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index manifests as loose JSON, one for each document, with fields that are missing or do not fit."""
    at = F.col("doc_id")
    fields = [F.col("source").alias("kb_id"), F.when(at % 2 == 0, "m").alias("embedding_model"), F.when(at % 3 == 0, "800").when(at % 3 == 1, "bad").alias("chunk_size"), at.cast("string").alias("doc_count")]
    loose = table(spark, sf_dir, "documents").select(F.to_json(F.struct(*fields)).alias("json"))
    names = ("kb_id", "embedding_model", "chunk_size", "chunk_overlap", "doc_count", "chunk_count", "updated_at")
    return manifest.coerced_manifests(loose.select(F.from_json("json", ", ".join(f"{n} string" for n in names)).alias("m")).select("m.*"))


def inverted_file(spark: SparkSession, sf_dir: str) -> ivf.Index:
    """All vectors in an inverted file, written and read back."""
    held = written(spark, "ivf")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    held.publish(lambda folder: ivf.build(rows, folder, "vec_id"), "all")
    return ivf.Index.read(spark, held.folders("all")[0])


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query()
def ivf_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector against the lists nearest to it; tests hold it against all rows (recall)."""
    return ivf.search(inverted_file(spark, sf_dir), _asked_vectors(spark, sf_dir), 10)


@query(NEAR_BATCH_SQL)
def ivf_topk_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all lists: the exact result, through the inverted file."""
    found = ivf.search(inverted_file(spark, sf_dir), _asked_vectors(spark, sf_dir), 10, probes=0)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


INDEXED = "kb_id string, doc_id bigint, chunk_key bigint, text string"


def indexed(spark: SparkSession, rows: DataFrame, name: str = "all") -> segments.Indexed:
    """A chunk table with its index that holds the rows (kb_id, chunk_key, text) as one change."""
    held = segments.Indexed(written(spark, "indexed", INDEXED), ("doc_id",))
    held.change(rows.withColumn("doc_id", F.col("chunk_key")), rows.select(F.col("chunk_key").alias("doc_id")).limit(0), name)
    return held


_RANKED = ", z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM r) SELECT query_id, chunk_key, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM z WHERE rank <= 10"


def _ten(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_key", "rank", F.round("score", 6).alias("score"))


@query(scored_sql("'all'", "true") + _RANKED)
def blockmax_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions against stored blocks of postings, each block read once for all of them."""
    return _ten(segments.search(indexed(spark, chunks(spark, sf_dir)).index("all"), asked(spark, sf_dir), 10))


@query((scored_sql("'all'", "true") + _RANKED).replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 7 <> 0)"))
def segmented_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions after three changes of an index: two thirds of the documents, a fifth of them with another text; the rest, and the right texts; a seventh is removed.

    Scores are those of an index that is built anew.
    """
    rows = chunks(spark, sf_dir).withColumn("doc_id", F.col("chunk_key"))
    at = F.col("doc_id")
    held = segments.Indexed(written(spark, "indexed", INDEXED), ("doc_id",))
    wrong = F.when(at % 5 == 0, F.concat(F.lit("entirely other words "), F.substring("text", 1, 200))).otherwise(F.col("text"))
    held.change(rows.where(at % 3 != 0).withColumn("text", wrong), rows.select("doc_id").limit(0), "all")
    held.change(rows.where((at % 3 == 0) | (at % 5 == 0)), rows.where(at % 5 == 0).select("doc_id"), "all")
    held.change(rows.limit(0), rows.where(at % 7 == 0).select("doc_id"), "all")
    return _ten(segments.search(held.index("all"), asked(spark, sf_dir), 10))


#: A question's vector is that of its number.
_HYBRID = (
    scored_sql("'all'", "true")
    + f""",
v AS (SELECT q.vec_id AS query_id, e.vec_id AS k, {COSINE.format("e.embedding", "q.embedding")} AS score FROM embeddings e JOIN documents ON e.vec_id = doc_id, embeddings q JOIN benchmark ON q.vec_id = item_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, k) <= 24),
b AS (SELECT query_id, chunk_key AS k, score FROM r WHERE query_id IN (SELECT vec_id FROM embeddings) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k) <= 24),
m AS (SELECT query_id, k, v.score AS d, b.score AS s FROM v FULL JOIN b USING (query_id, k)),
f AS ({FUSED.format(by="query_id, d, s,", w="PARTITION BY query_id")}), g AS (SELECT *, CASE WHEN count(s) OVER (PARTITION BY query_id) > 0 THEN f ELSE d END AS best FROM f)
SELECT query_id, k AS chunk_key, round(d, 6) AS dense_score, round(s, 6) AS sparse_score, round(best, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best DESC, k) AS INTEGER) AS rank FROM g QUALIFY rank <= 10
"""
)


def _hybrid(spark: SparkSession, sf_dir: str, lists: bool = False) -> DataFrame:
    rows = materialise(with_vectors(spark, sf_dir, "all").where(F.col("embedding").isNotNull()), "vectors")
    questions = asked(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    vectors = None
    if lists:
        held = written(spark, "ivf")
        held.publish(lambda folder: ivf.build(rows.select("chunk_key", "embedding"), folder))
        vectors = replace(ivf.Index.read(spark, held.folders()[0]), probes=0)
    found = retrieve.hybrid_batch(rows, questions, indexed(spark, chunks(spark, sf_dir)).index("all"), vectors=vectors)
    return found.select("query_id", "chunk_key", *[F.round(c, 6).alias(c) for c in ("dense_score", "sparse_score", "score")], "rank")


@query(_HYBRID)
def hybrid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for all questions as one table, over stored postings and all vectors."""
    return _hybrid(spark, sf_dir)


@query(_HYBRID)
def hybrid_batch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the dense side from an inverted file, all of its lists."""
    return _hybrid(spark, sf_dir, lists=True)


class Measured:
    """A provider whose vectors SQL can tell: characters, blanks, and one."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


class Refusing:
    """A provider that must not be asked."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        raise RuntimeError(f"asked for {len(texts)} texts")


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS FLOAT) AS n_chars, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS FLOAT) AS n_blanks, (SELECT count(DISTINCT coalesce(text, '')) FROM documents) AS texts_sent FROM documents")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents embedded, then again under other names by a provider that fails if it is called; `texts_sent` is how many texts the first one was given."""
    cache = EmbeddingCache(written(spark, "vectors", EmbeddingCache.SCHEMA), "measured", "m")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache.embed(rows, Measured())
    again = cache.embed(rows.select(F.col("doc_id"), F.concat(F.lit("renamed_"), F.col("doc_id").cast("string")).alias("name"), "text"), Refusing())
    sent = cache.held.read().count()
    return again.select("doc_id", F.col("embedding")[0].alias("n_chars"), F.col("embedding")[1].alias("n_blanks"), F.lit(sent).cast("bigint").alias("texts_sent"))
