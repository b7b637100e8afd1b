"""Hybrid retrieval: dense and sparse candidates, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators import bm25, dense, fusion, ivf, segments
from quarry.settings import Settings


def hybrid(chunks: DataFrame, question: str, vector: list[float], kb_id: str | None = None, settings: Settings | None = None, top_k: int | None = None, key: str = "chunk_key", index: segments.Segments | None = None, vectors: ivf.Index | None = None) -> DataFrame:
    """The top k chunks for one question: (key, dense_score, sparse_score, score, rank).

    chunks: kb_id, key, text, embedding (null: none). Both sides fetch max(k, bm25_fetch_k) rows. With BM25 off, or without a sparse hit,
    the dense order stands. With a stored index, the sparse side reads postings and no texts; with an inverted file of the same chunks, the dense side reads the lists near the question.
    """
    mine = chunks if kb_id is None else chunks.where(F.col("kb_id") == kb_id)
    return _hybrid(mine, question, vector, settings or Settings(), top_k, key, index, (), vectors)


def hybrid_each(chunks: DataFrame, question: str, vector: list[float], kb_ids: list[str], settings: Settings | None = None, top_k: int | None = None, key: str = "chunk_key", index: segments.Segments | None = None) -> DataFrame:
    """The top k chunks of each of several knowledge bases, with kb_id: as hybrid for each, in one pass over the tables."""
    return _hybrid(chunks.where(F.col("kb_id").isin(kb_ids)), question, vector, settings or Settings(), top_k, key, index, ("kb_id",))


def _hybrid(mine: DataFrame, question: str, vector: list[float], settings: Settings, top_k: int | None, key: str, index: segments.Segments | None, by: tuple[str, ...], vectors: ivf.Index | None = None) -> DataFrame:
    question = question.strip()
    k = top_k or settings.search.results
    if not question:
        mine = mine.limit(0)
    fetch = max(k, settings.search.candidates)
    if vectors and question:
        near = ivf.search_one(mine.sparkSession, vectors, vector, fetch).select(key, "score")
    else:
        near = dense.search_one(mine.where(F.col("embedding").isNotNull()), vector, fetch, key, by=by).select(*by, key, "score")
    if not settings.search.words:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), key)
        plain = near.select(*by, key, F.col("score").alias("dense_score"), F.lit(None).cast("double").alias("sparse_score"), "score")
        return plain.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if index is None or not question:
        words = bm25.search_one(mine, question, fetch, key, settings.search.k1, settings.search.b, settings.search.document_terms, settings.search.question_terms, bool(by))
    else:
        asked = mine.sparkSession.createDataFrame([(0, question)], "query_id int, text string")
        words = segments.search(index, asked, fetch, bool(by), settings.search.question_terms)
    merged = fusion.merge(near, words.select(*by, F.col("chunk_key").alias(key), "score"), [*by, key])
    return fuse_or_dense(merged, key, k, settings.search.dense_share, by)


def hybrid_batch(chunks: DataFrame, questions: DataFrame, index: segments.Segments, settings: Settings | None = None, top_k: int | None = None, vectors: ivf.Index | None = None, key: str = "chunk_key") -> DataFrame:
    """(query_id, key, dense_score, sparse_score, score, rank): as hybrid, for a table of questions (query_id, text, embedding) over one knowledge base.

    The sparse side reads blocks of stored postings, the dense side all vectors or, with an inverted file, the lists near each question. Blank questions find nothing.
    """
    s = settings or Settings()
    k = top_k or s.search.results
    fetch = max(k, s.search.candidates)
    asked = questions.where(F.length(strip(F.col("text"))) > 0)
    near = ivf.search(vectors, asked, fetch) if vectors else dense.search(chunks.select(key, "embedding"), asked, fetch, key)
    near = near.select("query_id", key, "score")
    if not s.search.words:
        words = near.limit(0)
    else:
        words = segments.search(index, asked, fetch, most=s.search.question_terms).select("query_id", F.col("chunk_key").alias(key), "score")
    return fuse_or_dense(fusion.merge(near, words, ["query_id", key]), key, k, s.search.dense_share, ("query_id",))


def fuse_or_dense(merged: DataFrame, key: str, k: int, alpha: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Fused scores, or dense ones where the sparse side is empty."""
    within = Window.partitionBy(*by)
    mixed = alpha * fusion.min_max(F.col("dense_score"), within) + (1 - alpha) * fusion.min_max(F.col("sparse_score"), within)
    final = F.when(F.count("sparse_score").over(within) > 0, mixed).otherwise(F.col("dense_score"))
    ranked = merged.withColumn("score", final).withColumn("rank", F.row_number().over(within.orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k) if k > 0 else ranked


def share(k: int, n: int) -> int:
    """Rows that each of n knowledge bases gives to k."""
    return max(1, -(-k // n)) if n else 0


def across(found: DataFrame, kb_ids: list[str], k: int) -> DataFrame:
    """found (kb_id, rank, ...) of several knowledge bases: so many of each, in their order, cut to k; no global rerank."""
    order = F.array_position(F.array(*[F.lit(x) for x in kb_ids]) if kb_ids else F.array().cast("array<string>"), F.col("kb_id"))
    kept = found.where(F.col("kb_id").isin(kb_ids) & (F.col("rank") <= share(k, len(kb_ids)))).withColumn("kb_order", order)
    return kept.orderBy("kb_order", "rank").limit(k)
