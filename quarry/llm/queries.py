"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import crosspolytope, decontaminate, extract, filteraudit, language, mixing, pivots, secrets, simhash, suffixarrays, suffixtrees, topk, toxicity
from quarry.llm.common import table
from quarry.llm.oracles import ORACLE_SQL


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_suffixtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtrees.remove_repeated_words(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.findings_by_path(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffixarrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarrays.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op11_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.search(table(spark, sf_dir, "embeddings"))


def op13_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract": op1_extract,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_suffixtrees": op5_suffixtrees,
    "op6_topk": op6_topk,
    "op7_secrets": op7_secrets,
    "op8_language": op8_language,
    "op9_decontaminate": op9_decontaminate,
    "op10_suffixarrays": op10_suffixarrays,
    "op11_pivots": op11_pivots,
    "op12_crosspolytope": op12_crosspolytope,
    "op13_filteraudit": op13_filteraudit,
}
