"""Facets, catalogue listings and file-name suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import basename, matches_filter, mentions, question_tokens, score_file_name, strip
from quarry.schemas import INDEXED

#: What is said beside suggestions.
NO_FILES, ASK_FIRST, RECENT = "暂无可用文件", "输入问题后自动推荐可过滤的文件名", "未识别到文件名，以下为最近文件"


def facet_files(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(name, n) by falling count, then name; hits without a source count as unknown."""
    name = F.when(F.coalesce("source", F.lit("")) == "", F.lit("unknown")).otherwise(basename(F.col("source")))
    return hits.groupBy(*by, name.alias("name")).agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "name")


def source_names(hits: DataFrame, order: str = "pos") -> DataFrame:
    """(name, pos): distinct file names, first seen first; hits without a source do not count."""
    named = hits.where(F.coalesce("source", F.lit("")) != "").groupBy(basename(F.col("source")).alias("name"))
    return named.agg(F.min(order).alias("pos")).orderBy("pos")


def filter_files(hits: DataFrame, filters: list[str]) -> DataFrame:
    """Hits whose file is among the filters (all, without filters); to be applied to a result, not to its candidates."""
    return hits.where(matches_filter(F.col("source"), F.array(*[F.lit(f) for f in filters]))) if filters else hits


def list_kbs(kb_paths: DataFrame, manifests: DataFrame, kbs: DataFrame) -> DataFrame:
    """Every knowledge base with its roots and, if it has one, its manifest."""
    roots = kb_paths.groupBy("kb_id").agg(F.sort_array(F.collect_list("root")).alias("roots"))
    return kbs.select("kb_id").distinct().join(roots, "kb_id", "left").join(manifests, "kb_id", "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<string>"))).orderBy("kb_id")


def resolve_kbs(kbs: DataFrame, wanted: list[str] | str | None) -> DataFrame:
    """(kb_id, pos): the wanted ones that exist, in the order given; without any, the first there is."""
    names = [w.strip() for w in (wanted.split(",") if isinstance(wanted, str) else wanted or []) if w.strip()]
    asked = kbs.sparkSession.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], "kb_id string, pos int")
    there = asked.join(kbs.select("kb_id").distinct(), "kb_id", "left_semi")
    default = kbs.select("kb_id").distinct().orderBy("kb_id").limit(1).select("kb_id", F.lit(0).alias("pos"))
    fallback = default.join(there.select(F.lit(1).alias("any")).limit(1), F.lit(True), "left_anti")
    return there.unionByName(fallback).orderBy("pos")


def file_names(records: DataFrame, kb_ids: list[str] | None = None) -> DataFrame:
    """(name, updated_at): indexed files that are still there, with their latest change."""
    live = records.where((F.col("status") == INDEXED) & ~F.col("source_deleted"))
    live = live if kb_ids is None else live.where(F.col("kb_id").isin(kb_ids))
    return live.groupBy(basename(F.col("abs_path")).alias("name")).agg(F.max("updated_at").alias("updated_at")).where("name <> ''")


def suggest(names: DataFrame, question: str, limit: int = 8) -> DataFrame:
    """(name, score, message, rank): names by score, then oldest change, then name; the latest files if none scores."""
    asked = strip(F.lit(question))
    score = score_file_name(asked, F.col("name"), question_tokens(asked)) + F.when(F.array_contains(mentions(asked), F.lower("name")), 50).otherwise(0)
    scored = names.withColumn("score", score)
    best = F.max("score").over(Window.partitionBy())
    top = scored.orderBy(F.when(F.col("score") > 0, 0).otherwise(1), F.desc("score"), "updated_at", "name").limit(limit)
    recent = scored.orderBy(F.desc("updated_at"), "name").limit(limit)
    both = top.withColumn("kind", F.lit(0)).unionByName(recent.withColumn("kind", F.lit(1))).withColumn("best", best)
    kept = both.where(F.when(F.col("best") > 0, (F.col("kind") == 0) & (F.col("score") > 0)).otherwise(F.col("kind") == 1))
    message = F.when(F.col("best") <= 0, F.lit(RECENT))
    order = Window.partitionBy().orderBy(F.desc("score"), F.when(F.col("best") > 0, F.unix_micros("updated_at")).otherwise(-F.unix_micros("updated_at")), "name")
    return kept.select("name", "score", "updated_at", message.alias("message"), F.row_number().over(order).alias("rank"))


def suggest_files(records: DataFrame, kb_ids: list[str], question: str, limit: int = 8) -> tuple[list[str], str | None]:
    """Names for a form field, and what to say beside them."""
    names = file_names(records, kb_ids)
    if not kb_ids or not names.head(1):
        return [], NO_FILES
    if not question.strip():
        return [], ASK_FIRST
    rows = suggest(names, question, limit).orderBy("rank").collect()
    return [r["name"] for r in rows], rows[0]["message"] if rows else None
