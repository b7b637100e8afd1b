"""Min-max fusion of dense and sparse hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.7


def min_max(score: Column, within: Window | None = None) -> Column:
    """Between 0 and 1 over the scores that are there; 0 where they are all the same or missing."""
    within = within if within is not None else Window.partitionBy()
    low, high = F.min(score).over(within), F.max(score).over(within)
    return F.when(high > low, F.coalesce((score - low) / (high - low), F.lit(0.0))).otherwise(0.0)


def merge(dense: DataFrame, sparse: DataFrame, on: list[str]) -> DataFrame:
    """All hits of either side (signature, score), with dense_score and sparse_score; of repeats in a side the last score holds."""
    sides = []
    for side, name in ((dense, "dense"), (sparse, "sparse")):
        last = F.max_by("score", "rank") if "rank" in side.columns else F.max("score")
        sides.append(side.groupBy(*on).agg(last.alias(f"{name}_score")))
    return sides[0].join(sides[1], on, "full_outer")


def fuse(merged: DataFrame, key: str, k: int, alpha: float = ALPHA, by: tuple[str, ...] = ()) -> DataFrame:
    """merged with `score` and `rank`, the best k (0 or less: all) of each group; ties by key."""
    within = Window.partitionBy(*by)
    score = alpha * min_max(F.col("dense_score"), within) + (1 - alpha) * min_max(F.col("sparse_score"), within)
    ranked = merged.withColumn("score", score).withColumn("rank", F.row_number().over(within.orderBy(F.desc("score"), key)))
    return ranked if k <= 0 else ranked.where(F.col("rank") <= k)


def hybrid_rerank(hits: DataFrame, key: str, k: int, alpha: float = ALPHA, by: tuple[str, ...] = ()) -> DataFrame:
    """hits (score, keyword) by fused scores if any keyword hit, else by the vector score alone."""
    within = Window.partitionBy(*by)
    mixed = alpha * min_max(F.col("score"), within) + (1 - alpha) * min_max(F.col("keyword"), within)
    final = F.when(F.max("keyword").over(within) > 0, mixed).otherwise(F.col("score"))
    ranked = hits.withColumn("final", final).withColumn("rank", F.row_number().over(within.orderBy(F.desc("final"), key)))
    return ranked.where(F.col("rank") <= k)
