"""Row numbers within groups of any size: rows are sorted by range over all partitions, and what a group has in the partitions before is added up from counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import materialise

#: monotonically_increasing_id: the partition above these bits, the row below.
_BITS = 33


def numbered(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str = "rank") -> DataFrame:
    """df with the place of each row in its group, from 1, as row_number gives it; no group is in one task. Rows stay near their neighbours."""
    sort = [*by, *order]
    placed = materialise(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), "placed").withColumn("__part", F.shiftright("__at", _BITS))
    held = placed.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(held.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in by], (before - F.col("__first") + 1).alias("__shift")), "starts")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("__part") == F.col("__p"))
    return placed.join(starts, same).select(*df.columns, (F.col("__at") + F.col("__shift")).cast("int").alias(name))
