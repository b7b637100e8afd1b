"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. Each source has a target (words the mix takes from it): sources share the total by
weight, no target above `cap` times its source's size, and what a capped source leaves over is reshared by weight.
Among all document rates between 0 and `cap` that meet the targets, entropy balancing takes those of least relative entropy
to one copy of everything. The convex dual has one multiplier per source, the solution is the exponential tilt
rate = min(cap, exp(multiplier * size / mean size)), and Newton iterations (kept inside a bracket, so that they cannot
diverge) find the multipliers. They run on the distributed counts of (source, size), not on documents: the tilt depends on
nothing else. State is one row per source in a written table; the planner broadcasts it only while it is small, and
otherwise joins by shuffling, so the number of sources is not bounded.

Rates are rounded into copies: whole copies, plus one for documents whose hash lies under a threshold that is found per source by two
rounds of 4096-fold bucket sums; the one document at the threshold gives a part of its last copy, which meets the target
to the word. The hash depends on doc_id alone, so reruns agree.

Defined results: null and wordless texts have size 0 and take 0; a null source is a source, ordered last; repeated rows are
documents of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, release

#: Weights by the sources' order, repeating; copies of a document at most; a word.
WEIGHTS = (1, 2, 3)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"

TOLERANCE = 1e-9
MOST_ROUNDS = 80
BUCKETS = 4096


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, key, source, size) of every row, key a hash of the text."""
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("key"), docs[source].cast("string").alias("source"), size.alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n, smallest, weight, target), n and smallest over documents that have words."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    row = F.monotonically_increasing_id()
    ordered = materialise(totals.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), row.alias("row")), "sources")
    # A row's place in the order is its place in its partition plus the sizes of the partitions before.
    before, offsets = 0, []
    for part, first, rows in sorted(ordered.groupBy("part").agg(F.min("row"), F.count("*")).collect()):
        offsets.append((part, before - first))
        before += rows
    shift = spark.createDataFrame(offsets, "part int, shift bigint")
    cycle = F.array(*[F.lit(w) for w in weights])
    place = F.pmod(F.col("row") + F.col("shift"), F.lit(len(weights))).cast("int")
    weighted = materialise(ordered.join(F.broadcast(shift), "part").select("source", "source_size", "n", "smallest", F.element_at(cycle, place + 1).alias("weight")), "sources")
    return weighted.withColumn("target", _shares(weighted, cap))


def _shares(sources: DataFrame, cap: int) -> Column:
    """The target of each source, from a level that rises until no further source is above its cap."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, weight, capped = total, None, -1
    above = F.lit(False)
    while True:
        got = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size") * cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        count, taken, weight = got[0] or 0, got[1] or 0, got[2] or 0
        if count == capped or not weight:
            break
        capped, left = count, total - taken
        above = F.col("weight") * F.lit(float(left)) > F.col("source_size") * F.lit(float(cap * weight))
    even = F.col("weight") * F.lit(float(left)) / F.lit(float(max(1, weight)))
    limit = (F.col("source_size") * cap).cast("double")
    return F.least(F.when(above, limit).otherwise(even), limit)


def _tilt(multiplier: Column, size: Column, mean: Column, cap: int) -> Column:
    return F.exp(F.least(multiplier * size / mean, F.lit(math.log(cap))))


def _exact(x: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that reruns agree to the last digit."""
    return F.sum(x.cast("decimal(30,10)")).cast("double")


def multipliers(sizes: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """targets with `mean` and the dual's solution `multiplier`; null where a source takes nothing or its whole cap."""
    counts = materialise(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")), "counts")
    share = F.try_divide("target", "source_size")
    state = targets.withColumn("mean", F.try_divide("source_size", "n")).withColumn("free", (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * cap))
    least = F.col("smallest") / F.col("mean")
    state = state.withColumn("multiplier", F.when(F.col("free"), F.lit(0.0)))
    state = state.withColumn("low", F.when(F.col("free"), F.when(share < 1, F.log(share) / least).otherwise(0.0)))
    state = state.withColumn("high", F.when(F.col("free"), F.when(share < 1, 0.0).otherwise(F.lit(math.log(cap)) / least)))
    state = materialise(state.withColumn("off", F.lit(None).cast("double")), "state")
    columns = state.columns
    for _ in range(MOST_ROUNDS):
        rate = _tilt(F.col("multiplier"), F.col("size"), F.col("mean"), cap)
        words = F.col("docs") * F.col("size") * rate
        slope = F.when(F.col("multiplier") * F.col("size") / F.col("mean") < math.log(cap), words * F.col("size") / F.col("mean")).otherwise(0.0)
        met = counts.alias("c").join(state.where("free").alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy("s.source").agg(_exact(words).alias("words"), _exact(slope).alias("slope"))
        joined = state.alias("s").join(met.alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")), "left")
        over = F.col("words") - F.col("target")
        high = F.when(over > 0, F.col("multiplier")).otherwise(F.col("high"))
        low = F.when(over > 0, F.col("low")).otherwise(F.col("multiplier"))
        newton = F.col("multiplier") - over / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (newton > low) & (newton < high)
        done = F.abs(over) <= F.col("target") * TOLERANCE
        step = F.when(done, F.col("multiplier")).when(inside, newton).otherwise((low + high) / 2)
        fresh = {"multiplier": step, "low": low, "high": high, "off": F.abs(over) / F.col("target")}
        after = materialise(joined.select(*[fresh.get(c, F.col(f"s.{c}")).alias(c) for c in columns]), "state")
        worst = after.agg(F.max("off")).first()[0]
        release(state)
        state = after
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("source", "source_size", "target", "mean", "multiplier", "free")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, key, source, size, source_size, target, rate, taken) of every row of docs, key a hash of the text."""
    sizes = materialise(sized(docs, doc_id, text, source), "sizes")
    solved = materialise(multipliers(sizes, source_targets(sizes, weights, cap), cap), "solved")
    rate = F.when(F.col("free"), _tilt(F.col("multiplier"), F.col("d.size"), F.col("mean"), cap)).when(F.col("d.size") > 0, F.lit(float(cap))).otherwise(0.0)
    uniform = F.shiftrightunsigned(F.xxhash64("d.doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    rated = sizes.alias("d").join(solved.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.key", "d.source", "d.size", "s.source_size", "s.target", rate.alias("rate"), uniform.alias("u"))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("score", F.col("u") - (F.col("rate") - F.col("whole")))
    place = F.floor((F.col("score") + 1) / 2 * F.lit(float(BUCKETS * BUCKETS)))
    rated = rated.withColumn("extra", (F.col("size") > 0) & (F.col("whole") < cap)).withColumn("high", F.floor(place / BUCKETS)).withColumn("low", F.pmod(place, F.lit(BUCKETS)))
    rated = materialise(rated.drop("u"), "rated")
    return _rounded(rated)


def _crossing(sums: DataFrame, bucket: str) -> DataFrame:
    """Of each source, the first bucket at which the running sum reaches `need`, and what is needed inside it."""
    running = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    reached = sums.withColumn("upto", F.sum("words").over(running)).where("upto >= need")
    return reached.groupBy("source").agg(F.min_by(F.struct(F.col(bucket), (F.col("need") - F.col("upto") + F.col("words")).alias("need")), F.col(bucket)).alias("x")).select("source", f"x.{bucket}", "x.need")


def _rounded(rated: DataFrame) -> DataFrame:
    need = rated.groupBy("source").agg((F.round(F.first("target")) - F.sum(F.col("size") * F.col("whole"))).cast("bigint").alias("need")).where("need > 0")
    need = materialise(need, "need")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    sums = rated.where("extra").groupBy("source", "high").agg(F.sum("size").alias("words"))
    first = materialise(_crossing(sums.alias("r").join(need.alias("n"), same("r", "n")).select("r.source", "high", "words", "need"), "high"), "first")
    inside = rated.where("extra").alias("r").join(first.alias("n"), same("r", "n") & (F.col("r.high") == F.col("n.high"))).groupBy("r.source", "low").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    second = materialise(_crossing(inside, "low"), "second")
    cross = materialise(first.alias("a").join(second.alias("b"), same("a", "b")).select("a.source", F.col("a.high").alias("at_high"), F.col("b.low").alias("at_low"), F.col("b.need").alias("rest")), "cross")

    placed = rated.alias("r").join(cross.alias("n"), same("r", "n"), "left").select("r.*", "at_high", "at_low", "rest")
    under = F.col("extra") & ((F.col("high") < F.col("at_high")) | ((F.col("high") == F.col("at_high")) & (F.col("low") < F.col("at_low"))))
    edge = F.coalesce(F.col("extra") & (F.col("high") == F.col("at_high")) & (F.col("low") == F.col("at_low")), F.lit(False))
    base = F.col("size") * F.col("whole")
    columns = ["doc_id", "key", "source", "size", "source_size", "target", "rate"]
    clear = placed.where(~edge).select(*columns, (base + F.when(F.coalesce(under, F.lit(False)), F.col("size")).otherwise(0)).cast("bigint").alias("taken"))
    # One bucket of each source in 4096 squared holds the threshold: its few documents are taken in order of score.
    order = Window.partitionBy("source").orderBy("score", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.coalesce(F.sum("size").over(order), F.lit(0))))
    marginal = placed.where(edge).withColumn("part", part).select(*columns, (base + F.col("part")).cast("bigint").alias("taken"))
    return clear.unionByName(marginal)
