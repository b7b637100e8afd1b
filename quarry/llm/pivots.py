"""Hard negatives by a pivot table.

Vectors become integers floor(256 * x). Each row gets one more component, sqrt(M^2 - |x|^2) with M the largest length of all rows, and each anchor a zero there: then the squared distance of
an anchor to a row is |anchor|^2 + M^2 - 2 * product, so a larger inner product is a smaller Euclidean distance. The pivot table holds each row with its distances to
`PIVOTS` pivots. For an anchor, whose distances to the pivots are computed once, the triangle inequality brackets its distance to each row from the
stored ones, and with it the product; only rows whose bracket can still reach what is asked are multiplied out. The table is dealt by the nearest pivot and the distance to it, so that
a block of rows lies close together, and the bracket of the whole block (from the least and largest stored distances) comes before those of its rows.

Two passes over the table set blocks of anchors against blocks of rows, each in one job. The first finds each anchor's positives, the `positives` best other rows of its label: a bracket
matters while it can reach the least of those that the task has found so far. The second finds the negatives, rows of another label whose product lies in the band of
a positive, `LOW` to `HIGH` per cent of its product: a bracket matters if it meets a band and can reach the least of the `negatives` that the band has so far.

Pivots are chosen from `SAMPLE` rows (drawn by a hash), each farthest from those before; any rows as pivots give the same results. Of rows that have the vector and the label in common
only those with the smallest ids can be results (one more than are asked for, as one may be the anchor), which a group limit keeps on the map side; anchors are all rows.

Defined results: rows whose label or vector is null, or whose vector is empty or holds null or non-finite components, take no part, and neither do rows without an id, which a result could not
name; rows are rows, even if they repeat an id or a vector: each is a candidate for all others and, if its id is divisible by `every`, an anchor of its own; only vectors of the anchor's length meet it;
components beyond 2^62 count as 2^62, and products beyond 64 bits as the largest number of 64 bits (compared exactly before); extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import lists, materialise
from quarry.operators import blocks

SCALE = 256
EVERY, SHIFTED = 100, 7
LABELS = 10
POSITIVES, NEGATIVES = 5, 10
#: Per cent of a positive's product that a negative's lies between.
LOW, HIGH = 30, 90
PIVOTS, SAMPLE = 16, 2_048
LARGEST = 2**62

_FOUND = "anchor bigint, slot int, row bigint, vec_id bigint, score bigint"
_FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, size, v): the rows that take part, numbered, with integer components and the labels of every `SHIFTED`-th id moved on."""
    rows = df.select(df[vec_id].cast("bigint").alias("vec_id"), df[label].cast("bigint").alias("label"), df[vector].cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & blocks.whole("v"))
    moved = F.when(F.pmod("vec_id", F.lit(SHIFTED)) == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", moved.alias("label"), F.size("v").alias("size"), whole.alias("v"))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of integers, exactly: in doubles or 64 bits where they fit, else as Python's integers, cut to 64 bits at the end."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[max(-(2**63), min(2**63 - 1, x)) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


class Pivots:
    """The pivots of vectors of one length, augmented, and the largest length of a row."""

    def __init__(self, sample: np.ndarray, largest: float):
        self.largest = largest
        whole = self._augmented(sample)
        chosen = [int(np.argmax(np.sqrt((whole**2).sum(axis=1))))]
        least = np.full(len(whole), np.inf)
        while len(chosen) < min(PIVOTS, len(whole)):
            least = np.minimum(least, ((whole - whole[chosen[-1]]) ** 2).sum(axis=1))
            if not least.max() > 0:
                break
            chosen.append(int(least.argmax()))
        self.at = whole[chosen]

    def _augmented(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.column_stack([v, np.sqrt(np.maximum(self.largest**2 - (v**2).sum(axis=1), 0))])

    def distances(self, v: np.ndarray, anchor: bool = False) -> np.ndarray:
        """(vectors, pivots): Euclidean distances of rows, or of anchors with their zero component."""
        x = np.column_stack([v.astype(np.float64), np.zeros(len(v))]) if anchor else self._augmented(v)
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (self.at**2).sum(axis=1)[None, :] - 2 * x @ self.at.T, 0))


def chosen(rows: DataFrame) -> dict[int, Pivots]:
    """The pivots for each length of vectors: `SAMPLE` rows a length come to the driver."""
    length = F.aggregate("v", F.lit(0.0), lambda total, x: F.hypot(total, x.cast("double")))
    largest = {r["size"]: r["most"] for r in rows.groupBy("size").agg(F.max(length).alias("most")).collect()}
    order = Window.partitionBy("size").orderBy(F.xxhash64("row"), "row")
    sample: dict[int, list] = {size: [] for size in largest}
    for r in rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE).select("size", "v").collect():
        sample[r["size"]].append(r["v"])
    return {size: Pivots(np.array(some, np.int64), largest[size] * (1 + 1e-9)) for size, some in sample.items()}


def pivot_table(rows: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """rows with their distances to all pivots, dealt and sorted by the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for size in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == size))
                far = pivots[size].distances(mine.column(4).flatten().to_numpy().reshape(-1, size))
                yield pa.RecordBatch.from_arrays([*mine.columns, lists(far.ravel(), np.full(len(far), far.shape[1]), pa.float64())], names=[*mine.schema.names, "far"])

    stored = rows.mapInArrow(run, "row bigint, vec_id bigint, label bigint, size int, v array<bigint>, far array<double>")
    near = F.array_min("far")
    by = ["size", F.array_position("far", near), near]
    return stored.repartitionByRange(*by, "row").sortWithinPartitions(*by).drop("size")


class _Brackets(blocks.Seen):
    """The best rows of each slot of each anchor of a block, among those of the blocks seen; subclasses say which rows and which of their products count."""

    slots = 1

    def __init__(self, anchors: blocks.Block, pivots: dict[int, Pivots], keep: int):
        self.keep, self.pivots = keep, pivots[anchors.size]
        self.anchors, self.labels, self.exact = anchors["row"], anchors["label"], anchors.matrix("v", np.int64)
        self.far = self.pivots.distances(self.exact, anchor=True)
        #: |anchor|^2 + M^2, and how far products of brackets may be off.
        self.base = (self.exact.astype(np.float64) ** 2).sum(axis=1) + self.pivots.largest**2
        self.slack = 1e-6 + self.base * 1e-6
        self.least = np.full((anchors.n, self.slots), -(2**63), dtype=np.float64)
        self.held: list[pa.Table] = []
        self.rows = 0

    def wanted_at(self, at: np.ndarray | slice, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether products between low and high may count for some slot of these anchors (which come first in both)."""
        raise NotImplementedError

    def apart(self, rows: blocks.Block) -> np.ndarray:
        """(anchors, rows): the rows that may be results by label and identity."""
        raise NotImplementedError

    def inside(self, score: np.ndarray, who: np.ndarray, slot: int) -> np.ndarray:
        """Which products (of anchors `who`, rows) count for a slot."""
        raise NotImplementedError

    def _products(self, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest products at distances of `near` to `far`."""
        shape = (-1,) + (1,) * (near.ndim - 1)
        base, slack = self.base.reshape(shape), self.slack.reshape(shape)
        return (base - far**2) / 2 - slack, (base - near**2) / 2 + slack

    def add(self, rows: blocks.Block) -> None:
        far = rows.matrix("far")
        # The whole block first: its stored distances to a pivot lie in an interval.
        low, high = far.min(axis=0), far.max(axis=0)
        some = np.flatnonzero(self.wanted_at(slice(None), *self._products(np.maximum(self.far - high, low - self.far).clip(0).max(axis=1), (self.far + high).min(axis=1))))
        if not len(some):
            return
        near, most = np.zeros((len(some), rows.n)), np.full((len(some), rows.n), np.inf)
        for p in range(far.shape[1]):
            mine, theirs = self.far[some, p, None], far[None, :, p]
            np.maximum(near, np.abs(mine - theirs), out=near)
            np.minimum(most, mine + theirs, out=most)
        shape = self.base[some, None], self.slack[some, None]
        survive = self.apart(rows)[some] & self.wanted_at(some, (shape[0] - most**2) / 2 - shape[1], (shape[0] - near**2) / 2 + shape[1])
        who, which = some[survive.any(axis=1)], np.flatnonzero(survive.any(axis=0))
        if len(who) and len(which):
            self._check(rows, who, which, survive[survive.any(axis=1)][:, which])

    def _check(self, rows: blocks.Block, who: np.ndarray, which: np.ndarray, survive: np.ndarray) -> None:
        """Survivors, multiplied out."""
        score = inner(self.exact[who], rows.matrix("v", np.int64)[which])
        ids, numbers = rows["vec_id"][which], rows["row"][which]
        for slot in range(self.slots):
            counts = survive & self.inside(score, who, slot)
            value = np.where(counts, score.astype(np.float64), -np.inf)
            least = self.least[who, slot]
            if len(which) >= self.keep:
                least = np.maximum(least, np.partition(value, len(which) - self.keep, axis=1)[:, len(which) - self.keep])
                self.least[who, slot] = least
            # Doubles of 64-bit products may meet where the products don't, so what equals the least stays.
            i, j = np.nonzero(counts & (value >= least[:, None]))
            if len(i):
                self.held.append(pa.table([pa.array(c, f.type) for c, f in zip((self.anchors[who][i], np.full(len(i), slot), numbers[j], ids[j], score[i, j]), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW))
                self.rows += len(i)
        if self.rows > 4 * self.keep * self.least.size + blocks.ROWS:
            self._cut()

    def _cut(self) -> pa.Table:
        whole = blocks.best(pa.concat_tables(self.held), ["anchor", "slot"], "score", ["vec_id", "row"], self.keep)
        self.held, self.rows = [whole], whole.num_rows
        return whole

    def found(self) -> pa.RecordBatch:
        whole = self._cut() if self.held else _FOUND_ARROW.empty_table()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in whole.columns], schema=_FOUND_ARROW)


class _Positives(_Brackets):
    """The best other rows of the anchor's label."""

    def wanted_at(self, at, low, high):
        least = self.least[at, 0]
        return high >= (least if high.ndim == 1 else least[:, None])

    def apart(self, rows):
        return (self.labels[:, None] == rows["label"][None, :]) & (self.anchors[:, None] != rows["row"][None, :])

    def inside(self, score, who, slot):
        return np.ones(score.shape, bool)


class _Negatives(_Brackets):
    """For each positive of an anchor, the best rows of other labels in its band."""

    slots = POSITIVES

    def __init__(self, anchors: blocks.Block, pivots: dict[int, Pivots], keep: int):
        super().__init__(anchors, pivots, keep)
        self.low, self.high = anchors.matrix("low", np.int64), anchors.matrix("high", np.int64)

    def wanted_at(self, at, low, high):
        least, most = np.maximum(self.least[at], self.low[at].astype(np.float64)), self.high[at].astype(np.float64)
        there = self.low[at] <= self.high[at]
        if low.ndim == 2:
            low, high, least, most, there = low[:, :, None], high[:, :, None], least[:, None, :], most[:, None, :], there[:, None, :]
            out = np.zeros(low.shape[:2], bool)
            for slot in range(self.slots):  # a slot at a time, so that no third dimension is held
                out |= there[:, :, slot] & (high[:, :, 0] >= least[:, :, slot]) & (low[:, :, 0] <= most[:, :, slot])
            return out
        return (there & (high[:, None] >= least) & (low[:, None] <= most)).any(axis=1)

    def apart(self, rows):
        return self.labels[:, None] != rows["label"][None, :]

    def inside(self, score, who, slot):
        return (score >= self.low[who, slot, None]) & (score <= self.high[who, slot, None])


def _pass(kind: type[_Brackets], anchors: DataFrame, table: DataFrame, pivots: dict[int, Pivots], keep: int) -> DataFrame:
    """(anchor, slot, row, vec_id, score, nth): the best of all tasks."""
    count = max(1, -(-anchors.count() // blocks.QUERIES))
    asked = materialise(blocks.packed(anchors.repartition(count), "v", blocks.QUERIES), "anchors")
    found = blocks.pairs(asked, table, lambda block: kind(block, pivots, keep), _FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return materialise(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep), kind.__name__.strip("_").lower())


def _bands(positives: DataFrame) -> DataFrame:
    """(row, low, high): for each anchor, the least and largest product of the negatives of each of its positives; empty where it has fewer."""
    share = lambda percent, up: F.expr(f"cast({'ceil' if up else 'floor'}(cast(score as decimal(20, 0)) * {percent} / 100) as bigint)")
    of = positives.select(F.col("anchor").alias("row"), "nth", share(LOW, True).alias("low"), share(HIGH, False).alias("high"))
    slots = [(name, i) for name in ("low", "high") for i in range(1, POSITIVES + 1)]
    one = lambda name, i: F.max(F.when(F.col("nth") == i, F.col(name)))
    held = of.groupBy("row").agg(*[one(name, i).alias(f"{name}{i}") for name, i in slots])
    filled = lambda name, other: F.array(*[F.coalesce(F.col(f"{name}{i}"), F.lit(other).cast("bigint")) for i in range(1, POSITIVES + 1)]).alias(name)
    return held.select("row", filled("low", 1), filled("high", 0))


def hard_negatives(df: DataFrame, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the best rows of other labels in the band of each positive of each anchor."""
    with blocks.batches(df.sparkSession):
        whole = materialise(integers(df, vec_id, vector, label), "integers")
        same = Window.partitionBy("v", "label").orderBy("vec_id", "row")
        rows = materialise(whole.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= max(POSITIVES, NEGATIVES) + 1).drop("nth"), "rows")
        pivots = chosen(rows)
        table = materialise(blocks.packed(pivot_table(rows, pivots), "v"), "pivots")
        anchors = whole.where(F.pmod("vec_id", F.lit(every)) == 0).select("row", "vec_id", "label", "v")
        positives = _pass(_Positives, anchors, table, pivots, POSITIVES)
        negatives = _pass(_Negatives, anchors.join(_bands(positives), "row"), table, pivots, NEGATIVES)
        named = positives.select("anchor", (F.col("nth") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = negatives.select("anchor", "slot", F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "slot"])
        ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        return materialise(found.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
