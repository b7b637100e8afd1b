"""Exact top-k inner products with a vector-approximation file.

Vectors become integers floor(scale * x). The approximation file holds one byte per component: the number of the cell, out of
`cells` of equal width between the component's least and largest value, that the integer lies in. A query scans the
cells only. A cell's edges bound the product from both sides; the k-th largest of the lower bounds is a threshold that every result
reaches, so rows whose upper bound is below it are out. Exact vectors are read in the order of the upper bounds, in two steps: first those of the `first * k` best
bounds; their k-th exact score is a higher threshold, and only rows whose bound reaches it are read in the second step. What is
left cannot be a result. Both steps keep the k best of each query in every partition before they shuffle, and never gather a query's candidates in one place.

Queries go in blocks of `block` rows. A block's results are written before the next one starts, so neither what is broadcast nor the plan grows
with the data. Equal vectors score alike, and ties go to the smaller id: of each vector only the k + 1 smallest ids can be results (one may be
the query's own), which a group limit keeps on the map side, so a vector that a third of all rows share costs no more than another.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or candidate; rows that share an id
are one row (its smallest vector); only vectors of the query's length are candidates; extra columns are ignored; an empty
table gives an empty result; rows without an id take no part; components beyond 2^61 count as 2^61, and products beyond 64 bits as the largest number of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, gathered, materialise, record, release

SCALE = 1024
CELLS = 64
BLOCK = 1024
K = 10
FIRST = 4
#: Components beyond it count as it.
LARGEST = 2**61

_BOUNDS = pa.schema([("query_id", pa.int64()), ("bounds", pa.list_(pa.float64()))])
_CANDIDATES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("bound", pa.float64())])
_SCORED = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_RANKED_DDL = "query_id bigint, rank int, vec_id bigint, score bigint"


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, size, v) of the rows that take part, v the integers as little-endian 64-bit bytes; one row for an id."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.floor(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) * scale)
                if np.isfinite(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)).all():
                    ids.append(at)
                    values.append(np.clip(v, -LARGEST, LARGEST).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], names=["vec_id", "v"])

    found = df.select(df[vec_id].cast("bigint"), df[vector].cast("array<double>")).mapInArrow(run, "vec_id bigint, v binary")
    return found.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", (F.octet_length("v") / 8).cast("int").alias("size"), "v")


def _matrix(values: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i8").reshape(len(values), size)


def edges(vectors: DataFrame, cells: int = CELLS) -> dict[int, np.ndarray]:
    """For each vector length, the cells + 1 edges of every component: cell c holds edge c up to edge c + 1, less one."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array(batch.column(0).to_pylist())
            values = batch.column(1).to_pylist()
            for size in set(sizes.tolist()) - {0}:
                m = _matrix([values[i] for i in np.flatnonzero(sizes == size)], size)
                both = np.array([m.min(axis=0), -m.max(axis=0)])
                seen[size] = np.minimum(seen[size], both) if size in seen else both
        rows = [(size, i, int(low), int(-high)) for size, x in seen.items() for i, (low, high) in enumerate(x.T)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["size", "i", "low", "high"])

    found: dict[int, list] = {}
    for r in vectors.select("size", "v").mapInArrow(extremes, "size bigint, i bigint, low bigint, high bigint").groupBy("size", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("size", "i").collect():
        found.setdefault(r["size"], []).append((r["low"], r["high"]))
    steps = np.arange(cells + 1)
    out = {}
    for size, bounds in found.items():
        low, high = np.array(bounds, dtype=np.int64).T
        low, high = low.astype(object), high.astype(object)  # Python's integers: widths times steps may not fit 64 bits
        out[size] = (low[:, None] + -(-(high - low + 1)[:, None] * steps // cells)).astype(np.int64)
    return out


def approximate(vectors: DataFrame, marks: dict[int, np.ndarray]) -> DataFrame:
    """The approximation file: (vec_id, size, code), code the cell number of each component as a byte."""
    shared = vectors.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for size, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(v, "<i8")
                codes.append(((x[:, None] >= shared.value[size]).sum(axis=1) - 1).astype(np.uint8).tobytes() if size else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], names=["vec_id", "size", "code"])

    return vectors.select("vec_id", "size", "v").mapInArrow(run, "vec_id bigint, size int, code binary")


class Block:
    """A block of queries of one length, with what the bounds need."""

    def __init__(self, rows: list[tuple[int, bytes]], size: int, marks: np.ndarray | None):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.exact = _matrix([r[1] for r in rows], size)
        q = self.exact.astype(np.float64)
        self.size, self.up, self.down = size, np.maximum(q, 0), np.minimum(q, 0)
        self.marks = marks
        self.threshold = np.full(len(rows), -np.inf)
        #: Sums in doubles may be off by so much; bounds are widened by it.
        self.slack = 0.0 if marks is None or not size else float(np.abs(q).max(initial=0) * np.abs(marks).max(initial=0) * size * 2.0**-50)

    def bounds(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every query's product with every coded vector."""
        if not self.size:
            zero = np.zeros((len(self.ids), len(codes)))
            return zero, zero
        at = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), self.size).astype(np.intp)
        every = np.arange(self.size)
        low, high = self.marks[every, at].astype(np.float64), self.marks[every, at + 1].astype(np.float64) - 1
        return self.up @ low.T + self.down @ high.T - self.slack, self.up @ high.T + self.down @ low.T + self.slack


def _own_size(block: Block, batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    keep = np.flatnonzero(np.array(batch.column(1).to_pylist()) == block.size)
    codes = batch.column(2).to_pylist()
    return batch.column(0).to_numpy()[keep], [codes[i] for i in keep]


def _thresholds(approx: DataFrame, block: Block, k: int) -> np.ndarray:
    """For each query of the block, the k-th largest lower bound over all candidates."""
    shared = approx.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = np.full((len(block.ids), k), -np.inf)
        for batch in batches:
            ids, codes = _own_size(block, batch)
            if len(ids):
                low, _ = block.bounds(codes)
                low[block.ids[:, None] == ids[None, :]] = -np.inf
                best = np.concatenate([best, low], axis=1)
                best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
        yield record(_BOUNDS, (block.ids, best.tolist()))

    found = approx.mapInArrow(run, "query_id bigint, bounds array<double>")
    kth = found.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("bounds")), asc=False)[k - 1].alias("kth"))
    by = {r["query_id"]: r["kth"] for r in kth.collect()}
    shared.destroy()
    return np.array([by.get(int(i), -np.inf) for i in block.ids])


def _candidates(approx: DataFrame, block: Block) -> DataFrame:
    """(query_id, vec_id, bound) where the upper bound reaches the query's threshold, from the cells alone."""
    shared = approx.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            ids, codes = _own_size(block, batch)
            if len(ids):
                _, high = block.bounds(codes)
                q, c = np.nonzero((high >= block.threshold[:, None]) & (block.ids[:, None] != ids[None, :]))
                yield record(_CANDIDATES, (block.ids[q], ids[c], high[q, c]))

    return approx.mapInArrow(run, "query_id bigint, vec_id bigint, bound double")


def _scored(candidates: DataFrame, exact: DataFrame, block: Block, k: int) -> DataFrame:
    """(query_id, vec_id, score): exact scores of the candidates, of each query and partition the k best."""
    shared = exact.sparkSession.sparkContext.broadcast((block.ids, block.exact))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        by = np.argsort(ids)
        best = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if batch.num_rows:
                q = by[np.searchsorted(ids, batch.column(0).to_numpy(), sorter=by)]
                vectors = _matrix(batch.column(2).to_pylist(), queries.shape[1])
                best = _best([np.concatenate(x) for x in zip(best, (ids[q], batch.column(1).to_numpy(), _products(queries[q], vectors)), strict=True)], k)
        if len(best[0]):
            yield record(_SCORED, best)

    read = candidates.select("query_id", "vec_id").join(exact.select("vec_id", "v"), "vec_id").select("query_id", "vec_id", "v")
    return read.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of each row of a with that of b: in 64 bits where they fit, else in Python's integers, cut to 64 bits at the end."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**62:
        return np.einsum("ij,ij->i", a, b)
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([max(1 - 2**63, min(2**63 - 1, int(x))) for x in exact], np.int64)


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, id, score) the k best rows of each query, ties by id."""
    query, at, score = rows
    order = np.lexsort((at, -score, query))
    fresh = np.flatnonzero(np.diff(query[order], prepend=query[order[0]] - 1))
    place = np.arange(len(order)) - np.repeat(fresh, np.diff(np.append(fresh, len(order))))
    keep = order[place < k]
    return [query[keep], at[keep], score[keep]]


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block_results(approx: DataFrame, exact: DataFrame, block: Block, k: int, first: int) -> DataFrame:
    """The results of one block of queries."""
    block.threshold = _thresholds(approx, block, k)
    found = materialise(_candidates(approx, block), "candidates")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "vec_id")
    early = found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= first * k).select("query_id", "vec_id")
    started = materialise(_ranked(_scored(early, exact, block, k), k), "started")
    reached = started.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    # Bounds of doubles are widened already; a bound that equals the k-th score may still win by its id.
    later = found.join(reached, "query_id", "left").where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached"))).select("query_id", "vec_id")
    rest = later.join(started.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    done = materialise(_ranked(started.drop("rank").unionByName(_scored(rest, exact, block, k)), k), "ranked")
    release(found)
    release(started)
    return done


def top_k(df: DataFrame, k: int = K, every: int = 100, block: int = BLOCK, cells: int = CELLS, first: int = FIRST, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row whose id is divisible by `every`."""
    spark: SparkSession = df.sparkSession
    whole = materialise(integers(df, vec_id, vector, scale), "vectors")
    # Only the k + 1 smallest ids of equal vectors can be results.
    same = Window.partitionBy("v").orderBy("vec_id")
    exact = materialise(whole.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"), "exact")
    marks = edges(whole, cells)
    approx = materialise(approximate(exact, marks), "approximation")
    queries = whole.where(F.pmod("vec_id", F.lit(every)) == 0).orderBy("size", "vec_id")
    results = (_block_results(approx, exact, Block(rows, size, marks.get(size)), k, first) for rows, size in _query_blocks(queries, block))
    return gathered(spark, results, _RANKED_DDL, "top")


def _query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[list[tuple[int, bytes]], int]]:
    held: list[tuple[int, bytes]] = []
    size = -1
    for at, length, v in queries.select("vec_id", "size", "v").toLocalIterator():
        if held and (len(held) == block or length != size):
            yield held, size
            held = []
        held.append((at, bytes(v)))
        size = length
    if held:
        yield held, size
