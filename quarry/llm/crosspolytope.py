"""Approximate nearest neighbours by inner product: cross-polytope hashing with fast Hadamard pseudo-rotations.

A rotation flips signs and applies the fast Hadamard transform, three times over, to a unit vector that is padded to a power of two. Its hash is the nearest signed
axis, the component of largest size; `depth` rotations together number a bucket, and a table is one such numbering. `TABLES` tables hold every row. A query probes in each table
every bucket whose axes it loses at most `radius` on: the loss of an axis is the largest component's size less the query's component along this axis. The rows of
probed buckets are candidates and are ranked exactly, by the inner product in doubles. The depth grows with the number of rows, so a bucket of even data
holds some `BUCKET` rows at every size.

`radius` is fitted: the true neighbours of `SAMPLE` queries (drawn by a hash) are found exactly, and the radius is the least at which `RECALL` of them
would be found. Those rows are the only ones that are sampled; all rows are indexed, and nothing is capped. A query that finds fewer than k rows is
answered exactly from all rows.

Inner products of rows of unequal lengths are not those of their directions: where lengths differ by more than `EVEN`, a component is added to each row that makes all
lengths equal, and a zero to each query. Buckets with many rows or queries are cut into a grid of cells of at most about `CELL_ROWS` rows and `CELL_QUERIES` queries, so a crowd
of near copies is many tasks. A task hands on the k best of what it sees, so one pass over all cells would hand on k rows for each query and task. Instead a query meets its cells in rounds:
first one cell of its own bucket in each table, then shares of the others that grow by `GROWTH`. The k-th best score so far goes along with the query, and only rows that reach it
are handed on; what a later round hands on so depends on how many rows do, and not on how many tasks see them. Of equal vectors only the k + 1 with the smallest ids can be among results, which a group limit keeps on the map side.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, and neither do rows without an id, which a result could not name; rows are
rows, even if they repeat an id or a vector: each is a candidate for all others and, if its id is divisible by `every`, a query of its own; only vectors of the query's length are
candidates; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import changes, lists, materialise, runs, single
from quarry.operators import blocks

K, EVERY = 20, 20
TABLES, ROUNDS = 6, 3
BUCKET = 400
SAMPLE, RECALL = 128, 0.95
EVEN = 0.01
CELL_ROWS, CELL_QUERIES = 4_096, 1_024
GROWTH = 64


@dataclass(frozen=True)
class Shape:
    """What the hash of vectors of one length needs: rotations a table, and the largest length of a vector if lengths differ (else 0)."""

    size: int
    depth: int
    largest: float

    @property
    def padded(self) -> int:
        return max(2, 1 << (self.size + (self.largest > 0) - 1).bit_length())


def rotate(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """Rows of x (of a power of two components) turned by `ROUNDS` of random signs and a Hadamard transform."""
    n, d = x.shape
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (ROUNDS, d))
    for sign in signs:
        x = x * sign
        half = 1
        while half < d:
            x = x.reshape(n, -1, 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
            half *= 2
        x = x.reshape(n, d) / math.sqrt(d)
    return x


def directions(v: np.ndarray, shape: Shape, query: bool) -> np.ndarray:
    """Unit vectors to be hashed, padded: of rows with the component that makes all lengths equal, of queries with a zero there."""
    v = np.asarray(v, np.float64)
    out = np.zeros((len(v), shape.padded))
    lengths = np.sqrt((v / np.abs(v).max(axis=1, keepdims=True)) ** 2 @ np.ones(v.shape[1])) * np.abs(v).max(axis=1)
    if shape.largest and not query:
        share = np.minimum(lengths / shape.largest, 1.0)
        out[:, : v.shape[1]] = v / shape.largest
        out[:, v.shape[1]] = np.sqrt(1 - share**2)
    else:
        out[:, : v.shape[1]] = v / lengths[:, None]
    return out


def _axes(x: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: 2 i for +e_i, 2 i + 1 for -e_i."""
    at = np.abs(x).argmax(axis=1)
    return 2 * at + (x[np.arange(len(x)), at] < 0)


def _losses(x: np.ndarray) -> np.ndarray:
    """What each row loses on each signed axis."""
    signed = np.stack([x, -x], axis=2).reshape(len(x), -1)
    return signed.max(axis=1, keepdims=True) - signed


def hashes(x: np.ndarray, shape: Shape) -> np.ndarray:
    """The bucket of each row in each table."""
    found = np.zeros((len(x), TABLES), np.int64)
    for table in range(TABLES):
        for i in range(shape.depth):
            found[:, table] = found[:, table] * 2 * shape.padded + _axes(rotate(x, (table, i)))
    return found


def probes(x: np.ndarray, shape: Shape, table: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, bucket): all buckets of a table whose losses add up to `radius` at most, found axis by axis."""
    rows, numbers, lost = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(shape.depth):
        losses = _losses(rotate(x, (table, i)))
        parts = []
        for piece in np.array_split(np.arange(len(rows)), max(1, len(rows) // 4096)):
            total = lost[piece, None] + losses[rows[piece]]
            at, axis = np.nonzero(total <= radius)
            parts.append((rows[piece][at], numbers[piece][at] * 2 * shape.padded + axis, total[at, axis]))
        rows, numbers, lost = (np.concatenate(c) for c in zip(*parts, strict=True))
    return rows, numbers


def least_loss(queries: np.ndarray, rows: np.ndarray, shape: Shape) -> np.ndarray:
    """For each pair of a query and a row, the least radius at which some table gives the row to the query."""
    out = np.full(len(queries), np.inf)
    every = np.arange(len(queries))
    for table in range(TABLES):
        lost = np.zeros(len(queries))
        for i in range(shape.depth):
            lost += _losses(rotate(queries, (table, i)))[every, _axes(rotate(rows, (table, i)))]
        out = np.minimum(out, lost)
    return out


def vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, size, v): the rows that take part, numbered. Floats stay floats, which are half as wide, until they are multiplied; all else becomes doubles."""
    found = df.select(df[vec_id].cast("bigint").alias("vec_id"), df[vector].alias("v"))
    kind = found.schema["v"].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):
        found = found.withColumn("v", F.col("v").cast("array<double>"))
    found = found.where(F.col("vec_id").isNotNull() & blocks.whole("v") & F.exists("v", lambda x: x != 0))
    return found.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("size"), "v")


def shapes(rows: DataFrame) -> dict[int, Shape]:
    """The shape of the hash for each length of vectors: one row a length comes to the driver."""
    length = F.aggregate("v", F.lit(0.0), lambda total, x: F.hypot(total, x))  # no square that overflows
    out = {}
    for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.min(length).alias("low"), F.max(length).alias("high")).collect():
        largest = r["high"] * (1 + 1e-9) if r["high"] - r["low"] > EVEN * r["high"] else 0.0
        one = Shape(r["size"], 1, largest)
        out[r["size"]] = Shape(r["size"], max(1, round(math.log(max(1.0, r["n"] / BUCKET), 2 * one.padded))), largest)
    return out


def _kind(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.simpleString()


def place(rows: DataFrame, shapes: dict[int, Shape]) -> DataFrame:
    """rows with the bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == size))
                found = hashes(directions(mine.column(3).flatten().to_numpy().reshape(-1, size), shapes[size], False), shapes[size])
                yield pa.RecordBatch.from_arrays([*mine.columns, lists(found.ravel(), np.full(len(found), TABLES), pa.int64())], names=[*mine.schema.names, "buckets"])

    return rows.select("row", "vec_id", "size", "v").mapInArrow(run, f"row bigint, vec_id bigint, size int, v {_kind(rows)}, buckets array<bigint>")


def probed(queries: DataFrame, shapes: dict[int, Shape], radii: dict[int, float]) -> DataFrame:
    """(row, size, v, table, home, buckets): the buckets that each query probes, its own (`home`) among them, one row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == size))
                x = directions(mine.column(2).flatten().to_numpy().reshape(-1, size), shapes[size], True)
                home = hashes(x, shapes[size])
                for table in range(TABLES):
                    at, bucket = probes(x, shapes[size], table, radii[size])
                    order = np.argsort(at, kind="stable")
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(np.full(len(x), table), pa.int32()), pa.array(home[:, table]), lists(bucket[order], np.bincount(at, minlength=len(x)), pa.int64())], names=[*mine.schema.names, "table", "home", "buckets"])

    return queries.select("row", "size", "v").mapInArrow(run, f"row bigint, size int, v {_kind(queries)}, table int, home bigint, buckets array<bigint>")


def fitted(rows: DataFrame, queries: DataFrame, shapes: dict[int, Shape], k: int) -> dict[int, float]:
    """For each length of vectors, the least radius at which `RECALL` of the true neighbours of the sample would be found."""
    order = Window.partitionBy("size").orderBy(F.xxhash64("row"), "row")
    sample = materialise(queries.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE).drop("nth"), "sample")
    true = blocks.nearest(sample.select(F.col("row").alias("query"), "v"), rows.select(F.col("row").alias("key"), "v"), k, apart="key")
    pairs = true.select("query", "key").join(sample.select(F.col("row").alias("query"), "size", F.col("v").alias("q")), "query").join(rows.select(F.col("row").alias("key"), "v"), "key")
    found: dict[int, list] = {}
    for r in pairs.select("size", "q", "v").collect():  # SAMPLE * k rows a length at most
        found.setdefault(r["size"], []).append((r["q"], r["v"]))
    radii = dict.fromkeys(shapes, 0.0)
    for size, some in found.items():
        q, v = (np.array(x, np.float64) for x in zip(*some, strict=True))
        radii[size] = float(np.quantile(least_loss(directions(q, shapes[size], True), directions(v, shapes[size], False), shapes[size]), RECALL, method="higher")) + 1e-9
    return radii


_BUCKET = ["size", "table", "bucket"]
_CELL = [*_BUCKET, "across", "down"]


def grid(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """(bucket, n_down, n_across): how many cells every bucket that a query probes is cut into."""
    many = lambda df, name: df.groupBy(*_BUCKET).agg(F.count("*").alias(name))
    counts = many(asked.select("size", "table", F.explode("buckets").alias("bucket")), "queries").join(many(placed.select("size", F.posexplode("buckets").alias("table", "bucket")), "rows"), _BUCKET)
    cut = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    return counts.select(*_BUCKET, cut("rows", CELL_ROWS).alias("n_down"), cut("queries", CELL_QUERIES).alias("n_across"))


def _every(n: str, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)


def _spread(n: str, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.col(n)).cast("int")


def rounds(asked: DataFrame, grid: DataFrame) -> int:
    """How many rounds the query with the most cells takes: `TABLES` cells in the first, up to `GROWTH` times those before in each later one."""
    each = asked.select("row", "size", "table", F.explode("buckets").alias("bucket")).join(grid, _BUCKET).groupBy("row").agg(F.sum("n_down").alias("n"))
    most = each.agg(F.max("n").alias("n")).first()["n"] or 1
    return 1 + max(1, math.ceil(math.log(most / TABLES, GROWTH)))


def _round(last: int) -> Column:
    """The round of a query's cell: 0 for the one cell of its own bucket, else 1 to `last`, by a hash, each with `GROWTH` times as many as that before."""
    share = (F.pmod(F.xxhash64("row", "table", "bucket", "down"), F.lit(1 << 30)) + 1) / float(1 << 30)
    later = F.greatest(F.lit(1), last - F.floor(-F.log(share) / math.log(GROWTH)))
    return F.when((F.col("bucket") == F.col("home")) & (F.col("down") == _spread("n_down", "row", "table")), 0).otherwise(later).cast("int")


def cells(placed: DataFrame, asked: DataFrame, grid: DataFrame, least: DataFrame, at: int, last: int) -> DataFrame:
    """(cell, side, row, vec_id, v, least): rows (side 1) of every cell, and the queries (side 0) that meet it in round `at`, with the score to reach from least (row, least)."""
    rows = placed.select("row", "vec_id", "size", "v", F.posexplode("buckets").alias("table", "bucket")).join(grid, _BUCKET)
    rows = rows.select(*_BUCKET, _spread("n_down", "row").alias("down"), _every("n_across", "across"), F.lit(1).alias("side"), "row", "vec_id", "v", F.lit(None).cast("double").alias("least"))
    queries = asked.join(least, "row", "left").select("row", "size", "v", "least", "table", "home", F.explode("buckets").alias("bucket")).join(grid, _BUCKET)
    queries = queries.select("*", _every("n_down", "down")).where(_round(last) == at)
    queries = queries.select(*_BUCKET, "down", _spread("n_across", "row").alias("across"), F.lit(0).alias("side"), "row", F.lit(0).cast("bigint").alias("vec_id"), "v", "least")
    return rows.unionByName(queries).repartition(*_CELL).sortWithinPartitions(*_CELL, "side")


class _Ranking:
    """The k best rows of each query among what a task has seen, and that reach the query's score; a row may come from several tables."""

    def __init__(self, k: int):
        self.k, self.least, self.held, self.rows = k, {}, [], 0

    def add(self, q_rows: np.ndarray, q: np.ndarray, reach: np.ndarray, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        rough = q @ v.T
        slack = np.sqrt(blocks.products(q, q)) * np.sqrt(blocks.products(v, v)).max() * q.shape[1] * 2.0**-50
        slack[~np.isfinite(slack)] = 0
        rough[q_rows[:, None] == rows[None, :]] = -np.inf
        least = np.maximum(reach, [self.least.get(r, -np.inf) for r in q_rows.tolist()])
        if len(rows) >= self.k:
            least = np.maximum(least, np.partition(rough, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
            self.least.update(zip(q_rows.tolist(), least.tolist(), strict=True))
        i, j = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
        self.held.append(pa.table({"query": q_rows[i], "row": rows[j], "vec_id": ids[j], "score": blocks.products(q[i], v[j])}))
        self.rows += len(i)

    def cut(self) -> pa.Table:
        whole = pa.concat_tables(self.held)
        order = np.lexsort((whole.column("row").to_numpy(), whole.column("query").to_numpy()))
        pair = np.stack([whole.column(n).to_numpy()[order] for n in ("query", "row")])
        fresh = np.append(True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)) if len(order) else np.zeros(0, bool)
        whole = blocks.best(whole.take(pa.array(order[fresh])), ["query"], "score", ["vec_id", "row"], self.k)
        self.held, self.rows = [whole], whole.num_rows
        return whole


def ranked(dealt: DataFrame, k: int) -> DataFrame:
    """(query, row, vec_id, score): of each query the k best candidates of every task that reach its `least`, scored exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Ranking(k)
        for whole in runs(batches, _CELL, 2_000):
            ends = [*changes(whole, _CELL).tolist(), whole.num_rows]
            side, rows, ids, v, least = (single(whole, n) for n in ("side", "row", "vec_id", "v", "least"))
            side, rows, ids, least = side.to_numpy(), rows.to_numpy(), ids.to_numpy(), least.fill_null(-np.inf).to_numpy()
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                cut = start + int((side[start:end] == 0).sum())
                if start < cut < end:
                    m = v.slice(start, end - start).flatten().to_numpy().astype(np.float64, copy=False).reshape(end - start, -1)
                    best.add(rows[start:cut], m[: cut - start], least[start:cut], rows[cut:end], ids[cut:end], m[cut - start :])
            if best.rows > 500_000:
                kept = best.cut()
                if kept.num_rows > 250_000:
                    yield from kept.to_batches()
                    best = _Ranking(k)
        if best.held:
            yield from best.cut().to_batches()

    return dealt.mapInArrow(run, "query bigint, row bigint, vec_id bigint, score double")


def _first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(df: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of all other rows for each row whose id is divisible by `every`."""
    spark = df.sparkSession
    with blocks.batches(spark):
        whole = materialise(vectors(df, vec_id, vector), "vectors")
        same = Window.partitionBy("v").orderBy("vec_id", "row")
        rows = materialise(whole.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"), "rows")
        queries = whole.where(F.pmod("vec_id", F.lit(every)) == 0)
        forms = shapes(rows)
        radii = fitted(rows, queries, forms, k)
        placed = materialise(place(rows, forms), "placed")
        asked = materialise(probed(queries, forms, radii), "asked")
        cut = materialise(grid(placed, asked), "grid")
        last = rounds(asked, cut) - 1
        found = spark.createDataFrame([], "query bigint, row bigint, vec_id bigint, score double, rank int")
        for at in range(last + 1):
            least = found.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("least"))
            scored = found.drop("rank").unionByName(ranked(cells(placed, asked, cut, least, at, last), k))
            found = materialise(_first(scored.groupBy("query", "row").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score")), k), "found")
        # Queries with fewer than k rows: all rows of their length are candidates for them.
        few = queries.join(found.where(F.col("rank") == k).select(F.col("query").alias("row")), "row", "left_anti")
        rest = blocks.nearest(few.select(F.col("row").alias("query"), "v"), rows.select("vec_id", "row", "v"), k, ("vec_id", "row"), apart="row")
        names = whole.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
        done = found.join(few.select(F.col("row").alias("query")), "query", "left_anti").unionByName(rest.select("query", "row", "vec_id", "score", "rank"))
        return materialise(done.join(names, "query").select("query_id", "rank", "vec_id", "score"), "nearest")
