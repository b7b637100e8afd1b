"""Vectors as blocks: a stated set of queries against all rows of a table, as products of matrices inside tasks.

`packed` turns rows into rows that hold whole blocks, of at most so many rows each; `pairs` sets every block of queries against every block of rows in one job,
whatever the number of queries, and lets a function look at each pair. Neither passes the driver, and what a task holds is two blocks and what the function keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.runtime import materialise, reach_workers

#: Rows of a block of queries, and of a block of rows.
QUERIES, ROWS = 256, 2_048
#: What one Arrow batch may hold: a few blocks.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
#: States of blocks of queries that a task keeps; beyond it hands on what it has and starts anew.
STATES = 64


@contextmanager
def batches(spark: SparkSession, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[None]:
    """Within, Arrow batches are bounded in rows and bytes; the session's own settings come back behind it. Only for jobs that also run within."""
    reach_workers(spark)
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": most}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _is_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType)


def packed(rows: DataFrame, vector: str, most: int = ROWS, *, by: str | None = None) -> DataFrame:
    """(size, n, one array for each column): blocks of rows whose vectors have the same length, `size`; array columns are flattened and have a fixed length each.

    Rows of a partition are packed in their order. With `by`, which sorts each partition, a block holds rows of one value, which is a column of its own.
    """
    fields = [(f.name, f.dataType.elementType if _is_list(f.dataType) else f.dataType, _is_list(f.dataType)) for f in rows.schema if f.name != by]
    schema = T.StructType([*([T.StructField(by, rows.schema[by].dataType)] if by else []), T.StructField("size", T.IntegerType()), T.StructField("n", T.IntegerType()), *[T.StructField(name, T.ArrayType(kind)) for name, kind, _ in fields]])
    names = [f.name for f in schema]

    def block(part: pa.Table, size: int, value: pa.Scalar | None) -> pa.RecordBatch:
        columns: list[pa.Array] = [] if value is None else [pa.array([value.as_py()], value.type)]
        columns += [pa.array([size], pa.int32()), pa.array([part.num_rows], pa.int32())]
        for name, _, nested in fields:
            chunks = part.column(name).chunks
            flat = pa.concat_arrays([c.flatten() if nested else c for c in chunks])
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        value: pa.Scalar | None = None
        for batch in batches:
            for part in _parts(batch, by):
                if by and part.column(by)[0] != value:
                    yield from (block(pa.Table.from_batches(mine), size, value) for size, mine in held.items() if mine)
                    held, value = {}, part.column(by)[0]
                sizes = pa.compute.list_value_length(part.column(vector)).to_numpy(zero_copy_only=False)
                for size in np.unique(sizes).tolist():
                    mine = held.setdefault(size, [])
                    mine.append(part.filter(pa.array(sizes == size)))
                    while sum(b.num_rows for b in mine) >= most:
                        whole = pa.Table.from_batches(mine)
                        yield block(whole.slice(0, most), size, value)
                        mine[:] = whole.slice(most).to_batches()
        yield from (block(pa.Table.from_batches(mine), size, value) for size, mine in held.items() if mine)

    return rows.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, by: str | None) -> Iterator[pa.RecordBatch]:
    """The batch, or its runs of equal values."""
    if not batch.num_rows:
        return
    ends = [batch.num_rows]
    if by:
        values = batch.column(by)
        ends = [*(np.flatnonzero(pa.compute.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
    for start, end in zip([0, *ends[:-1]], ends, strict=True):
        yield batch.slice(start, end - start)


class Block:
    """One packed block inside a task: arrays by column name; `matrix` gives an array column as rows."""

    def __init__(self, n: int, size: int, columns: dict[str, pa.Array]):
        self.n, self.size, self.columns = n, size, columns

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name].to_numpy(zero_copy_only=False)

    def matrix(self, name: str, kind: type = np.float64) -> np.ndarray:
        return np.asarray(self[name], kind).reshape(self.n, -1)


def _blocks(batch: pa.RecordBatch, prefix: str) -> Iterator[Block]:
    names = [n for n in batch.schema.names if n.startswith(prefix)]
    fixed = {f"{prefix}size", f"{prefix}n"}
    for i in range(batch.num_rows):
        columns = {n.removeprefix(prefix): batch.column(n)[i].values for n in names if n not in fixed}
        yield Block(batch.column(f"{prefix}n")[i].as_py(), batch.column(f"{prefix}size")[i].as_py(), columns)


#: Makes the state of a block of queries; a state takes blocks of rows, and gives what it has found.
State = Callable[[Block], "Seen"]


class Seen:
    """What a task keeps of one block of queries."""

    def add(self, rows: Block) -> None:
        raise NotImplementedError

    def found(self) -> pa.RecordBatch:
        raise NotImplementedError


def pairs(queries: DataFrame, rows: DataFrame, state: State, schema: str, on: str | None = None) -> DataFrame:
    """What the states of all packed query blocks have found in all packed row blocks of their size; several rows may come for a query, from several tasks.

    The queries are a stated set, met with all rows block by block: one row of this product is two whole blocks. The planner broadcasts the smaller side if
    it is below its threshold, and else sets partitions against each other. With `on`, only blocks of equal values meet, by an ordinary join.
    """
    mine = queries.select(F.monotonically_increasing_id().alias("block"), *[F.col(c).alias(f"q_{c}") for c in queries.columns])
    theirs = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple[int, Seen]] = {}
        for batch in batches:
            for at, q, r in zip(batch.column("block").to_pylist(), _blocks(batch, "q_"), _blocks(batch, "r_"), strict=True):
                if q.size != r.size:
                    continue
                if at not in states:
                    if len(states) == STATES:
                        yield from (s.found() for s in states.values())
                        states.clear()
                    states[at] = state(q)
                states[at].add(r)
        yield from (s.found() for s in states.values())

    met = mine.join(theirs, mine[f"q_{on}"] == theirs[f"r_{on}"]).drop(f"q_{on}", f"r_{on}") if on else mine.crossJoin(theirs)
    return met.mapInArrow(run, schema)


def best(rows: pa.Table, by: list[str], score: str, key: list[str], k: int) -> pa.Table:
    """The k rows of each group with the highest scores, ties by key."""
    order = rows.sort_by([*[(c, "ascending") for c in by], (score, "descending"), *[(c, "ascending") for c in key]])
    if not order.num_rows:
        return order
    changed = np.zeros(order.num_rows, bool)
    changed[0] = True
    for c in by:
        values = order.column(c).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(changed)
    place = np.arange(order.num_rows) - np.repeat(starts, np.diff(np.append(starts, order.num_rows)))
    return order.filter(pa.array(place < k))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of a with the same row of b; a pair gives the same value wherever it stands."""
    return np.einsum("ij,ij->i", np.ascontiguousarray(a), np.ascontiguousarray(b))


class Nearest(Seen):
    """The k rows with the largest inner product, or cosine, for each query of a block; ties by the keys."""

    def __init__(self, queries: Block, k: int, keys: list[str], cosine: bool = False, apart: str | None = None):
        self.k, self.keys, self.cosine, self.apart = k, keys, cosine, apart
        self.queries, self.vectors = queries.columns["query"], queries.matrix("v")
        self.own = queries["query"] if apart else None
        self.lengths = np.sqrt(products(self.vectors, self.vectors))
        self.least = np.full(queries.n, -np.inf)
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, rows: Block) -> None:
        v = rows.matrix("v")
        lengths = np.sqrt(products(v, v))
        with np.errstate(over="ignore", invalid="ignore"):
            rough = self.vectors @ v.T
            # Products of a matrix may differ from those of a pair in their last digits.
            slack = self.lengths * lengths.max(initial=0) * rows.size * 2.0**-50
            if self.cosine:
                both = self.lengths[:, None] * lengths[None, :]
                rough = np.divide(rough, both, out=np.zeros_like(rough), where=both > 0)
                slack = np.full(len(self.lengths), rows.size * 2.0**-50)
        slack[~np.isfinite(slack)] = 0
        if self.apart:
            rough[self.own[:, None] == rows[self.apart][None, :]] = -np.inf
        if rows.n >= self.k:
            self.least = np.maximum(self.least, np.partition(rough, rows.n - self.k, axis=1)[:, rows.n - self.k])
        q, r = np.nonzero((rough >= (self.least - slack)[:, None]) & (rough > -np.inf))
        score = products(self.vectors[q], v[r])
        if self.cosine:
            both = self.lengths[q] * lengths[r]
            score = np.divide(score, both, out=np.zeros_like(score), where=both > 0)
        self.held.append(pa.table({"at": q, "query": self.queries.take(pa.array(q)), **{c: rows.columns[c].take(pa.array(r)) for c in self.keys}, "score": score}))
        self.rows += len(q)
        if self.rows > 4 * self.k * len(self.least) + ROWS:
            self._cut()

    def _cut(self) -> pa.Table:
        whole = best(pa.concat_tables(self.held), ["at"], "score", self.keys, self.k)
        self.held, self.rows = [whole], whole.num_rows
        return whole

    def found(self) -> pa.RecordBatch:
        whole = self._cut().drop(["at"])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in whole.columns], names=whole.column_names)


def nearest(queries: DataFrame, rows: DataFrame, k: int, keys: tuple[str, ...] = ("key",), cosine: bool = False, apart: str | None = None) -> DataFrame:
    """(query, keys, score, rank) from queries (query, v) and rows (keys, v): the k best rows of each query, exactly, ties by the keys in their order.

    `apart` names a key by which a row does not meet the query of the same value. Blocks are written first, so that no pair packs them again. Run within `batches`.
    """
    doubles = F.col("v").cast("array<double>").alias("v")
    count = max(1, -(-queries.count() // QUERIES))
    asked = materialise(packed(queries.select("query", doubles).repartition(count), "v", QUERIES), "queries")
    held = materialise(packed(rows.select(*keys, doubles), "v"), "rows")
    kinds = [f"query {queries.schema['query'].dataType.simpleString()}", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys]]
    scored = pairs(asked, held, lambda block: Nearest(block, k, list(keys), cosine, apart), ", ".join([*kinds, "score double"]))
    order = Window.partitionBy("query").orderBy(F.desc("score"), *keys)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole(vector: str) -> Column:
    """The vector is there, not empty, and all of its components are finite."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
