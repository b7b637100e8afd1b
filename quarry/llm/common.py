"""What the operators of this subpackage share: scratch tables, Arrow helpers and column checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.runtime import reach_workers

#: Rows and bytes that one Arrow batch may hold: the unit of work of every Python worker here.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_local_root: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to ours; limits that are already lower stay. Workers get to see this package."""
    reach_workers(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = (spark.conf.get(name) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='quarry-')}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted at exit at the latest."""
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and its true size is known to the planner."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(spark: SparkSession, parts: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """Written parts, one after the other, as one table: each is appended and released, so the plan does not grow with their number."""
    path = scratch(spark, name)
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(path)
        release(part)
    return spark.read.schema(spark.createDataFrame([], schema).schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the scratch table that df was read from; only for tables that nothing reads any more."""
    files = df.inputFiles()
    for spark, path in list(_written):
        if any(f"{path.split('://')[-1]}/" in f for f in files):
            _delete(spark, path)
            _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the context may be gone at exit
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def utf8(df: DataFrame, column: str) -> F.Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit("")).cast("binary")


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, as one array, and its n + 1 offsets (no copy)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Rows sorted by keys, regrouped into tables that end where a key ends and hold at least `least` rows (but the last)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cut = _last_change(whole, keys)
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
            rows = whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def single(whole: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    found = whole.column(name).combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def changes(whole: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a row's keys differ from those of the row before."""
    differs = np.zeros(max(0, whole.num_rows - 1), dtype=bool)
    for key in keys:
        values = single(whole, key)
        differs |= np.asarray(pa.compute.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False), dtype=bool)
    return np.flatnonzero(differs) + 1


def _last_change(whole: pa.Table, keys: list[str]) -> int:
    found = changes(whole, keys)
    return int(found[-1]) if len(found) else 0
