"""Python workers and this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reach_workers(spark: SparkSession | None) -> None:
    """Let Python workers import this package from where the driver has it, if that folder is there for them as well."""
    if spark is None:
        return
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, ROOT])


_local_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode without it a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='quarry-stored-')}")


def _delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended before the program
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and the planner knows its size. Deleted when the program ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
