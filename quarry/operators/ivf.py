"""Vector search by an inverted file: rows lie in the lists of their nearest centroids, and a query reads the lists nearest to it.

Centroids are fitted on a bounded sample of `SAMPLE` rows at most (drawn by a hash of the key); every row is assigned. Lists are partitions on disk, so a question reads the
folders of its lists and no others; many questions meet the lists by a join of blocks. What is read is scored exactly, by cosine, with ties by key.

How many lists a query reads is fitted as well: the least number at which `RECALL` of the true `K` neighbours of `TRIED` rows would be found. `probes` overrides it; 0 reads all lists, which gives
the exact result. A list with many rows is written by several tasks.

Rows without a vector, with a zero one, or with one that holds null or non-finite components are not in the index; all vectors have one length.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import blocks, dense
from quarry.runtime import materialise

SAMPLE, LEAST_ROWS, MOST_LISTS = 65_536, 40, 1_024
ROUNDS = 10
TRIED, K, RECALL = 128, 10, 0.95
#: Rows of a list that one task writes.
FILE_ROWS = 100_000


def _units(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(most > 0, most, 1)
    lengths = np.sqrt((v**2).sum(axis=1, keepdims=True))
    return v / np.where(lengths > 0, lengths, 1)


def cluster(v: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors on the sphere, from evenly spaced rows on; a centroid that loses all rows takes the row that is farthest from its own."""
    at = v[np.linspace(0, len(v) - 1, lists).astype(int)]
    for _ in range(rounds):
        near = v @ at.T
        mine = near.argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, mine, v)
        empty = np.flatnonzero(np.bincount(mine, minlength=lists) == 0)
        sums[empty] = v[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        at = _units(sums)
    return at


@dataclass(frozen=True)
class Index:
    """An index that is stored under `path`: `rows` partitioned by list, and what was fitted."""

    path: str
    key: str
    centroids: np.ndarray
    probes: int

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        told = json.loads(spark.read.text(f"{path}/fitted").first()[0])
        centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        return cls(path, told["key"], np.array([r["v"] for r in centroids], np.float64), told["probes"])

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def nearest_lists(self, v: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The lists that each vector reads, nearest first."""
        n = self.probes if probes is None else probes
        return np.argsort(-(_units(v) @ self.centroids.T), axis=1, kind="stable")[:, : n or len(self.centroids)]


def _sample(rows: DataFrame, key: str, n: int) -> np.ndarray:
    found = rows.select(key, "embedding", F.xxhash64(key).alias("h")).orderBy("h", key).limit(n).select("embedding").collect()
    return np.array([r["embedding"] for r in found], np.float64)


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with `list`, the nearest centroid's number."""
    at = rows.columns.index("embedding")
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column(at).flatten().to_numpy(), np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((_units(v) @ shared.value.T).argmax(axis=1), pa.int32())], names=[*batch.schema.names, "list"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, list int")


def build(chunks: DataFrame, path: str, key: str = "chunk_key", lists: int | None = None) -> Index:
    """Fit, assign and write; lists: the square root of the number of rows unless told, within bounds."""
    spark = chunks.sparkSession
    rows = chunks.where(blocks.whole("embedding") & F.exists("embedding", lambda x: x != 0))
    with blocks.batches(spark):
        n, low, high = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if low != high:
            raise ValueError(f"vectors of different dimensions: {low} to {high}")
        sample = _units(_sample(rows, key, SAMPLE)) if n else np.zeros((0, 1))
        count = max(1, min(lists or round(math.sqrt(n)), MOST_LISTS, len(sample) // LEAST_ROWS or 1))
        centroids = cluster(sample, count) if n else np.zeros((1, 1))
        found = materialise(assigned(rows, centroids), "assigned")
        # At most MOST_LISTS rows: how many tasks write a list.
        files = found.groupBy("list").agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))
        dealt = found.join(F.broadcast(files), "list").withColumn("file", F.pmod(F.xxhash64(key), F.col("files"))).repartition("list", "file").drop("files", "file")
        dealt.write.partitionBy("list").parquet(f"{path}/rows") if n else rows.withColumn("list", F.lit(0)).write.parquet(f"{path}/rows")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        probes = _fitted(found, key, centroids) if n else 1
        spark.createDataFrame([(json.dumps({"key": key, "probes": probes}),)], "value string").coalesce(1).write.text(f"{path}/fitted")
    return Index(path, key, centroids, probes)


def _fitted(found: DataFrame, key: str, centroids: np.ndarray) -> int:
    """The least number of lists at which RECALL of the true neighbours of TRIED rows are found."""
    tried = materialise(found.select(key, "embedding", F.xxhash64(key).alias("h")).orderBy(F.desc("h"), key).limit(TRIED).select(F.col(key).alias("query"), F.col("embedding").alias("v")), "tried")
    true = blocks.nearest(tried, found.select(F.col(key).alias("key"), F.col("embedding").alias("v")), K, cosine=True, apart="key")
    pairs = true.select("query", "key").join(tried, "query").join(found.select(F.col(key).alias("key"), "list"), "key").select("v", "list").collect()  # TRIED * K rows
    if not pairs:
        return len(centroids)
    near = -(_units(np.array([r["v"] for r in pairs], np.float64)) @ centroids.T)
    place = (near < near[np.arange(len(pairs)), [r["list"] for r in pairs], None]).sum(axis=1)
    return int(np.quantile(place, RECALL, method="higher")) + 1


def search_one(spark: SparkSession, index: Index, vector: list[float], limit: int, probes: int | None = None, where: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """As dense.search_one, over the question's lists: other folders are not read."""
    lists = index.nearest_lists(np.array([vector], np.float64), probes)[0].tolist()
    near = F.col("list").isin(lists)
    return dense.search_one(index.rows(spark), vector, limit, index.key, near if where is None else near & where, by).drop("list")


def search(index: Index, queries: DataFrame, limit: int, probes: int | None = None) -> DataFrame:
    """(query_id, key, score, rank) for all queries (query_id, embedding) over their lists; queries without a whole vector take no part."""
    spark, key = queries.sparkSession, index.key
    shared = spark.sparkContext.broadcast(index)
    asked = queries.where(blocks.whole("embedding") & (F.size("embedding") == index.centroids.shape[1])).select(F.col("query_id").alias("query"), F.col("embedding").cast("array<double>").alias("v"))
    query = asked.schema["query"].dataType.simpleString()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.nearest_lists(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel(), pa.int32()))], names=["query", "v", "lists"])

    with blocks.batches(spark):
        probing = asked.mapInArrow(lists, f"query {query}, v array<double>, lists array<int>").select("query", "v", F.explode("lists").alias("list"))
        mine = materialise(blocks.packed(probing.repartition("list").sortWithinPartitions("list"), "v", blocks.QUERIES, by="list"), "probing")
        rows = index.rows(spark).select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("v"), "list")
        held = materialise(blocks.packed(rows.sortWithinPartitions("list"), "v", blocks.ROWS, by="list"), "lists")
        kind = rows.schema["key"].dataType.simpleString()
        scored = blocks.pairs(mine, held, lambda block: blocks.Nearest(block, limit, ["key"], cosine=True), f"query {query}, key {kind}, score double", on="list")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        return materialise(best.select(F.col("query").alias("query_id"), F.col("key").alias(key), "score", "rank"), "nearest")
