"""Continuous ingestion: new and changed files of a folder as a stream, each micro-batch through the sync of its own files alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.ingest import KnowledgeBase
from quarry.providers import Embedder
from quarry.runtime import materialise
from quarry.sources import datasource, files, office, pdf

#: State of this size goes with the number of files, so it is kept in a store on disk and not in the executors' memory.
STORE, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Changes(StatefulProcessor):
    """Of each path the time and size that were last seen; a file goes on only if it differs from them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "mtime bigint, length bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        latest = pd.concat(list(rows)).sort_values("mtime").tail(1)  # a path is once in a listing
        now = (int(latest["mtime"].iloc[0]), int(latest["length"].iloc[0]))
        if not self.seen.exists() or tuple(self.seen.get()) != now:
            self.seen.update(now)
            yield latest[["abs_path", "mtime", "length"]]

    def close(self) -> None:
        pass


def changes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (abs_path, mtime, length): files under the root that are new, or differ from what the stream has seen. No file is opened."""
    datasource.register(spark)
    listed = spark.readStream.format(datasource.LISTING).load(root)
    return listed.groupBy("abs_path").transformWithStateInPandas(Changes(), "abs_path string, mtime bigint, length bigint", "Append", "None")


def watch(spark: SparkSession, kb: KnowledgeBase, root: str, checkpoint: str, kb_id: str | None = None, provider: Embedder | None = None, once: bool = False) -> StreamingQuery:
    """A query that syncs files as they arrive or change: a micro-batch lists the folder, and opens its own files alone.

    The sync compares with the records, so a batch that runs again does no harm. Files that go are marked by a full sync.
    """

    def sync(batch: DataFrame, _: int) -> None:
        found = materialise(batch, "changes")  # once: state is not to be read again for each use
        paths = [r["abs_path"] for r in found.select("abs_path").toLocalIterator()]
        if paths:
            only = files.listed(files.some(spark, root, paths), root)
            kb.ingest(root, kb_id, provider, pdf=pdf.reader() if pdf.available() else None, doc=office.first_of(office.doc_by_package, office.doc_by_office), only=only)

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, PROVIDER)
    try:
        writer = changes(spark, root).writeStream.outputMode("append").foreachBatch(sync).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
