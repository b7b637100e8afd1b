"""Context, citations and answers from ranked hits."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import format_source
from quarry.operators import blocks as vectors
from quarry.runtime import materialise
from quarry.schemas import DELETED

#: Fixed value: the answer when the knowledge base has none.
FALLBACK = "无法从知识库中找到依据"


def blocks(hits: DataFrame) -> DataFrame:
    """hits with `block`, the labelled text."""
    label = format_source(F.col("source"), F.col("page"))
    return hits.withColumn("block", F.concat(F.lit("["), label, F.lit("]\n"), F.coalesce("text", F.lit(""))))


def context(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One text for each query: all blocks in the order of rank, parted by a blank line."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return blocks(hits).groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("context"))


#: Bytes of text in one piece of a digest.
PIECE = 1 << 20


def context_digest(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, md5): of each query's context as `context` gives it, which is nowhere whole: neighbours are packed into pieces, and one task reads the pieces of a query in their order.

    A digest of one text runs through it once and cannot be dealt out; what its task holds is a piece. Ranks are numbers that differ within a query.
    """
    kind = hits.schema[by].dataType
    rows = blocks(hits).select(by, "rank", F.col("block").cast("binary").alias("block")).sortWithinPartitions(by, "rank")
    pieces = T.StructType([T.StructField(by, kind), T.StructField("rank", hits.schema["rank"].dataType), T.StructField("piece", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, first, last, held, size = None, None, None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first[0]], schema.field(0).type), pa.array([first[1]], schema.field(1).type), pa.array([zlib.compress(b"\n\n".join(held), 6)], pa.binary())], names=[by, "rank", "piece"])

        for batch in batches:
            schema = batch.schema
            for key, rank, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (size > PIECE or last != (key, rank - 1)):
                    yield piece()
                    held, size = [], 0
                if not held:
                    first = (key, rank)
                held.append(block)
                size, last = size + len(block), (key, rank)
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, found = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([found.hexdigest()])], names=[by, "md5"])

        for batch in batches:
            schema = batch.schema
            for key, piece in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if found is not None and key == now:
                    found.update(b"\n\n")
                else:
                    if found is not None:
                        yield row()
                    now, found = key, hashlib.md5(usedforsecurity=False)
                found.update(zlib.decompress(piece.as_py()))
        if found is not None:
            yield row()

    with vectors.batches(hits.sparkSession):
        packed = rows.mapInArrow(pack, pieces).repartition(by).sortWithinPartitions(by, "rank")
        return materialise(packed.mapInArrow(digest, T.StructType([T.StructField(by, kind), T.StructField("md5", T.StringType())])), "digests")


#: Characters of the shortest block with its line end.
LEAST = 4


def trimmed_context(hits: DataFrame, most: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The longest run of blocks from the first whose lengths (with their line ends) fit `most`; 0 or less: all of them."""
    if most <= 0:
        return context(hits, by)
    order = Window.partitionBy(*by).orderBy("rank")
    # No block fits behind the first most / LEAST ones, and of one that is too long only its length counts: so little of a query comes to its task.
    line = F.concat("block", F.lit("\n"))
    short = blocks(hits).select(*by, "rank", F.length(line).cast("bigint").alias("size"), F.when(F.length(line) <= most, line).alias("block"))
    early = short.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(1, most // LEAST))
    sized = early.withColumn("used", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.when(F.col("used") <= most, F.struct("rank", "block"))))
    joined = F.array_join(F.transform(listed, lambda x: x["block"]), "\n")
    return sized.groupBy(*by).agg(F.regexp_replace(joined, r"(?U)^\s+|\s+$", "").alias("context"))


def citations(hits: DataFrame, records: DataFrame | None = None, listing: DataFrame | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first hit of each source and page, in the order of rank; deleted if its record says so or no listed file has its path."""
    first = Window.partitionBy(*by, "source", "page").orderBy("rank")
    cited = hits.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*by, "rank", "source", "page", "doc_id")
    gone = F.lit(False)
    if records is not None:
        marks = records.select(F.col("abs_path").alias("source"), (F.coalesce("source_deleted", F.lit(False)) | F.coalesce(F.col("status") == DELETED, F.lit(False))).alias("marked"))
        cited = cited.join(marks, "source", "left")
        gone = F.coalesce("marked", F.lit(False))
    if listing is not None:
        cited = cited.join(listing.select(F.col("abs_path").alias("source"), F.lit(True).alias("listed")), "source", "left")
        gone = gone | F.col("listed").isNull()
    return cited.select(*by, "rank", "source", "page", "doc_id", gone.alias("source_deleted"))


@dataclass
class Answer:
    answer: str
    citations: list[dict] = field(default_factory=list)
    context: str = ""
    error: str | None = None


def answer(question: str, hits: DataFrame, llm: Callable[[str, str], str] | None, most: int = 12000, records: DataFrame | None = None, listing: DataFrame | None = None) -> Answer:
    """hits: the few rows of one query. Without hits, without a model, or where it says nothing, the fallback; where it fails, that and the error."""
    one = hits.withColumn("query_id", F.lit(0))
    cited = [r.asDict() for r in citations(one, records, listing).drop("query_id").orderBy("rank").collect()]
    if not cited:
        return Answer(FALLBACK)
    text = trimmed_context(one, most).first()["context"]
    if llm is None:
        return Answer(FALLBACK, cited, text)
    try:
        return Answer(llm(question, text).strip() or FALLBACK, cited, text)
    except Exception as failure:  # noqa: BLE001  a provider may fail in any way; the hits are still of use, and the failure is told
        return Answer(FALLBACK, cited, text, str(failure) or type(failure).__name__)
