"""Folders of files as tables: listing, hashing, and page or row documents of each format.

Binary formats are parsed by mapInArrow over binaryFile rows; plain text stays in columns.
"""

from __future__ import annotations

import re
import traceback
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.encoding import decode
from quarry.functions.text import normalize, suffix
from quarry.runtime import reach_workers
from quarry.schemas import DOCUMENT
from quarry.sources import office, ocr

TEXT = (".txt", ".csv")
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")

_ARROW = pa.schema([("abs_path", pa.string()), ("doc_pos", pa.int32()), ("text", pa.string()), ("source_type", pa.string()), ("page", pa.int32()), ("sheet", pa.string()), ("row", pa.int32()), ("is_header", pa.bool_()), ("error", pa.string())])


def files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under the root: path, modificationTime, length, content (read only if asked for)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def some(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Some files under the root, as `files` gives them; no other file is opened. Their paths are on the driver, as Spark's own list of files is."""
    local = root.startswith("file:")
    # Characters that a path may hold and a pattern would read otherwise.
    plain = [re.sub(r"([\\{}\[\]*?])", r"\\\1", f"file://{p}" if local and p.startswith("/") else p) for p in paths]
    if not plain:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    return spark.read.format("binaryFile").load(plain)


def listing(spark: SparkSession, root: str, with_hash: bool = True) -> DataFrame:
    """(abs_path, rel_path, suffix, hash, mtime, length); mtime in milliseconds."""
    return listed(files(spark, root), root, with_hash)


def listed(found: DataFrame, root: str, with_hash: bool = True) -> DataFrame:
    """The listing of binaryFile rows."""
    path = F.regexp_replace("path", r"^file:/+", "/")
    base = root.replace("file://", "").rstrip("/")
    return found.select(
        path.alias("abs_path"),
        F.substring(path, len(base) + 2, 1 << 20).alias("rel_path") if base.startswith("/") else path.alias("rel_path"),
        suffix(path).alias("suffix"),
        (F.sha2("content", 256) if with_hash else F.lit(None).cast("string")).alias("hash"),
        F.unix_millis("modificationTime").alias("mtime"),
        "length",
    )


def shaped(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def parse_one(path: str, kind: str, content: bytes, engine: Callable | None, pdf: Callable | None, doc: Callable | None, how: ocr.Retry) -> list[tuple]:
    """The documents of a binary file: (doc_pos, text, source_type, page, sheet, row, is_header)."""
    short = kind.lstrip(".")
    if kind in (".xlsx", ".xls"):
        rows = office.xlsx_rows(content) if kind == ".xlsx" else office.legacy_rows(content)
        return [(i, r["text"], short, None, r["sheet"], r["row"], False) for i, r in enumerate(r for r in rows if not r["is_header"] and r["text"].strip())]
    if kind == ".docx":
        return [(i, t, short, i + 1, None, None, None) for i, t in _pages(office.docx_pages(content))]
    if kind == ".doc":
        if doc is None:
            raise RuntimeError("no extractor for .doc files")
        return [(i, t, short, i + 1, None, None, None) for i, t in _pages([doc(content)])]
    if kind == ".pdf":
        if pdf is None:
            raise RuntimeError("no reader for .pdf files")
        return [(i, t, short, i + 1, None, None, None) for i, t in _pages(ocr.pdf_pages(content, pdf, engine, how))]
    if kind in IMAGES:
        if engine is None:
            raise RuntimeError("no OCR engine")
        text = "\n".join(ocr.with_retry(lambda timeout: engine(content, path.rsplit("/", 1)[-1], timeout), how)).strip()
        return [(0, text, short, None, None, None, None)] if text else []
    raise ValueError(f"unsupported suffix {kind}")


def _pages(pages: list[str]) -> Iterator[tuple[int, str]]:
    """Pages that are not blank, with their ordinal."""
    for i, text in enumerate(pages):
        if text.strip():
            yield i, text.strip()


def documents(found: DataFrame, make_ocr: Callable[[], Callable] | None = None, pdf: Callable | None = None, doc: Callable | None = None, how: ocr.Retry | None = None) -> DataFrame:
    """DOCUMENT rows of binaryFile rows; a file that cannot be read gives one row with its error and no text.

    make_ocr builds the OCR engine, once for each Python worker and only where a file needs it.
    """
    how = how or ocr.Retry()
    reach_workers(found.sparkSession)
    path = F.regexp_replace("path", r"^file:/+", "/")
    kinds = found.select(path.alias("abs_path"), suffix(path).alias("kind"), "content")
    plain = kinds.where(F.col("kind").isin(*TEXT)).select("abs_path", normalize(decode(F.col("content"))).alias("text"), F.substring("kind", 2, 10).alias("source_type")).where("text <> ''")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("page", "int"), ("sheet", "string"), ("row", "int"), ("is_header", "boolean"), ("error", "string"))]
    plain = plain.select("abs_path", F.lit(0).alias("doc_pos"), "text", "source_type", *empty)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = ocr.Lazy(make_ocr) if make_ocr else None
        for batch in batches:
            for at, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = [(at, *r, None) for r in parse_one(at, kind, content, engine, pdf, doc, how)]
                except Exception as failure:  # noqa: BLE001  one bad file must not end the run
                    rows = [(at, 0, None, kind.lstrip("."), None, None, None, None, str(failure) or traceback.format_exc(limit=1))]
                if rows:
                    yield shaped(rows)

    binary = kinds.where(~F.col("kind").isin(*TEXT)).mapInArrow(parse, DOCUMENT)
    return plain.unionByName(binary)


def full_texts(docs: DataFrame) -> DataFrame:
    """(abs_path, text) of each file: its documents in order, sheets announced where they change."""
    from pyspark.sql import Window

    order = Window.partitionBy("abs_path").orderBy("doc_pos")
    head = F.when(F.col("sheet").isNotNull() & ~F.col("sheet").eqNullSafe(F.lag("sheet").over(order)), F.concat(F.lit("[Sheet: "), F.col("sheet"), F.lit("]\n"))).otherwise("")
    paged = F.when(F.col("page").isNotNull(), F.concat(F.lit("=== Page "), F.col("page").cast("string"), F.lit(" ===\n\n"))).otherwise("")
    parted = docs.where(F.col("error").isNull()).withColumn("part", F.concat(paged, head, "text"))
    listed = F.array_sort(F.collect_list(F.struct("doc_pos", "part")))
    glue = F.when(F.max("page").isNotNull(), "\n\n").otherwise("\n")
    return parted.groupBy("abs_path").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "\n").alias("joined"), F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n").alias("spaced"), glue.alias("glue")).select("abs_path", F.when(F.col("glue") == "\n\n", F.col("spaced")).otherwise(F.col("joined")).alias("text"))
