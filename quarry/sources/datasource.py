"""Folders of files as a format that Spark reads, and file contents as a table function of SQL.

    register(spark)
    spark.read.format("folder_documents").option("kinds", "docx,xlsx").load("/folder")
    SELECT d.* FROM binary_files f, LATERAL parse_file(f.path, f.content) d

Both give DOCUMENT rows: a page, a table row or a whole text each, and one row with the error for a file that cannot be read. The format lists the folder once and deals files to partitions by their size; files
of kinds that are not asked for are never opened. (Kinds are an option and no pushed filter: Spark keeps what a filter was pushed to for later queries of the same frame, which would lose
rows there.) It opens files by itself, from local folders or what pyarrow's file systems reach; for stores that
only Spark's readers reach there is the function, over binaryFile rows. `folder_listing` is the folder's listing as a stream, which Spark's own file stream is not: that one gives each path once, and
no file that has changed.
"""

from __future__ import annotations

import hashlib
import re
import traceback
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarry.functions.encoding import decode_bytes, garbled, repair_text
from quarry.runtime import reach_workers
from quarry.schemas import DOCUMENT
from quarry.sources import files, ocr, office, pdf

NAME, LISTING, FUNCTION = "folder_documents", "folder_listing", "parse_file"
#: Bytes of files that one partition reads, unless the option of this name says otherwise.
PARTITION_BYTES = "partitionBytes"
DEFAULT_BYTES = 32 << 20
#: Rows of a listing in one partition of the stream.
LISTED = 10_000


def rows(path: str, content: bytes) -> list[tuple]:
    """DOCUMENT rows of one file."""
    kind = _suffix(path)
    try:
        if kind in files.TEXT:
            text = decode_bytes(content)
            text = re.sub(r"\r\n?", "\n", repair_text(text) if garbled(text) else text).strip()
            return [(path, 0, text, kind[1:], None, None, None, None, None)] if text else []
        found = files.parse_one(path, kind, content, None, pdf.reader() if pdf.available() else None, office.first_of(office.doc_by_package, office.doc_by_office), ocr.Retry())
        return [(path, *r, None) for r in found]
    except Exception as failure:  # noqa: BLE001  one bad file must not end the run
        return [(path, 0, None, kind[1:], None, None, None, None, str(failure) or traceback.format_exc(limit=1))]


def _suffix(path: str) -> str:
    found = re.search(r"(?<=.)\.[^.]+$", path.rsplit("/", 1)[-1])
    return found[0].lower() if found else ""


def known() -> set[str]:
    return {*files.TEXT, ".docx", ".doc", ".xlsx", ".xls", ".pdf"}


@dataclass
class Files(InputPartition):
    """Some files of a folder."""

    paths: list[str]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get(PARTITION_BYTES, DEFAULT_BYTES))
        asked = [k.strip().lower().lstrip(".") for k in options.get("kinds", "").split(",") if k.strip()]
        self.kinds = {k[1:] for k in known()} & set(asked) if asked else {k[1:] for k in known()}

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def listed(self) -> list[fs.FileInfo]:
        store, root = self._at()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f for f in found if f.is_file and _suffix(f.path)[1:] in self.kinds), key=lambda f: f.path)

    def partitions(self) -> list[Files]:
        dealt: list[Files] = []
        held = self.most
        for f in self.listed():
            if held + f.size > self.most and (held or not dealt):
                dealt.append(Files([]))
                held = 0
            dealt[-1].paths.append(f.path)
            held += f.size
        return dealt or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._at()
        for path in partition.paths:
            try:
                with store.open_input_file(path) as opened:
                    found = rows(path, opened.read())
            except OSError as failure:
                found = [(path, 0, None, _suffix(path)[1:], None, None, None, None, str(failure))]
            if found:
                yield files.shaped(found)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(self.options)


class FolderStream(DataSourceStreamReader):
    """The listing of a folder, again whenever it differs; an offset is a digest of names, times and sizes."""

    def __init__(self, options: dict):
        self.folder = FolderReader({**options, "kinds": ""})
        self.folder.kinds = None

    def _rows(self) -> list[tuple[str, int, int]]:
        store, root = self.folder._at()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.path, f.mtime_ns // 1_000_000, f.size) for f in found if f.is_file)

    def initialOffset(self) -> dict:
        return {"digest": ""}

    def latestOffset(self) -> dict:
        return {"digest": hashlib.sha256(repr(self._rows()).encode()).hexdigest()}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        """What is there now: of a batch that runs again, the state behind it lets go on what it has not seen."""
        if start == end:
            return [Rows([])]
        found = self._rows()
        return [Rows(found[i : i + LISTED]) for i in range(0, len(found), LISTED)] or [Rows([])]

    def read(self, partition: Rows) -> Iterator[tuple]:
        yield from partition.rows


@dataclass
class Rows(InputPartition):
    """Some rows of a listing."""

    rows: list[tuple[str, int, int]]


class FolderListing(DataSource):
    """(abs_path, mtime, length) of the files in a folder, as a stream."""

    @classmethod
    def name(cls) -> str:
        return LISTING

    def schema(self) -> str:
        return "abs_path string, mtime bigint, length bigint"

    def streamReader(self, schema: object) -> FolderStream:
        return FolderStream(self.options)


class ParseFile:
    """The table function."""

    def eval(self, path: str, content: bytes):
        if path is not None and content is not None:
            yield from rows(re.sub(r"^file:/+", "/", path), bytes(content))


def register(spark: SparkSession) -> None:
    """Make the format and the function known to the session."""
    reach_workers(spark)
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(FolderListing)
    spark.udtf.register(FUNCTION, F.udtf(ParseFile, returnType=DOCUMENT))
