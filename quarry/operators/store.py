"""Tables on disk: versioned folders behind numbered pointers, so that nothing is overwritten while a plan reads it, and there is always a pointer."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import chunk_key

#: Pointers that stay, and with them the folders that they name: plans that were made before a write can still end.
KEPT = 3
#: So many folders of a key are left as they are, whatever their sizes.
FEW = 4
#: How often a writer looks again for a pointer that is being written, and how long it waits each time.
LOOKS, WAIT = 20, 0.1


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Table:
    """A Parquet table of folders; readers follow the newest pointer, which lists the folders of every key.

    A key's rows are replaced, or added to, without touching those of other keys. A write makes its folder, then the next pointer, as a file that must not be
    there yet: a writer that dies leaves the old state, and of two at once one finds the number taken. It reads the new pointer and goes again if that
    left its own key alone; else it fails, for what it has written may rest on rows that are gone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = ""):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointers(self) -> list[tuple[int, str]]:
        where, fs = _fs(self.spark, f"{self.path}/pointer-*.json")
        found = [str(s.getPath().getName()) for s in fs.globStatus(where) or ()]
        return sorted((int(n.removeprefix("pointer-").removesuffix(".json")), n) for n in found)

    def _folders(self, name: str) -> dict[str, list[str]] | None:
        """What a pointer lists; None while it is not whole."""
        with suppress(json.JSONDecodeError):
            return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}").collect()))
        return None

    def _state(self) -> tuple[list[tuple[int, str]], dict[str, list[str]]]:
        """All pointers, and the folders of the newest whole one. One that stays unfinished is what a dead writer left."""
        for look in range(LOOKS):
            pointers = self._pointers()
            for _, name in reversed(pointers):
                held = self._folders(name)
                if held is not None:
                    return pointers, held
                if look < LOOKS - 1:
                    break
            else:
                return pointers, {}
            time.sleep(WAIT)
        return pointers, {}

    def held(self, key: str = "") -> list[str]:
        """The names of the key's folders, oldest first."""
        return self._state()[1].get(key, [])

    def folders(self, *keys: str) -> list[str]:
        """The paths of all folders, or of the keys'."""
        return [f"{self.path}/{f}" for k, some in sorted(self._state()[1].items()) if not keys or k in keys for f in some]

    def exists(self) -> bool:
        return bool(self._pointers())

    def read(self, *keys: str) -> DataFrame:
        """All rows, or those of the keys; an empty table if there are none."""
        empty = self.spark.createDataFrame([], self.schema)
        folders = self.folders(*keys)
        return self.spark.read.schema(empty.schema).parquet(*folders) if folders else empty

    def write(self, rows: DataFrame, key: str = "") -> None:
        """The rows in place of the key's; a table that is written without keys is replaced as a whole."""
        self.publish(self._writer(rows), key)

    def append(self, rows: DataFrame, key: str = "") -> None:
        self.publish(self._writer(rows), key, add=True)

    def _writer(self, rows: DataFrame) -> Callable[[str], None]:
        wanted = self.spark.createDataFrame([], self.schema).columns
        return lambda folder: rows.select(*wanted).write.parquet(folder)

    def publish(self, write: Callable[[str], None], key: str = "", add: bool = False, instead_of: int = 0) -> str:
        """Let `write` fill a new folder, and point to it: as the key's only one, behind the others, or in place of so many of the newest. Returns its name."""
        folder = f"v-{uuid.uuid4().hex}"
        pointers, held = self._state()
        mine = held.get(key, [])
        write(f"{self.path}/{folder}")
        after = [*(mine[: len(mine) - instead_of] if add or instead_of else ()), folder]
        while not self._point(pointers[-1][0] + 1 if pointers else 0, held | {key: after}):
            pointers, held = self._state()
            if held.get(key, []) != mine:
                raise RuntimeError(f"{self.path}: {key or 'the table'} was written by someone else; read it again")
        self._sweep(pointers, held | {key: after})
        return folder

    def _point(self, number: int, held: dict[str, list[str]]) -> bool:
        """Write the pointer of this number; False if there is one."""
        target, fs = _fs(self.spark, f"{self.path}/pointer-{number:012d}.json")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as failure:
            if "AlreadyExists" in str(failure):
                return False
            raise
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        return True

    def _sweep(self, pointers: list[tuple[int, str]], held: dict[str, list[str]]) -> None:
        """Delete pointers older than those that stay, and folders that only they name."""
        old, stay = pointers[: max(0, len(pointers) + 1 - KEPT)], pointers[max(0, len(pointers) + 1 - KEPT) :]
        used = {f for folders in [held, *(self._folders(n) or {} for _, n in stay)] for some in folders.values() for f in some}
        for _, name in old:
            gone = {f for some in (self._folders(name) or {}).values() for f in some} - used
            for one in (*gone, name):
                where, fs = _fs(self.spark, f"{self.path}/{one}")
                fs.delete(where, True)

    def drop(self) -> None:
        where, fs = _fs(self.spark, self.path)
        fs.delete(where, True)


def to_fold(sizes: list[int]) -> int:
    """How many of the newest of a key's folders to make one, from sizes in the order of age: those that together are as large as the next older one; 0: none.

    A few may stay as they are. Sizes then grow geometrically, so their number is logarithmic, and a row is rewritten as often.
    """
    taken, total = 0, 0
    for size in reversed(sizes):
        if taken and size > total:
            break
        total += size
        taken += 1
    return taken if taken > 1 and len(sizes) > FEW else 0


class Deltas:
    """A table of rows that are added and removed by key: every change is a folder with its rows and the keys whose older rows are gone.

    Rows and removals carry the number of their change. A row holds unless a later change removes its key; removals in the change of a row itself reach older rows only.
    One change is one pointer, so readers see all of it or nothing. Folders are folded by size (`to_fold`): what a change writes goes with what it changes, and other folders stay.
    """

    def __init__(self, table: Table, keys: tuple[str, ...]):
        self.table, self.keys, self.spark = table, keys, table.spark
        empty = self.spark.createDataFrame([], table.schema)
        self.columns = empty.columns
        self.rows_schema = empty.withColumn("change", F.lit(0).cast("bigint")).schema
        self.gone_schema = empty.select(*keys).withColumn("change", F.lit(0).cast("bigint")).schema

    def _parts(self, folders: list[str]) -> tuple[DataFrame, DataFrame]:
        read = lambda name, schema: self.spark.read.schema(schema).parquet(*[f"{f}/{name}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return read("rows", self.rows_schema), read("gone", self.gone_schema)

    def _alive(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        last = gone.groupBy(*[F.col(k).alias(f"__{k}") for k in self.keys]).agg(F.max("change").alias("__last"))
        return rows.join(last, self._same() & (F.col("change") < F.col("__last")), "left_anti")

    def _same(self) -> Column:
        """Keys agree with those of the other side, which have two strokes before their names; a null is a key."""
        found = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
        return reduce(Column.__and__, found)

    def read(self, *names: str) -> DataFrame:
        """All rows that hold, or those of the tables of these names."""
        return self._alive(*self._parts(self.table.folders(*names))).select(*self.columns)

    def of(self, keys: DataFrame, name: str) -> DataFrame:
        """The rows that hold of some keys."""
        rows, gone = self._parts(self.table.folders(name))
        wanted = keys.select(*[F.col(k).alias(f"__{k}") for k in self.keys]).distinct()
        return self._alive(rows.join(wanted, self._same(), "left_semi"), gone.join(wanted, self._same(), "left_semi")).select(*self.columns)

    def change(self, rows: DataFrame, gone: DataFrame, name: str = "") -> int:
        """Add rows, and remove what there is of the keys in `gone`; the number of the change."""
        number = self._next(name)
        marked = lambda df, columns: df.select(*columns, F.lit(number).cast("bigint").alias("change"))

        def write(folder: str) -> None:
            marked(rows, self.columns).write.parquet(f"{folder}/rows")
            marked(gone.select(*self.keys).distinct(), self.keys).write.parquet(f"{folder}/gone")
            self._beside(folder, number, rows, gone, name)

        self.table.publish(write, name, add=True)
        self._fold(name)
        return number

    def _next(self, name: str) -> int:
        folders = self.table.folders(name)
        if not folders:
            return 1
        rows, gone = self._parts(folders)
        return (rows.select("change").unionByName(gone.select("change")).agg(F.max("change")).first()[0] or 0) + 1

    def sizes(self, name: str = "") -> list[int]:
        """Rows and removals of each folder, oldest first."""
        counts = []
        for folder in self.table.folders(name):
            rows, gone = self._parts([folder])
            counts.append(rows.count() + gone.count())
        return counts

    def _fold(self, name: str) -> None:
        folders = self.table.folders(name)
        n = to_fold(self.sizes(name)) if len(folders) > FEW else 0
        if not n:
            return
        rows, gone = self._parts(folders[-n:])

        def write(folder: str) -> None:
            self._alive(rows, gone).write.parquet(f"{folder}/rows")
            # Of all folders in one nothing older is left to remove.
            (gone.limit(0) if n == len(folders) else gone.groupBy(*self.keys).agg(F.max("change").alias("change"))).write.parquet(f"{folder}/gone")
            self._fold_beside(folder, folders[-n:], n == len(folders))

        self.table.publish(write, name, instead_of=n)

    def _beside(self, folder: str, number: int, rows: DataFrame, gone: DataFrame, name: str) -> None:
        """What a subclass keeps with each change."""

    def _fold_beside(self, folder: str, folders: list[str], whole: bool) -> None:
        """What a subclass keeps, of several changes as one."""


def is_doc(kb_id: str, doc_id: str) -> Column:
    return (F.col("kb_id") == kb_id) & (F.col("doc_id") == doc_id)


def keyed(chunks: DataFrame) -> DataFrame:
    """chunks with their deterministic key and the dimension of their vectors checked to be one."""
    return chunks.withColumn("chunk_key", chunk_key(F.col("kb_id"), F.col("root"), F.col("doc_id"), F.col("chunk_id")))


def delete_docs(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """chunks without those of the changed documents (kb_id, doc_id, and root if both have it)."""
    keys = [k for k in ("kb_id", "root", "doc_id") if k in chunks.columns and k in changed.columns]
    return chunks.join(changed.select(*keys).distinct(), keys, "left_anti")


def upsert(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """chunks with those of fresh documents replaced; also after an error or a deletion, so nothing is ever there twice."""
    return delete_docs(chunks, fresh).unionByName(fresh.select(*chunks.columns))


def check_dimension(chunks: DataFrame) -> int | None:
    """The one dimension of all vectors; None without vectors."""
    low, high = chunks.where(F.col("embedding").isNotNull()).agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"vectors of different dimensions: {low} to {high}")
    return low


def all_documents(chunks: DataFrame) -> DataFrame:
    """A scan without the vectors, missing text as empty."""
    return chunks.drop("embedding").withColumn("text", F.coalesce("text", F.lit("")))


def collection_name(base: str, kb_id: str, remote: bool) -> str:
    return f"{base}_{kb_id}" if remote else base


def processed_path(rel_path: Column) -> Column:
    """Where a file's full text is kept: the whole relative path, so files that differ in suffix alone do not meet."""
    return F.concat(rel_path, F.lit(".txt"))


def legacy_path(rel_path: Column) -> Column:
    """The older place: the suffix replaced."""
    return F.concat(F.regexp_replace(rel_path, r"(?<=[^/])\.[^./]+$", ""), F.lit(".txt"))
