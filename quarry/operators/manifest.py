"""Manifests: what has changed since the last run, file records, knowledge-base names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import basename, sanitize_kb_id
from quarry.runtime import materialise
from quarry.schemas import DELETED, ERROR, INDEXED, SKIPPED

#: Suffixes that can be ingested.
ALLOWED = (".txt", ".pdf", ".docx", ".doc", ".xls", ".xlsx", ".csv", ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")


def suffix_gate(listing: DataFrame) -> DataFrame:
    """listing with `supported`."""
    return listing.withColumn("supported", F.lower("suffix").isin(*ALLOWED))


def plan(listing: DataFrame, records: DataFrame, root: str | None = None) -> DataFrame:
    """(abs_path, action, reason): what to do about every file that is listed or on record.

    parse: new or changed, or not indexed, or deleted before; unchanged: same hash and time, indexed and not deleted; unsupported; deleted: on record
    (under this root) but not listed; gone: that, and known to be deleted.
    """
    known = records if root is None or "root" not in records.columns else records.where(F.col("root") == root)
    old = known.select("abs_path", F.col("hash").alias("old_hash"), F.col("mtime").alias("old_mtime"), F.col("status").alias("old_status"), F.col("source_deleted").alias("old_deleted"))
    both = suffix_gate(listing).withColumn("listed", F.lit(True)).join(old, "abs_path", "full_outer")
    same = (F.col("hash") == F.col("old_hash")) & (F.col("mtime") == F.col("old_mtime")) & (F.col("old_status") == INDEXED) & ~F.col("old_deleted")
    action = (
        F.when(F.col("listed").isNull() & ((F.col("old_status") == DELETED) | F.col("old_deleted")), "gone")
        .when(F.col("listed").isNull(), DELETED)
        .when(~F.col("supported"), "unsupported")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("parse")
    )
    reason = F.when(F.col("action") == DELETED, "source_missing").when(F.col("action").isin("unsupported", "unchanged"), F.col("action"))
    return both.withColumn("action", action).withColumn("reason", reason).select("abs_path", "action", "reason", "hash", "mtime", "old_status")


def classify(error: Column, documents: Column, chunks: Column) -> Column:
    """Why a file could not be indexed: an exception, no text, or no chunks; null if it could."""
    return F.coalesce(error, F.when(F.coalesce(documents, F.lit(0)) == 0, "no_text").when(F.coalesce(chunks, F.lit(0)) == 0, "no_chunks"))


def records_after(planned: DataFrame, outcome: DataFrame, records: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """The records after a run; outcome (abs_path, error) has a row for each parsed file."""
    here = listing.select("abs_path", "rel_path", "hash", "mtime")
    new = planned.where(F.col("action").isin("parse", "unsupported")).select("abs_path", "action").join(here, "abs_path").join(outcome.select("abs_path", "error"), "abs_path", "left")
    bad = F.col("action") == "unsupported"
    fresh = new.select(
        "abs_path",
        "rel_path",
        F.lit(root).alias("root"),
        F.when(bad, "").otherwise(F.col("hash")).alias("hash"),
        "mtime",
        F.when(bad, SKIPPED).when(F.col("error").isNotNull(), ERROR).otherwise(INDEXED).alias("status"),
        F.lit(False).alias("source_deleted"),
        F.when(bad, "unsupported").otherwise(F.col("error")).alias("error"),
        F.current_timestamp().alias("updated_at"),
    )
    lost = planned.where(F.col("action") == DELETED).select("abs_path", F.lit(True).alias("lost"))
    kept = records.join(fresh.select("abs_path"), "abs_path", "left_anti").join(lost, "abs_path", "left")
    aged = kept.select(
        "abs_path",
        "rel_path",
        "root",
        "hash",
        "mtime",
        F.when(F.col("lost"), DELETED).otherwise(F.col("status")).alias("status"),
        F.coalesce("lost", "source_deleted").alias("source_deleted"),
        "error",
        F.when(F.col("lost"), F.current_timestamp()).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return fresh.unionByName(aged)


def report(planned: DataFrame, outcome: DataFrame, run_id: str, kb_id: str, root: str) -> DataFrame:
    """One row for each file: bucket ingested, skipped or errors, status and reason."""
    joined = planned.where(F.col("action") != "gone").join(outcome.select("abs_path", "error"), "abs_path", "left")
    parsed = F.col("action") == "parse"
    bucket = F.when(parsed & F.col("error").isNull(), "ingested").when(parsed, "errors").otherwise("skipped")
    status = F.when(parsed & F.col("error").isNull(), INDEXED).when(parsed, ERROR).when(F.col("action") == DELETED, DELETED).otherwise(SKIPPED)
    return joined.select(F.lit(run_id).alias("run_id"), F.lit(kb_id).alias("kb_id"), F.lit(root).alias("root"), bucket.alias("bucket"), "abs_path", status.alias("status"), F.coalesce("reason", "error").alias("reason"), F.current_timestamp().alias("created_at"))


def nested_report(items: DataFrame) -> DataFrame:
    """One row for each run, its items in three arrays."""
    item = F.struct("abs_path", "status", "reason")
    arrays = [F.sort_array(F.collect_list(F.when(F.col("bucket") == b, item))).alias(b) for b in ("ingested", "skipped", "errors")]
    return items.groupBy("run_id", "kb_id", F.col("root").alias("root_path")).agg(F.min("created_at").alias("created_at"), *arrays)


def doc_count(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if((F.col("status") == INDEXED) & ~F.col("source_deleted")).alias("doc_count"))


def coerced_records(raw: DataFrame) -> DataFrame:
    """Records read from loose JSON: every field with its type and default. A record without a status has none, so its file is parsed again."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return raw.select(text("abs_path"), text("rel_path"), text("hash"), F.coalesce(F.try_to_number(F.col("mtime_ns").cast("string"), F.lit("9999999999999999999")).cast("bigint"), F.lit(0)).alias("mtime_ns"), text("status"), F.coalesce(F.col("source_deleted").cast("boolean"), F.lit(False)).alias("source_deleted"), F.col("error").cast("string").alias("error"), text("updated_at"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def kb_paths_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """(root, kb_id) from a JSON map; nothing from what is no map."""
    return raw.select(F.explode(F.from_json(column, "map<string,string>")).alias("root", "kb_id"))


def resolve_kb_ids(roots: DataFrame, bindings: DataFrame, together: bool = True) -> DataFrame:
    """(root, kb_id) for roots (root, wanted): the wanted name, else the root's binding, else a clean name no one has.

    A name that is taken gets six digits of the root's SHA-1, one that is still taken a number from 2 on as well. Many roots at once get different names: in each round the roots
    without one ask for their next, the least root of those that ask for the same gets it, and the rest go on, until all have one. As roots differ in their digits, that is two rounds, and one
    more for each number. If not `together`, each root is asked about alone: it gets the first name that no binding has, whatever the others get.
    """
    bound = roots.join(bindings.withColumnRenamed("kb_id", "bound"), "root", "left")
    named = materialise(bound.select("root", F.coalesce(F.nullif("wanted", F.lit("")), "bound").alias("kb_id")), "named")
    kept = named.where(F.col("kb_id").isNotNull())
    base, digits = sanitize_kb_id(basename(F.col("root"))), F.substring(F.sha1(F.col("root").cast("binary")), 1, 6)
    asking = named.where(F.col("kb_id").isNull()).select("root").distinct().select("root", base.alias("base"), F.concat_ws("_", base, digits).alias("short"))
    taken, won, attempt = bindings.select("kb_id"), [], 0
    taken = taken.unionByName(kept.select("kb_id")) if together else taken
    while asking.head(1):
        attempt += 1
        name = F.col("base") if attempt == 1 else F.col("short") if attempt == 2 else F.concat_ws("_", "short", F.lit(str(attempt - 1)))
        free = asking.withColumn("kb_id", name).join(taken, "kb_id", "left_anti")
        # A minimum, and not a sorted group: many roots may ask for one name.
        got = materialise(free.groupBy("kb_id").agg(F.min("root").alias("root")).select("root", "kb_id") if together else free.select("root", "kb_id"), "got")
        won.append(got)
        taken = taken.unionByName(got.select("kb_id")) if together else taken
        asking = materialise(asking.join(got, "root", "left_anti"), "asking")
    found = kept
    for got in won:
        found = found.unionByName(named.select("root").join(got, "root"))
    return found


def fingerprint(files: DataFrame, *by: str) -> DataFrame:
    """One digest over (rel, mtime, size) of all files of a group in the order of rel; of no group, empty without files.

    The digest needs a group's names in one place: one line a file, which for a folder of a million files is some 100 MB.
    """
    line = F.concat_ws(":", "rel", F.col("mtime").cast("string"), F.col("size").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("rel", line.alias("line"))))
    joined = F.array_join(F.transform(listed, lambda x: x["line"]), "\n")
    return files.groupBy(*by).agg(F.when(F.count("*") > 0, F.sha2(joined.cast("binary"), 256)).otherwise("").alias("fingerprint"))


#: Hexadecimal digits of a name's hash that number a leaf of the tree: 4096 leaves, met in 256 and 16 nodes and one root.
LEAF_DIGITS = 3


def tree_fingerprint(files: DataFrame, *by: str) -> DataFrame:
    """One digest over (rel, mtime, size) of all files of a group, as a tree; of no group, empty without files.

    A leaf is the digest of its files' digests in their order; a node is that of its children's, with their places; a level has a sixteenth of the one below. The leaf of a file is the beginning of the hash of its
    name, so the tree depends on the files alone and not on how rows lie, and an equal folder has an equal digest. No task holds more than a leaf's digests: 64 characters a file
    and 1 / 4096 of a folder. Two folders that differ in one file differ in one path of nodes. (`fingerprint`, one flat digest, needs all names of a group in one place.)
    """
    line = F.concat_ws(":", F.octet_length("rel").cast("string"), "rel", F.col("mtime").cast("string"), F.col("size").cast("string"))
    place = F.substring(F.sha2(F.col("rel").cast("binary"), 256), 1, LEAF_DIGITS)
    level = files.select(*by, place.alias("at"), F.sha2(line.cast("binary"), 256).alias("digest"))
    for digits in range(LEAF_DIGITS, -1, -1):
        listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "at", "digest"))), "\n")
        level = level.groupBy(*by, F.substring("at", 1, digits).alias("at")).agg(F.sha2(listed.cast("binary"), 256).alias("digest"))
    found = level.select(*by, F.col("digest").alias("fingerprint"))
    return found if by else found.agg(F.coalesce(F.max("fingerprint"), F.lit("")).alias("fingerprint"))


def manifest_matches(stored: DataFrame, expected: dict, *by: str) -> DataFrame:
    """Whether all stored manifests (of a group) have all expected values; False without one."""
    same = F.lit(True)
    for name, value in expected.items():
        same = same & (F.col(name).eqNullSafe(F.lit(value)) if name in stored.columns else F.lit(False))
    return stored.groupBy(*by).agg(F.coalesce(F.bool_and(same), F.lit(False)).alias("matches"))


def index_manifest(files: DataFrame, embedding_model: str, chunk_size: int, chunk_overlap: int) -> DataFrame:
    """(fingerprint, embedding_model, chunk_size, chunk_overlap): what an index was made of."""
    return fingerprint(files).select("fingerprint", F.lit(embedding_model).alias("embedding_model"), F.lit(chunk_size).alias("chunk_size"), F.lit(chunk_overlap).alias("chunk_overlap"))


def coerced_manifests(raw: DataFrame) -> DataFrame:
    """Index manifests read from loose JSON: every field with its type, and text or nothing where it does not fit."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    number = lambda c, kind: F.coalesce(F.try_to_number(F.col(c).cast("string"), F.lit("9999999999999999999")).cast(kind), F.lit(0).cast(kind)).alias(c)
    return raw.select(text("kb_id"), text("embedding_model"), number("chunk_size", "int"), number("chunk_overlap", "int"), number("doc_count", "bigint"), number("chunk_count", "bigint"), text("updated_at"))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def cached_text(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """sources (rel, mtime) with the cached text where it is not older than the source and not blank."""
    aged = sources.join(cache.select("rel", F.col("mtime").alias("cached_at"), F.col("text").alias("cached")), "rel", "left")
    return aged.withColumn("text", F.when((F.col("cached_at") >= F.col("mtime")) & (F.trim("cached") != ""), F.col("cached"))).drop("cached_at", "cached")
