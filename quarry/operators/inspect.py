"""Looking into a chunk table: listings, size statistics, schema discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import format_source
from quarry.runtime import materialise


def matches_doc(doc_id: Column, wanted: str, contains: bool = False) -> Column:
    text = doc_id.cast("string")
    return F.contains(text, F.lit(wanted)) if contains else text == wanted


def matches_chunk(chunk_id: Column, wanted: int) -> Column:
    return chunk_id.cast("string") == str(wanted)


def point_id(value: str) -> int | str:
    return int(value) if value.isdigit() else value


def size_stats(chunks: DataFrame) -> DataFrame:
    """Least, most and mean characters of the rows scanned."""
    n = F.length("text")
    return chunks.agg(F.count("*").alias("chunks"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"))


def count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n"))


def doc_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy("doc_id")


def lookup(chunks: DataFrame, keys: list, key: str = "chunk_key") -> DataFrame:
    return chunks.where(F.col(key).isin(keys))


def show(chunks: DataFrame, where: Column | None = None, limit: int | None = 20, width: int = 200) -> DataFrame:
    """Rows (so many, or all) with a label, their metadata on one line, and their text cut for display."""
    rows = chunks if where is None else chunks.where(where)
    names = [c for c in ("kb_id", "doc_id", "chunk_id", "source_type", "page", "sheet", "row") if c in chunks.columns]
    meta = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in names])
    text = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("..."))).otherwise(F.col("text"))
    page = F.col("page") if "page" in chunks.columns else F.lit(None).cast("int")
    return (rows if limit is None else rows.limit(limit)).select(format_source(F.col("source"), page).alias("label"), meta.alias("meta"), text.alias("text"))


def json_types(rows: DataFrame, column: str, sample: int | None = None, nested: bool = False) -> DataFrame:
    """(key, types): for each key of a JSON column, the types its values are seen with, in `sample` rows or all.

    With `nested`, keys of objects inside are there as well, by their path (`a.b`; `a[]` are the elements of a list): level by level, until there is none. Text is parsed once, so a text that
    looks like a number is a text. Rows that are no JSON, or no object, say nothing. An integer of more than 38 digits counts as a float.
    """
    taken = rows.limit(sample) if sample else rows
    level = taken.select(F.lit("").alias("at"), F.try_parse_json(column).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    found, depth = None, 0
    while True:
        of = level.lateralJoin(taken.sparkSession.tvf.variant_explode(F.col("v").outer())).select("at", "key", "value")
        path = F.when(F.col("key").isNull(), F.concat("at", F.lit("[]"))).otherwise(F.concat_ws(".", F.nullif("at", F.lit("")), "key"))
        of = of.select(path.alias("key"), "value", F.schema_of_variant("value").alias("kind"))
        of = materialise(of, "values") if nested else of
        counted = of.groupBy("key").agg(F.collect_set(_json_kind(F.col("value"), F.col("kind"))).alias("kinds"))
        found = counted if found is None else found.unionByName(counted)
        if not nested or depth > 100:
            break
        depth += 1
        level = of.where(F.col("kind").startswith("OBJECT<") | F.col("kind").startswith("ARRAY<")).select(F.col("key").alias("at"), F.col("value").alias("v"))
        if not level.head(1):
            break
    return found.select("key", F.array_join(F.sort_array("kinds"), ",").alias("types")).orderBy("key")


def _json_kind(value: Column, kind: Column) -> Column:
    """The name of a value's type; a whole number beyond 64 bits is kept as a decimal, as are 1.0 and 0.5."""
    wide = F.abs(F.try_variant_get(value, "$", "decimal(38,0)")) >= F.lit(2**63 - 1).cast("decimal(38,0)")
    return (
        F.when(kind == "VOID", "null")
        .when(kind == "BIGINT", "int")
        .when(kind == "DOUBLE", "float")
        .when(kind.startswith("DECIMAL"), F.when(kind.endswith(",0)") & F.coalesce(wide, F.lit(False)), "int").otherwise("float"))
        .when(kind == "BOOLEAN", "bool")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict")
        .otherwise("str")
    )


def vector_config(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.agg(F.lit(column).alias("name"), F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most"), F.lit("cosine").alias("distance"))


def payload_schema(rows: DataFrame) -> list[tuple[str, str]]:
    return rows.dtypes
