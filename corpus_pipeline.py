"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans and mixing, one stage after the other.

Each stage works on all rows that its predecessor kept, written as Parquet and read again. All stages but the last return the columns of
documents; the last adds each document's share in the mix. Decisions are made for rows, known by doc_id and a hash of the text and not by doc_id alone: a null
doc_id is an id, and of rows that share an id each is judged by its own text. Other columns pass through whatever their names; only the last stage's own
columns (ADDED) replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import decontaminate, language, mixing, secrets, simhash
from quarry.llm.common import materialise, private, table

#: Columns of the last stage: words of the document and of its source, words that the mix takes of the source, the document's rate, and words that it takes of it.
ADDED = ("size", "source_size", "target", "rate", "taken")


def _same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Rows agree in the paired columns, nulls included."""
    found = [left[a].eqNullSafe(right[b]) for a, b in pairs.items()]
    return found[0] if len(found) == 1 else found[0] & _same(left, right, dict(list(pairs.items())[1:]))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go (null texts too); the others get the predicted language, or keep theirs if there is none to learn."""
    learned = language.prototypes(docs)
    if not learned:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = private(docs, "__lang", "__score")
    found = language.identify(docs, learned, added=(lang, score))
    return found.where(F.col(lang) != language.UNDETERMINED).withColumn("lang", F.col(lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest doc_id stays (a null one is the smallest); of repeated rows, one."""
    key, id_, of = private(docs, "__key", "__id", "__of")
    keyed = docs.withColumn(key, simhash.text_key(docs))
    kept = materialise(simhash.survivors(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": id_, "key": of}), "kept")
    return keyed.join(kept, _same(keyed, kept, {"doc_id": id_, key: of}), "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    _, found = decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    (digest,) = private(docs, "__digest")
    return docs.withColumn(digest, decontaminate.text_digest(docs)).join(found.select(F.col("digest").alias(digest)), digest, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask, and n_chars, if there is such a column, follows; no document goes."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; documents of which it takes none go. Rows that agree in id, source and text share their parts out in any order."""
    row = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    mine = {c: n for c, n in zip(("doc_id", "source", "key", "nth", *ADDED), private(docs, *[f"__{c}" for c in ("doc_id", "source", "key", "nth", *ADDED)]), strict=True)}
    hashed, nth = private(docs, "__hashed", "__row")
    mixed = mixing.mix(docs.select("doc_id", "text", "source")).withColumn("nth", row("doc_id", "source", "key")).where("taken > 0")
    mixed = mixed.select(*[F.col(c).alias(n) for c, n in mine.items()])
    theirs = [c for c in docs.columns if c.lower() not in ADDED]
    keyed = docs.withColumn(hashed, F.xxhash64(F.col("text").cast("string")))
    keyed = keyed.withColumn(nth, row("doc_id", "source", hashed))
    pairs = {"doc_id": mine["doc_id"], "source": mine["source"], hashed: mine["key"], nth: mine["nth"]}
    return keyed.join(mixed, _same(keyed, mixed, pairs)).select(*theirs, *[F.col(mine[c]).alias(c) for c in ADDED])


STAGES = [
    ("language", identify_language),
    ("near_dedup", near_dedup),
    ("decontaminate", remove_benchmark),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: SQL cannot express the language, fingerprint and mixing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
