"""A BM25 index in segments, with postings in blocks that know their largest contribution.

Every sync writes a segment for what it changed: the postings of added chunks, the keys of removed ones, and what both change of the number of chunks, their length, and the document frequency of
each term. A reader adds these up over all segments, so scores are those of an index that is built anew; a posting holds until a later segment removes its chunk.
`folded` makes one segment of several, by size (`store.to_fold`), so few stay.

Within a segment chunks are dealt to ranges of about `RANGE` chunks by a hash of their key, and a term's postings of one range are a block: one row, whose `impacts` are the least length for each
term frequency. With the statistics of today they give the block's largest contribution exactly, whatever has been added since. The sum of these over a question's terms bounds every chunk of
a range. A few questions first score the `FIRST` (and at least as many as are asked for) ranges of highest bound; the limit-th best score is a threshold, and of the other ranges only those whose bound reaches it are read. Many
questions read each block of their terms once and are scored together (`bm25.best`): their ranges, chosen for each, would be read and shuffled many times over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import bm25
from quarry.operators.store import Deltas, Table
from quarry.runtime import materialise

RANGE, FIRST = 16, 32
#: Questions up to which ranges are chosen for each question. More of them want nearly all ranges between them, and read each block once.
FEW = 4
#: Bounds and scores are sums of doubles in different orders, and scores are rounded.
SLACK = 1e-8
PARTS = ("blocks", "terms", "corpus", "gone")


@dataclass(frozen=True)
class Segments:
    """blocks (kb_id, segment, term, range, n, impacts, postings), terms (kb_id, term, df), corpus (kb_id, n, total), gone (kb_id, segment, chunk_key); numbers of terms and corpus are changes."""

    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame
    gone: DataFrame
    k1: float = bm25.K1
    b: float = bm25.B

    @classmethod
    def read(cls, spark: SparkSession, folders: list[str], k1: float = bm25.K1, b: float = bm25.B) -> Segments:
        return cls(*[spark.read.parquet(*[f"{folder}/{name}" for folder in folders]) for name in PARTS], k1, b)

    def corpus_stats(self) -> DataFrame:
        """(kb_id, n, avgdl)."""
        return self.corpus.groupBy("kb_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").select("kb_id", "n", (F.col("total") / F.col("n")).alias("avgdl"))

    def term_stats(self, only: DataFrame | None = None) -> DataFrame:
        """(kb_id, term, df, idf, avgdl) of all terms, or of those in a table of terms."""
        mine = self.terms if only is None else self.terms.join(only.select("term").distinct(), "term", "left_semi")
        summed = mine.groupBy("kb_id", "term").agg(F.sum("df").alias("df")).where("df > 0")
        return summed.join(self.corpus_stats(), "kb_id").select("kb_id", "term", "df", bm25.idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")

    def alive(self, postings: DataFrame) -> DataFrame:
        """postings (kb_id, segment, chunk_key, ...) without those that a later segment removes."""
        last = self.gone.groupBy(F.col("kb_id").alias("__kb"), F.col("chunk_key").alias("__key")).agg(F.max("segment").alias("__last"))
        return postings.join(last, (F.col("kb_id") == F.col("__kb")) & (F.col("chunk_key") == F.col("__key")) & (F.col("segment") < F.col("__last")), "left_anti")

    def postings(self) -> DataFrame:
        """(kb_id, segment, term, chunk_key, tf, dl): all that hold."""
        return self.alive(self.blocks.select("kb_id", "segment", "term", F.inline("postings")))


def _dealt(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows (kb_id, chunk_key, ...) with their range, those of a range in one task; chunks (kb_id, n) give the number of ranges."""
    ranges = chunks.select("kb_id", F.greatest(F.ceil(F.col("n") / RANGE), F.lit(1)).alias("ranges"))
    placed = rows.join(F.broadcast(ranges), "kb_id").withColumn("range", F.pmod(F.xxhash64("chunk_key"), F.col("ranges")).cast("int")).drop("ranges")
    return placed.repartition("kb_id", "range")


def _write_blocks(placed: DataFrame, path: str) -> None:
    """Dealt postings (kb_id, segment, range, chunk_key, term, tf, dl) as blocks, in the order of terms; nothing is shuffled again."""
    held = placed.groupBy("kb_id", "segment", "term", "range").agg(F.sort_array(F.collect_list(F.struct("chunk_key", "tf", "dl"))).alias("postings"))
    seen = F.array_sort(F.array_distinct(F.transform("postings", lambda p: p["tf"])))
    impacts = F.transform(seen, lambda tf: F.struct(tf.alias("tf"), F.array_min(F.transform(F.filter("postings", lambda p: p["tf"] == tf), lambda p: p["dl"])).alias("dl")))
    rows = held.select("kb_id", "segment", "term", "range", F.size("postings").alias("n"), impacts.alias("impacts"), "postings")
    # Dealt by ranges: a term that all chunks hold is in every file, sorted, and readers of other terms skip it by the statistics of row groups.
    rows.sortWithinPartitions("term", "range").write.parquet(f"{path}/blocks")


def write(path: str, number: int, added: DataFrame, removed: DataFrame, most: int = bm25.DOC_TOKENS) -> None:
    """Segment `number` from chunks (kb_id, chunk_key, text) that are added and removed. A chunk that is changed is both, under its key."""
    held = materialise(bm25.doc_stats(added.select("kb_id", "chunk_key", "text"), "chunk_key", most), "tokens")
    lost = materialise(bm25.doc_stats(removed.select("kb_id", "chunk_key", "text"), "chunk_key", most), "tokens")
    change = held.withColumn("by", F.lit(1)).unionByName(lost.withColumn("by", F.lit(-1)))
    total = lambda c: F.sum(c).cast("bigint")
    change.groupBy("kb_id").agg(total("by").alias("n"), total(F.col("by") * F.col("dl")).alias("total")).write.parquet(f"{path}/corpus")
    terms = change.select("kb_id", "by", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("kb_id", "term").agg(total("by").alias("df"))
    terms.where("df <> 0").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    lost.select("kb_id", F.lit(number).cast("bigint").alias("segment"), "chunk_key").distinct().write.parquet(f"{path}/gone")
    # Tokens are dealt by their chunk's range, and postings are counted and put in blocks where they are.
    tokens = _dealt(held, held.groupBy("kb_id").agg(F.count("*").alias("n"))).select("kb_id", "range", "chunk_key", "dl", F.explode("tokens").alias("term"))
    counted = tokens.groupBy("kb_id", "range", "chunk_key", "term").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))
    _write_blocks(counted.withColumn("segment", F.lit(number).cast("bigint")), path)


def folded(path: str, index: Segments, whole: bool) -> None:
    """One segment, of the last one's number, in place of those of the index. Keys that are removed stay on record for older segments, unless these are the whole index."""
    number = index.blocks.select("segment").unionByName(index.gone.select("segment")).agg(F.max("segment")).first()[0] or 0
    index.corpus.groupBy("kb_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.parquet(f"{path}/corpus")
    index.terms.groupBy("kb_id", "term").agg(F.sum("df").alias("df")).where("df <> 0").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    gone = index.gone.limit(0) if whole else index.gone.groupBy("kb_id", "chunk_key").agg(F.max("segment").alias("segment")).select("kb_id", "segment", "chunk_key")
    gone.write.parquet(f"{path}/gone")
    postings = materialise(index.postings(), "postings")
    counts = postings.groupBy("kb_id").agg(F.count_distinct("chunk_key").alias("n"))
    _write_blocks(_dealt(postings.withColumn("segment", F.lit(number).cast("bigint")), counts), path)


def bounds(index: Segments, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, kb_id, segment, range, most): what no chunk of the range can exceed; postings are not read."""
    heads = index.blocks.select("kb_id", "segment", "term", "range", "impacts").join(terms, "term").join(stats, ["kb_id", "term"])
    largest = F.array_max(F.transform("impacts", lambda i: bm25.term_score(i["tf"], i["dl"], F.col("idf"), F.col("avgdl"), index.k1, index.b)))
    return heads.groupBy("query_id", "kb_id", "segment", "range").agg(F.sum(largest).alias("most"))


def score(index: Segments, terms: DataFrame, stats: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query_id, kb_id, chunk_key, score) of the chunks in the ranges (query_id, kb_id, segment, range)."""
    read = index.blocks.select("kb_id", "segment", "term", "range", "postings").join(terms, "term").join(ranges.select("query_id", "kb_id", "segment", "range"), ["query_id", "kb_id", "segment", "range"], "left_semi")
    hits = index.alive(read.select("query_id", "kb_id", "segment", "term", F.inline("postings"))).join(stats, ["kb_id", "term"])
    each = bm25.term_score(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"), index.k1, index.b)
    return hits.groupBy("query_id", "kb_id", "chunk_key").agg(F.round(F.sum(each), bm25.DIGITS).alias("score")).where("score > 0")


@dataclass(frozen=True)
class Reading:
    """What a search reads: bounds of all ranges, those read first and what they gave, and those read after them."""

    bounds: DataFrame
    first: DataFrame
    started: DataFrame
    rest: DataFrame


def _reading(index: Segments, terms: DataFrame, stats: DataFrame, limit: int, keys: list[str], first: int) -> Reading:
    every = materialise(bounds(index, terms, stats), "bounds")
    at = ["query_id", "kb_id", "segment", "range"]
    order = Window.partitionBy(*keys).orderBy(F.desc("most"), "kb_id", "segment", "range")
    early = materialise(every.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= first).select(*at), "first")
    started = materialise(score(index, terms, stats, early), "started")
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_key")
    reached = started.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == limit).select(*keys, F.col("score").alias("reached"))
    later = every.join(early, at, "left_anti").join(reached, keys, "left").where(F.col("reached").isNull() | (F.col("most") >= F.col("reached") - SLACK))
    return Reading(every, early, started, later.select(*at))


def search(index: Segments, queries: DataFrame, limit: int, per_kb: bool = False, most: int = bm25.QUERY_TOKENS, first: int = FIRST) -> DataFrame:
    """(query_id, kb_id, chunk_key, score, rank) as bm25.search: the best `limit` chunks of each query (and knowledge base), ties by chunk_key."""
    keys = ["query_id", "kb_id"] if per_kb else ["query_id"]
    terms = materialise(bm25.query_terms(queries, most), "terms")
    stats = materialise(index.term_stats(terms), "stats")
    if len(terms.select("query_id").distinct().limit(FEW + 1).collect()) > FEW:
        wanted = index.blocks.join(F.broadcast(terms.select("term").distinct()), "term")
        return bm25.best(index.alive(wanted.select("kb_id", "segment", "term", F.inline("postings"))), terms, stats, limit, per_kb, index.k1, index.b)
    read = _reading(index, terms, stats, max(1, limit), keys, max(first, limit))
    found = read.started.unionByName(score(index, terms, stats, materialise(read.rest, "rest")))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, limit))


class Indexed(Deltas):
    """Chunks with their index: a change of the chunks holds the segment of what it adds and removes, so one pointer stands for both."""

    def __init__(self, table: Table, keys: tuple[str, ...], k1: float = bm25.K1, b: float = bm25.B, most: int = bm25.DOC_TOKENS):
        super().__init__(table, keys)
        self.k1, self.b, self.most = k1, b, most

    def index(self, *names: str) -> Segments | None:
        """The index of some knowledge bases, or of all; None if one of them has none."""
        folders = [f"{f}/index" for f in self.table.folders(*names)]
        return Segments.read(self.spark, folders, self.k1, self.b) if folders and all(self.table.held(name) for name in names) else None

    def _beside(self, folder: str, number: int, rows: DataFrame, gone: DataFrame, name: str) -> None:
        write(f"{folder}/index", number, rows, self.of(gone, name), self.most)

    def _fold_beside(self, folder: str, folders: list[str], whole: bool) -> None:
        folded(f"{folder}/index", Segments.read(self.spark, [f"{f}/index" for f in folders], self.k1, self.b), whole)
