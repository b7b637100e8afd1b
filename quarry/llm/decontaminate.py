"""Benchmark decontamination by a prefix-filtered join of word windows.

An item's windows are its runs of ten consecutive words (an item with fewer words is one window). Containment is exact,
so of a window's words, ordered by rarity in the corpus, a prefix of one word is enough: every place that holds the
window holds its rarest word. The join is on that word; the word's position in the window fixes where the window would start,
which gives the positional bound (it starts inside the document) and the length bound (it ends inside it); what passes is
verified word by word.

Everything is a table: the windows, the corpus counts of their words, the windows' rarest words, and the places of those words in the corpus, which carry
the words of the window that they would stand in. Nothing of the benchmark goes to the driver. What travels to the executors beforehand is a Bloom
filter of the windows and of where their rarest word stands, by rolling hashes of words; a place is written only for a window that the filter has, so what is
written grows with the hits and not with how common the benchmark's words are. The filter grows with the windows up to a fixed size; more windows fill it and
more places pass, but none is lost and the join decides in any case.
A place is keyed by its text's digest, so copies of a text meet before the join. The join's keys are the rarest word and the window around it, so only
a passage that very many texts hold is one hot key, with one window beside it, which adaptive execution splits.

Defined results: null and wordless texts have no words and no hits; items without words have no windows; repeated items and
documents each count; a null doc_id or item_id is an id (a null item_id has no name in the digest); extra columns are ignored; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, materialise, record, release, utf8

WINDOW = 10
#: Most bits of the filter (16 MB), and bits for each window.
BITS, BITS_EACH = 1 << 27, 64
#: Candidates in one row of places.
PART = 4096

#: Bytes that are in a word (0-9, a-z and all of 0x80-0xFF, after A-Z has become a-z); others part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(text: bytes, width: int) -> list[tuple[bytes, ...]]:
    found = words(text)
    if not found:
        return []
    return [tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, window) of each item's windows, a window being its words, parted by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := sorted(set(windows(text, width))):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array([b" ".join(w) for w in found], pa.binary())], names=["item_id", "window"])

    return items.mapInArrow(run, "item_id bigint, window binary").select("item_id", F.col("window").cast("string").alias("window"))


def word_counts(source: DataFrame) -> DataFrame:
    """(word, n): occurrences over all documents, summed batch by batch before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for value in batch.column(0).to_pylist():
                seen.update(words(value))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return source.select("text").mapInArrow(count, "word binary, n bigint").select(F.col("word").cast("string").alias("word"), "n")


def prefixes(distinct: DataFrame, source: DataFrame) -> DataFrame:
    """(wid, window, word, at, size), written: of each window, the rarest word, its place in it, and the window's length."""
    placed = materialise(distinct.select("wid", F.posexplode(F.split("window", " ")).alias("at", "word")), "window-words")
    # Only counts of the windows' words are shuffled, where their list is small enough for the planner to send it ahead.
    vocabulary = materialise(placed.select("word").distinct(), "vocabulary")
    counts = word_counts(source).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    ranked = placed.join(counts, "word", "left").select("wid", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at").alias("rank"))
    least = ranked.groupBy("wid").agg(F.min("rank").alias("rank"), F.count("*").cast("int").alias("size"))
    # A word that the corpus does not have cannot be hit.
    done = materialise(least.where("rank.n > 0").join(distinct, "wid").select("wid", "window", "rank.word", "rank.at", "size"), "prefixes")
    release(placed)
    release(vocabulary)
    return done


class _Hashes(dict):
    """Hashes of words, each computed once; cleared between texts when there are many."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 1 << 18:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers of the rolling hash, of a word's place in a window, and of the filter's two bits.
_STEP, _AT, _FIRST, _SECOND = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words; equal runs have equal hashes."""
    n = len(hashes) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(size if n > 0 else 0):
        out = out * _STEP + hashes[j : j + n]
    return out ^ (out >> np.uint64(29))


class Filter:
    """A Bloom filter of two bits a key; a power of two of bits, packed."""

    def __init__(self, bits: int, packed: np.ndarray | None = None):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.packed = np.zeros(bits // 8, np.uint8) if packed is None else packed

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((keys * m) >> self.shift for m in (_FIRST, _SECOND))

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.packed, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        first, second = ((self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for at in self.places(keys))
        return (first & second).astype(bool)


def _placed(keys: np.ndarray, at: int) -> np.ndarray:
    """Keys of windows whose rarest word stands at a place."""
    return (keys + np.uint64(at + 1)) * _AT


def window_filter(prefix: DataFrame, bits: int = BITS) -> Filter:
    """The filter of the windows' hashes, alone and with the place of the rarest word; only its bits reach the driver."""
    bits = 1 << min(bits.bit_length() - 1, max(6, (BITS_EACH * prefix.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, hashes = Filter(bits), _Hashes()
        for batch in batches:
            for window, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = window.encode().split(b" ")
                key = rolling(hashes.of(found), len(found))
                mine.add(np.concatenate([key, _placed(key, at)]))
        packed = mine.packed.view("<i8")
        some = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packed[some])], names=["at", "bits"])

    found = prefix.select("window", "at").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return Filter(bits, out.view(np.uint8))


_PLACE = "word: string, at: int, start: bigint, window: string"
_PLACES = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("part", pa.int32()), ("places", pa.list_(pa.struct([("word", pa.string()), ("at", pa.int32()), ("start", pa.int64()), ("window", pa.string())])))])
_PLACES_DDL = f"doc_id bigint, digest binary, n_words bigint, part int, places array<struct<{_PLACE}>>"


def places(source: DataFrame, wanted: Filter, sizes: list[int]) -> DataFrame:
    """(doc_id, digest, n_words, part, places): of every row a part 0, and more parts where a text has many places.

    A place is a word that may be the rarest of a window around it, with its place there, the window's start and its words.
    """
    shared = source.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, hashes = shared.value, _Hashes()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, digest, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words(value)
                met, part = [], 0
                for start, at, size in _met(hashes.of(found), wanted, sizes):
                    window = found[start : start + size]
                    met.append({"word": window[at].decode(), "at": at, "start": start, "window": b" ".join(window).decode()})
                    if len(met) == PART:
                        yield record(_PLACES, zip((doc, digest, len(found), part, met)))
                        met, part = [], part + 1
                if met or not part:
                    rows.append((doc, digest, len(found), part, met))
                    held += 1 + len(met)
                if held >= PART:
                    yield record(_PLACES, zip(*rows, strict=True))
                    rows, held = [], 0
            if rows:
                yield record(_PLACES, zip(*rows, strict=True))

    return source.mapInArrow(run, _PLACES_DDL)


def _met(hashes: np.ndarray, wanted: Filter, sizes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, at, size) of the windows of a text that the filter has."""
    for size in sizes:
        keys = rolling(hashes, size)
        starts = np.flatnonzero(wanted.has(keys))
        if len(starts):
            for at in range(size):
                for start in starts[wanted.has(_placed(keys[starts], at))].tolist():
                    yield start, at, size


def text_digest(docs: DataFrame, text: str = "text") -> F.Column:
    return F.unhex(F.sha2(utf8(docs, text), 256))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, bits: int = BITS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_words) of every row, and (digest, n_hit, n_items, names) of the texts that hold a window; digest is text_digest."""
    bound_batches(docs.sparkSession)
    source = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), text_digest(docs, text).alias("digest"), utf8(docs, text).alias("text"))
    held = materialise(item_windows(benchmark.select(benchmark[item_id].cast("bigint").alias("item_id"), utf8(benchmark, item_text).alias("text")), width), "windows")
    distinct = materialise(held.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "distinct")
    prefix = prefixes(distinct, source.select("text"))
    # Sizes are at most `width` numbers.
    sizes = sorted(r["size"] for r in prefix.select("size").distinct().collect())
    every = materialise(places(source, window_filter(prefix, bits), sizes), "places")

    one = every.where(F.size("places") > 0).select("digest", "n_words", "part", "places").dropDuplicates(["digest", "part"]).select("digest", "n_words", F.inline("places"))
    met = one.join(prefix, ["word", "at", "window"]).where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    hits = materialise(met.select("digest", "start", (F.col("start") + F.col("size")).alias("stop"), "wid"), "hits")

    covered = hits.groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    owners = held.join(distinct, "window").select("wid", "item_id")
    names = hits.select("digest", "wid").distinct().join(owners, "wid").select("digest", "item_id").distinct()
    listed = names.groupBy("digest").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("names"))
    found = materialise(covered.select("digest", _covered("spans").alias("n_hit")).join(listed, "digest"), "found")
    return every.where("part = 0").select("doc_id", "digest", "n_words"), found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs."""
    every, found = contaminated(docs, benchmark, **how)
    return every.join(found, "digest", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _covered(spans: str) -> F.Column:
    """How many words an array of spans (start, stop) covers: in their order, each adds what lies behind the furthest stop before it."""
    begin = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(
        F.array_sort(spans),
        begin,
        lambda done, span: F.struct((done["n"] + F.greatest(F.lit(0), span["stop"] - F.greatest(done["upto"], span["start"]))).alias("n"), F.greatest(done["upto"], span["stop"]).alias("upto")),
        lambda done: done["n"],
    )
