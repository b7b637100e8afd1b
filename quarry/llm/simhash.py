"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits; bit i is set if more than half of the text's shingle hashes have it. Texts link if their
fingerprints differ in at most `radius` bits. Rows with equal fingerprints are one class, so only different fingerprints are
compared, and a class of any size is one row.

Comparison is tiled: a tile is a set of fingerprints of neighbouring population counts, two tiles are compared by numpy
exclusive-or and bit counts, and a pair of tiles is skipped where the population counts of one lie more than `radius` from
those of the other (bits that differ change the count by at most their number). Inside a pair of tiles the same holds for sub-tiles.

Tiles are dealt by blocks of bits. Of `blocks` blocks, two fingerprints within the radius agree in at least blocks - radius, so each
choice of that many blocks is a key, and tiles are drawn up within the fingerprints that share a key's value. The number of blocks follows from the number
of fingerprints: more blocks give longer keys, so that a value has about a tile of fingerprints at any size of the corpus, and the work
does not grow with its square. A value that more fingerprints share (a cluster, or plain chance) is cut into bands of population counts,
a band that is still too large by a hash, and every pair of tiles whose bands are near enough is a unit of work.

A unit joins what it links while it compares, and emits a spanning forest of its links: its memory is bounded by its fingerprints, and not
by their pairs.

Defined results: null and wordless texts have fingerprint zero and link like any other; repeated rows share a class; a text
with fewer words than a shingle is one shingle; a null doc_id is a row like another, and names a component only if all of its rows have none;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, changes, materialise, runs, utf8
from quarry.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 4096
SUBTILE = 256
BITS = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    hashed = xxhash.xxh64_intdigest
    if n <= shingle:
        return hashed(joined, seed)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(stops[: n - shingle] + 1).tolist()]
    found = np.fromiter([hashed(joined[a:b], seed) for a, b in zip(starts, stops[shingle - 1 :].tolist(), strict=True)], np.uint64, n - shingle + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, fp) of every row, key a hash of the text, fp the fingerprint's bits as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "key", "fp"])

    whole = utf8(docs, text)
    return docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("key"), whole.alias("text")).mapInArrow(run, "doc_id bigint, key bigint, fp bigint")


def block_count(fingerprints: int, radius: int, tile: int) -> int:
    """The fewest blocks whose keys are long enough for about a tile of fingerprints to share a value."""
    blocks = radius + 1
    while blocks < 2 * radius and fingerprints > tile << (BITS * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def block_keys(radius: int, blocks: int) -> list[int]:
    """The bits of every key: all choices of blocks - radius out of the blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def _bands(keyed: DataFrame, tile: int) -> DataFrame:
    """(key, value, pop, band, low, high, subs) of the values with more than a tile of fingerprints: the band of each population count.

    A value has at most 65 population counts, so all of this is small; the counts are aggregated on the map side.
    """
    counts = keyed.groupBy("key", "value", "pop").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("key", "value")
    before = F.coalesce(F.sum("n").over(whole.orderBy("pop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = counts.withColumn("of", F.sum("n").over(whole)).withColumn("band", F.floor(before / tile).cast("int")).where(F.col("of") > tile)
    band = Window.partitionBy("key", "value", "band")
    subs = F.ceil(F.sum("n").over(band) / tile).cast("int")
    return large.select("key", "value", "pop", "band", F.min("pop").over(band).alias("low"), F.max("pop").over(band).alias("high"), subs.alias("subs"))


def _units(fps: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fp, key, value, left, right, second): every fingerprint in each unit of work that it takes part in."""
    blocks = block_count(fps.count(), radius, tile)
    masks = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in block_keys(radius, blocks)])
    keyed = fps.select("fp", F.posexplode(masks).alias("key", "mask")).select("fp", "key", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), F.bit_count("fp").alias("pop"))
    bands = materialise(_bands(keyed, tile), "bands")
    tiles = bands.select("key", "value", "band", "low", "high", "subs").distinct()
    near = (F.col("o.low") - F.col("t.high") <= radius) & (F.col("t.low") - F.col("o.high") <= radius)
    same = [F.col(f"t.{c}") == F.col(f"o.{c}") for c in ("key", "value")]
    pairs = tiles.alias("t").join(tiles.alias("o"), [*same, near]).select("t.key", "t.value", "t.band", F.col("o.band").alias("other"), F.col("o.subs").alias("parts"))
    pairs = materialise(pairs.select("key", "value", "band", "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "tile-pairs")

    placed = keyed.join(bands.select("key", "value", "pop", "band", "subs"), ["key", "value", "pop"], "left")
    alone = placed.where(F.col("band").isNull()).select("fp", "key", "value", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(False).alias("second"))
    own = F.shiftleft(F.col("band").cast("bigint"), 32) + F.pmod(F.xxhash64("fp", F.lit(7)), F.col("subs"))
    met = placed.where(F.col("band").isNotNull()).withColumn("own", own).join(pairs, ["key", "value", "band"])
    other = F.shiftleft(F.col("other").cast("bigint"), 32) + F.col("part")
    crowded = met.select("fp", "key", "value", F.least("own", other).alias("left"), F.greatest("own", other).alias("right"), (F.col("own") > other).alias("second"))
    return alone.unionByName(crowded)


def forest(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different fingerprints within the radius that connect whatever all such links connect."""
    keys = ["key", "value", "left", "right"]
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _units(fps, radius, tile).repartition(parts, *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, keys, 1 << 16):
            found = whole.column("fp").to_numpy().view(np.uint64)
            second = whole.column("second").to_numpy(zero_copy_only=False).astype(bool)
            same = whole.column("left").to_numpy() == whole.column("right").to_numpy()
            cuts = [0, *changes(whole, keys).tolist(), whole.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if stop - start < 2:
                    continue
                here = found[start:stop]
                left, right = (here, here) if same[start] else (here[~second[start:stop]], here[second[start:stop]])
                a, b = linked(left, right, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return ordered.mapInArrow(compare, "a bigint, b bigint")


def near(left: np.ndarray, right: np.ndarray, radius: int, size: int = SUBTILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius, by pairs of sub-tiles whose population counts are near enough; within one set, each pair once."""
    own = left is right
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    right = left if own else right[np.argsort(np.bitwise_count(right), kind="stable")]
    counts_left, counts_right = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    for i in range(0, len(left), size):
        rows = left[i : i + size]
        low, high = counts_left[i], counts_left[min(i + size, len(left)) - 1]
        first = int(np.searchsorted(counts_right, low - radius, "left"))
        last = int(np.searchsorted(counts_right, high + radius, "right"))
        for j in range(max(first, i) if own else first, last, size):
            columns = right[j : min(j + size, last)]
            r, c = np.nonzero(np.bitwise_count(rows[:, None] ^ columns[None, :]) <= radius)
            if own:
                keep = r + i < c + j
                r, c = r[keep], c[keep]
            if len(r):
                yield rows[r], columns[c]


def linked(left: np.ndarray, right: np.ndarray, radius: int, held: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius; pairs are joined as they are found, so few are held at a time."""
    empty = np.zeros(0, np.uint64)
    a, b, waiting, size = empty, empty, [], 0
    for pair in near(left, right, radius):
        waiting.append(pair)
        size += len(pair[0])
        if size >= held:
            a, b = spanning(np.concatenate([a, *(p[0] for p in waiting)]), np.concatenate([b, *(p[1] for p in waiting)]))
            waiting, size = [], 0
    return spanning(np.concatenate([a, *(p[0] for p in waiting)]), np.concatenate([b, *(p[1] for p in waiting)])) if waiting else (a, b)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star from the first node of each component of the links to its other nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(least, root[u], low)
        np.minimum.at(least, root[v], low)
        least = least[least]
        after = least[root]
        if np.array_equal(after, root):
            break
        root = after
    others = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[others]], nodes[others]


def grouped(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, fp, component, component_id) of every row; component is the smallest fingerprint (as a signed long) that links reach, component_id the smallest doc_id."""
    marked = materialise(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    groups = components(forest(classes.select("fp"), radius, tile))
    joined = materialise(classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "grouped")
    # The root of a component is its smallest fingerprint; the smallest doc_id is what is asked for.
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(joined.join(least, "component").select("fp", "component", "component_id"), "named")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    return grouped(docs, **how).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, key): of each component one row, that with the smallest doc_id (none first) and then text hash; key is text_key of its text."""
    rows = grouped(docs, **how)
    return rows.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("x.doc_id", "x.key")


def text_key(docs: DataFrame, text: str = "text") -> F.Column:
    return F.xxhash64(utf8(docs, text))
