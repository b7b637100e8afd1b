"""Repeated windows of a corpus: the plumbing that the two substring operators share.

A window is `width` consecutive units (words or bytes) of one document. Both operators sort suffixes, cut at the width, and look
for equal ones; sorting every suffix of a corpus would shuffle many times its size, so suffixes are first narrowed down, without
loss, and dealt out so that equal windows meet:

1. Anchors. Of the runs of `gram` units in a window, the one with the smallest hash is the window's anchor. It depends on the
   window's content alone, so equal windows have equal anchors at equal offsets. Neighbouring windows mostly share theirs.
2. Only anchors that occur at least twice among different texts can belong to repeated windows; they are counted exactly, over all documents.
   Exact copies of a text are found by its digest first: every window of a copy starts in an earlier document.
3. Fragments. The longest runs of windows with one recurring anchor, with their content. Equal fragments are merged (the earliest place
   of each is kept), reduced on the map side, so a passage that a third of all documents hold is one fragment.
4. Groups. The fragments of an anchor form a group: their suffixes share the anchor as a prefix. A group of more than `crowd` fragments gets a longer prefix,
   half a window (`extended`): each fragment is cut in two, as its windows reach half a window to the right of the anchor or to the left, and dealt by that half.
   Fragments that are alone with theirs are done. Groups that are still too large get the longest prefix, the whole window (`wholes`): such a group is
   one window's content, a single leaf. At every length it is contents that are compared; hashes only deal rows out, and leave out what occurs once.
5. Sorting. Every group is sorted by the operator's own method, in chunks of bounded size; classes of equal windows come out, each with its earliest place.
6. Removal. A place of a fragment loses the windows that have an earlier place; spans are merged for each document.

Rows are documents by (doc_id, hash of the text): repeated rows repeat in the result. Places are compared by (doc_id, start), so rows that share an id but not the text
are to words as any document is to itself, and to bytes like parts of one document that start together. A null doc_id is the smallest.

Only texts with a recurring anchor are shuffled, once; all tables between the steps are written to the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, buffer, changes, lists, materialise, record, release, runs, single, utf8

#: Units that one vectorised step handles, and bits of a unit's position in it.
STEP, POSITION_BITS = 1 << 18, 21
#: Fragments of one prefix beyond which the group gets a longer one; bytes of fragments that one sort handles.
CROWD = 512
CHUNK_BYTES = 1 << 19

#: What stands for a null doc_id: it sorts first.
NO_ID = -(1 << 63)

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

Normalise = Callable[[bytes], bytes]
#: From a buffer and the documents' offsets: value, start and stop of each unit, and where each document ends in units.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
#: From the fragments' contents and numbers of windows, a class number for each window, equal for equal windows.
Classes = Callable[[list[bytes], np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Kind:
    """What tells the operators apart.

    normalise: the text whose units count; glue: what parts the kept units; across: only earlier documents count, else earlier
    places of the same document as well.
    """

    width: int
    gram: int
    normalise: Normalise
    units: Units
    classes: Classes
    glue: bytes
    across: bool


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd constant and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * STEP)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            factors = np.full(size + 1, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of `gram` values, from differences of one running sum."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(values) - gram + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchor_runs(values: np.ndarray, ends: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of every run of windows that share an anchor.

    values: units of several documents end to end; ends: where each document ends. No window leaves its document.
    """
    n, width = len(values), kind.width
    firsts, counts, anchors = [], [], []
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    long = ends - starts >= width
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - width + 1, -1)
    valid = np.cumsum(change[:n]) > 0
    low = np.uint64((1 << POSITION_BITS) - 1)
    for at in range(0, max(0, n - width + 1), STEP):
        part = values[at : at + STEP + width - 1]
        ok = valid[at : at + len(part) - width + 1]
        if not ok.any():
            continue
        hashes = gram_hashes(part, kind.gram)
        keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        place = sliding_min(keyed, width - kind.gram + 1) & low
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
        first = np.flatnonzero(fresh & ok)
        stop = np.flatnonzero((fresh | ~ok)[1:]) + 1
        stop = np.append(stop, len(place))
        last = stop[np.searchsorted(stop, first, "right")]
        firsts.append(first + at)
        counts.append(last - first)
        anchors.append(hashes[place[first].astype(np.int64)])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(anchors)


def _measured(column: pa.Array, kind: Kind) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts, their units (values, starts, stops in the buffer), where documents end in units, and in bytes."""
    texts = [kind.normalise(t) for t in column.to_pylist()]
    data, offsets = buffer(pa.array(texts, pa.large_binary()))
    values, starts, stops, ends = kind.units(data, offsets)
    return texts, values, starts, stops, ends, offsets


def _groups(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Rows in groups of bounded text, a longer text alone."""
    _, offsets = buffer(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, len(column))
        start = min(stop, len(column))


def sketch(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, key, n, digest, anchors): units, digest of the normalised text, anchors of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _groups(batch.column(2)):
                texts, values, _, _, ends, _ = _measured(batch.column(2).slice(a, b - a), kind)
                first, _, anchors = anchor_runs(values, ends, kind)
                owner = np.searchsorted(ends, first, "right")
                counts = np.bincount(owner, minlength=len(texts))
                kept = [hashlib.sha256(t).digest() for t in texts]
                sizes = np.diff(np.concatenate([[0], ends]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), lists(anchors.view(np.int64), counts, pa.int64())], names=["doc_id", "key", "n", "digest", "anchors"])

    return docs.mapInArrow(run, "doc_id bigint, key bigint, n bigint, digest binary, anchors array<bigint>")


def recurring(sketches: DataFrame, firsts: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, key, anchors): of each first copy of a text, its anchors that occur elsewhere as well."""
    single = sketches.join(firsts.select("doc_id", "key"), ["doc_id", "key"], "left_semi").select("doc_id", "key", F.explode("anchors").alias("anchor"))
    if kind.across:
        often = single.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    else:
        often = single.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    often = materialise(often.select("anchor"), "anchors")
    return single.join(often, "anchor", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("anchors"))


_FRAGMENT = pa.schema([("anchor", pa.int64()), ("fid", pa.binary()), ("content", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])
_FRAGMENT_DDL = "anchor bigint, fid binary, content binary, doc_id bigint, key bigint, start bigint, windows bigint"


def _fid(content: bytes, prefix: int) -> bytes:
    """A name for a fragment's content under a prefix."""
    return hashlib.blake2b(content, digest_size=16, key=prefix.to_bytes(8, "little", signed=True)).digest()


def fragments(texts: DataFrame, kind: Kind) -> DataFrame:
    """(anchor, fid, content, doc_id, key, start, windows) of every fragment; start in units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _groups(batch.column(2)):
                texts, values, starts, stops, ends, _ = _measured(batch.column(2).slice(a, b - a), kind)
                first, count, anchors = anchor_runs(values, ends, kind)
                anchors = anchors.view(np.int64)
                wanted = np.unique(batch.column(3).slice(a, b - a).flatten().to_numpy())
                keep = np.flatnonzero(np.isin(anchors, wanted))
                if not len(keep):
                    continue
                first, count, anchors = first[keep], count[keep], anchors[keep]
                owner = np.searchsorted(ends, first, "right")
                whole = b"".join(texts)
                contents = [whole[s:e] for s, e in zip(starts[first].tolist(), stops[first + count + kind.width - 2].tolist(), strict=True)]
                begin = np.concatenate([[0], ends])[owner]
                fids = [_fid(c, k) for c, k in zip(contents, anchors.tolist(), strict=True)]
                ids, keys = (batch.column(i).slice(a, b - a).to_numpy()[owner] for i in (0, 1))
                yield record(_FRAGMENT, (anchors, fids, contents, ids, keys, first - begin, count))

    return texts.mapInArrow(run, _FRAGMENT_DDL)


def merged(places: DataFrame) -> DataFrame:
    """(anchor, fid, content, windows, doc_id, start): one row for each different fragment, with its earliest place."""
    least = F.min(F.struct("doc_id", "start"))
    found = places.groupBy("anchor", "fid").agg(least.alias("at"), F.first("content").alias("content"), F.first("windows").alias("windows"))
    return found.select("anchor", "fid", "content", "windows", "at.doc_id", "at.start")


_PLACES_DDL = "fid binary, times array<bigint>, docs array<bigint>, starts array<bigint>"


def _places(fids: pa.Array, windows: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """The place of each window of each fragment, as runs of windows whose places follow one another: mostly one run."""
    owner = np.repeat(np.arange(len(windows)), windows)
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (np.diff(owner) != 0) | (np.diff(docs) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(fresh)
    counts = np.bincount(owner[first], minlength=len(windows))
    times = np.diff(np.append(first, len(owner)))
    return pa.RecordBatch.from_arrays([fids, lists(times, counts, pa.int64()), lists(docs[first], counts, pa.int64()), lists(starts[first], counts, pa.int64())], names=["fid", "times", "docs", "starts"])


def earliest(different: DataFrame, kind: Kind, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(fid, times, docs, starts): for each window of each fragment, the earliest place of its class, in runs.

    different: (anchor, fid, content, windows, doc_id, start), one row for each different fragment with its earliest place. A group of
    one fragment has nothing to be compared with: no two windows of it are equal, since they hold the anchor at different offsets.
    """
    parts = int(different.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _chunks(batches, chunk_bytes):
            fresh = np.diff(np.concatenate([[0], changes(whole, ["anchor"]), [whole.num_rows]]))
            alone = np.repeat(fresh, fresh) == 1
            for some, sort in ((np.flatnonzero(alone), False), (np.flatnonzero(~alone), True)):
                if not len(some):
                    continue
                part = whole.take(pa.array(some)).combine_chunks()
                windows = part.column("windows").to_numpy()
                docs = np.repeat(part.column("doc_id").to_numpy(), windows)
                inside = np.arange(len(docs)) - np.repeat(np.cumsum(windows) - windows, windows)
                starts = np.repeat(part.column("start").to_numpy(), windows) + inside
                if sort:
                    found = kind.classes(part.column("content").to_pylist(), windows)
                    order = np.lexsort((starts, docs, found))
                    least = order[np.flatnonzero(np.diff(found[order], prepend=-1))]  # the earliest place of each class, by class
                    by = np.zeros(found.max() + 1, np.int64)
                    by[found[least]] = least
                    docs, starts = docs[by[found]], starts[by[found]]
                yield _places(single(part, "fid"), windows, docs, starts)

    return different.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(run, _PLACES_DDL)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor, in tables of whole groups and about `most` bytes of content."""

    def small() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(i, 256) for i in range(0, batch.num_rows, 256))

    held, size = [], 0
    for whole in runs(small(), ["anchor"], 1):
        held.append(whole)
        size += whole.column("content").nbytes
        if size >= most:
            yield pa.concat_tables(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def resolved(different: DataFrame, kind: Kind, crowd: int, chunk_bytes: int) -> DataFrame:
    """(fid, times, docs, starts) of all fragments, by prefixes as long as their groups need."""
    crowds = _crowds(different, crowd)
    found = earliest(different.join(crowds, "anchor", "left_anti"), kind, chunk_bytes)
    if not crowds.head(1):
        return found
    cut = materialise(extended(different.join(crowds, "anchor", "left_semi"), kind), "halves")
    halves = materialise(merged(cut), "different-halves")
    crowds = _crowds(halves, crowd)
    each = earliest(halves.join(crowds, "anchor", "left_anti"), kind, chunk_bytes)
    if crowds.head(1):
        each = each.unionByName(wholes(halves.join(crowds, "anchor", "left_semi"), kind))
    back = cut.select("parent", "skip", "fid").join(materialise(each, "earliest-halves"), "fid").groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("skip", "times", "docs", "starts"))).alias("x"))
    return found.unionByName(back.select(F.col("parent").alias("fid"), *[F.flatten(F.col(f"x.{c}")).alias(c) for c in ("times", "docs", "starts")]))


def _crowds(different: DataFrame, crowd: int) -> DataFrame:
    return materialise(different.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "crowds")


_HALF = pa.schema([*_FRAGMENT, ("parent", pa.binary()), ("skip", pa.int64())])
_HALF_DDL = f"{_FRAGMENT_DDL}, parent binary, skip bigint"


def extended(different: DataFrame, kind: Kind, size: int = 256) -> DataFrame:
    """The fragments under a prefix of half a window, which holds the anchor: (anchor, fid, content, doc_id, key, start, windows, parent, skip).

    Windows that reach half a window to the right of where the anchor starts are dealt by that half, the others, which come first, by the half that ends with the anchor. Which
    of both follows from the anchor's offset in the window, so equal windows still meet. skip: windows of the parent before the first.
    """
    width, gram, half = kind.width, kind.gram, kind.width // 2
    low = np.uint64((1 << POSITION_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                texts, values, starts, stops, ends, _ = _measured(part.column("content"), kind)
                whole, begin = b"".join(texts), np.concatenate([[0], ends[:-1]])
                hashes = gram_hashes(values, gram) & ~low
                anchor = hashes[begin[:, None] + np.arange(width - gram + 1)].argmin(axis=1)
                rows = []
                for b, p, n, parent, doc, start in zip(begin.tolist(), anchor.tolist(), *(part.column(c).to_pylist() for c in ("windows", "fid", "doc_id", "start")), strict=True):
                    left = min(max(p - (width - half), 0), n)
                    for skip, count, first in ((0, left, p + gram - half), (left, n - left, p)):
                        if count:
                            piece = whole[starts[b + first] : stops[b + first + half - 1]]
                            prefix = int.from_bytes(hashlib.blake2b(piece, digest_size=8, key=b"left" if first < p else b"right").digest(), "little", signed=True)
                            content = whole[starts[b + skip] : stops[b + skip + count + width - 2]]
                            rows.append((prefix, _fid(content, prefix), content, doc, 0, start + skip, count, parent, skip))
                yield record(_HALF, zip(*rows, strict=True))

    return different.mapInArrow(run, _HALF_DDL)


_PACKED = pa.schema([("chunk", pa.string()), ("fids", pa.list_(pa.binary())), ("contents", pa.list_(pa.binary())), ("windows", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("digests", pa.binary())])
_PACKED_DDL = "chunk string, fids array<binary>, contents array<binary>, windows array<bigint>, docs array<bigint>, starts array<bigint>, digests binary"
_DEALT = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("digests", pa.binary()), ("often", pa.binary())])
_MET = pa.schema([("chunk", pa.string()), ("digests", pa.binary())])
_ASKED = pa.schema([("chunk", pa.string()), ("content", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64())])


def wholes(different: DataFrame, kind: Kind, size: int = 256) -> DataFrame:
    """The same for groups whose prefix is the whole window: windows of one content are one leaf, and take its earliest place.

    Fragments are packed into chunks of `size`. First, windows that occur once are left out: chunks send digests of their windows to buckets, which
    send back those that come again. Of the others, a chunk sends each different content once, with its earliest place, and contents meet.
    Rows are chunks, or the different contents of a chunk, and not windows.
    """
    parts = int(different.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                contents, windows = part.column("content").to_pylist(), part.column("windows").to_pylist()
                digests = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in _windows(contents, windows, kind))
                row = (uuid.uuid4().hex, part.column("fid").to_pylist(), contents, windows, part.column("doc_id").to_pylist(), part.column("start").to_pylist(), digests)
                yield record(_PACKED, [[x] for x in row])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, times = np.unique(np.frombuffer(digests, "<u8"), return_counts=True)
                bucket = (keys % np.uint64(parts)).astype(np.int32)
                by = np.argsort(bucket, kind="stable")
                rows = [(int(bucket[some[0]]), chunk, keys[some].tobytes(), (times[some] > 1).tobytes()) for some in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(some)]
                if rows:
                    yield record(_DEALT, zip(*rows, strict=True))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, ["bucket"], 1):
            keys = [np.frombuffer(b, "<u8") for b in whole.column("digests").to_pylist()]
            often = [np.frombuffer(b, bool) for b in whole.column("often").to_pylist()]
            every, times = np.unique(np.concatenate([*keys, *(k[o] for k, o in zip(keys, often, strict=True))]), return_counts=True)
            again = every[times > 1]
            rows = [(chunk, found.tobytes()) for chunk, k in zip(whole.column("chunk").to_pylist(), keys, strict=True) if len(found := k[np.isin(k, again)])]
            if rows:
                yield record(_MET, zip(*rows, strict=True))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, contents, windows, docs, starts, digests, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = np.isin(np.frombuffer(digests, "<u8"), np.concatenate([np.frombuffer(b, "<u8") for b in again])).tolist()
                least: dict[bytes, tuple[int, int]] = {}
                for want, content, place in zip(wanted, _windows(contents, windows, kind), _each(windows, docs, starts), strict=True):
                    if want and place < least.get(content, (place[0], place[1] + 1)):
                        least[content] = place
                yield record(_ASKED, ([chunk] * len(least), list(least), [d for d, _ in least.values()], [s for _, s in least.values()]))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fids, contents, windows, docs, starts, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least = {f["content"]: (f["doc_id"], f["start"]) for f in found or ()}
                places = [least.get(content, place) for content, place in zip(_windows(contents, windows, kind), _each(windows, docs, starts), strict=True)]
                d, s = (np.array(x, np.int64) for x in zip(*places, strict=True))
                yield _places(pa.array(fids, pa.binary()), np.array(windows), d, s)

    packed = materialise(different.mapInArrow(pack, _PACKED_DDL), "packed")
    dealt = packed.select("chunk", "digests").mapInArrow(deal, "bucket int, chunk string, digests binary, often binary")
    met = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "chunk string, digests binary").groupBy("chunk").agg(F.collect_list("digests").alias("again"))
    asked = materialise(packed.join(met, "chunk").select(*packed.columns, "again").mapInArrow(ask, "chunk string, content binary, doc_id bigint, start bigint"), "asked")
    least = asked.groupBy("content").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("content", "at.doc_id", "at.start")
    told = asked.select("chunk", "content").join(least, "content").groupBy("chunk").agg(F.collect_list(F.struct("content", "doc_id", "start")).alias("found"))
    return packed.join(told, "chunk", "left").select("fids", "contents", "windows", "docs", "starts", "found").mapInArrow(unpack, _PLACES_DDL)


def _windows(contents: list[bytes], windows: list[int], kind: Kind) -> Iterator[bytes]:
    """The content of each window of each fragment."""
    for content, n in zip(contents, windows, strict=True):
        _, starts, stops, _ = kind.units(np.frombuffer(content, np.uint8), np.array([0, len(content)]))
        for a, b in zip(starts[:n].tolist(), stops[kind.width - 1 : kind.width - 1 + n].tolist(), strict=True):
            yield content[a:b]


def _each(windows: list[int], docs: list[int], starts: list[int]) -> Iterator[tuple[int, int]]:
    """The place of each window of each fragment."""
    for n, doc, start in zip(windows, docs, starts, strict=True):
        yield from ((doc, start + i) for i in range(n))


_SPANS_DDL = "doc_id bigint, key bigint, froms array<bigint>, tos array<bigint>"


def _lost(kind: Kind) -> Callable:
    """From (doc_id, key, start, times, docs, starts) of each place of a fragment to the spans of units that its windows remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            times, docs, starts = (batch.column(n).flatten().to_numpy() for n in ("times", "docs", "starts"))
            holder = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column("times").offsets)))
            owner = np.repeat(holder, times)
            counts = np.bincount(owner, minlength=batch.num_rows)
            starts = np.repeat(starts, times) + np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
            docs = np.repeat(docs, times)
            own = batch.column(0).to_numpy()[owner]
            place = batch.column(2).to_numpy()[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            gone = docs < own if kind.across else (docs < own) | ((docs == own) & (starts < place))
            at = np.flatnonzero(gone)
            if not len(at):
                continue
            # Consecutive windows of one fragment give one span.
            first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owner[at], prepend=-1) != 0))
            last = np.append(first[1:], len(at)) - 1
            rows, size = np.unique(owner[at[first]], return_counts=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in (0, 1)), lists(place[at[first]], size, pa.int64()), lists(place[at[last]] + kind.width, size, pa.int64())], names=["doc_id", "key", "froms", "tos"])

    return run


def _cut(kind: Kind) -> Callable:
    """From (doc_id, key, text, froms, tos) to (doc_id, key, removed, spans, digest of what is kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, text, froms, tos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = kind.normalise(text)
                _, starts, stops, _ = kind.units(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, np.array(froms, np.int64), 1)
                np.add.at(change, np.array(tos, np.int64), -1)
                gone = np.cumsum(change[:-1]) > 0
                keep = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                parts = [text[starts[a] : stops[b - 1]] for a, b in keep.reshape(-1, 2).tolist()]
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((doc, key, int(gone.sum()), spans, hashlib.sha256(kind.glue.join(parts)).digest()))
            if rows:
                yield record(pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("digest", pa.binary())]), zip(*rows, strict=True))

    return run


def remove_repeats(docs: DataFrame, kind: Kind, crowd: int = CROWD, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept_sha256) of every row of docs."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.coalesce(docs[doc_id].cast("bigint"), F.lit(NO_ID)).alias("doc_id"), utf8(docs, text).alias("text")).select("doc_id", F.xxhash64("text").alias("key"), "text")
    sketches = materialise(sketch(source, kind), "sketches")
    firsts = materialise(sketches.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("at")).select("digest", "at.doc_id", "at.key"), "firsts")
    hot = materialise(recurring(sketches, firsts, kind), "recurring")
    sizes = materialise(sketches.select("doc_id", "key", "n", "digest"), "sizes")
    release(sketches)  # its anchors are the largest table here, and done with
    document = ["doc_id", "key"]
    affected = materialise(source.join(hot, document).select(*document, "text", "anchors"), "affected")
    places = materialise(fragments(affected, kind), "fragments")

    different = materialise(merged(places), "different")
    found = materialise(resolved(different, kind, crowd, chunk_bytes), "earliest")
    release(different)

    lost = places.select("fid", *document, "start").join(found, "fid").select(*document, "start", "times", "docs", "starts").mapInArrow(_lost(kind), _SPANS_DDL)
    spans = lost.groupBy(*document).agg(F.flatten(F.collect_list("froms")).alias("froms"), F.flatten(F.collect_list("tos")).alias("tos"))
    cut = affected.select(*document, "text").join(spans, document).mapInArrow(_cut(kind), "doc_id bigint, key bigint, removed bigint, spans bigint, digest binary")
    cut = materialise(cut, "cut").dropDuplicates(document)

    copy = (F.col("s.doc_id") > F.col("f.doc_id")) & (F.col("n") >= kind.width)
    every = sizes.alias("s").join(firsts.alias("f"), F.col("s.digest") == F.col("f.digest")).select("s.doc_id", "s.key", "n", F.col("s.digest").alias("whole"), copy.alias("copy"))
    joined = every.join(cut.withColumnRenamed("digest", "rest"), document, "left")
    digest = F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex(F.coalesce("rest", "whole"))))
    return joined.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "n",
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        digest.alias("kept_sha256"),
    )
