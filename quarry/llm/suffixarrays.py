"""Suffix-array dedup on bytes by the difference-cover algorithm.

Suffixes that can hold a repeated window are dealt out so that equal windows meet (see windows.py). Each group's suffix array comes from the
difference-cover algorithm: the triples at positions 1 and 2 modulo 3 are sorted and named; where names repeat, the sequence of
names is sorted by recursion; the remaining suffixes are sorted by their first byte and the name behind it, and merged. Neighbours in the array
are then compared over the window's width. A byte goes if a window covers it that also starts earlier, in a document with a smaller
doc_id or before in the same one; windows may overlap.

Sorting happens group by group and not in one global sort, since a sort of all suffixes would move some hundred times the input. Groups
hold all suffixes that share a content-defined prefix, so no equal pair is parted.

Defined results: null and empty texts have no bytes and the digest of none; texts shorter than a window lose nothing; of equal
windows the first place stays; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.windows import Kind, remove_repeats

WIDTH = 100
PREFIX = 24


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data) + 1)
    return data.astype(np.uint64) + np.uint64(1), at[:-1], at[1:], offsets[1:]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of positive integers."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    wide = np.concatenate([s, [0, 0, 0]]).astype(np.int64)
    base = int(wide.max()) + 1
    if base * base * max(base, n + 4) >= 2**63:
        raise ValueError(f"{n} suffixes are too many for one group")
    # Sample: positions 1 and 2 modulo 3; a position behind the end keeps the two halves apart.
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = (wide[sample] * base + wide[sample + 1]) * base + wide[sample + 2]
    order = np.argsort(triples, kind="stable")
    named = np.cumsum(np.diff(triples[order], prepend=-1) != 0)
    names = np.empty(len(sample), np.int64)
    names[order] = named
    if named[-1] < len(sample):
        order = suffix_array(names)
    ordered = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[ordered] = np.arange(1, len(ordered) + 1)
    ordered = ordered[ordered < n]
    # The others: by first element and the rank behind it.
    rest = np.arange(0, n, 3)
    more = n + 4
    rest = rest[np.argsort(wide[rest] * more + rank[rest + 1], kind="stable")]
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    less = np.searchsorted(wide[first] * more + rank[first + 1], wide[rest] * more + rank[rest + 1])
    triple = lambda i: (wide[i] * base + wide[i + 1]) * more + rank[i + 2]
    less = less + np.searchsorted(triple(second), triple(rest))
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + less
    mask = np.ones(n, bool)
    mask[place] = False
    out[place] = rest
    out[mask] = ordered
    return out


def same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the windows at a and b are equal, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, np.uint64, padded.tobytes(), strides=(1,))
    same = np.ones(len(a), bool)
    for at in [*range(0, width - 7, 8), *([width - 8] if width % 8 and width > 8 else [])]:
        same &= eights[a + at] == eights[b + at]
    if width < 8:
        for at in range(width):
            same &= data[a + at] == data[b + at]
    return same


def window_classes(contents: list[bytes], windows: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A number for each window of each fragment, in order, the same for equal windows."""
    # Bytes are 1 to 256 and fragments are parted by 0; a window never reaches the mark behind its fragment.
    data = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    lengths = windows + width
    symbols = data.astype(np.int64) + 1
    symbols[np.cumsum(lengths) - 1] = 0
    symbols += 1
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    is_window = np.zeros(len(data), bool)
    is_window[at] = True
    order = suffix_array(symbols)
    order = order[is_window[order]]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ~same_prefix(data, order[:-1], order[1:], width)
    found = np.empty(len(data), np.int64)
    found[order] = np.cumsum(fresh) - 1
    return found[at]


KIND = Kind(WIDTH, PREFIX, bytes, byte_units, window_classes, b"", across=False)


def remove_repeated_bytes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs."""
    return remove_repeats(docs, KIND, **how).withColumnRenamed("n", "n_bytes")
