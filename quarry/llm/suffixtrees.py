"""Substring dedup on words by prefix-partitioned suffix trees.

Suffixes of word sequences are divided into groups that fit in memory by prefixes of variable length: the eight words at their
anchor, half a window where a group is still too large, and at last the whole window, a single leaf (see windows.py). Each group's suffix tree is built on
its own, as the sorted suffixes with the lengths of the prefixes that neighbours have in common, cut at the window's width: an internal node is a run of suffixes whose
common prefixes reach its depth. The nodes at the window's width are the maximal repeats: the suffixes below one begin with the same window. A word goes if such a window covers it that also starts
in a document with a smaller doc_id.

Defined results: null and wordless texts have no words, nothing is removed and the digest is that of no bytes; texts with fewer words
than a window lose nothing; ties do not exist, since a repeat inside one document does not count; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.windows import Kind, mixed, powers, remove_repeats

WIDTH = 50
PREFIX = 8


def normalise(text: bytes) -> bytes:
    return b" ".join(text.split())  # of bytes: white space is \x20 and \x09-\x0D


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of normalised texts: a hash of each word, its start and stop in the buffer, and where each text ends in words."""
    letter = data != 0x20
    filled = offsets[:-1][np.diff(offsets) > 0]
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    before[filled] = False
    starts = np.flatnonzero(letter & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = ~before[1:] & letter[:-1] | ~letter[1:]
    if len(data):
        after[-1] = True
    stops = np.flatnonzero(letter & (after | np.concatenate([~letter[1:], [True]])[: len(data)])) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    values = mixed((sums[stops] - sums[starts]) * down[starts])
    return values, starts, stops, np.searchsorted(starts, offsets[1:], "left")


class Subtree:
    """The suffix tree of a sequence, cut at a depth: suffixes in order and the lengths of neighbours' common prefixes."""

    def __init__(self, symbols: np.ndarray, depth: int):
        # Ranks of the prefixes of 1, 2, 4, ... symbols, and of the whole depth: each sorts pairs of those before it.
        ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1]
        span = 1
        while span * 2 <= depth:
            ranks.append(self._paired(ranks[-1], span))
            span *= 2
        self.order = np.argsort(self._paired(ranks[-1], depth - span) if span < depth else ranks[-1], kind="stable")
        self.common = np.zeros(len(symbols), np.int64)  # with the suffix before
        self.common[1:] = self._common(ranks, self.order[:-1], self.order[1:], depth)

    @staticmethod
    def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """How many symbols the suffixes at a and b have in common, up to the depth: the longest steps that agree, one after the other."""
        n = len(ranks[0])
        same = np.zeros(len(a), np.int64)
        for level in reversed(range(len(ranks))):
            rank, step = np.append(ranks[level], 0), 1 << level
            equal = rank[np.minimum(a + same, n)] == rank[np.minimum(b + same, n)]
            same += np.where(equal & (same + step <= depth) & (np.maximum(a, b) + same < n), step, 0)
        return same

    @staticmethod
    def _paired(rank: np.ndarray, ahead: int) -> np.ndarray:
        other = np.zeros_like(rank)
        other[: len(rank) - ahead] = rank[ahead:] if ahead < len(rank) else 0
        return np.unique(rank * (int(rank.max(initial=0)) + 1) + other, return_inverse=True)[1].astype(np.int64) + 1

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix, the number of the node at the depth that it is below."""
        below = np.cumsum(self.common < depth) - 1 if len(self.common) else np.zeros(0, np.int64)
        out = np.empty(len(below), np.int64)
        out[self.order] = below
        return out


def window_classes(contents: list[bytes], windows: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A number for each window of each fragment, in order, the same for equal windows."""
    known: dict[bytes, int] = {b"": 0}
    symbols: list[int] = []
    for content in contents:
        symbols += [known.setdefault(word, len(known)) for word in content.split(b" ")]
        symbols.append(0)
    starts = np.cumsum(windows + width) - (windows + width)  # a fragment has windows + width - 1 words and an end mark
    at = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    nodes = Subtree(np.array(symbols, np.int64), width).nodes(width)
    return np.unique(nodes[at], return_inverse=True)[1]


KIND = Kind(WIDTH, PREFIX, normalise, word_units, window_classes, b" ", across=True)


def remove_repeated_words(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_spans) of every row of docs."""
    return remove_repeats(docs, KIND, **how).withColumnRenamed("n", "n_words").select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans")
