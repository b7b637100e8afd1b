"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def _components(n: int, linked) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def simhash(docs: dict[int, str | None], shingle: int = 4, radius: int = 4) -> set[tuple]:
    marks = []
    for text in docs.values():
        words = SPACED.findall(lower(text or ""))
        grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        marks.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    ids = list(docs)
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, marks = [ids[i] for i in order], [marks[i] for i in order]
    top = _components(len(ids), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= radius)
    return {(ids[i], f"{marks[i]:016x}", ids[top[i]]) for i in range(len(ids))}


def secrets(docs: dict[int, str | None]) -> set[tuple]:
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = set()
    for doc, text in docs.items():
        text = text or ""
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        out.add((doc, *(sum(f[2] == k for f in found) for k in ("assign", "access", "hex")), sha(spans), spans))
    return out


def contamination(docs: dict[int, str | None], items: dict[int, str | None], width: int = 10) -> set[tuple]:
    owners = defaultdict(set)
    for item, text in items.items():
        words = FOLDED.findall(lower(text or ""))
        for i in range(max(1, len(words) - width + 1)) if words else ():
            owners[tuple(words[i : i + width])].add(item)
    out = set()
    for doc, text in docs.items():
        words, hit, held = FOLDED.findall(lower(text or "")), set(), set()
        for n in {len(w) for w in owners}:
            for i in range(len(words) - n + 1):
                if found := owners.get(tuple(words[i : i + n])):
                    held |= found
                    hit.update(range(i, i + n))
        out.add((doc, len(words), len(hit), len(held), sha(",".join(sorted(map(str, held)))), bool(hit)))
    return out


def repeated_words(docs: dict[int, str | None], width: int = 50) -> set[tuple]:
    words = {d: SPACED.findall(t or "") for d, t in sorted(docs.items())}
    first: dict[tuple, int] = {}
    for doc, w in words.items():
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), doc)
    out = set()
    for doc, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < doc:
                gone.update(range(i, i + width))
        spans = sum(i - 1 not in gone for i in gone)
        out.add((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)), spans))
    return out


def repeated_bytes(docs: dict[int, str | None], width: int = 100) -> set[tuple]:
    whole = {d: (t or "").encode() for d, t in sorted(docs.items())}
    first: dict[bytes, tuple] = {}
    for doc, b in whole.items():
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], (doc, i))
    out = set()
    for doc, b in whole.items():
        gone = set()
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (doc, i):
                gone.update(range(i, i + width))
        out.add((doc, len(b), len(gone), sum(i - 1 not in gone for i in gone), sha(bytes(x for i, x in enumerate(b) if i not in gone))))
    return out


def top_k(rows: list[tuple], k: int = 10, every: int = 100) -> set[tuple]:
    import math

    good = {i: [math.floor(1024 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in good.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def mixture(docs: list[tuple], weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> dict:
    """(source, size) -> (target, rate) of documents (source, size): shares filled up to their caps one round after the other, and each tilt found by halving."""
    import math

    sources = sorted({s for s, _ in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total = {s: sum(n for t, n in docs if t == s) for s in sources}
    target: dict = {}
    while True:
        left = [s for s in sources if s not in target]
        rest = sum(total.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        if not (over := [s for s in left if share[s] > cap * total[s]]):
            break
        target |= {s: cap * total[s] for s in over}
    target |= share
    rates = {}
    for s in sources:
        sizes = [n for t, n in docs if t == s and n]
        rate = lambda x, n: min(cap, math.exp(min(x * n, 9)))
        low, high = -1000.0, 1000.0
        for _ in range(200):
            x = (low + high) / 2
            low, high = (low, x) if sum(n * rate(x, n) for n in sizes) > target[s] else (x, high)
        rates |= {(s, n): (target[s], rate((low + high) / 2, n)) for n in sizes} | {(s, 0): (target[s], 0.0)}
    return rates
