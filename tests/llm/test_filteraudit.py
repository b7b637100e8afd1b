"""The audit of filters against a plain version that runs every order over every document."""

from __future__ import annotations

import re
from itertools import permutations

import pytest

from quarry.llm import filteraudit

DOCS = "doc_id bigint, text string, lang string, mask int, n string, good bigint"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def plain(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    seen: dict[str, int] = {}
    for doc, text, *_ in docs:
        if doc is not None:
            seen[text or ""] = min(doc, seen.get(text or "", doc))
    parts: dict[str, list] = {}
    for doc, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(set("#$%&*|") & set(text)), "E": doc is not None and seen[text] < doc,
        }
        said = [(q, t) for d, q, t, *_ in labels if d == doc and doc is not None]
        parts.setdefault(lang or "", []).append((fails, any(q == 1 for q, _ in said), any(t == 1 for _, t in said)))
    out, orders = set(), ["".join(p) for p in permutations("ABCDE")]
    for part, rows in parts.items():
        removed = {(o, i): [r for r in rows if r[0][o[i]] and not any(r[0][x] for x in o[:i])] for o in orders for i in range(5)}
        shapley = {f: sum(len(removed[o, o.index(f)]) for o in orders) for f in "ABCDE"}
        for o in orders:
            for i, f in enumerate(o):
                gone, before = removed[o, i], set(o[:i])
                out.add((
                    part, o, i + 1, sum(not any(r[0][x] for x in o[: i + 1]) for r in rows), len(gone), sum(r[0][f] and any(r[0][x] for x in before) for r in rows),
                    sum([x for x in "ABCDE" if r[0][x]] == [f] for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), shapley[f],
                ))
    return out


@pytest.fixture(scope="module")
def tables():
    long = " ".join(f"word{i}" for i in range(130))
    texts = [None, "", " \n", "short", long, long, long + " #", "A" * 40 + " " + long, "rep " * 150, long + " rep" * 90, long, "ÀÉ " * 30, "x|y", "tab\tsep " * 60 + "Z" * 3, long + " é" * 200_000]
    docs = [(i, t, ["en", None, "", "de"][i % 4], i, "n", 0) for i, t in enumerate(texts)]
    docs += [docs[4]] * 3 + [(None, long, "en", 0, "n", 0), (2, long, "fr", 0, "n", 0), (2, long, "de", 0, "n", 0), (None, "only here", "en", 0, "n", 0)] + [(50 + i, "copied", "en", 0, "n", 0) for i in range(40)]
    labels = [(4, 1, 0, "p"), (4, 0, 1, "p"), (5, 1, None, "p"), (6, None, 1, "p"), (None, 1, 1, "p"), (8, 1, 1, "p"), (8, 1, 1, "p"), (55, 0, 1, "p"), (99, 1, 1, "p"), (9, 1, 0, "p")]
    return docs, labels


def test_every_order(spark, tables):
    docs, labels = tables
    got = [tuple(r) for r in filteraudit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()]
    assert len(got) == len(set(got)) == 600 * 4 and set(got) == plain(docs, labels)


def test_empty_tables(spark, tables):
    docs, labels = tables
    none, few = spark.createDataFrame([], LABELS), spark.createDataFrame(docs[:5], DOCS)
    assert {tuple(r) for r in filteraudit.audit(few, none).collect()} == plain(docs[:5], [])
    assert filteraudit.audit(few.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_copies_meet_by_digest_and_id(spark, tables):
    docs, labels = tables
    plan = filteraudit.histogram(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join LeftOuter" in line]
    assert any("doc_id" in line and "digest" in line for line in joins), "a text that many share is no key of a join by itself"
