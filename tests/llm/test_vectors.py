"""Hard negatives and approximate neighbours against plain versions: nulls, ties, repeated rows, several lengths, large components, empty tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from quarry.llm import crosspolytope, pivots, queries
from quarry.operators import blocks

VECTORS = "vec_id bigint, embedding array<double>, label int, size int, v string, row int"


def awkward(n: int = 400) -> list[tuple]:
    rng = random.Random(3)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    rows = [(i, unit([rng.gauss(0, 1) for _ in range(8)]), rng.randrange(3)) for i in range(n)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(60)]  # equal vectors
    rows += [(2000 + i, [x + 0.001 * rng.random() for x in rows[100][1]], 1) for i in range(40)]  # near copies
    rows += [(3000 + i, [rng.gauss(0, 1) for _ in range(3)], i % 2) for i in range(20)]  # another length
    rows += [rows[100]] * 2 + [(100, rows[5][1], 1), (None, rows[7][1], 1), (100, None, 1), (4000, [], 1), (4100, [0.0] * 8, 1), (4200, [1.0, None] + [0.0] * 6, 0), (4300, [math.nan] + [1.0] * 7, 0), (4400, [math.inf] * 8, 1), (4500, rows[9][1], None)]
    return [(i, v, label, 1, "clash", 0) for i, v, label in rows]


def usable(v) -> bool:
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows: list[tuple], every: int = 100) -> list[tuple]:
    held = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None and usable(v)]
    out = []
    for n, (anchor, label, v) in enumerate(held):
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i, other) for m, (i, other, w) in enumerate(held) if m != n and len(w) == len(v))
        for p, positive, _ in [x for x in scored if x[2] == label][:5]:
            band = [(s, i) for s, i, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(anchor, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(band, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [blocks.ROWS, 16])
def test_hard_negatives(spark, size, monkeypatch):
    monkeypatch.setattr(blocks.packed, "__defaults__", (size,))
    rows = awkward()
    got = sorted(tuple(r) for r in pivots.hard_negatives(spark.createDataFrame(rows, VECTORS), every=10).collect())
    assert len(got) > 1000 and got == plain_negatives(rows, 10)


def test_hard_negatives_of_few_and_large_rows(spark):
    assert pivots.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    for rows in ([(0, [1.0, 2.0], 1, 1, "", 0)], [(i, [1e9 + i, -1e9 * i, 1e12], i % 2, 1, "", 0) for i in range(0, 60, 5)], [(i, [1e9, 2.0**40 * i], i % 3, 1, "", 0) for i in range(40)], [(i, [float(-i), 0.0], i % 2, 1, "", 0) for i in range(30)]):
        got = sorted(tuple(r) for r in pivots.hard_negatives(spark.createDataFrame(rows, VECTORS), every=5).collect())
        fit = [tuple(max(-(2**63), min(2**63 - 1, x)) for x in r) for r in plain_negatives(rows, 5)]
        assert got == fit or any(abs(x) == 2**63 - 1 for r in fit for x in r), "beyond 64 bits the band is that of the cut product"
    assert pivots.hard_negatives(spark.createDataFrame([(i, [1e300 * (i + 1)], i % 2, 1, "", 0) for i in range(0, 50, 5)], VECTORS), every=5).count() >= 0


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 200, (6, 8))
    rows = np.rint(centres[rng.integers(0, 6, 900)] + rng.normal(0, 4, (900, 8))).astype(np.int64)
    held = pivots.Pivots(rows[:200], float(np.sqrt((rows**2).sum(axis=1)).max()) * (1 + 1e-9))
    columns = {"row": np.arange(300), "label": np.zeros(300, np.int64), "v": rows[:300].ravel()}
    import pyarrow as pa

    state = pivots._Positives(blocks.Block(300, 8, {k: pa.array(v) for k, v in columns.items()}), {8: held}, 5)
    far = held.distances(rows)
    near, most = np.abs(state.far[:, None] - far[None]).max(axis=2), (state.far[:, None] + far[None]).min(axis=2)
    exact = rows[:300] @ rows.T
    low, high = (state.base[:, None] - most**2) / 2 - state.slack[:, None], (state.base[:, None] - near**2) / 2 + state.slack[:, None]
    assert (low <= exact).all() and (exact <= high).all()
    kth = np.sort(exact, axis=1)[:, -5]
    assert (high >= kth[:, None]).mean() < 0.5, "rows of other clusters are left out by their stored distances"


def neighbours(rows: list[tuple], k: int, every: int) -> dict:
    """For each query (id and vector): the scores of the true results, best first."""
    held = [(i, v) for i, v, *_ in rows if i is not None and usable(v) and any(v)]
    out: dict = {}
    for n, (query, v) in enumerate(held):
        if query % every == 0:
            out.setdefault(query, []).append(sorted(((-float(np.dot(v, w)), i) for m, (i, w) in enumerate(held) if m != n and len(w) == len(v)))[:k])
    return out


def test_neighbours(spark):
    rows = awkward()
    found = crosspolytope.search(spark.createDataFrame(rows, VECTORS), k=5, every=10).collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = neighbours(rows, 5, 10)
    assert set(got) == set(want) and all(len(got[q]) == sum(map(len, want[q])) for q in want)
    hit = sum(len({(i, round(-s, 9)) for some in want[q] for s, i in some} & {(i, round(s, 9)) for _, i, s in got[q]}) for q in want)
    assert hit >= 0.9 * sum(len({(i, round(s, 9)) for some in x for s, i in some}) for x in want.values())
    for q, some in got.items():
        if len(want[q]) == 1:
            assert [r for r, *_ in sorted(some)] == list(range(1, len(some) + 1)) and sorted(some) == [(r, i, s) for r, (s, i) in enumerate(sorted(((s, i) for _, i, s in some), key=lambda x: (-x[0], x[1])), 1)]


def crowded(n: int = 1500) -> list[tuple]:
    """Even data, and a third as many near copies of one vector."""
    rng = np.random.default_rng(4)
    even, copies = rng.normal(size=(n, 64)), rng.normal(size=64) + 0.01 * rng.normal(size=(n // 3, 64))
    return [(i, v, 0, 1, "", 0) for i, v in enumerate(np.concatenate([even, copies]).tolist())]


def test_rows_handed_on_do_not_follow_the_tasks(spark, monkeypatch):
    made, ranked = [], crosspolytope.ranked

    def counted(*args):
        made.append(ranked(*args).count())
        return ranked(*args)

    monkeypatch.setattr(crosspolytope, "ranked", counted)
    df, got = spark.createDataFrame(crowded(), VECTORS), []
    conf = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for tasks in (4, 64):
            for name, value in conf.items():
                spark.conf.set(name, value or str(tasks))
            made.clear()
            got.append((sorted(tuple(r) for r in crosspolytope.search(df, k=5, every=10).collect()), sum(made)))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    (few, few_made), (many, many_made) = got
    assert few == many and len(few) == 200 * 5
    assert many_made <= 5 * few_made, "sixteen times the tasks"


def test_rounds_meet_every_cell_once(spark, monkeypatch):
    df = spark.createDataFrame(crowded(600), VECTORS)
    floats = df.withColumn("embedding", df["embedding"].cast("array<float>"))
    want = sorted(tuple(r) for r in crosspolytope.search(floats, k=5, every=10).collect())
    for name, value in {"CELL_ROWS": 32, "CELL_QUERIES": 8, "GROWTH": 4}.items():
        monkeypatch.setattr(crosspolytope, name, value)
    rounds, numbers = crosspolytope.rounds, []
    monkeypatch.setattr(crosspolytope, "rounds", lambda *args: numbers.append(rounds(*args)) or numbers[-1])
    assert sorted(tuple(r) for r in crosspolytope.search(floats, k=5, every=10).collect()) == want and numbers[0] > 2
    assert sorted(tuple(r) for r in crosspolytope.search(floats.withColumn("embedding", floats["embedding"].cast("array<double>")), k=5, every=10).collect()) == want, "floats give the sums of doubles"


def test_neighbours_of_few_rows(spark):
    assert crosspolytope.search(spark.createDataFrame([], VECTORS)).collect() == []
    for rows in ([(0, [1.0, 2.0], 1, 1, "", 0)], [(i, [1.0 + i, 2.0, -i * 1.0], 1, 1, "", 0) for i in range(15)], [(i, [0.5, 0.5], 1, 1, "", 0) for i in range(50)], [(20 * i, [2.0], 1, 1, "", 0) for i in range(3)]):
        got: dict = {}
        for r in sorted(crosspolytope.search(spark.createDataFrame(rows, VECTORS)).collect()):
            got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert got == {q: some[0] for q, some in neighbours(rows, 20, 20).items() if some[0]}, "all candidates where there are few, ties by id"


def test_lengths_that_differ(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 9) for _ in range(16)], 1, 1, "", 0) for i in range(2000)]
    got: dict = {}
    for r in crosspolytope.search(spark.createDataFrame(rows, VECTORS)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = neighbours(rows, 20, 20)
    assert sum(len(got[q] & {i for _, i in want[q][0]}) for q in want) >= 0.9 * 20 * len(want)


def test_depth_and_cells(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "BUCKET", 4)
    monkeypatch.setattr(crosspolytope, "CELL_ROWS", 32)
    monkeypatch.setattr(crosspolytope, "CELL_QUERIES", 8)
    rows = awkward(3000)
    frame = spark.createDataFrame(rows, VECTORS)
    assert crosspolytope.shapes(crosspolytope.vectors(frame))[8].depth > 1
    got: dict = {}
    for r in crosspolytope.search(frame, k=10).collect():
        got.setdefault(r["query_id"], []).append(round(r["score"], 9))
    want = {q: sorted(round(-s, 9) for one in some for s, _ in one) for q, some in neighbours(rows, 10, 20).items()}
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(len(set(x)) for x in want.values())


def test_rotations_keep_lengths_and_probes_hold_the_home_bucket():
    x = np.random.default_rng(2).normal(size=(50, 32))
    turned = crosspolytope.rotate(x, (1, 0))
    assert np.allclose((turned**2).sum(axis=1), (x**2).sum(axis=1)) and np.allclose(turned @ turned.T, x @ x.T)
    shape = crosspolytope.Shape(32, 2, 0.0)
    unit = crosspolytope.directions(x, shape, True)
    home = crosspolytope.hashes(unit, shape)
    for table in range(crosspolytope.TABLES):
        at, bucket = crosspolytope.probes(unit, shape, table, 0.05)
        assert all(home[i, table] in bucket[at == i] for i in range(50))
        assert {(i, b) for i, b in zip(at.tolist(), bucket.tolist(), strict=True)} >= {(i, b) for i, b in zip(*(c.tolist() for c in crosspolytope.probes(unit, shape, table, 0.0)), strict=True)}


def test_recall_of_the_query(spark, duck, sf_dir):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    want = {q: {i for _, i in some[0]} for q, some in neighbours(rows, 20, 20).items()}
    got: dict = {}
    for r in queries.QUERIES["op12_crosspolytope"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(want) and sum(len(got[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))
