"""Exact top-k against brute force: odd rows, equal ids, great numbers; and what the bounds leave out."""

import collections
import math

import numpy as np

from weft.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string, block int"


def brute(rows, every=50, k=5):
    good = []
    for at, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v):
            good.append((at, i, [math.floor(256 * x) for x in v]))
    out = collections.Counter()
    for at, i, v in good:
        if i % every == 0:
            best = sorted((-max(min(sum(a * b for a, b in zip(v, w)), topk.HIGH), topk.LOW), j) for o, j, w in good if o != at)[:k]
            out[tuple((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))] += 1
    return collections.Counter(x for rows, n in out.items() for x in rows for _ in range(n))


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, **more).collect())


def test_odd_rows_equal_ids_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(130)] + [(200, [float("nan")] * 6), (250, None), (251, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [0.0] * 6), (None, [1.0] * 6), (350, [float("inf")] * 6), (400, []), (450, [1.0, 2.0])]
    rows += [(i, rows[0][1]) for i in (40, 41, 42)] + [(0, rows[0][1]), (0, rows[5][1]), (50, rows[0][1])] + [(7, rows[0][1])] * 3
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, block=20) == brute(rows)
    assert found(spark, rows[:3]) == brute(rows[:3]) and found(spark, [(0, [1.0])]) == {}
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_numbers_beyond_floating_point(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 9)).tolist()) for i in range(120)] + [(200, [1e200, 1.0, 0.0, 0.0]), (201, [-1e200, 3.0, 0.0, 0.0]), (202, [1e307] * 4), (250, [2.0**45, 1.0, 0.0, 0.0]), (251, [2.0**45, 3.0, 0.0, 0.0])]
    assert found(spark, rows) == brute(rows)


def share(vectors, asked, k=5):
    """The share of candidates that is evaluated, with seeds as in the job."""
    x = np.floor(256 * vectors)
    pivots = topk.Pivots(x[: topk.SAMPLE], topk.PIVOTS)
    ids = np.arange(len(x))
    seeds = x[asked] @ x[: topk.SAMPLE].T
    seeds[np.arange(len(asked))[asked < topk.SAMPLE], asked[asked < topk.SAMPLE]] = -np.inf
    least = np.partition(seeds, -k, axis=1)[:, -k]
    found, evaluated = topk.best_of_block(x[asked], asked, least, x, ids, ids, pivots, k)
    for q in range(len(asked)):
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[asked[q]]) if i != asked[q])[:k]
        assert sorted((-s, c) for a, c, s in found if a == q) == want
    return evaluated / (len(asked) * len(x))


def test_bounds_leave_most_candidates_out():
    rng = np.random.default_rng(6)
    even = rng.normal(size=(6000, 64))
    even /= np.linalg.norm(even, axis=1)[:, None]
    assert share(even, np.arange(0, 6000, 100)) < 0.35  # no structure at all: the worst case
    middles = rng.normal(size=(40, 64))
    clustered = middles[rng.integers(0, 40, 6000)] + 0.15 * rng.normal(size=(6000, 64))
    clustered /= np.linalg.norm(clustered, axis=1)[:, None]
    assert share(clustered, np.arange(0, 6000, 100)) < 0.06


def test_cells_that_no_query_can_reach_are_not_visited():
    rng = np.random.default_rng(7)
    middles = 20 * rng.normal(size=(10, 16))
    x = np.floor(256 * (middles[np.arange(1000) % 10] + 0.1 * rng.normal(size=(1000, 16))))
    pivots = topk.Pivots(x, 10)
    table = pivots.distances(x)
    cell = table.argmin(1)
    low, high = (np.stack([f(table[cell == c], 0) for c in range(10)]) for f in (np.min, np.max))
    longest = np.array([(x[cell == c] ** 2).sum(1).max() for c in range(10)])
    scores = x @ x.T
    least = np.partition(scores, -6, axis=1)[:, -6].astype(float)
    open_to = topk.reachable(table, (x**2).sum(1), least, low, high, longest)
    assert open_to.mean() < 0.5
    for q in range(0, 1000, 37):
        assert set(cell[np.flatnonzero(scores[q] >= least[q])]) <= set(np.flatnonzero(open_to[q]))
