"""Hard negatives against brute force: odd rows, equal ids, ties, great numbers; and how much the vertical scan leaves unread."""

import collections
import math

import numpy as np
import pytest

from weft.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, uid int, rank string, block string"


def brute(rows, every=100, low=30, high=90):
    good = [(at, i, [math.floor(256 * x) for x in v], m) for at, (i, v, m) in enumerate(rows) if i is not None and m is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    score = lambda v, w: max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63))
    out = collections.Counter()
    for at, i, v, m in good:
        if i % every:
            continue
        all_of = sorted((-score(v, w), j, o, n) for o, j, w, n in good if o != at)
        for s, j, _, _ in [x for x in all_of if x[3] == m][:5]:
            inside = [(t, c) for t, c, _, n in all_of if n != m and low * -s <= 100 * -t <= high * -s][:10]
            out.update((i, j, r, c, -s, -t) for r, (t, c) in enumerate(inside, 1))
    return out


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, v, m, 1, "x", "y") for i, v, m in rows], SCHEMA).repartition(3)
    return collections.Counter(tuple(r) for r in hn.mined(table, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made(n, width=6, seed=3, labels=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, width))
    return [(i, (middle[i % labels] * 0.5 + rng.normal(size=width)).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_odd_rows_equal_ids_and_ties(spark):
    rows = made(420)
    rows += [(500, [float("nan")] * 6, 1), (600, None, 1), (601, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (700, [0.0] * 6, 2), (None, [1.0] * 6, 1), (800, [float("inf")] * 6, 0), (900, [], 1), (1000, [1.0, 2.0], 2), (1100, [1.0] * 6, None), (1200, [1.0] * 6, 99)]
    rows += [(0, rows[0][1], rows[0][2]), (0, rows[5][1], rows[0][2]), (100, rows[0][1], 1), (41, rows[7][1], 2), (42, rows[7][1], 2)] + [(43, rows[8][1], 1)] * 14
    want = brute(rows)
    assert len(want) > 100 and found(spark, rows) == want
    assert found(spark, rows, block=50) == want
    assert found(spark, rows[:1]) == {} and found(spark, [(0, [1.0], 1), (1, [2.0], 1)]) == {}
    assert hn.mined(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_numbers_beyond_floating_point(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 9)).tolist(), int(i % 2)) for i in range(220)] + [(300, [1e200, 1.0, 0.0, 0.0], 0), (301, [-1e200, 3.0, 0.0, 0.0], 1), (302, [1e307] * 4, 1), (400, [2.0**45, 1.0, 0.0, 0.0], 1), (401, [2.0**45, 3.0, 0.0, 0.0], 0)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("low, high", [(0, 100), (90, 99), (-50, 20)])
def test_other_windows(spark, low, high):
    rows = made(310, seed=9)
    assert found(spark, rows, low=low, high=high) == brute(rows, low=low, high=high)


def test_the_scan_reads_less_than_all(spark):
    """Dimensions of falling weight, as after a rotation to principal axes: most candidates leave before the last ones."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(8000, 64)) * 0.9 ** np.arange(64))
    label = rng.integers(5, size=len(x))
    ids = np.arange(len(x))
    block = hn.Block(x, ids, ids, label)
    read = size = 0
    for q in range(0, len(x), 400):
        same, other = np.flatnonzero(label == label[q]), np.flatnonzero(label != label[q])
        at, score, n = hn.positives_in(block, x[q], q, same, -np.inf, 5)
        every = x @ x[q]
        assert score.tolist() == sorted(every[same[same != q]], reverse=True)[:5]
        windows = [(*hn.window(int(s), 30, 90), -np.inf) for s in score]
        got, m = hn.negatives_in(block, x[q], other, windows, 10)
        for (a, b, _), (_, scores) in zip(windows, got):
            assert scores.tolist() == sorted((s for s in every[other] if a <= s <= b), reverse=True)[:10]
        read, size = read + n + m, size + x.size
    assert read < 0.6 * size


def test_label_noise(spark):
    rows = [(i, [1.0], m) for i, m in [(7, 9), (14, 3), (8, 4), (0, None)]]
    got = hn.noisy_labels(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: r.label for r in got.collect()} == {7: 0, 14: 4, 8: 4, 0: None}
