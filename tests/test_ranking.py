"""Batch search against the definition, by both ways, and the postings that its bounds leave unread."""

import collections
import math
import random

import numpy as np
import pytest

from weft.operators import ranking
from weft.operators import retrieval as R


def brute(docs, queries, k=10):
    n, mean = len(docs), max(1e-9, sum(len(t) for _, t in docs) / max(1, len(docs)))
    tf = [collections.Counter(t) for _, t in docs]
    df = collections.Counter(w for c in tf for w in c)
    out = []
    for q, asked in queries:
        raw = [(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(asked) if c[w]), i) for (i, t), c in zip(docs, tf)]
        best = sorted((-round(s, 9), i, s) for s, i in raw if s > 0)[:k]
        out += [(q, r, i, round(s / best[0][2], 6)) for r, (_, i, s) in enumerate(best, 1)]
    return sorted(out)


def made(seed=5, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, rng.choices(words, weights, k=rng.randrange(0, 60))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(30)] + [(n + 40, [])]
    queries = [(f"q{i}", rng.choices(words, weights, k=rng.randrange(1, 25))) for i in range(40)] + [("none", ["absent"]), ("empty", []), ("copies", docs[7][1])]
    return docs, queries


@pytest.mark.parametrize("most", [None, 0])
def test_batch_search(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(R, "MOST_TERMS", most)
    monkeypatch.setattr(ranking, "BLOCK", 64)
    docs, queries = made()
    d = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3)
    q = spark.createDataFrame(queries, "query_id string, tokens array<string>")
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in R.bm25_batch(d, q).collect())
    want = brute(docs, queries)
    assert [x[:3] for x in got] == [x[:3] for x in want] and max(abs(a[3] - b[3]) for a, b in zip(got, want)) < 2e-6
    assert R.bm25_batch(d.limit(0), q).count() == 0 and R.bm25_batch(d, q.limit(0)).count() == 0


def test_common_terms_are_looked_up_only(spark):
    """Five rare terms and twenty that every document has: the postings read are few once scores are known."""
    rng = np.random.default_rng(1)
    n = 4096
    doc = np.concatenate([np.tile(np.arange(n), 20), rng.choice(n, 5 * 60)])
    term = np.concatenate([np.repeat(np.arange(20), n), np.repeat(np.arange(20, 25), 60)])
    _, first = np.unique(doc * 100 + term, return_index=True)
    doc, term = doc[first], term[first]
    weight = np.where(term < 20, rng.random(len(term)) * 0.05, 5 + rng.random(len(term)))
    post = ranking.Postings(doc, term, weight, 25)
    score = np.bincount(doc, weight, n)
    at, got, read = ranking.best_of(post, np.arange(25), n, 10, 0.0)
    top = np.argsort(-score)[:10]
    assert set(top) <= set(at.tolist()) and np.allclose(got, score[at]) and read < 0.1 * len(doc)
