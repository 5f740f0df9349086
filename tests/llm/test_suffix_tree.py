"""The suffix tree against one that is grown in memory from its definition, and its base columns."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from weft.llm import suffix_tree

D, LEAST, LIMIT = suffix_tree.DISCOUNT, suffix_tree.LEAST, suffix_tree.DIVERGENCE


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


class Grown:
    """Contexts as tuples, the nearest word last."""

    def __init__(self, texts):
        rows = [[b" ", *tokens(x)] for x in texts]
        self.counts = collections.Counter(w for r in rows for w in r[1:])
        self.total, self.distinct = sum(self.counts.values()), len(self.counts)
        self.discount = max(sum(n == 1 for n in self.counts.values()), 1) / (self.distinct + 1)
        self.rest, self.own, level = {}, {}, 1
        while True:
            found = collections.defaultdict(collections.Counter)
            for r in rows:
                for i in range(level, len(r)):
                    found[tuple(r[i - level : i])][r[i]] += 1
            before = len(self.rest)
            for context, then in found.items():
                if level > 1 and context[1:] not in self.rest or (c := sum(then.values())) < LEAST:
                    continue
                kept, mass, low_mass, gained = {}, 0.0, 0.0, 0.0
                for x, n in then.items():
                    if n >= LEAST:
                        low = 10 ** self.log(context[1:], x)
                        if abs(n * math.log(n / (c * low))) >= LIMIT:
                            kept[x] = own = (n - D) / c
                            mass, low_mass, gained = mass + own, low_mass + low, gained + own * math.log(own / low)
                left = (1 - mass) / (1 - min(low_mass, 1 - 1e-9))
                if kept and c * (gained + (1 - mass) * math.log(left)) >= LIMIT:
                    self.rest[context] = math.log10(left)
                    self.own[context] = {x: math.log10(p) for x, p in kept.items()}
            if len(self.rest) == before:
                break
            level += 1

    def log(self, context, x):
        """log10 of the probability of x after a context, whose suffixes are tried if it was not retained."""
        if not context:
            n = self.counts[x]
            return math.log10((n - self.discount) / self.total) if n else math.log10(self.discount * self.distinct / self.total)
        if context not in self.rest:
            return self.log(context[1:], x)
        if x in self.own[context]:
            return self.own[context][x]
        return self.rest[context] + self.log(context[1:], x)

    def longest(self, before):
        """The longest suffix of what came before that is retained, all of whose own suffixes are."""
        k = 0
        while k < len(before) and tuple(before[len(before) - k - 1 :]) in self.rest:
            k += 1
        return tuple(before[len(before) - k :])

    def score(self, text):
        r = [b" ", *tokens(text)]
        return sum(self.log(self.longest(r[:i]), r[i]) for i in range(1, len(r)))


def corpus():
    rng = random.Random(2)
    common = "the quick brown fox jumps over the lazy dog and runs away".split()
    other = "the quick brown cat sleeps under the lazy tree".split()
    texts = [" ".join(rng.choice([common, other]) if rng.random() < 0.6 else rng.choices([*common, *other, f"rare{i % 40}"], k=15)) for i in range(4000)]
    texts += [None, "", " ", "Unseen words only", "THE quick\x0bbrown\x1cfox", "é" * 3 + " the lazy", "the quick brown fox " * 3000]
    return texts, [*range(len(texts))]


@pytest.mark.parametrize("tiers", [(200_000, 1_000_000), (5, 20), (0, 0)])
def test_scores_are_those_of_the_definition(spark, tiers):
    texts, ids = corpus()
    docs = spark.createDataFrame([(i, x, "n", 1) for i, x in zip(ids, texts)], "doc_id long, text string, word string, n int").repartition(3)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in ids]
    tree = Grown([x for x, t in zip(texts, train) if t])
    assert max(map(len, tree.rest)) >= 2, "deeper than two words"
    rows = {r.doc_id: r for r in suffix_tree.scored(docs, hot_words=tiers[0], hot_nodes=tiers[1]).collect()}
    assert len(rows) == len(ids)
    for i, x, t in zip(ids, texts, train):
        r, words = rows[i], tokens(x)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not t, len(words), sum(tree.counts[w] > 0 for w in words), tree.total)
        assert r.base_score == pytest.approx(sum(math.log10((tree.counts[w] + 1) / (tree.total + tree.distinct + 1)) for w in words))
        assert r.score == pytest.approx(tree.score(x), abs=1e-5, rel=1e-7), i
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # after any context the probabilities of all words and of the unknown ones sum to one
    for context in [(), *tree.rest][:60]:
        assert sum(10 ** tree.log(context, x) for x in tree.counts) + 10 ** tree.log(context, b"unknown") == pytest.approx(1)


def test_contexts_that_are_rare_in_a_row_are_not_counted(spark, monkeypatch):
    own, sums = suffix_tree.windows, {}

    def told(texts, level, bitmap):
        found = own(texts, level, bitmap)
        sums[level] = [r["sum(n)"] for r in found.groupBy(*suffix_tree.context_columns(level)).sum("n").collect()]
        return found

    monkeypatch.setattr(suffix_tree, "windows", told)
    docs = spark.createDataFrame(list(zip(*reversed(corpus()))), "doc_id long, text string").repartition(3)
    suffix_tree.scored(docs)
    print({k: (len(v), sum(n < LEAST for n in v)) for k, v in sums.items()})
    assert len(sums[3]) > 50 and sum(n < LEAST for n in sums[3]) < 0.2 * len(sums[3])


def test_rows_without_ids_equal_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(0, "a b"), (0, "a b"), (None, "a c"), (2, None)], "doc_id long, text string")
    rows = suffix_tree.scored(docs).collect()
    assert sorted((r.doc_id is None, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows if r.doc_id != 2)[-1][1] is None
    assert sum(r.doc_id == 0 for r in rows) == 2 and len(rows) == 4
    assert suffix_tree.scored(docs.limit(0)).count() == 0
    nothing = suffix_tree.scored(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (nothing.score, nothing.n_known, nothing.train_tokens) == (0.0, 0, 0)


def test_sequences_and_bitmaps():
    import pyarrow as pa

    distinct, at, sizes = suffix_tree.tokenised(pa.array(["A  b", "", " a "]))
    assert [distinct[i] for i in at] == [" ", "a", "b", " ", " ", " ", " ", "a", " "] and sizes.tolist() == [4, 2, 3]
    symbols = suffix_tree.Words(["a"]).symbols(distinct)[at]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cold = np.concatenate([[0], np.cumsum([sum(symbols[a:b] < 0) for a, b in zip(ends, ends[1:])])])
    rows = suffix_tree.Sequence(suffix_tree.packed_lists(np.maximum(symbols, -1).astype(np.int32), ends), suffix_tree.packed_lists(symbols[symbols < 0], cold))
    assert rows.symbol.tolist() == symbols.tolist()
    assert rows.room.tolist() == [0, 1, 2, 3, 0, 1, 0, 1, 2] and rows.sizes.tolist() == [3, 1, 2] and rows.symbol[1] == 0
    bits = suffix_tree.Bitmap()
    assert not bits.has(np.arange(100, dtype=np.uint64)).any()


def test_contexts_earn_their_place_on_held_out_texts(spark):
    """Perplexity of held-out words: with single words only it is about 6500 here, with the shipped thresholds it must keep
    at least half (in logarithms) of what LEAST 8 and DIVERGENCE 6 gained, 2844."""
    import os

    path = os.environ.get("SUFFIX_TREE_TEST", "/root/testdata/sf0.1/documents.parquet")
    if not os.path.exists(path):
        pytest.skip("the table is not here")
    rows = suffix_tree.scored(spark.read.parquet(path)).where("held_out").selectExpr("sum(score) as s", "sum(n_tokens) as n").first()
    perplexity = 10 ** (-rows.s / rows.n)
    print("held-out perplexity", perplexity)
    assert perplexity < math.sqrt(6493 * 2844)


def test_pairs_of_words_that_are_rare_are_shuffled_in_few_bytes(spark, monkeypatch):
    """Most pairs of a corpus are rare; rows of three longs took about eleven bytes a pair in the shuffle."""
    own, told = suffix_tree.windows, {}

    def kept(texts, level, bitmap):
        found = own(texts, level, bitmap)
        if level == 1:
            told["sent"] = suffix_tree.occurrences(texts, level, bitmap, 8).selectExpr("sum(size)", "sum(octet_length(rows))").first()
            told["rare"] = found.where(f"n < {LEAST}").count()
        return found

    monkeypatch.setattr(suffix_tree, "windows", kept)
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(1500)}" for _ in range(100))) for i in range(2500)], "doc_id long, text string").repartition(2)
    suffix_tree.scored(docs)
    (size, sent), rare = told["sent"], told["rare"]
    print(size, sent, rare)
    assert size > 100_000 and sent < 5 * size and rare == 0


@pytest.mark.parametrize("width", [1, 2, 5])
def test_rows_of_symbols_are_summed_and_come_back(width):
    rng = np.random.default_rng(width)
    symbols = np.concatenate([np.arange(50), rng.integers(-(2**63), 0, 40), [suffix_tree.OTHER, suffix_tree.RARE, 199_999]])
    for many in (1, 2, 3000):
        columns = [rng.choice(symbols, many) for _ in range(width)]
        times = rng.integers(1, 5, many)
        for n in (None, times):
            want = collections.Counter()
            for row, k in zip(zip(*(c.tolist() for c in columns)), [1] * many if n is None else n.tolist()):
                want[row] += k
            rows, sums = suffix_tree.summed(columns, n)
            assert dict(zip(zip(*(c.tolist() for c in rows)), sums.tolist())) == want and len(sums) == len(want)
            again = suffix_tree.unsqueezed(suffix_tree.squeezed([*rows, sums]), width + 1, len(sums))
            assert [c.tolist() for c in again] == [c.tolist() for c in (*rows, sums)]
