"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its distinct words' character n-grams (with marks for the word's ends) and whole words, each hashed to a
bucket with an embedding. The mean of the embeddings (with NEUTRAL
zero vectors, so that a few subwords do not decide) goes through a linear layer and a softmax over two classes; both
layers are trained together. Unseen spellings share n-grams, and so vectors, with seen words.

Because the layer after the mean is linear, a bucket adds a fixed number to the log-odds; the trained model is broadcast
as one float per bucket, whose size does not depend on the data.

Defined results: a null text is an empty text, scored by the bias alone; texts of any length are scored whole; without
usable labels of both classes every score is the share of toxic labels (0 without labels); several labels for one id
count as toxic if one is; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Cache, fold, row_filter, spread, steps, text_rows

#: The fit takes at most so many labelled texts of each class, by a hash of the id; each as the bag of its whole text.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 3000
BITS, DIMENSIONS, SHORTEST, LONGEST = 17, 4, 3, 6
BUCKETS, NEUTRAL = 1 << BITS, 400
STEPS, BATCH, RATE, DECAY, SEED = 300, 200, 0.3, 0.003, 7
CACHED = 250_000
#: A bag's entry has a bucket above so many bits and a count in them; a greater count takes several entries.
COUNT_BITS = 32 - BITS
MOST = (1 << COUNT_BITS) - 1
#: Entries of bags that the fit unpacks at a time, and words whose subwords are taken at a time.
UNPACKED, WORDS_PER_STEP = 2_000_000, 10_000
PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def words_of(text: str) -> list[bytes]:
    """Distinct words between ASCII white space, A-Z lowered."""
    return sorted(set(text.encode().lower().split()))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the words, and the number of the word that each belongs to."""
    marked = [f"<{w.decode()}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.repeat(np.cumsum(sizes), sizes)
    of = np.repeat(np.arange(len(marked)), sizes)
    at = np.arange(len(points))
    buckets, owner = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):  # rolled: a hash of the n code points from each place on
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        rolled = rolled * PRIMES[0] + shifted + np.uint64(1)
        if n >= SHORTEST:
            ok = at + n <= ends
            mixed = rolled[ok] * PRIMES[1]
            buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
            owner.append(of[ok])
    starts = np.cumsum(sizes) - sizes
    weights = np.cumprod(np.full(64, PRIMES[0]))
    whole = np.add.reduceat(points * weights[(at - np.repeat(starts, sizes)) & 63], starts) if len(points) else np.zeros(0, np.uint64)
    buckets.append((whole * PRIMES[1] >> np.uint64(64 - BITS)).astype(np.int32))
    owner.append(np.arange(len(marked)))
    return np.concatenate(buckets), np.concatenate(owner)


class Model:
    def __init__(self, gain: np.ndarray, bias: float):
        """gain: what each bucket adds to the log-odds, averaged over a text's subwords."""
        self.gain, self.bias = gain, bias
        self.seen = Cache(CACHED)

    def resolve(self, words: list[bytes]) -> list[complex]:
        """Each word's sum of gains, and (as the imaginary part) its number of subwords."""
        if not words:
            return []
        buckets, of = subwords(words)
        return (np.bincount(of, self.gain[buckets], len(words)) + 1j * np.bincount(of, minlength=len(words))).tolist()

    def scores(self, texts: list[str]) -> np.ndarray:
        bags = [words_of(x) for x in texts]
        got = np.array(self.seen.all_of([w for b in bags for w in b], self.resolve), np.complex128)
        of = np.repeat(np.arange(len(bags)), np.fromiter(map(len, bags), np.int64, len(bags)))
        total, count = np.bincount(of, got.real, len(bags)), np.bincount(of, got.imag, len(bags))
        return 1 / (1 + np.exp(-np.clip(total / (count + NEUTRAL) + self.bias, -500, 500)))


def bag_of(text: str) -> np.ndarray:
    """The buckets of all subwords of a whole text's distinct words, packed with how often each occurs."""
    words, counts = words_of(text), np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(words), WORDS_PER_STEP):
        counts += np.bincount(subwords(words[lo : lo + WORDS_PER_STEP])[0], minlength=BUCKETS)
    packed = []
    while len(some := np.flatnonzero(counts)):
        taken = np.minimum(counts[some], MOST)
        packed.append((some << COUNT_BITS | taken).astype(np.uint32))
        counts[some] -= taken
    return np.concatenate(packed) if packed else np.zeros(0, np.uint32)


def unpacked(bags: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, bucket, count) of the entries of bags, some bags at a time."""
    at, total = 0, 0
    for i in range(len(bags) + 1):
        if i == len(bags) or total and total + len(bags[i]) > UNPACKED:
            every = np.concatenate(bags[at:i])
            yield np.repeat(np.arange(at, i), [len(x) for x in bags[at:i]]), every >> COUNT_BITS, (every & MOST).astype(np.float64)
            at, total = i, 0
        if i < len(bags):
            total += len(bags[i])


def fit(bags: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Train embeddings and softmax together by Adam on weighted cross-entropy."""
    if not len(bags) or not 0 < toxic.sum() < len(toxic):
        share = float((toxic * weight).sum() / max(weight.sum(), 1e-9)) if len(bags) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    order = np.random.default_rng(SEED)
    length = np.array([(x & MOST).sum(dtype=np.int64) + NEUTRAL for x in bags], np.float64)

    embedding = order.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.stack([np.linspace(-1, 1, DIMENSIONS), np.linspace(1, -1, DIMENSIONS)], 1).astype(np.float32)
    bias = np.zeros(2, np.float32)
    places = [embedding, layer, bias]
    first, second, step = [np.zeros_like(p) for p in places], [np.zeros_like(p) for p in places], 0
    weight = weight / weight.mean()
    epochs = -(-STEPS // -(-len(bags) // BATCH))
    for epoch in range(epochs):
        deal = order.permutation(len(bags))
        for lo in range(0, len(bags), BATCH):
            rows = deal[lo : lo + BATCH]
            some = [bags[i] for i in rows]
            held = list(unpacked(some)) if sum(map(len, some)) <= UNPACKED else None
            turn = layer[:, 1] - layer[:, 0]
            # the two-class softmax and the mean: along `turn` only, the embeddings' gradient is one number a bucket
            gain, odds = embedding @ turn, np.zeros(len(rows))
            for doc, ids, n in held or unpacked(some):
                odds += np.bincount(doc, gain[ids] * n, len(rows))
            odds = odds / length[rows] + bias[1] - bias[0]
            miss = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - toxic[rows]) * weight[rows] / len(rows)
            pull = np.zeros(BUCKETS)
            for doc, ids, n in held or unpacked(some):
                pull += np.bincount(ids, (miss / length[rows])[doc] * n, BUCKETS)
            pull = pull.astype(np.float32)
            along = embedding.T @ pull
            slopes = [pull[:, None] * turn[None, :], np.stack([-along, along], 1), np.array([-miss.sum(), miss.sum()], np.float32)]
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for p, g, m, v in zip(places, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p *= 1 - rate * DECAY
                p -= (rate / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model((embedding @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def trained(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> tuple[np.ndarray, float]:
    """Fit on labelled documents outside the held-out fold, in one task over a bounded sample.

    Whole texts become bags where they lie; only bags, of a size bounded by the number of buckets, go to the fit."""
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & (fold(labels["doc_id"], folds) != held_out)).groupBy(labels["doc_id"]).agg(F.max((labels["toxic"] > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    sample = picked[0].union(picked[1]).select(F.col("doc_id").alias("known_id"), "toxic")
    rows = spread(text_rows(docs))
    rows = rows.join(F.broadcast(sample), rows["doc_id"] == sample["known_id"]).select(F.struct(F.xxhash64("doc_id").alias("k"), "toxic").alias("about"), "text")
    weights = {c: counts.get(c, 0) / max(1, min(counts.get(c, 0), most)) for c, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for about, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x["k"] for x in about], pa.int64()), pa.array([bag_of(x).tobytes() for x in texts], pa.binary()), pa.array([x["toxic"] for x in about], pa.int32())], ["k", "bag", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((k, x, t) for b in batches for k, x, t in zip(*(c.to_pylist() for c in b.columns)))
        toxic = np.array([t for _, _, t in found], np.float64)
        model = fit([np.frombuffer(x, np.uint32) for _, x, _ in found], toxic, np.array([weights[int(t)] for t in toxic]))
        yield pa.RecordBatch.from_arrays([pa.array([model.gain.tobytes()], pa.binary()), pa.array([model.bias])], ["gain", "bias"])

    row = rows.mapInArrow(bags, "k long, bag binary, toxic int").repartition(1).mapInArrow(run, "gain binary, bias double").first()
    return (np.frombuffer(row["gain"], np.float32), row["bias"]) if row else (np.zeros(BUCKETS, np.float32), -20.0)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, folds, held_out))
    models: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = models.setdefault(0, Model(*model.value))
        for ids, texts in steps(batches):
            score = own.scores(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = spread(text_rows(docs)).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; each is judged where it lies."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    models: dict = {}
    return row_filter(spread(docs), lambda texts: models.setdefault(0, Model(*model.value)).scores(texts) < 0.5)
