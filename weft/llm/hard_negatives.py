"""Hard negatives by a vertical scan of decomposed vectors (branch and bound on dimensions).

Candidates lie in blocks, each a table of dimensions: one column for each, with its least and greatest value. An anchor
reads a block's dimensions in the descending order of its own magnitudes, a strip at a time. After a strip every candidate
left has a partial score, and the least and greatest contributions of the dimensions not read yet bound its score from both
sides. A candidate whose bounds cannot meet any window any more, or cannot reach the scores that surely stand in it,
leaves the bitmap; those left at the end have exact scores, which settle the windows.

Two scans follow each other: the first finds the positives, the best rows of the anchor's label; their scores open the
windows of the second, which finds the best rows of other labels within each window.

Defined results: components become floor(256 * x). Rows with a null label or id, a null vector, or null or non-finite
components (before or after that product) take no part; vectors of other lengths are compared as if padded with zeros, and
an empty vector scores 0. Rows are told apart by themselves: repeated rows and equal ids are candidates, anchors and
positives of their own. Ties go to the smaller id. A positive with a negative score has an empty window, one with 0 takes
scores of 0. Fewer rows than asked for give all of them; a lone label has no negatives; an empty table gives no rows; other
columns, whatever their names, are ignored. Scores are whole numbers of any size, given as the nearest 64-bit one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut
from weft.llm.topk import exact, matrix, products

#: Candidates in a block, dimensions of a strip, rows (with the smallest hashes) from which anchors get their first bounds.
BLOCK, STRIP, SAMPLE = 16_384, 8, 2048


class Block:
    """Candidates decomposed into columns, in the order in which ties are settled."""

    def __init__(self, rows: np.ndarray, uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray):
        order = np.lexsort((uid, vec_id))
        rows, self.uid, self.vec_id, self.label = rows[order], uid[order], vec_id[order], label[order]
        fine = exact(rows)
        self.great = np.flatnonzero(~fine)  # products of these are not exact in floating point
        self.great_rows = rows[self.great]
        self.fine = fine
        self.columns = np.ascontiguousarray(np.where(fine[:, None], rows, 0).T)
        self.least, self.most = self.columns.min(1, initial=np.inf), self.columns.max(1, initial=-np.inf)

    def all_scores(self, query: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Exact scores by whole numbers."""
        rows = self.columns[:, of].T.copy()
        at = np.flatnonzero(~self.fine[of])
        rows[at] = self.great_rows[np.searchsorted(self.great, of[at])]
        return np.array(products(rows, query, False), np.int64)

    def scan(self, query: np.ndarray, alive: np.ndarray, may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        """(candidates, exact scores, products read) of those that `may` keeps by their bounds until all dimensions are read."""
        if not exact(query[None, :])[0]:
            return alive, self.all_scores(query, alive), len(alive) * len(query)
        great = alive[~self.fine[alive]]
        alive = alive[self.fine[alive]]
        order = np.argsort(-np.abs(query), kind="stable")
        ends = np.stack([query * self.least, query * self.most])[:, order] if len(alive) else np.zeros((2, len(query)))
        low, high = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(0), ends.max(0)))
        score, read = np.zeros(len(alive)), 0
        for lo in range(0, len(order), STRIP):
            if not len(alive):
                break
            dims = order[lo : lo + STRIP]
            part = self.columns[dims] if len(alive) == self.columns.shape[1] else self.columns[np.ix_(dims, alive)]
            score = score + query[dims] @ part
            read += len(dims) * len(alive)
            hi = lo + len(dims)
            kept = may(score + low[hi], score + high[hi])
            if not kept.all():
                alive, score = alive[kept], score[kept]
        whole = score.astype(np.int64)
        if len(great):
            alive, whole = np.concatenate([alive, great]), np.concatenate([whole, self.all_scores(query, great)])
        return alive, whole, read


def nth(values: np.ndarray, n: int) -> float:
    """The n-th greatest value, or minus infinity."""
    return float(np.partition(values, -n)[-n]) if len(values) >= n else -np.inf


def best(score: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest scores, ties by the candidates' order."""
    if len(score) > n:
        keep = np.flatnonzero(score >= np.partition(score, -n)[-n])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((at[keep], -score[keep]))][:n]


def positives_in(block: Block, query: np.ndarray, own: int, alive: np.ndarray, least: float, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The n best candidates among `alive` but the anchor itself; those below `least` are left out."""

    def may(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= max(least, nth(low, n))

    at, score, read = block.scan(query, alive[block.uid[alive] != own], may)
    top = best(score, at, n)
    return at[top], score[top], read


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def negatives_in(block: Block, query: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int, float]], n: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window (from, to, a score that its n-th best reaches) its n best candidates among `alive`."""
    reach = [max(float(a), t) for a, _, t in windows]

    def may(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(low), bool)
        for i, (a, b, _) in enumerate(windows):
            sure = low[(low >= a) & (high <= b)]
            reach[i] = max(reach[i], nth(sure, n))
            kept |= (high >= reach[i]) & (low <= b)
        return kept

    at, score, read = block.scan(query, alive, may)
    found = []
    for a, b, _ in windows:
        inside = np.flatnonzero((score >= a) & (score <= b))
        top = inside[best(score[inside], at[inside], n)]
        found.append((at[top], score[top]))
    return found, read


def mined(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for each anchor (vec_id divisible by
    `every`) and each of its n_positives best rows of the same label: the n_negatives best rows of other labels whose score
    is `low` to `high` hundredths of the positive's.

    vectors: vec_id, embedding and label, as they are to be used. A block of candidates is decomposed once in a task, and the
    anchors are streamed past it; so memory is a block and one anchor's partial scores, and what is copied is anchors. Each
    block passes on its best rows only, and Spark limits each group again before it is shuffled.
    """
    spark = vectors.sparkSession
    whole = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("v"))
    rows = rows.where("v is not null and vec_id is not null and label is not null").where(whole)
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: x * 256).alias("v")).where(whole)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "v"))
    n, width = rows.select(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, n // 1024))
    names = ["uid", "vec_id", "label", "v"]

    sample = rows.orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(SAMPLE).toArrow().combine_chunks()
    known = matrix(sample.column("v").combine_chunks(), width) if len(sample) else np.zeros((0, width))
    fine = exact(known) if len(known) else np.zeros(0, bool)
    seed = spark.sparkContext.broadcast((known[fine], sample.column("uid").to_numpy()[fine], sample.column("label").to_numpy()[fine]))

    def units(asking: DataFrame, more: list[str]) -> DataFrame:
        """Candidates and, after those of their block, all anchors, each block in one task."""
        others = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), *names, *(F.lit(None).cast(asking.schema[c].dataType).alias(c) for c in more))
        asked = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), *names, *more)
        return others.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def run(answer: Callable[[Block, dict, pa.RecordBatch, int, np.ndarray], list[tuple]], types: list[pa.DataType], out: list[str]):
        """answer's rows for each anchor of a stream of units; `of` are the block's rows by label."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, made = None, [], None
            for b in batches:
                number, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
                change = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
                for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(number)]):
                    if lo == hi:
                        continue
                    part = b.slice(lo, hi - lo)
                    if number[lo] != now:
                        now, held, made = number[lo], [], None
                    if kind[lo] == 0:
                        held.append(part)
                        continue
                    if made is None:
                        if not held:
                            continue  # a block without candidates
                        ids = [np.concatenate([h.column(c).to_numpy() for h in held]) for c in (2, 3, 4)]
                        made = Block(np.concatenate([matrix(h.column(5), width) for h in held]), *ids)
                        labels = {int(x): made.label == x for x in np.unique(made.label)}
                        held = []
                    queries = matrix(part.column(5), width)
                    found = [row for i in range(len(part)) for row in answer(made, labels, part, i, queries[i])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], out)

        return go

    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)

    def first_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors with the score of their last positive among the sample."""
        x, uid, label = seed.value
        for b in batches:
            q, own, mine = matrix(b.column(3), width), b.column(0).to_numpy(), b.column(2).to_numpy()
            least = [nth((x[(label == m) & (uid != o)]) @ v, n_positives) if f else -np.inf for v, o, m, f in zip(q, own, mine, exact(q))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.float64())], [*names, "least"])

    def positives(made: Block, labels: dict, part: pa.RecordBatch, i: int, query: np.ndarray) -> list[tuple]:
        own, label = part.column(2)[i].as_py(), part.column(4)[i].as_py()
        if label not in labels:
            return []
        at, score, _ = positives_in(made, query, own, np.flatnonzero(labels[label]), part.column(6)[i].as_py(), n_positives)
        return [(own, int(made.vec_id[a]), int(made.uid[a]), int(s)) for a, s in zip(at, score)]

    long = pa.int64()
    asking = anchors.mapInArrow(first_reach, "uid long, vec_id long, label long, v array<double>, least double")
    found = units(asking, ["least"]).mapInArrow(run(positives, [long] * 4, ["uid", "positive_id", "positive_uid", "positive_score"]), "uid long, positive_id long, positive_uid long, positive_score long")
    order = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id", "positive_uid")
    top = found.withColumn("p", F.row_number().over(order)).where(F.col("p") <= n_positives)
    kept = top.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("p", "positive_id", "positive_score"))).alias("positives"))
    asking = cut(anchors.join(kept, "uid").select(*names, F.col("positives.positive_id").alias("ids"), F.col("positives.positive_score").alias("scores")))

    def second_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors with a score that the last negative of each window reaches, by the sample."""
        x, _, label = seed.value
        for b in batches:
            q, mine = matrix(b.column(3), width), b.column(2).to_numpy()
            least = []
            for v, m, f, scores in zip(q, mine, exact(q), b.column(5).to_pylist()):
                s = x[label != m] @ v if f else np.zeros(0)
                least.append([nth(s[(s >= a) & (s <= z)], n_negatives) for a, z in (window(p, low, high) for p in scores)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.list_(pa.float64()))], [*names, "ids", "scores", "least"])

    def negatives(made: Block, labels: dict, part: pa.RecordBatch, i: int, query: np.ndarray) -> list[tuple]:
        own, anchor, label = (part.column(c)[i].as_py() for c in (2, 3, 4))
        ids, scores, least = (part.column(c)[i].as_py() for c in (6, 7, 8))
        other = np.flatnonzero(~labels[label]) if label in labels else np.arange(len(made.uid))
        asked = {p: (*window(p, low, high), t) for p, t in zip(scores, least)}
        asked = {p: w for p, w in asked.items() if w[0] <= w[1]}
        if not asked or not len(other):
            return []
        got = dict(zip(asked, negatives_in(made, query, other, list(asked.values()), n_negatives)[0]))
        return [(own, j, anchor, ids[j], p, int(made.vec_id[a]), int(made.uid[a]), int(s)) for j, p in enumerate(scores) if p in got for a, s in zip(*got[p])]

    asking = asking.mapInArrow(second_reach, "uid long, vec_id long, label long, v array<double>, ids array<long>, scores array<long>, least array<double>")
    out = ["uid", "p", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_uid", "negative_score"]
    found = units(asking, ["ids", "scores", "least"]).mapInArrow(run(negatives, [long] * 8, out), ", ".join(f"{c} long" for c in out))
    order = Window.partitionBy("uid", "p").orderBy(F.desc("negative_score"), "negative_id", "negative_uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def noisy_labels(vectors: DataFrame) -> DataFrame:
    """The embeddings with the next of ten labels where vec_id is divisible by 7."""
    label = F.when(F.pmod(vectors["vec_id"], F.lit(7)) == 0, (vectors["label"] + 1) % 10).otherwise(vectors["label"])
    return vectors.select(vectors["vec_id"], vectors["embedding"], label.alias("label"))


ORACLE = """
WITH r AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.uid AS q, c.uid AS c, q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.v, c.v)::BIGINT AS score
           FROM r q JOIN r c ON q.uid <> c.uid WHERE q.vec_id % 100 = 0),
     p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS i FROM s WHERE same) WHERE i <= 5),
     n AS (SELECT p.q, p.i, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.q, p.i ORDER BY s.score DESC, s.vec_id, s.c) AS rank
           FROM p JOIN s ON p.q = s.q AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
