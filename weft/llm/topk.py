"""Exact top-k inner products by pivot-table elimination.

Every vector has a row of distances to many pivots. From the rows of a query and a candidate follows the greatest lower
bound of their distance that those distances allow (both are placed as apexes over the simplex of the pivots; the distance
of the apexes bounds theirs), and so, with their lengths, an upper bound of their inner product. A query's candidates are
evaluated in the order of that bound, and the search stops exactly when no bound left can beat the k-th best score.

Each query begins with the k-th best score among a bounded sample of candidates. Candidates lie in cells, each about its
nearest pivot; a cell whose ranges of pivot distances rule out that score for a query is not visited by it at all.

Defined results: components become floor(256 * x); vectors that are null, or hold null or non-finite components (before or
after that product), take no part; vectors of other lengths than the query's are compared as if padded with zeros; an empty
vector scores 0; every row but the query's own is a candidate, rows with equal ids included, and each row whose id asks is a
query of its own; ties go to the smaller id; fewer than k candidates give all of them; rows without an id take no part; an
empty table gives no rows; other columns are ignored. Scores are whole numbers of any size, given as the nearest 64-bit one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut

#: Pivots; vectors (with the smallest hashes) among which pivots are chosen and from which queries get their first scores;
#: candidates in a block; candidates that are evaluated between two looks at the bounds.
PIVOTS, SAMPLE, BLOCK, STRIDE = 48, 2048, 16_384, 64
#: Queries whose bounds are held at a time.
ASKED = 64
LOW, HIGH = -(2**63), 2**63 - 1


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one width, rounded down to whole numbers."""
    out = np.zeros((len(lists), width))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
    return out


def exact(rows: np.ndarray) -> np.ndarray:
    """Whether products of each row with others like it are exact in floating point."""
    return np.abs(rows).max(1, initial=0) <= np.sqrt(2.0**52 / max(1, rows.shape[1]))


def products(rows: np.ndarray, query: np.ndarray, small: bool) -> list[int]:
    """Inner products as whole numbers."""
    if small:
        return (rows @ query).astype(np.int64).tolist()
    q = [int(x) for x in query]
    return [min(max(sum(a * int(b) for a, b in zip(q, r)), LOW), HIGH) for r in rows]


class Pivots:
    """Vectors far apart from each other, and an orthonormal basis of what they span."""

    def __init__(self, sample: np.ndarray, most: int):
        found = [int(np.argmax((sample**2).sum(1)))] if len(sample) else []
        gap = ((sample - sample[found[0]]) ** 2).sum(1) if found else np.zeros(0)
        while found and len(found) < most and gap.max() > 0:
            found.append(int(np.argmax(gap)))
            gap = np.minimum(gap, ((sample - sample[found[-1]]) ** 2).sum(1))
        self.rows = sample[found]
        u, size, v = np.linalg.svd(self.rows, full_matrices=False) if found else (np.zeros((0, 0)), np.zeros(0), np.zeros((0, sample.shape[1])))
        good = size > 1e-6 * size.max(initial=0)
        self.to_apex = u[:, good] / size[good] if found else np.zeros((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The pivot table's row of each vector."""
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (self.rows**2).sum(1)[None, :] - 2 * x @ self.rows.T, 0))

    def apexes(self, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pivots' span that the distances determine, and the heights above it."""
        squared = (x**2).sum(1)
        inside = ((squared[:, None] + (self.rows**2).sum(1)[None, :] - table**2) / 2) @ self.to_apex
        return inside, np.sqrt(np.maximum(squared - (inside**2).sum(1), 0) + 1e-7 * squared)  # rounding must not lose a candidate


def best_of_block(queries: np.ndarray, own: np.ndarray, least: np.ndarray, rows: np.ndarray, uid: np.ndarray, rid: np.ndarray, pivots: Pivots, k: int) -> tuple[list, int]:
    """(query, candidate, score) of each query's k best candidates of one block, those below its `least` left out; and how
    many products were evaluated. own: each query's own row."""
    order = np.lexsort((uid, rid))
    rows, uid, rid = rows[order], uid[order], rid[order]
    small_q, small_r = exact(queries), exact(rows)
    every_small = bool(small_r.all())
    spread_out = np.flatnonzero(~small_r)
    inside_r, height_r = pivots.apexes(rows, pivots.distances(rows))
    slack = 1e-9 * (rows**2).sum(1) + 1
    found, evaluated = [], 0
    for lo in range(0, len(queries), ASKED):
        q = queries[lo : lo + ASKED]
        inside_q, height_q = pivots.apexes(q, pivots.distances(q))
        bounds = inside_q @ inside_r.T + height_q[:, None] * height_r[None, :] + slack[None, :] + 1e-9 * (q**2).sum(1)[:, None]
        for i, bound in enumerate(bounds):
            small = bool(small_q[lo + i])
            limit = least[lo + i] if small else -np.inf
            if not small:
                bound = np.full(len(rows), np.inf)
            elif not every_small:
                bound = bound.copy()
                bound[spread_out] = np.inf
            left = np.flatnonzero((bound >= limit) & (uid != own[lo + i]))
            mine: list[tuple[int, int]] = []

            def evaluate(take: np.ndarray) -> None:
                nonlocal mine, limit
                plain = small and (every_small or bool(small_r[take].all()))
                mine += [(-s, c) for s, c in zip(products(rows[take], queries[lo + i], plain), take.tolist())]
                mine = sorted(mine)[:k]
                if len(mine) == k:
                    limit = max(limit, -mine[-1][0])

            if len(left) > STRIDE:  # the best bounds first; of the others those that can reach the k-th score by then, in order
                left = left[np.argpartition(-bound[left], STRIDE - 1)]
            evaluate(left[:STRIDE])
            evaluated += len(left[:STRIDE])
            left = left[STRIDE:]
            left = left[bound[left] >= limit]
            left = left[np.argsort(-bound[left], kind="stable")]
            for at in range(0, len(left), STRIDE):
                take = left[at : at + STRIDE]
                if bound[take[0]] < limit:
                    break  # no bound left reaches the k-th score, ties included
                evaluate(take)
                evaluated += len(take)
            found += [(lo + i, int(order[c]), -s) for s, c in mine]
    return found, evaluated


def reachable(table: np.ndarray, squared: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Which cells may hold a candidate that reaches each query's `least` score. low, high: each cell's ranges of distances to
    the pivots; longest: its greatest squared length."""
    out = np.ones((len(table), len(low)), bool)
    for c in np.flatnonzero(np.isfinite(longest)):
        gap = np.maximum(np.maximum(low[c] - table, table - high[c]), 0).max(1, initial=0)
        out[:, c] = (squared + longest[c] - gap**2) / 2 + 1e-6 * (squared + longest[c]) + 1 >= least
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query (vec_id divisible by `every`).

    A block of candidates is never copied; queries that it may answer are streamed past it. So memory is a block, a batch of
    queries and their bounds, and what is copied is queries, once for each block of the cells that they can reach.
    """
    spark = vectors.sparkSession
    scaled = F.transform(F.col("v"), lambda x: x * 256)
    whole = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.where(whole).select("vec_id", scaled.alias("v")).where(whole)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v"))
    asks = F.pmod("vec_id", F.lit(every)) == 0
    n, width = rows.select(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()

    sample = rows.orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(SAMPLE).select("uid", "vec_id", "v").toArrow().combine_chunks()
    lists = sample.column("v").combine_chunks() if len(sample) else pa.array([], pa.list_(pa.float64()))
    known = matrix(lists, width)
    small = exact(known) if len(known) else np.zeros(0, bool)
    pivots = Pivots(known[small], PIVOTS)
    first = spark.sparkContext.broadcast((known[small], sample.column("uid").to_numpy()[small], pivots))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), width)
            pivots = first.value[2]
            table = pivots.distances(x)
            cell = table.argmin(1) if table.shape[1] else np.zeros(len(x), np.int64)
            cell = np.where(exact(x), cell, max(1, table.shape[1]))  # rows of great numbers lie apart
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), flat, pa.array((x**2).sum(1))], ["uid", "vec_id", "v", "cell", "table", "squared"])

    placed_rows = cut(rows.mapInArrow(placed, "uid long, vec_id long, v array<double>, cell int, table array<double>, squared double"))
    m = len(pivots.rows)
    ranges = placed_rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("squared").alias("longest"), *(f(F.col("table")[i]).alias(f"{f.__name__}{i}") for i in range(m) for f in (F.min, F.max))).orderBy("cell").toArrow()
    cells = ranges.column("cell").to_numpy()
    count = ranges.column("n").to_numpy()
    low = np.stack([ranges.column(f"min{i}").to_numpy() for i in range(m)], 1) if m else np.zeros((len(cells), 0))
    high = np.stack([ranges.column(f"max{i}").to_numpy() for i in range(m)], 1) if m else np.zeros((len(cells), 0))
    longest = np.where(cells >= max(1, m), np.inf, ranges.column("longest").to_numpy())
    want = min(spark.sparkContext.defaultParallelism, -(-n // 1024))
    blocks = np.maximum(1, np.maximum(-(-count // block), np.round(count * want / max(1, n)).astype(np.int64)))
    begin = np.cumsum(blocks) - blocks
    total = int(blocks.sum())

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their first k-th score, copied to the blocks of cells that they can reach."""
        seed, seed_uid, pivots = first.value
        for b in batches:
            x, uid = matrix(b.column(2), width), b.column(0).to_numpy()
            least = np.full(len(x), -np.inf)
            fine = exact(x)
            for lo in range(0, len(x), ASKED):
                score = x[lo : lo + ASKED] @ seed.T
                score[uid[lo : lo + ASKED, None] == seed_uid[None, :]] = -np.inf
                if score.shape[1] > k:
                    least[lo : lo + ASKED] = np.partition(score, -k, axis=1)[:, -k]
            least[~fine] = -np.inf
            open_to = reachable(pivots.distances(x), (x**2).sum(1), least, low, high, longest)
            open_to[~fine] = True
            row, cell = np.nonzero(open_to)
            copies = blocks[cell]
            row = np.repeat(row, copies)
            number = np.repeat(begin[cell], copies) + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            for lo in range(0, len(row), 5000):
                part = pa.array(row[lo : lo + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(number[lo : lo + 5000].astype(np.int32)), pa.array(np.ones(len(part), np.int32)), *(c.take(part) for c in b.columns), pa.array(least[row[lo : lo + 5000]])], ["block", "asks", "uid", "vec_id", "v", "least"])

    queries = placed_rows.where(asks).select("uid", "vec_id", "v").mapInArrow(asked, "block int, asks int, uid long, vec_id long, v array<double>, least double")
    start = F.element_at(F.lit(begin.tolist()).cast("array<int>"), F.array_position(F.lit(cells.tolist()).cast("array<int>"), F.col("cell")).cast("int")) if len(cells) else F.lit(0)
    size = F.element_at(F.lit(blocks.tolist()).cast("array<int>"), F.array_position(F.lit(cells.tolist()).cast("array<int>"), F.col("cell")).cast("int")) if len(cells) else F.lit(1)
    others = placed_rows.select((start + F.pmod(F.xxhash64("uid"), size)).cast("int").alias("block"), F.lit(0).alias("asks"), "uid", "vec_id", "v", F.lit(None).cast("double").alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, candidates before queries."""
        now, held, block_rows = None, [], None

        def answer(asking: pa.RecordBatch) -> pa.RecordBatch:
            q = matrix(asking.column(4), width)
            uid, qid = asking.column(2).to_numpy(), asking.column(3).to_numpy()
            found, _ = best_of_block(q, uid, asking.column(5).to_numpy(), *block_rows, first.value[2], k)
            a, c, score = ([f[i] for f in found] for i in range(3))
            a = np.array(a, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(uid[a]), pa.array(qid[a]), pa.array(block_rows[2][np.array(c, np.int64)]), pa.array(score, pa.int64())], ["uid", "query_id", "vec_id", "score"])

        for b in batches:
            number, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            change = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, len(number)]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if number[lo] != now:
                    now, held, block_rows = number[lo], [], None
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if not held and block_rows is None:
                    continue  # a block without candidates
                if block_rows is None:
                    block_rows = (np.concatenate([matrix(h.column(4), width) for h in held]), np.concatenate([h.column(2).to_numpy() for h in held]), np.concatenate([h.column(3).to_numpy() for h in held]))
                    held = []
                yield answer(part)

    units = others.union(queries).repartition(max(1, total), "block").sortWithinPartitions("block", "asks")
    found = units.mapInArrow(run, "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")  # Spark keeps k rows a query before it shuffles
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH r AS (SELECT row_number() OVER () AS uid, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
           FROM r q JOIN r c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
