"""Ranking of many queries at once: postings of a block of documents by term with their greatest weights, and exact early stops.

Documents are never joined with queries. A task holds one block of documents and the table of queries; for each query it
splits the terms by their greatest weight in the block: what only has terms whose weights together stay below the k-th best
score so far cannot be among the k best, so the long postings of common terms are looked up for the few documents left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents of a block; scores closer than this are settled by the rounding of the merge, so bounds keep that distance.
BLOCK, SLACK = 4096, 1e-8
#: Documents whose tokens are counted at a time.
PIECE = 500


class Queries:
    """Terms of queries as numbers: those of query i stand at begin[i] .. begin[i + 1]."""

    def __init__(self, ids: list, terms: list[np.ndarray]):
        self.ids = ids
        self.terms = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        self.begin = np.cumsum([0, *map(len, terms)])


class Postings:
    """Of a block: for each term the documents (places, ascending) and weights."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        here = np.flatnonzero(np.diff(self.begin))
        if len(here):
            self.most[here] = np.maximum.reduceat(self.weight, self.begin[here])


def best_of(post: Postings, terms: np.ndarray, n: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of all documents that may be among the k best, and the postings read. least: a score that the k-th best reaches."""
    terms = terms[post.most[terms] > 0]
    terms = terms[np.argsort(-post.most[terms], kind="stable")]
    rest = np.append(np.cumsum(post.most[terms][::-1])[::-1], 0.0)  # what the terms from each on can add
    score, read = np.zeros(n), 0
    held: np.ndarray | None = None  # documents that can still reach the k best, once others cannot
    for i, t in enumerate(terms):
        if held is None and rest[i] < least - SLACK:
            held = np.flatnonzero(score > 0)
        if held is not None:
            held = held[score[held] + rest[i] >= least - SLACK]
            if not len(held):
                break
        lo, hi = post.begin[t], post.begin[t + 1]
        docs = post.doc[lo:hi]
        if held is None or len(held) * 8 > hi - lo:
            score[docs] += post.weight[lo:hi]
            read += hi - lo
        else:
            at = np.minimum(np.searchsorted(docs, held), len(docs) - 1)
            met = docs[at] == held
            score[held[met]] += post.weight[lo:hi][at[met]]
            read += len(held)
        if held is None and i % 4 == 3:
            least = max(least, nth(score, k))
    found = np.flatnonzero(score > 0) if held is None else held
    found = found[score[found] >= max(least, nth(score[found], k)) - SLACK]
    return found, score[found], read


def nth(score: np.ndarray, k: int) -> float:
    return float(np.partition(score, -k)[-k]) if len(score) >= k else 0.0


def counted(numbers: dict[str, int]):
    """Rows (key, tokens) as key, number of tokens, numbers of known terms and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, PIECE) for batch in batches for at in range(0, len(batch), PIECE)):
            lists = b.column(1)
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            known = np.fromiter((numbers.get(w, -1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            term = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            pair, n = np.unique(doc[term >= 0] * len(numbers) + term[term >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) * len(numbers)), pa.int32())
            of = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), of(pair % max(1, len(numbers))), of(n)], ["key", "len", "terms", "counts"])

    return run


def ranked(queries, idf: np.ndarray, mean: float, k: int, k1: float, b: float):
    """Rows of `counted` as query number, key and raw score, of each query's best documents in this task. queries: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = queries.value
        tops: list[list[tuple]] = [[] for _ in asked.ids]
        held: list[pa.RecordBatch] = []
        kind = None

        def answer() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            keys, size = table.column("key").to_pylist(), table.column("len").to_numpy()
            lists = table.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy(zero_copy_only=False))
            term, n = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy().astype(np.float64)
            post = Postings(doc, term, idf[term] * n * (k1 + 1) / (n + k1 * (1 - b + b * size[doc] / mean)), len(idf))
            for q in range(len(asked.ids)):
                top = tops[q]
                least = top[-1][2] if len(top) == k else 0.0
                at, score, _ = best_of(post, asked.terms[asked.begin[q] : asked.begin[q + 1]], len(keys), k, least)
                if len(at):
                    tops[q] = sorted([*top, *((-round(s, 9), keys[i], s) for i, s in zip(at.tolist(), score.tolist()))])[:k]

        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, len(b), BLOCK)):
            held.append(batch)
            kind = batch.schema.field("key").type
            if sum(map(len, held)) >= BLOCK:
                answer()
                held = []
        if held:
            answer()
        rows = [(q, key, s) for q, top in enumerate(tops) for _, key, s in top]
        if rows:
            number, key, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(key, kind), pa.array(score, pa.float64())], ["number", "key", "raw"])

    return run
