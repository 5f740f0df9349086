"""Token counts by a map-side look-up in two tiers: a broadcast table of frequent pre-tokens, then worker caches.

Nothing is shuffled: a task slices its texts into pre-tokens, takes the number of tokens of each from the broadcast table,
and merges the rest, remembering them in a bounded cache of the worker. The table only saves work; it never changes a
count, so it is made from the first SAMPLE documents that Spark finds.

Defined results: a null text is an empty text of no tokens; texts of any length are counted whole; a special token's
string inside a text is one token, as the library counts it by default; repeated rows give repeated rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import bpe, pretokens
from weft.llm.common import Cache, spread, steps, text_rows, worker_state

#: Documents, and of each so many characters, whose pre-tokens fill the table; it holds HOT of them at most.
SAMPLE, SAMPLE_CHARS, HOT = 500, 20_000, 50_000


@functools.cache
def specials(path: str) -> list[str]:
    """Strings that the library takes as one token wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", []) if not t["normalized"]]


def lengths(path: str) -> Cache:
    return worker_state(("token counts", path), lambda: Cache(bpe.CACHED))


def lengths_of(path: str):
    return lambda pieces: [len(x) // 4 for x in bpe.ranks(path).encode_pieces(pieces)]


def hot_table(docs: DataFrame, path: str) -> dict[str, int]:
    """The most frequent pre-tokens of a few documents, with their numbers of tokens."""
    texts = [r[0][:SAMPLE_CHARS] for r in docs.select("text").head(SAMPLE)]
    pieces = [p for p, _ in Counter(pretokens.slices(texts)[0]).most_common(HOT) if len(p) <= 32]
    return dict(zip(pieces, lengths_of(path)(pieces)))


def count_texts(texts: list[str], path: str, hot: dict[str, int]) -> np.ndarray:
    """The number of tokens of each text."""
    parts, of, extra = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        split = [text]
        for mark in specials(path):
            if mark in text:
                split = [y for x in split for y in x.split(mark)]
        extra[i] = len(split) - 1
        parts += split
        of += [i] * len(split)
    pieces, counts = pretokens.slices(parts)
    got = list(map(hot.get, pieces))
    miss = [i for i, v in enumerate(got) if v is None]
    for i, v in zip(miss, lengths(path).all_of([pieces[i] for i in miss], lengths_of(path))):
        got[i] = v
    sums = np.concatenate([[0], np.cumsum(np.fromiter(got, np.int64, len(got)))])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return extra + np.bincount(of, sums[ends[1:]] - sums[ends[:-1]], len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every document."""
    rows = text_rows(docs)
    table = docs.sparkSession.sparkContext.broadcast(hot_table(rows, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = table.value
        for ids, texts in steps(batches):
            n = count_texts(texts, path, hot)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return spread(rows).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
