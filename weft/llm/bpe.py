"""Byte-level BPE: encoding with offsets, and decoding, by the ranks of a public tokenizer.

Matches of the pattern come from the vectorised pre-tokeniser; each distinct one is merged once (a worker keeps a bounded
cache), and all new ones of a step are merged side by side: pieces of one length form an array, the lowest-ranked pair of
each row is found by argmin, and every row loses one symbol a round until no pair of it has a rank.

Defined results: a null text is an empty text and has no ids; texts of any length are encoded whole; lone surrogates
can't occur in Spark strings; repeated rows and equal ids give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import pretokens
from weft.llm.common import Cache, spread, steps, text_rows, worker_state

#: Distinct pieces that a worker remembers in each of two generations.
CACHED = 400_000
NONE = np.int32(2**31 - 1)


class Ranks:
    """A vocabulary of byte strings by rank, and the table of pairs that merge."""

    def __init__(self, rank: dict[bytes, int], pair: dict[tuple[int, int], int], whole: bool):
        """pair: the rank, which is also the id, that two ids merge to; whole: a piece with a rank is not merged."""
        self.rank, self.pair, self.whole = rank, pair, whole
        size = max(rank.values(), default=0) + 1
        self.byte = np.full(256, -1, np.int32)
        words = [b""] * size
        for word, r in rank.items():
            words[r] = word
            if len(word) == 1:
                self.byte[word[0]] = r
        self.lengths = np.fromiter(map(len, words), np.int64, size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        keys = np.fromiter((a << 32 | b for a, b in pair), np.uint64, len(pair))
        self.bits = max(4, int(len(pair) * 2).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        where, left = self.slot(keys), np.arange(len(keys))
        values = np.fromiter(pair.values(), np.int32, len(pair))
        while len(left):  # open addressing: of those that want a free slot, one gets it
            free = self.keys[where] == np.uint64(2**64 - 1)
            self.keys[where[free]] = keys[left[free]]
            got = self.keys[where] == keys[left]
            self.values[where[got]] = values[left[got]]
            left, where = left[~got], (where[~got] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        flat = keys.reshape(-1)
        out, left, where = np.full(len(flat), NONE), np.arange(len(flat)), self.slot(flat)
        while len(left):
            found = self.keys[where]
            hit = found == flat[left]
            out[left[hit]] = self.values[where[hit]]
            on = ~hit & (found != np.uint64(2**64 - 1))
            left, where = left[on], (where[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(keys.shape)

    def merge_rows(self, s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge rows of symbols of one width; gives (row numbers, their ids) by final width."""
        done, rows = [], np.arange(len(s))
        r = self.merged(s[:, :-1], s[:, 1:])
        while len(rows):
            if s.shape[1] == 1:
                done.append((rows, s))
                break
            j = r.argmin(1)
            best = r[np.arange(len(rows)), j]
            on = best != NONE
            if not on.all():
                done.append((rows[~on], s[~on]))
                rows, s, r, j, best = rows[on], s[on], r[on], j[on], best[on]
                if not len(rows):
                    break
            i, width = np.arange(len(rows)), s.shape[1] - 1
            col = np.arange(width)
            s = np.take_along_axis(s, col + (col > j[:, None]), 1)
            s[i, j] = best
            if width > 1:
                col = col[:-1]
                r = np.take_along_axis(r, col + (col > j[:, None]), 1)
                k = np.flatnonzero(j < width - 1)
                r[k, j[k]] = self.merged(s[k, j[k]], s[k, j[k] + 1])
                k = np.flatnonzero(j > 0)
                r[k, j[k] - 1] = self.merged(s[k, j[k] - 1], s[k, j[k]])
        return done

    def encode_long(self, word: bytes) -> np.ndarray:
        """One long piece, by a heap of pairs: n log n for n bytes."""
        import heapq

        ids = [int(self.byte[c]) for c in word]
        n, pair = len(ids), self.pair
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(pair[x], i, x) for i, x in enumerate(zip(ids, ids[1:])) if x in pair]
        heapq.heapify(heap)
        while heap:
            rank, i, x = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != x:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (y := (rank, ids[after[i]])) in pair:
                    heapq.heappush(heap, (pair[y], i, y))
            if (p := before[i]) >= 0 and (y := (ids[p], rank)) in pair:
                heapq.heappush(heap, (pair[y], p, y))
        return np.array([x for x, a in zip(ids, alive) if a], np.uint32)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        words = [p.encode() for p in pieces]
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            r = self.rank.get(w) if self.whole else None
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(w) > 48:
                out[i] = self.encode_long(w).astype("<u4").tobytes()
            else:
                by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            for lo in range(0, len(at), 20_000):
                part = at[lo : lo + 20_000]
                s = self.byte[np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(-1, length)]
                for rows, ids in self.merge_rows(s):
                    raw, width = ids.astype("<u4").tobytes(), ids.shape[1] * 4
                    for k, row in enumerate(rows.tolist()):
                        out[part[row]] = raw[k * width : (k + 1) * width]
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, and where each id's bytes begin (the last number: their end)."""
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        if not len(ids):
            return b"", ends
        source = np.repeat(self.offsets[ids] - ends[:-1], size) + np.arange(ends[-1])
        return self.bytes[source].tobytes(), ends


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, others follow from 256."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def ranks(path: str) -> Ranks:
    """Of a .tiktoken file any two parts of a ranked string merge; of a .json file those that it lists."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        rank = {bytes(map(letters.get, w)): i for w, i in model["vocab"].items() if all(c in letters for c in w)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pair = {(model["vocab"][a], model["vocab"][b]): model["vocab"][a + b] for a, b in merges}
        if any(x >= y for x, y in itertools.pairwise(pair.values())):
            raise ValueError(f"{path}: ids do not grow in the order of merges")
        return Ranks(rank, pair, False)
    with open(path, "rb") as f:
        rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return Ranks(rank, {(rank[w[:i]], rank[w[i:]]): r for w, r in rank.items() for i in range(1, len(w)) if w[:i] in rank and w[i:] in rank}, True)


def cache(path: str) -> Cache:
    return worker_state(("bpe", path), lambda: Cache(CACHED))


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    pieces, counts = pretokens.slices(texts)
    got = cache(path).all_of(pieces, ranks(path).encode_pieces)
    ends = np.cumsum(counts).tolist()
    return [b"".join(got[a:b]) for a, b in zip([0, *ends], ends)]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and offsets (where each id's bytes begin in the text's UTF-8) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches, 500_000):
            raw = [np.frombuffer(x, "<u4").astype(np.int32) for x in encode_texts(texts, path)]
            size = ranks(path).lengths
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.list_(pa.int32())), pa.array([(np.cumsum(size[x]) - size[x]).astype(np.int32) for x in raw], pa.list_(pa.int32()))], ["doc_id", "ids", "offsets"])

    return spread(text_rows(docs)).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that the ids of each row of doc_id, ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, ends = ranks(path).decode(batch.column(1).flatten().to_numpy(zero_copy_only=False))
            counts = np.cumsum([0, *batch.column(1).value_lengths().fill_null(0).to_pylist()])
            at = ends[counts].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([whole[a:b] for a, b in zip(at, at[1:])], pa.binary())], ["doc_id", "decoded"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: ids are encoded and decoded again in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            raw = encode_texts(texts, path)
            whole, ends = ranks(path).decode(np.frombuffer(b"".join(raw), "<u4").astype(np.int64))
            counts = np.cumsum([0, *map(len, raw)]) // 4
            at = ends[counts].tolist()
            view = memoryview(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(counts), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return spread(text_rows(docs)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
