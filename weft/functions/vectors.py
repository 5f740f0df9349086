"""Hashed features of many rows at once: tokens, and 3- and 4-grams of characters, counted by number before any is hashed.

A task takes about STEP characters at a time. Grams are numbers (a gram of n is the number of its first n - 1 characters and
the next one), so a feature becomes a string and a digest once a step, and nothing of a text is shuffled but its sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a step; code points there are; codes up to which a table is kept in place of a sort; places remembered.
STEP, POINTS, DENSE, REMEMBERED = 1_000_000, 0x110000, 1 << 23, 500_000


def place(feature: str, dimensions: int) -> int:
    """Twice the bucket, plus 1 for a negative sign: as `text.feature_place`."""
    digest = hashlib.sha256(feature.encode()).digest()
    return int.from_bytes(digest[:8], "little") % dimensions * 2 + digest[8] % 2


def numbered(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes ascending, the number of each code among them); all are below `most`."""
    if most > DENSE:
        return np.unique(codes, return_inverse=True)
    here = np.zeros(most, bool)
    here[codes] = True
    found = np.flatnonzero(here)
    number = np.zeros(most, np.int32)
    number[found] = np.arange(len(found))
    return found, number[codes].astype(np.int64)


def grams(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For 3- and 4-grams: the distinct ones, and of each occurrence its row and the number of its gram."""
    sizes = np.array([len(x) for x in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    letters, prefix = numbered(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64), POINTS)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row))  # characters from each place to its row's end
    char, at, strings = prefix, np.arange(len(row)), letters[:, None]
    for n in (2, 3, 4):
        ok = left[at] >= n
        at = at[ok]
        codes, prefix = numbered(prefix[ok] * len(letters) + char[at + n - 1], len(strings) * len(letters))
        strings = np.concatenate([strings[codes // max(1, len(letters))], letters[codes % max(1, len(letters))][:, None]], 1)
        if n > 2:
            told = strings.astype("<u4").tobytes().decode("utf-32-le")
            yield [told[i : i + n] for i in range(0, len(told), n)], row[at], prefix


def sums(dimensions: int):
    """Rows (key, words) as key and the sum of the signs of the features in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}

        def add(total: np.ndarray, features: list[str], row: np.ndarray, number: np.ndarray) -> None:
            if not features:
                return
            if len(places) > REMEMBERED:
                places.clear()
            for f in features:
                if f not in places:
                    places[f] = place(f, dimensions)
            of = np.fromiter((places[f] for f in features), np.int64, len(features))
            total += np.bincount(row * dimensions + (of >> 1)[number], (1 - 2 * (of & 1))[number], len(total))

        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            ends = np.cumsum(pc.binary_length(pc.binary_join(lists, " ")).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(lists):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
                words = lists.slice(at, end - at)
                total = np.zeros(len(words) * dimensions)
                coded = words.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
                add(total, coded.dictionary.to_pylist(), row, coded.indices.to_numpy(zero_copy_only=False))
                for found in grams(pc.binary_join(words, " ").to_pylist()):
                    add(total, *found)
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dimensions, pa.int32()), pa.array(total.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), each], ["key", "sums"])
                at = end

    return run


def totals(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """A row a key: the sums of all its lists."""
    lists = batch.column(1)
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    each = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)
    return np.add.reduceat(each, np.cumsum(n) - n, axis=0) if len(n) else each


def units(dimensions: int, key: str):
    """Rows (key, lists) as key, bucket and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = totals(batch, dimensions)
            norm = np.sqrt((each * each).sum(1))
            row, bucket = np.nonzero(each)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(each[row, bucket] / norm[row])], [key, "bucket", "weight"])

    return run


def cosines(asked: np.ndarray, key: str):
    """Rows (key, lists) as key and score, the inner product with a unit vector, where that is above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = totals(batch, len(asked))
            norm = np.sqrt((each * each).sum(1))
            score = (each / np.maximum(norm, 1.0)[:, None] * asked).sum(1)
            at = np.flatnonzero(score > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(score[at])], [key, "score"])

    return run
