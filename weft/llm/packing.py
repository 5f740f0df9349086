"""Packing along a space-filling curve: neighbouring documents share sequences, and no sequence needs padding.

Each document's tokens are hashed to a vector, whose projection to three dimensions gives a place on a Hilbert curve.
Documents are dealt by ranges of the curve, each range is sorted and cut into sequences of 4096 tokens as one stream.
The rest of a range is cut into sequences whose lengths are powers of two, which are not padded.

Defined results: a null text is an empty text and has its end token only; texts of any length are packed whole, over
many sequences (and ranges) if need be; copies lie side by side on the curve, and a hash of the id breaks ties, so that a
group of any size is dealt over many ranges; repeated rows and equal ids are packed each (pieces of rows with equal ids
carry the same doc_id); a null id is packed under null; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Cache, arrow_steps, fresh_path, spread, text_rows, worker_state

LENGTH, END = 4096, 2
#: A range of the curve holds about this much; a table has MOST_RANGES at most, and each range is streamed, whatever its size.
RANGE_BYTES, MOST_RANGES = 12 << 20, 100_000
#: A document of more tokens than this moves in parts: no task receives a long one whole, and ranges of rows are ranges of bytes.
PART = 1 << 12
DIMENSIONS, BITS, HASHED, SEED = 3, 10, 1024, 11
#: Distinct words that a worker remembers in each of two generations.
CACHED = 300_000
#: Characters of a step: words are made distinct in each step before any of them is looked up.
STEP = 4_000_000
#: New words are given to the library side by side, SEPARATED by a mark that stands for one id of its own.
MARK, SEPARATED = "\x01", 500


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def id_type(path: str) -> np.dtype:
    """16 bits for each id where the vocabulary allows it."""
    return np.dtype("<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


def library_ids(texts: list[str], path: str) -> list[np.ndarray]:
    return [np.array(e.ids, id_type(path)) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def mark_id(path: str) -> int | None:
    """The one id of the mark, if it has one."""
    got = library_ids([MARK], path)[0]
    return int(got[0]) if len(got) == 1 else None


def ids_of(words: list[str], path: str) -> list[bytes]:
    """The ids of each word (no white space in it), by the library. The tokenizer drops white space and nothing joins across
    it, so words are encoded side by side and their ids parted at the mark's; a word that holds the mark is encoded alone."""
    mark = mark_id(path)
    alone = [i for i, w in enumerate(words) if MARK in w] if mark is not None else range(len(words))
    found: list = [None] * len(words)
    for i, ids in zip(alone, library_ids([words[i] for i in alone], path)):
        found[i] = ids.tobytes()
    rest = [i for i, f in enumerate(found) if f is None]
    blocks = [rest[lo : lo + SEPARATED] for lo in range(0, len(rest), SEPARATED)]
    size = id_type(path).itemsize
    for lo in range(0, len(blocks), 20):
        some = blocks[lo : lo + 20]
        for block, ids in zip(some, library_ids([f" {MARK} ".join([words[i] for i in b]) for b in some], path)):
            raw, at = ids.tobytes(), 0
            for i, end in zip(block, [*(np.flatnonzero(ids == mark) * size).tolist(), len(raw)], strict=True):
                found[i] = raw[at:end]
                at = end + size
    return found


#: Each byte with A-Z lowered.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
STOP[[*b".,"]] = True


def regular(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lowered and with a space before a full stop or comma that follows A-Z or a-z, where the tokenizer
    parts words anyway: fewer distinct words, and the same ids.

    Texts that hold the beginning of a special token keep their capitals: the library matches those tokens before it lowers."""
    texts = texts.cast(pa.large_string())
    kept = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    low = LOWER[data]
    for i in np.flatnonzero(kept).tolist():
        low[offsets[i] : offsets[i + 1]] = data[offsets[i] : offsets[i + 1]]
    stops = np.flatnonzero(LETTER[low[:-1]] & STOP[low[1:]]) + 1  # a space too many between two texts does no harm
    before = np.searchsorted(stops, offsets, side="right")
    moved = pa.py_buffer((offsets + before).astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(texts), moved, pa.py_buffer(np.insert(low, stops, 32)))


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of whole texts with their end tokens, one text after another, and where each text's ids begin (and the end).

    A text's ids are those of its pieces between ASCII white space; pieces are made distinct before they are looked up."""
    words = pc.ascii_split_whitespace(regular(texts))
    counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    cache = worker_state(("packing", path), lambda: Cache(CACHED))
    found = cache.all_of(coded.dictionary.to_pylist(), lambda new: ids_of(new, path))
    kind = id_type(path)
    found.append(np.array([END], kind).tobytes())
    flat = np.frombuffer(b"".join(found), kind)
    size = np.fromiter(map(len, found), np.int32, len(found)) // kind.itemsize
    begin = np.cumsum(size, dtype=np.int32) - size  # a step has fewer ids than characters: below 2 ** 31
    each = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(counts), len(found) - 1)
    n = size[each]
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    source = np.repeat(begin[each] - ends[:-1].astype(np.int32), n)
    source += np.arange(len(source), dtype=np.int32)
    return flat[source], ends[np.concatenate([[0], np.cumsum(counts + 1)])]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of integer points (rows, below 2 ** bits) on the Hilbert curve: undo excess rotations, Gray-decode, interleave."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


@functools.cache
def projection(vocabulary: int) -> np.ndarray:
    """For each token id: the row of a random projection that its hashed dimension has."""
    rows = np.random.default_rng(SEED).choice(np.array([-1.0, 1.0], np.float32), (HASHED, DIMENSIONS))
    return rows[(np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64) % HASHED]


def places(ids: np.ndarray, ends: np.ndarray, hashes: np.ndarray, vocabulary: int) -> np.ndarray:
    """Where documents lie: the Hilbert key of each above 32 bits of a hash of its id. No document is without tokens."""
    if len(ends) < 2:
        return np.zeros(0, np.int64)
    rows = projection(vocabulary)
    vectors = np.stack([np.add.reduceat(rows[:, d][ids], ends[:-1], dtype=np.float64) for d in range(DIMENSIONS)], 1)
    scaled = 1 / (1 + np.exp(-vectors / np.sqrt(np.diff(ends))[:, None]))
    key = hilbert(np.minimum((scaled * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
    return key << 32 | hashes & 0xFFFFFFFF


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Parts of every document: doc_id, start (ids before it), ids, doc_tokens and place."""
    kind = id_type(path)
    names = ["doc_id", "start", "ids", "doc_tokens", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, texts in arrow_steps(batches, STEP):
            ids, ends = encode_texts(texts, path)
            hashes = np.fromiter((zlib.crc32(str(i).encode()) for i in doc.to_pylist()), np.int64, len(doc))
            place = places(ids, ends, hashes, max(1 << 16, tokenizer(path).get_vocab_size() + 1))
            total = np.diff(ends)
            parts = -(-total // PART)
            of = np.repeat(np.arange(len(total)), parts)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART
            offsets = np.append(ends[of] + start, ends[-1]) * kind.itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([doc.cast(pa.int64()).take(pa.array(of)), pa.array(start), raw.cast(pa.binary()), pa.array(total[of]), pa.array(place[of])], names)

    return spread(text_rows(docs)).mapInArrow(run, "doc_id long, start long, ids binary, doc_tokens long, place long")


def stream(rows: Iterator[tuple[int, int, bytes, int]], part: int, kind: np.dtype, with_ids: bool) -> Iterator[list[tuple]]:
    """Cut one range's parts of documents (doc_id, start, ids, doc_tokens) into sequences; gives the pieces of sequences as
    they are filled."""
    held, filled, sequence = [], 0, 0
    for doc, before, raw, total in rows:
        start, size = 0, len(raw) // kind.itemsize
        while start < size:
            take = min(size - start, LENGTH - filled)
            ids = np.frombuffer(raw, kind, take, start * kind.itemsize)
            held.append((doc, before + start, ids, total, part << 40 | sequence, filled))
            start, filled = start + take, filled + take
            if filled == LENGTH:
                yield [finish(*p, with_ids) for p in held]
                held, filled, sequence = [], 0, sequence + 1
    out, room, offset = [], 0, 0
    for doc, start, ids, total, _, _ in held:  # the rest, in powers of two
        while len(ids):
            if not room:
                room, offset = 1 << (filled.bit_length() - 1), 0
            n = min(len(ids), room)
            out.append(finish(doc, start, ids[:n], total, part << 40 | sequence, offset, with_ids))
            start, ids, room, offset, filled = start + n, ids[n:], room - n, offset + n, filled - n
            if not room:
                sequence += 1
    if out:
        yield out


def finish(doc: int, start: int, ids: np.ndarray, total: int, sequence: int, offset: int, with_ids: bool) -> tuple:
    wide = ids.astype("<u4")
    return doc, start, len(wide), wide.view(np.int32) if with_ids else zlib.crc32(wide.tobytes()), total, sequence, offset


def packed(docs: DataFrame, path: str, with_ids: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (or their crc32), doc_tokens, sequence_id and offset.

    Ids are computed once and written to the shared folder. Parts of documents are dealt by Spark's range partitioning of
    their places, so ranges are about even however the documents lie; each task sorts one range (spilling if need be) and
    streams it. A range leaves at most twelve sequences of powers of two behind its full ones, so their share depends on
    range_bytes and on nothing else.
    """
    spark = docs.sparkSession
    path_to = fresh_path(spark, "packing")
    tokenized(docs, path).write.parquet(path_to)
    rows = spark.read.parquet(path_to)
    size = rows.select(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    ranges = min(MOST_RANGES, max(1, round(size / range_bytes)))
    types = ["long", "long", "long", "array<int>" if with_ids else "long", "long", "long", "long"]
    names = ["doc_id", "start", "length", "ids" if with_ids else "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.list_(pa.int32()) if t == "array<int>" else pa.int64() for t in types]
    kind = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        block: list[tuple] = []
        for pieces in stream(each, TaskContext.get().partitionId(), kind, with_ids):
            block += pieces
            if len(block) >= (200 if with_ids else 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), kinds)], names)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), kinds)], names)

    order = ["place", "doc_id", "start", "ids"]
    ranged = rows.repartitionByRange(ranges, *order[:3]).sortWithinPartitions(*order).select("doc_id", "start", "ids", "doc_tokens")
    return ranged.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(names, types)))
