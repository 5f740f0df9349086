"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

A folder of token files has three parts, all written and read by Spark, so any store that Spark reaches will do:

    blocks/    files of independent blocks, in the order of the documents; a block ends with MARK, at which Spark splits files
    table/     the shared frequency of every id that occurs, out of 2 ** bits
    parts/     for each file its number of ids and blocks, and where its first id stands among all

A block holds BLOCK ids (the last of a file fewer) of one or more documents, dealt in turn to LANES interleaved states of 64
bits which share one stream of 32-bit words. A checkpoint every STRIDE steps has the states and the place in the stream, so
decoding may begin at each of them. The header tells the documents in the block; checksums guard the header, the coded
words and the ids. Many blocks are coded side by side in numpy.

Defined results: a null text is an empty text and has its end id only; documents are written in ascending doc_id order,
those without an id first; repeated rows and equal ids are documents of their own, next to each other; a document of any
length runs on over blocks and files; an empty table gives no blocks and no rows; other columns, whatever their names, are
ignored. A file that misses blocks, or whose bytes changed, is refused with a ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import arrow_steps, fresh_path, spread, text_rows
from weft.llm.packing import END, PART, STEP, encode_texts, id_type

BLOCK, LANES, STRIDE = 1 << 14, 32, 1 << 7
#: The frequencies of all ids sum to 2 ** BITS; a larger vocabulary takes more.
BITS = 20
#: States lie in LOW .. 2 ** 63; a word leaves a state that would grow beyond.
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
#: Blocks coded side by side.
SIDE = 128
#: What ends a block in a file. No proper beginning of it is an end of it, and no block holds it (`coded` sees to that).
MARK = "=end-of-rans-block=\n"
MAGIC = b"RANS"
#: magic, salt, file, block, place of the first id in the file, ids, documents, ids of the first one before this block, ids
#: of the last one in all, words, checkpoints, crc32 of the ids, crc32 of the words; numbers begin with their highest byte
HEAD = struct.Struct(">4sIIIQQIQQIIII")
#: Bytes of ids that one file is made of, and files at most.
FILE_BYTES, MOST_FILES = 24 << 20, 100_000


class Table:
    """The shared frequencies, for coding and decoding."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int):
        self.bits = bits
        size = int(ids.max(initial=-1)) + 1
        self.freq, self.begin = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        order = np.argsort(ids, kind="stable")
        self.freq[ids[order]] = freq[order]
        self.begin[ids[order]] = np.cumsum(freq[order]) - freq[order]
        self.id_at = np.repeat(ids[order].astype(np.uint32), freq[order].astype(np.int64))


def frequencies(counts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Whole numbers in proportion to the counts (all positive), 1 at least, whose sum is 2 ** bits; and the bits."""
    while len(counts) > 1 << (bits - 2):
        bits += 1
    if not len(counts):
        return np.zeros(0, np.int64), bits
    share = counts * (float(1 << bits) / float(counts.sum()))
    freq = np.maximum(1, np.floor(share)).astype(np.int64)
    left = (1 << bits) - int(freq.sum())
    order = np.lexsort((np.arange(len(freq)), -counts))
    if left > 0:
        freq[order[0]] += left
    for i in order:  # ones for rare ids are taken from the most frequent
        if left >= 0:
            break
        take = min(-left, int(freq[i]) // 2)
        freq[i] -= take
        left += take
    return freq, bits


def encoded(ids: np.ndarray, table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(states, places, words) for each row of ids (rows of blocks, a multiple of LANES long), coded side by side.

    states: those at each checkpoint, the first one at the beginning; places: the words read before each."""
    rows, size = ids.shape
    steps = size // LANES
    freq, begin, bits = table.freq, table.begin, np.uint64(table.bits)
    x = np.full((rows, LANES), LOW, np.uint64)
    words, out = np.zeros((steps, rows, LANES), np.uint32), np.zeros((steps, rows, LANES), bool)
    states = np.zeros((rows, -(-steps // STRIDE), LANES), np.uint64)
    top = np.uint64(63 - table.bits)
    for t in range(steps - 1, -1, -1):
        now = ids[:, t * LANES : (t + 1) * LANES]
        f = freq[now]
        full = (x >> top) >= f
        out[t], words[t] = full, x  # the low 32 bits
        x = np.where(full, x >> WORD, x)
        q = x // f
        x = (q << bits) + (x - q * f) + begin[now]
        if t % STRIDE == 0:
            states[:, t // STRIDE] = x
    found = []
    for r in range(rows):
        each = out[:, r]
        n = np.cumsum(each.sum(1)) - each.sum(1)
        found.append((states[r], n[::STRIDE].astype(np.uint32), words[:, r][each]))
    return found


def decoded(blocks: list[tuple[np.ndarray, np.ndarray, int]], table: Table) -> np.ndarray:
    """Ids in rows: of each (states, words, steps) so many steps; states and words as they stand at a checkpoint. All have the
    same number of steps."""
    x = np.stack([b[0] for b in blocks])
    steps = blocks[0][2]
    words = np.concatenate([*(b[1] for b in blocks), np.zeros(1, np.uint32)])
    place = np.cumsum([0, *(len(b[1]) for b in blocks[:-1])])
    limit = len(words) - 1
    ids = np.zeros((len(blocks), steps * LANES), np.uint32)
    mask, bits = np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    for t in range(steps):
        slot = x & mask
        now = table.id_at[slot]
        ids[:, t * LANES : (t + 1) * LANES] = now
        x = table.freq[now] * (x >> bits) + slot - table.begin[now]
        short = x < LOW
        n = np.cumsum(short, axis=1)
        at = np.minimum(place[:, None] + n - 1, limit)
        x = np.where(short, x << WORD | words[np.maximum(at, 0)], x)
        place = place + n[:, -1]
    return ids


def covered(raw: bytes, salt: int) -> bytes:
    """The bytes by exclusive or with four that come from the salt (0: as they are), so that another salt gives other bytes."""
    data = np.frombuffer(raw, np.uint8)
    key = np.frombuffer(struct.pack("<I", salt * 0x9E3779B1 & 0xFFFFFFFF), np.uint8)
    return (data ^ np.resize(key, len(data))).tobytes() if salt else raw


def pack_block(ids: np.ndarray, table: Table, part: int, number: int, first: int, docs: list[tuple], code: tuple, salt: int) -> bytes:
    """The bytes of a block. docs: (doc_id or None, ids before this block, ids in it, ids in all) in order."""
    states, places, words = code
    known = np.array([d[0] is not None for d in docs], np.uint8)
    names = np.array([d[0] or 0 for d in docs], "<i8")
    sizes = np.array([d[2] for d in docs], "<u4")
    words = words.astype("<u4").tobytes()
    head = HEAD.pack(MAGIC, salt, part, number, first, len(ids), len(docs), docs[0][1], docs[-1][3], len(words) // 4, len(states), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(words))
    body = known.tobytes() + names.tobytes() + sizes.tobytes() + states.astype("<u8").tobytes() + places.astype("<u4").tobytes()
    return head + covered(body + struct.pack("<I", zlib.crc32(head + body)) + words, salt)


class Read:
    """One block's bytes, taken apart and checked."""

    def __init__(self, raw: bytes):
        if len(raw) < HEAD.size or raw[:4] != MAGIC:
            raise ValueError(f"no block begins with {raw[:16]!r}")
        _, salt, self.part, self.number, self.first, self.n, docs, self.before, self.last_total, n_words, points, self.ids_crc, words_crc = HEAD.unpack_from(raw)
        at = HEAD.size
        raw = raw[:at] + covered(raw[at:], salt)
        sizes = [docs, 8 * docs, 4 * docs, 8 * LANES * points, 4 * points]
        ends = np.cumsum([at, *sizes]).tolist()
        if len(raw) != ends[-1] + 4 + 4 * n_words or struct.unpack_from("<I", raw, ends[-1])[0] != zlib.crc32(raw[: ends[-1]]):
            raise ValueError(f"file {self.part}, block {self.number}: its header is damaged")
        known, names, self.sizes = np.frombuffer(raw, np.uint8, docs, at), np.frombuffer(raw, "<i8", docs, ends[1]), np.frombuffer(raw, "<u4", docs, ends[2]).astype(np.int64)
        self.doc_ids = [int(i) if k else None for i, k in zip(names, known)]
        self.states = np.frombuffer(raw, "<u8", LANES * points, ends[3]).reshape(points, LANES)
        self.places = np.frombuffer(raw, "<u4", points, ends[4]).astype(np.int64)
        if zlib.crc32(raw[ends[-1] + 4 :]) != words_crc:
            raise ValueError(f"file {self.part}, block {self.number}: its words are damaged")
        self.words = np.frombuffer(raw, "<u4", n_words, ends[-1] + 4)
        self.steps = -(-self.n // LANES)

    def documents(self) -> list[tuple]:
        """(doc_id, ids before this block, place in the block, ids in it, ids in all)."""
        begin = np.cumsum(self.sizes) - self.sizes
        before = [self.before] + [0] * (len(begin) - 1)
        total = [b + int(s) for b, s in zip(before, self.sizes)]
        total[-1] = self.last_total
        return list(zip(self.doc_ids, before, begin.tolist(), self.sizes.tolist(), total))

    def ids(self, table: Table, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids lo .. hi of the block, decoded from the last checkpoint before them."""
        hi = self.n if hi is None else hi
        point = lo // (STRIDE * LANES)
        begin = point * STRIDE
        got = decoded([(self.states[point], self.words[self.places[point] :], -(-hi // LANES) - begin)], table)[0]
        return got[lo - begin * LANES : hi - begin * LANES]


def all_ids(blocks: list[Read], table: Table) -> list[np.ndarray]:
    """The ids of whole blocks, those of one size decoded side by side, and held against their checksums."""
    found: list = [None] * len(blocks)
    by: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        by.setdefault(b.steps, []).append(i)
    for steps, some in by.items():
        got = decoded([(blocks[i].states[0], blocks[i].words, steps) for i in some], table)
        for i, ids in zip(some, got):
            found[i] = ids[: blocks[i].n]
            if zlib.crc32(found[i].astype("<u4").tobytes()) != blocks[i].ids_crc:
                raise ValueError(f"file {blocks[i].part}, block {blocks[i].number}: its ids are damaged")
    return found


def coded(pieces: Iterator[tuple], part: int, kind: np.dtype, table: Table, side: int = SIDE, mark: bytes = MARK.encode()) -> Iterator[list[bytes]]:
    """Blocks of one file, from its documents' pieces in order: (doc_id, uid, ids before the piece, raw ids, ids in all)."""
    held, docs, count, number, first = [], [], 0, 0, 0
    doc_now = None

    def emit(rows: list[tuple[np.ndarray, list]]) -> list[bytes]:
        nonlocal number, first
        size = -(-len(rows[0][0]) // LANES) * LANES
        matrix = np.stack([np.pad(r[0], (0, size - len(r[0])), mode="edge") for r in rows])
        out = []
        for i, ((ids, documents), code) in enumerate(zip(rows, encoded(matrix, table))):
            salt, raw = 0, pack_block(ids, table, part, number, first, documents, code, 0)
            while mark in raw + mark[:-1]:
                salt += 1
                if salt > 1 << 16:
                    raise ValueError("the mark is part of a header")
                raw = pack_block(ids, table, part, number, first, documents, code, salt)
            out.append(raw)
            number, first = number + 1, first + len(ids)
        return out

    full: list[tuple[np.ndarray, list]] = []
    for doc_id, uid, before, raw, total in pieces:
        ids = np.frombuffer(raw, kind)
        at = 0
        while at < len(ids):
            take = ids[at : at + BLOCK - count]
            if docs and doc_now == uid:
                docs[-1][2] += len(take)
            else:
                docs.append([doc_id, before + at, len(take), total])
                doc_now = uid
            held.append(take)
            count, at = count + len(take), at + len(take)
            if count == BLOCK:
                full.append((np.concatenate(held), docs))
                held, docs, count = [], [], 0
                if len(full) == side:
                    yield emit(full)
                    full = []
    if full:
        yield emit(full)
    if held:
        yield emit([(np.concatenate(held), docs)])


def write(docs: DataFrame, path: str, tokenizer: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all documents, each with its end id, to the folder `path`, in ascending doc_id order.

    Texts are encoded once, and their ids written to the shared folder in parts of bounded length. Their frequencies are
    summed in tasks (a row for each id that occurs). Parts are dealt by Spark's range partitioning of (doc_id, row, place), so
    neither a long document nor one id on many rows makes a file large; each task sorts its range and codes it as a stream.
    """
    spark = docs.sparkSession
    kind = id_type(tokenizer)
    names = ["doc_id", "uid", "before", "ids", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for doc, texts in arrow_steps(batches, STEP):
            ids, ends = encode_texts(texts, tokenizer)
            total = np.diff(ends)
            parts = -(-total // PART)
            of = np.repeat(np.arange(len(total)), parts)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART
            offsets = np.append(ends[of] + start, ends[-1]) * kind.itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([doc.cast(pa.int64()).take(pa.array(of)), pa.array((task << 40) + row + of), pa.array(start), raw.cast(pa.binary()), pa.array(total[of])], names)
            row += len(total)

    tokens = fresh_path(spark, "token-ids")
    spread(text_rows(docs)).mapInArrow(run, "doc_id long, uid long, before long, ids binary, total long").write.option("compression", "zstd").parquet(tokens)
    rows = spark.read.parquet(tokens)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            if len(got) > len(total):
                got, total = total, got
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(np.where(np.arange(len(at)) == 0, total.sum(), 0))], ["id", "n", "sum"])

    counted = rows.select("ids").mapInArrow(tally, "id long, n long, sum long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    ids, counts = counted.column("id").to_numpy(), counted.column("n").to_numpy()
    freq, bits = frequencies(counts)
    spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "freq": pa.array(freq, pa.int64()), "bits": pa.array([bits] * len(ids), pa.int64())})).coalesce(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(Table(ids, freq, bits))
    files = min(MOST_FILES, max(1, round(int(counts.sum()) * kind.itemsize / file_bytes)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for blocks in coded(each, TaskContext.get().partitionId(), kind, table.value):
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])

    order = [F.asc_nulls_first("doc_id"), F.asc("uid"), F.asc("before")]
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select(*names)
    blocks = ranged.mapInArrow(code, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", MARK).option("compression", "none").text(f"{path}/blocks")

    sums = sorted(tuple(r) for r in blocks_of(spark, path).groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect())
    bases = np.cumsum([0, *(n for _, n, _ in sums)]).tolist()
    spark.createDataFrame([(*s, b) for s, b in zip(sums, bases)], "part long, n long, blocks long, base long").coalesce(1).write.parquet(f"{path}/parts")


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    """part, number, first, n and block (its bytes) of every block; the numbers come from the headers, without Python."""
    raw = F.col("value").cast("binary")
    number = lambda at, size: F.conv(F.hex(F.substring(raw, at + 1, size)), 16, 10).cast("long")
    lines = spark.read.option("lineSep", MARK).text(f"{path}/blocks")
    return lines.select(number(8, 4).alias("part"), number(12, 4).alias("number"), number(16, 8).alias("first"), number(24, 8).alias("n"), raw.alias("block"))


def table_of(spark: SparkSession, path: str) -> Table:
    """The frequency table of a folder: a row for each id that occurs."""
    rows = spark.read.parquet(f"{path}/table").orderBy("id").toArrow()
    bits = int(rows.column("bits")[0].as_py()) if len(rows) else BITS
    return Table(rows.column("id").to_numpy(), rows.column("freq").to_numpy(), bits)


def checked(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `at`, the place of their first id among all; a ValueError if a file misses some. Files are at most
    MOST_FILES, so their rows are broadcast."""
    parts = spark.read.parquet(f"{path}/parts")
    found = blocks_of(spark, path)
    there = found.groupBy("part").agg(F.count_distinct("number").alias("there"), F.sum("n").alias("ids"))
    bad = parts.join(F.broadcast(there), "part", "full").where("blocks is null or there is null or there <> blocks or ids <> n").select("part").head(5)
    if bad:
        raise ValueError(f"blocks are missing from, or too many in, files {sorted(r[0] for r in bad)}")
    return found.join(F.broadcast(parts.select("part", "base")), "part").withColumn("at", F.col("base") + F.col("first"))


def reading(blocks: DataFrame, path: str, rows: Callable[[list[Read], list[np.ndarray], list[int]], pa.RecordBatch], schema: str) -> DataFrame:
    """rows(blocks, their ids, their places among all ids) of all blocks, SIDE at a time."""
    spark = blocks.sparkSession
    table = spark.sparkContext.broadcast(table_of(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), SIDE):
                some = [Read(x.as_buffer().to_pybytes()) for x in b.column(1).slice(lo, SIDE)]
                yield rows(some, all_ids(some, table.value), b.column(0).slice(lo, SIDE).to_pylist())

    return spread(blocks.select("at", "block")).mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document in each block: doc_id, start (ids of all documents before it), before (its own ids before
    these), ids and total (its ids in all)."""
    names = ["doc_id", "start", "before", "ids", "total"]

    def rows(blocks: list[Read], ids: list[np.ndarray], at: list[int]) -> pa.RecordBatch:
        found = [(d, a + place - before, before, found[place : place + n].astype(np.int32), total) for b, found, a in zip(blocks, ids, at) for d, before, place, n, total in b.documents()]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    return reading(checked(spark, path), path, rows, "doc_id long, start long, before long, ids array<int>, total long")


def window(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """at and ids of the ids first .. last (exclusive) among all, a row for each block that holds some; nothing is decoded
    before the last checkpoint in front of them."""
    table = spark.sparkContext.broadcast(table_of(spark, path))
    blocks = checked(spark, path).where((F.col("at") < last) & (F.col("at") + F.col("n") > first)).select("at", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_pylist()
            some = [Read(x.as_buffer().to_pybytes()) for x in b.column(1)]
            cuts = [(max(0, first - a), min(r.n, last - a)) for a, r in zip(at, some)]
            found = [r.ids(table.value, lo, hi).astype(np.int32) for r, (lo, hi) in zip(some, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array([a + lo for a, (lo, _) in zip(at, cuts)], pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["at", "ids"])

    return blocks.mapInArrow(run, "at long, ids array<int>")


#: The polynomial of crc32, lowest power in the highest bit; and x to the power 8 * 2 ** i modulo it.
POLYNOMIAL = 0xEDB88320


def times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of crc32."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def moved(crc: int, size: int) -> int:
    """What a crc32 adds, by exclusive or, to that of its bytes followed by `size` others."""
    power = 1 << 23  # x to the power 8
    while size:
        if size & 1:
            crc = times(crc, power)
        power, size = times(power, power), size >> 1
    return crc


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written and read back.

    The crc32 of a document over several blocks is the exclusive or of what its parts add to it, so parts are aggregated in
    tasks before they are shuffled, whatever their number."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write(docs, path, tokenizer)

    def rows(blocks: list[Read], ids: list[np.ndarray], at: list[int]) -> pa.RecordBatch:
        found = []
        for b, ids_in, a in zip(blocks, ids, at):
            raw = ids_in.astype("<u4").tobytes()
            for doc, before, place, n, total in b.documents():
                crc = zlib.crc32(raw[4 * place : 4 * (place + n)])
                found.append((doc, a + place - before, n, moved(crc, 4 * (total - before - n)), total))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "start", "n", "crc", "total"])

    parts = reading(checked(spark, path), path, rows, "doc_id long, start long, n long, crc long, total long")
    return parts.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
