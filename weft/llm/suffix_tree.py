"""Language-model scoring by a probabilistic suffix tree over words.

Level by level: contexts of k words are counted wherever their suffix of k - 1 words was retained, and a context is retained
if its next words diverge from what its suffix predicts (relative entropy, weighted by its count). So contexts differ in
length, and the tree deepens as long as the test retains any. In a retained context the next words that are frequent enough
and diverge have discounted probabilities of their own, and all others share the rest in the proportions of the suffix. The
root is the distribution of single words, discounted in favour of unknown ones. A text is scored from the longest suffix of
what came before each word that is retained.

The tree is tables: contexts with the factor of their rest, and nodes with their gain over what the suffix predicts. In
logarithms a word's probability is the sum of the root's, of its retained contexts' rests and of its nodes' gains, so a
text's score is a sum over keys, which joins and aggregates; nothing of the tree has a bound but LEAST occurrences, and it
grows with the corpus. Only as a first tier the most frequent words and nodes, at most HOT_WORDS and HOT_NODES, are
broadcast; what is not among them is joined, so the tiers' sizes change no result. Bitmaps of BITS bits tell which keys
need not be counted or joined; where they fill up, more is counted and joined than needed, with the same result.

Defined results: a null text is an empty text and has its end only; texts of any length are scored whole; without training
tokens a text's scores are 0; repeated rows and equal ids are scored each (a training text as often as it occurs); a null
id is in no fold, held_out is null and its text is not learned; an empty table gives no rows; other columns are ignored.
Words are joined by their bytes. Words that are not of the first tier are 63-bit hashes inside contexts, and contexts
64-bit hashes in sums.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_steps, fold, fresh_path, most_frequent, spread, text_rows

#: The end of a text; no word holds a space. It also stands before a text's first word.
END = " "
#: Occurrences from which a word, a context or a node can be in the tree: the same for a corpus of any size.
LEAST = 8
#: Relative entropy, in nats times occurrences, that a context and each of its words must reach; and what is discounted.
DIVERGENCE, DISCOUNT, SEED = 60.0, 0.5, 42
#: Sizes of the broadcast tiers and of a bitmap, whatever the corpus.
HOT_WORDS, HOT_NODES, BITS = 200_000, 1_000_000, 1 << 26
#: Bits of a key that tell its place in the first tier of nodes.
SLOTS = 21
#: Characters of a step, and rows that a task gathers before it hands them on.
STEP, GATHERED = 4_000_000, 1_500_000
#: Levels whose contexts have all been counted as nodes of the level before, as all of the suffixes there were.
KNOWN = 2
#: Training tokens a task that adds counts, and the parts that it takes one after another.
PER_TASK, PARTS = 2_000_000, 2
#: The next words of a context that are too rare to be nodes, together.
OTHER = -(2**63)
#: The symbol of every word that is neither of the first tier nor has LEAST occurrences: no context or node holds it.
RARE = -(2**62)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * PRIMES[1]
    return (h ^ (h >> np.uint64(27))) * PRIMES[2]


def extended(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The key of a context with one more word before it."""
    return mixed(key * PRIMES[0] + symbol.view(np.uint64) + np.uint64(1))


def node(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The key of a context's next word."""
    return mixed((key ^ PRIMES[1]) * PRIMES[2] + symbol.view(np.uint64) + np.uint64(3))


def unretained(key: np.ndarray) -> np.ndarray:
    """The key that tells that a context with nodes was counted and not retained."""
    return mixed((key ^ PRIMES[2]) * PRIMES[0] + np.uint64(5))


ROOT = np.uint64(7)


class Words:
    """The first tier of words: their numbers by string."""

    def __init__(self, words: list[str]):
        self.number = {w: i for i, w in enumerate(words)}

    def symbols(self, words: list[str]) -> np.ndarray:
        """A number for each word: its own in the first tier, a hash below zero for others."""
        get = self.number.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = (xxhash.xxh64_intdigest(words[i], SEED) | 1 << 63) - (1 << 64)
        return out


def tokenised(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (the end is the last), the place of every word among them, and each text's number of words. A text
    begins with the mark of an end that is not its own, and ends with one that is."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if "" in distinct:  # white space at a text's ends
        real = at != distinct.index("")
        at, of = at[real], of[real]
    sizes = np.bincount(of, minlength=len(texts)) + 2
    stops = np.cumsum(sizes)
    inside = np.ones(len(at) + 2 * len(sizes), bool)
    inside[stops - 1] = inside[stops - sizes] = False
    out = np.full(len(inside), len(distinct), np.int32)
    out[inside] = at
    return [*distinct, END], out, sizes


def packed_lists(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Numbers up to each end (the first is 0) as the bytes of one row."""
    offsets = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def unpacked_lists(rows: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of rows, and how many each row has."""
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, rows.offset * 4) if len(rows) else np.zeros(1, np.int32)
    data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), np.diff(offsets).astype(np.int64) // size


class Sequence:
    """Symbols of some texts, their owners, and how many symbols of its text stand before each. Symbols of the first tier are
    stored in 32 bits, in whose place others have -1; those are in `cold`, in order. -2 stands for RARE."""

    def __init__(self, symbols: pa.BinaryArray, cold: pa.BinaryArray):
        short, size = unpacked_lists(symbols, np.int32)
        self.symbol = short.astype(np.int64)
        self.symbol[short == -1] = unpacked_lists(cold, np.int64)[0]
        self.symbol[short == -2] = RARE
        self.sizes = size - 1  # tokens: words and the end
        self.room = np.arange(len(self.symbol)) - np.repeat(np.cumsum(size) - size, size)

    @functools.cached_property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes + 1)


class Bitmap:
    """Which keys may be there; never misses one that is. tokens: how many the texts have whose keys these are; near:
    the nearest words of the contexts that were retained last."""

    def __init__(self, tokens: int = 0):
        self.tokens, self.near = tokens, None
        self.words = np.zeros(BITS // 64, np.uint64)

    def add(self, keys: DataFrame) -> None:
        """keys: a table with a column key; its bits are put together by slot, at most BITS / 64 rows of them."""
        bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
        slots = keys.select(F.pmod(F.shiftright("key", 6), F.lit(BITS // 64)).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
        at = slots.column("slot").to_numpy()
        self.words[at] |= slots.column("bits").to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        signed = keys.view(np.int64)
        return self.words[(signed >> 6) & (BITS // 64 - 1)] >> (keys & np.uint64(63)) & np.uint64(1) == 1


def stored(rows: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows, written to the shared folder and read again, so that the plan behind them ends here. Nothing reads the
    shuffle files of that plan again, so Spark is asked to remove them when the write has ended."""
    spark = rows.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Remove tables of the shared folder that nothing reads again."""
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        path = tables[0].sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(tables[0].sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def context_columns(level: int) -> list[str]:
    """w1 is the nearest word before the next one."""
    return [f"w{i}" for i in range(1, level + 1)]


def keyed(rows: DataFrame, level: int, kept: list[str], closed: bool = False) -> DataFrame:
    """The key of each row's context (and next word, if there is a column x), and the columns `kept`; closed: the key that tells
    that the context was not retained."""
    names = context_columns(level) + (["x"] if "x" in rows.columns else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.full(b.num_rows, ROOT)
            for i in range(level):
                key = extended(key, b.column(i).to_numpy())
            if "x" in names:
                key = node(key, b.column(level).to_numpy())
            if closed:
                key = unretained(key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(b.column(n) for n in kept)], ["key", *kept])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept)
    return rows.select(*names, *kept).mapInArrow(run, "key long" + (", " + kinds if kept else ""))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (in training texts) and every (in all texts); docs has train and text. Counted in tasks first."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("every", pa.int64())])

    def added(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum"), ("every", "sum")])
        return sums.select(["word", "n_sum", "every_sum"]).rename_columns(schema.names).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for train, texts in arrow_steps(batches, STEP):
            distinct, at, sizes = tokenised(texts)
            learn = np.repeat(train.to_numpy(zero_copy_only=False).astype(bool), sizes)
            told = np.ones(len(at), bool)
            told[np.cumsum(sizes) - sizes] = False  # the mark before a text is no token of it
            every, n = np.bincount(at[told], minlength=len(distinct)), np.bincount(at[told & learn], minlength=len(distinct))
            some = every > 0
            held.append(pa.table([pa.array(distinct, pa.string()).filter(pa.array(some)), pa.array(n[some]), pa.array(every[some])], schema=schema))
            if sum(map(len, held)) > GATHERED:
                held = [added(held)]
                if len(held[0]) > GATHERED // 2:
                    yield from held.pop().to_batches(max_chunksize=200_000)
        if held:
            yield from added(held).to_batches(max_chunksize=200_000)

    return docs.select("train", "text").mapInArrow(run, "word string, n long, every long").repartition("word").groupBy("word").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def coded_words(rows: DataFrame, words, kept: list[str], symbol: str) -> DataFrame:
    """The symbol of each row's word, and the columns `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(words.value.symbols(b.column(0).to_pylist())), *b.columns[1:]], [symbol, *kept])

    return rows.select("word", *kept).mapInArrow(run, ", ".join(f"{c} long" for c in [symbol, *kept]))


def encoded(docs: DataFrame, words, often) -> DataFrame:
    """doc_id, train, the symbols of every text, and its words that are not of the first tier; docs has doc_id, train, text.
    often: a bitmap of the symbols outside the first tier that are not RARE."""
    names = ["doc_id", "train", "symbols", "cold", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for about, texts in arrow_steps(batches, STEP):
            distinct, at, sizes = tokenised(texts)
            own = words.value.symbols(distinct)
            own[(own < 0) & ~often.value.has(own.view(np.uint64))] = RARE
            symbols, ends = own[at], np.concatenate([[0], np.cumsum(sizes)])
            cold = np.flatnonzero(symbols < 0)
            of = np.repeat(np.arange(len(sizes)), sizes)
            first = np.zeros(len(at), bool)
            first[ends[:-1]] = True
            told = cold[~first[cold]]
            rare = pa.array(distinct, pa.string()).take(pa.array(at[told]))
            short = packed_lists(np.where(symbols == RARE, -2, np.maximum(symbols, -1)).astype(np.int32), ends)
            listed = cold[symbols[cold] != RARE]
            long = packed_lists(symbols[listed], np.concatenate([[0], np.cumsum(np.bincount(of[listed], minlength=len(sizes)))]))
            yield pa.RecordBatch.from_arrays([*about.flatten(), short, long, lists(of[told], rare, len(sizes))], names)

    return docs.select(F.struct("doc_id", "train"), "text").mapInArrow(run, "doc_id long, train boolean, symbols binary, cold binary, rare array<string>")


def lists(owners: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """values, sorted by owner, as a list for each of n owners."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))]), pa.int32()), values)


def summed(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of symbols in order, and how often each occurs (n: occurrences that a row stands for)."""
    names, codes = [], []
    for c in columns:  # symbols outside the first tier are numbered after those of it, so that several fit into one number
        cold, top = c < 0, int(c.max(initial=0)) + 1
        own, back = np.unique(c[cold], return_inverse=True)
        code = c.copy()
        code[cold] = back + top
        names.append((top, own))
        codes.append(code)
    widths = [int(top + len(own)).bit_length() for top, own in names]
    if sum(widths) < 64:
        whole = codes[0]
        for code, width in zip(codes[1:], widths[1:]):
            whole = whole << width | code
        order = None if n is None else np.argsort(whole)
        whole = np.sort(whole) if n is None else whole[order]
        starts = np.flatnonzero(np.diff(whole, prepend=-1))
        whole, out = whole[starts], []
        for (top, own), width in zip(names[::-1], widths[::-1]):
            code = whole & ((1 << width) - 1)
            cold = code >= top
            code[cold] = own[code[cold] - top]
            out.insert(0, code)
            whole = whole >> width
    else:
        order = np.lexsort(codes[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for code in codes:
            new[1:] |= np.diff(code[order]) != 0
        starts = np.flatnonzero(new)
        out = [c[order[starts]] for c in columns]
    if n is None:
        return out, np.diff(starts, append=len(columns[0]))
    return out, np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def squeezed(columns: list[np.ndarray]) -> bytes:
    """Rows in order as bytes: steps of the first column and all others, byte by place, compressed."""
    steps = [np.diff(columns[0], prepend=np.int64(0)), *columns[1:]]
    return pa.Codec("zstd").compress(np.ascontiguousarray(np.stack(steps).view(np.uint8).reshape(len(steps), -1, 8).transpose(0, 2, 1)), asbytes=True)


def unsqueezed(row: bytes, width: int, size: int) -> np.ndarray:
    data = np.frombuffer(pa.Codec("zstd").decompress(row, width * size * 8), np.uint8).reshape(width, 8, size)
    columns = data.transpose(0, 2, 1).copy().reshape(width, -1).view(np.int64)
    columns[0] = np.cumsum(columns[0])
    return columns


def occurrences(texts: DataFrame, level: int, bitmap, parts: int) -> DataFrame:
    """Occurrences of contexts of `level` words (w1 the nearest) and their next word x, summed within tasks: each row has those
    of one of `parts` parts, squeezed, `size` of them. Left out are contexts that cannot occur LEAST times, as some of their
    words or all of them in a row are known to occur less often, or whose suffix is not retained. Next words that cannot occur
    LEAST times are left out up to level KNOWN and OTHER beyond it; up to there a context's next words are dealt over all parts."""

    def counted(symbols: pa.BinaryArray, cold: pa.BinaryArray) -> list[np.ndarray]:
        rows, seen = Sequence(symbols, cold), bitmap.value
        s = rows.symbol
        if level == 1:
            often = seen.has(node(np.full(len(s), ROOT), s)) & (s != RARE)
            p = np.flatnonzero((rows.room[1:] >= 1) & often[1:] & often[:-1]) + 1
            return [s[p - 1], s[p]]
        p = np.flatnonzero(rows.room >= level)
        p = p[seen.near.has(s[p - 1].view(np.uint64))]
        key = np.full(len(p), ROOT)
        for k in range(1, level):  # a context is retained only if all its suffixes are
            key = extended(key, s[p - k])
            if k > 1 or level == 2:
                ok = seen.has(key)
                p, key = p[ok], key[ok]
        fine = seen.has(node(key, s[p]))
        for k in range(1, level):  # each word follows the one before it often enough
            ok = seen.has(node(extended(np.full(len(p), ROOT), s[p - k - 1]), s[p - k])) & (s[p - k - 1] != RARE)
            p, fine = p[ok], fine[ok]
        if level > 2:  # w1 is itself a next word: of the words before it, which were counted unless a suffix of theirs was not retained
            far, may = np.full(len(p), ROOT), np.zeros(len(p), bool)
            for k in range(2, level + 1):
                far = extended(far, s[p - k])
                may |= seen.has(unretained(far)) if k < level else seen.has(node(far, s[p - 1]))
            p, fine = p[may], fine[may]
        if level <= KNOWN:
            p, fine = p[fine], fine[fine]
        return [*(s[p - k] for k in range(1, level + 1)), np.where(fine, s[p], OTHER)]

    def told(columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = np.full(len(n), ROOT)
        for w in columns[:level]:
            key = extended(key, w)
        if level <= KNOWN:
            key = node(key, columns[level])
        part = (key >> np.uint64(20)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        part, columns = part[order], [c[order] for c in (*columns, n)]
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        for i in range(0, len(cuts) - 1, 100):
            pieces = list(zip(cuts[i : i + 100], cuts[i + 1 :]))
            rows = [pa.array(x) for x in ([int(part[lo]) for lo, _ in pieces], [hi - lo for lo, hi in pieces], [squeezed([c[lo:hi] for c in columns]) for lo, hi in pieces])]
            yield pa.RecordBatch.from_arrays(rows, ["part", "size", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            held.append(counted(b.column(0), b.column(1)))
            if sum(len(c[0]) for c in held) > GATHERED:
                yield from told(*summed([np.concatenate(c) for c in zip(*held)]))
                held = []
        if sum(len(c[0]) for c in held):
            yield from told(*summed([np.concatenate(c) for c in zip(*held)]))

    return texts.mapInArrow(run, "part long, size long, rows binary")


def windows(texts: DataFrame, level: int, bitmap) -> DataFrame:
    """Contexts of `level` words and their next words x that occur LEAST times, with their n; beyond level KNOWN also what the
    other next words of a context that occurs LEAST times have together, as OTHER. A task holds one part at a time."""
    names = [*context_columns(level), "x", "n"]
    tasks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, bitmap.value.tokens // PER_TASK + 1)

    def added(held: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        *columns, n = np.concatenate([unsqueezed(row, level + 2, size) for row, size in held], axis=1)
        columns, n = summed(columns, n)
        rare = (n < LEAST) | (columns[level] == OTHER)
        yield pa.RecordBatch.from_arrays([pa.array(c[~rare]) for c in (*columns, n)], names)
        if level > KNOWN:  # all of a context is in this part
            new = np.ones(len(n), bool)
            new[1:] = np.any([np.diff(w) != 0 for w in columns[:level]], axis=0)
            at = np.flatnonzero(new)
            other = np.add.reduceat(np.where(rare, n, 0), at)
            more = (np.add.reduceat(n, at) >= LEAST) & (other > 0)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(w[at[more]] for w in columns[:level]), np.full(more.sum(), OTHER), other[more])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int]] = []
        now = None
        for b in batches:
            for part, size, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if part != now and held:
                    yield from added(held)
                    held = []
                now = part
                held.append((row.as_buffer(), size))
        if held:
            yield from added(held)

    return occurrences(texts, level, bitmap, PARTS * tasks).repartitionById(tasks, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def grown(texts: DataFrame, level: int, bitmap, retained: DataFrame | None, below: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The retained contexts of one level (with their count c and rest), the nodes counted in them (with n, logp and, if they
    have a probability of their own, gain), and the nodes counted in all. below: what the suffix predicts for its counted next
    words. known: the nodes of the level before; their words are followed by something as often as they occur."""
    names = context_columns(level)
    counts = stored(windows(texts, level, bitmap), "counts")
    if level <= KNOWN:
        contexts = known.select(F.col("x").alias("w1"), *(F.col(f"w{i - 1}").alias(f"w{i}") for i in range(2, level + 1)), F.col("n").alias("c"))
    else:
        contexts = counts.groupBy(*names).agg(F.sum("n").alias("c")).where(F.col("c") >= LEAST)
    if retained is not None:
        contexts = contexts.join(retained.select(*names[:-1]), names[:-1], "left_semi")
    base = below.select(*names[:-1], "x", F.col("logp").alias("below"))
    nodes = counts.where(F.col("x") != OTHER).join(contexts, names).join(base, [*names[:-1], "x"])
    own, low = (F.col("n") - DISCOUNT) / F.col("c"), F.pow(F.lit(10.0), "below")
    nodes = nodes.withColumn("own", own).withColumn("low", low).withColumn("keep", F.abs(F.col("n") * F.ln(F.col("n") / (F.col("c") * F.col("low")))) >= DIVERGENCE)
    nodes = stored(nodes, "nodes")
    released(counts)
    sums = nodes.where("keep").groupBy(*names).agg(F.first("c").alias("c"), F.sum("own").alias("mass"), F.least(F.sum("low"), F.lit(1 - 1e-9)).alias("mass_low"), F.sum(F.col("own") * F.ln(F.col("own") / F.col("low"))).alias("gained"))
    left = (1 - F.col("mass")) / (1 - F.col("mass_low"))
    kept = stored(sums.where(F.col("c") * (F.col("gained") + (1 - F.col("mass")) * F.ln(left)) >= DIVERGENCE).select(*names, "c", F.log10(left).alias("rest")), "contexts")
    told = nodes.join(kept.select(*names, "rest"), names)
    gain = F.when(F.col("keep"), F.log10("own") - F.col("rest") - F.col("below"))
    told = told.select(*names, "x", "n", F.when(F.col("keep"), F.log10("own")).otherwise(F.col("rest") + F.col("below")).alias("logp"), gain.alias("gain"))
    return kept, stored(told, "told"), nodes


class Model:
    """Counts of words, their first tier, the tree's first tier (sorted keys and values), and the table of all its values."""

    def __init__(self, total: int, distinct: int, once: int):
        self.total, self.distinct = total, distinct
        self.discount = max(once, 1) / (distinct + 1)
        self.depth = 0

    def unknown(self) -> float:
        """log10 of the root's probability of all unknown words together."""
        return float(np.log10(self.discount * self.distinct / self.total)) if self.total else 0.0


def vocabulary(counts: DataFrame, hot_words: int = HOT_WORDS) -> tuple[Model, Column]:
    """The model with its counts and first tier of words, and which words of the table are in that tier."""
    model = Model(*counts.where("n > 0").select(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first())
    hot = most_frequent(counts, "every", hot_words)
    first = counts.where(hot).orderBy(F.desc("every"), "word").toArrow()
    model.words, model.train = first.column("word").to_pylist(), first.column("n").to_numpy().astype(np.float64)
    return model, hot


def learned(model: Model, texts: DataFrame, counts: DataFrame, words, hot_nodes: int = HOT_NODES) -> DataFrame:
    """Grow the tree of training texts (symbols) into the model; gives the table of its values (key, value, weight) outside
    the first tier. words: the broadcast first tier of words."""
    spark = texts.sparkSession

    root = F.log10((F.col("n") - model.discount) / max(model.total, 1))
    often = coded_words(counts.where(F.col("n") >= LEAST), words, ["n"], "x")
    below = stored(often.groupBy("x").agg(F.max("n").alias("n")).select("x", "n", root.alias("logp")), "root")
    bits = Bitmap(model.total)
    bits.add(keyed(below, 0, []))
    retained, values, parts, nodes = None, None, [], below
    while True:
        level = model.depth + 1
        bitmap = spark.sparkContext.broadcast(bits)
        suffixes = below
        known = nodes
        retained, below, nodes = grown(texts, level, bitmap, retained, suffixes, known)
        parts += [retained, below]
        found = retained.count()
        bitmap.unpersist()
        released(known)
        if not found:
            released(nodes)
            break
        model.depth = level
        contexts = keyed(retained, level, ["rest", "c"]).toDF("key", "value", "weight")
        own = keyed(below, level, ["gain", "n"]).toDF("key", "value", "weight").where("value is not null")
        values = contexts.union(own) if values is None else values.union(contexts).union(own)
        names = context_columns(level)
        bits.near = Bitmap()
        bits.near.add(retained.select(F.col("w1").alias("key")).distinct())
        closed = nodes.select(*names).distinct().join(retained.select(*names), names, "left_anti")
        bits.add(contexts.select("key").union(keyed(nodes, level, [])).union(keyed(closed, level, [], True)))
    if values is None:
        model.keys, model.values, model.bits = np.zeros(0, np.uint64), np.zeros(0), None
        return spark.createDataFrame([], "key long, value double, weight long")
    values = stored(values, "values")
    released(*parts)
    common = most_frequent(values, "weight", hot_nodes)
    tier = values.where(common).select("key", "value").toArrow()
    keys = tier.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model.keys, model.values = keys[order], tier.column("value").to_numpy()[order]
    model.first = np.searchsorted(model.keys >> np.uint64(64 - SLOTS), np.arange((1 << SLOTS) + 1)).astype(np.int32)
    rest = values.where(~common)
    model.bits = None
    if not rest.isEmpty():
        model.bits = Bitmap()
        model.bits.add(rest)
    return rest


def looked_up(keys: np.ndarray, model: Model) -> np.ndarray:
    """Values of keys in the first tier, nan for others; the first SLOTS bits of a key tell where it is in their order."""
    out = np.full(len(keys), np.nan)
    if not len(model.keys):
        return out
    slot = keys >> np.uint64(64 - SLOTS)
    at, end = model.first[slot], model.first[slot + np.uint64(1)]
    left = np.flatnonzero(at < end)
    at = at[left]
    while len(left):
        same = model.keys[at] == keys[left]
        out[left[same]] = model.values[at[same]]
        at = at + 1
        more = ~same & (at < end[left])
        left, at = left[more], at[more]
    return out


def tree_sums(rows: Sequence, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the sum of values in the first tier, and (text, key) of what has to be looked up in the table."""
    total, owners, cold = np.zeros(len(rows.sizes)), [], []
    p = np.flatnonzero(rows.room >= 1)
    key = np.full(len(p), ROOT)
    for level in range(1, model.depth + 1):
        key = extended(key, rows.symbol[p - level])
        value = looked_up(key, model)
        here = ~np.isnan(value)
        total += np.bincount(rows.of[p[here]], value[here], len(total))
        if model.bits is not None:
            more = ~here & model.bits.has(key)
            owners.append(rows.of[p[more]])
            cold.append(key[more])
            here |= more
        p, key = p[here], key[here]
        if not len(p):
            break
        ends = node(key, rows.symbol[p])
        value = looked_up(ends, model)
        own = ~np.isnan(value)
        total += np.bincount(rows.of[p[own]], value[own], len(total))
        if model.bits is not None:
            more = ~own & model.bits.has(ends)
            owners.append(rows.of[p[more]])
            cold.append(ends[more])
        deeper = rows.room[p] > level
        p, key = p[deeper], key[deeper]
    both = (np.concatenate(owners), np.concatenate(cold)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.argsort(both[0], kind="stable")
    return total, both[0][order], both[1][order]


def scored(docs: DataFrame, folds: int = 7, held_out: int = 2, hot_words: int = HOT_WORDS, hot_nodes: int = HOT_NODES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    texts = spread(text_rows(docs)).withColumn("train", F.coalesce(fold(F.col("doc_id"), folds) != held_out, F.lit(False)))
    counts = stored(word_counts(texts), "words")
    model, hot = vocabulary(counts, hot_words)
    first = spark.sparkContext.broadcast(Words(model.words))
    often = Bitmap()
    often.add(coded_words(counts.where((F.col("n") >= LEAST) & ~hot), first, [], "key"))
    often = spark.sparkContext.broadcast(often)
    coded = stored(encoded(texts, first, often).withColumn("row", F.monotonically_increasing_id()), "symbols", "zstd")
    nodes = learned(model, coded.where("train").select("symbols", "cold"), counts, first, hot_nodes)
    sent = spark.sparkContext.broadcast(model)
    base = float(np.log10(model.total + model.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        logs = np.log10(own.train + 1)
        roots = np.where(own.train > 0, np.log10(np.maximum(own.train - own.discount, 1e-300) / max(own.total, 1)), own.unknown()) if own.total else np.zeros(len(own.train))
        for b in batches:
            rows, n = Sequence(b.column(2), b.column(3)), b.num_rows
            hot = np.flatnonzero((rows.room > 0) & (rows.symbol >= 0))
            of, symbol = rows.of[hot], rows.symbol[hot]
            known = of[own.train[symbol] > 0]
            total, owners, cold = tree_sums(rows, own)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(rows.sizes),
                    pa.array(np.bincount(known, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(of, logs[symbol], n).astype(np.float64)),
                    pa.array(total + np.bincount(of, roots[symbol], n)),
                    lists(owners, pa.array(cold.view(np.int64)), n),
                ],
                ["row", "doc_id", "n_tokens", "known", "logs", "told", "cold"],
            )

    each = stored(coded.select("row", "doc_id", "symbols", "cold").mapInArrow(run, "row long, doc_id long, n_tokens long, known long, logs double, told double, cold array<long>"), "scores")
    words = counts.where(~hot)

    n = F.coalesce("n", F.lit(0))
    root = F.when(n > 0, F.log10((n - model.discount) / max(model.total, 1))).otherwise(model.unknown())
    rare = coded.select("row", F.explode("rare").alias("word")).join(words.select("word", "n"), "word", "left")
    rare = rare.select("row", (n > 0).cast("long").alias("more_known"), F.log10(n + 1).alias("more_logs"), root.alias("more_told"))
    cold = each.select("row", F.explode("cold").alias("key")).join(nodes, "key").select("row", F.lit(0).cast("long").alias("more_known"), F.lit(0.0).alias("more_logs"), F.col("value").alias("more_told"))
    sums = (rare if model.bits is None else rare.union(cold)).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more_known", "more_logs", "more_told")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return each.drop("cold").join(sums, "row", "left").select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("more_known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("more_logs") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("told") + zero("more_told")).alias("score"),
    )
