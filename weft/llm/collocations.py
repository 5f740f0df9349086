"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

A task cuts its texts into pieces and words and counts, for a step of many texts at once, which words follow each prefix; it
emits a stripe for each prefix, an associative array of next words and counts. Stripes of a prefix meet in one place (a few,
by a hash of the next word, so that no prefix is a hot one) and are added element by element. Prefixes are words first. The
sum of a prefix's stripe, the ends of pieces included, is how often the prefix occurs; the elements are its extensions. Then
prefixes are pairs of words, for pairs that occur often enough to be part of a candidate; the greatest element of a stripe,
and of those that end in a pair, says whether a longer phrase takes the pair up (subsumption).

Which pairs occur often enough is asked of a bitmap of bounded size, hashed from the counted pairs: what passes by chance
is counted too and dropped by its count, so the bitmap saves work and never changes a result, however large the corpus.

Defined results: a null text is empty; a null language is `und`; a text without words adds nothing; texts of any length are
read whole; repeated rows and equal ids are texts of their own; ties are settled by the phrase; an empty table gives no
rows; other columns, whatever their names, are ignored. Counts below 10 ** 15 keep all arithmetic exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import arrow_steps, cut, fresh_path, join_groups, spread

#: Characters that a task counts at a time.
STEP = 8_000_000
#: Stripes of a prefix are dealt to so many places by the hash of the next word.
PLACES = 16
#: Bits of the bitmap for each pair in it, and bits at most.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: So many of the most frequent parts of candidates are broadcast; more are joined by a shuffle.
BROADCAST_PARTS = 50_000
#: Places in which each language's phrases are ranked first.
SALTS = 64

LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
ENDS, GAPS = np.zeros(256, bool), np.zeros(256, bool)
ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True  # of pieces
GAPS[[*b" \t"]] = True  # of words
STRIPE = "lang string, prefix string, place int, nexts array<string>, counts array<long>"
NAMES = ["lang", "prefix", "place", "nexts", "counts"]


class Words:
    """The words of some texts as codes, in order."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        end = ENDS[data]
        inside = ~(end | GAPS[data])
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = inside[begins]  # texts lie side by side
        end[begins] = True  # (a letter may begin a text: it is no end of a piece then, but begins one)
        at = np.flatnonzero(first)
        size = np.cumsum(inside)
        size = np.append(size[at] - 1, size[-1] if len(size) else 0)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[inside])])
        coded = packed.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.word = coded.dictionary
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.word.to_pylist()), np.uint64, len(self.word))
        text = np.searchsorted(offsets, at, side="right") - 1
        langs = langs.dictionary_encode()
        self.lang_name = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
        self.lang_hash = np.fromiter((xxhash.xxh64_intdigest(x) for x in self.lang_name.cast(pa.binary()).to_pylist()), np.uint64, len(self.lang_name))
        piece = np.cumsum(end)[at]
        self.more = np.zeros(len(at), bool)  # whether the next word is in the same piece
        self.more[:-1] = piece[1:] == piece[:-1]


def mixed(lang: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A hash of a language and two words, from theirs."""
    x = (lang * np.uint64(3) + one) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ x >> np.uint64(29)) + two) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def stripes(prefix: np.ndarray, following: np.ndarray, last: int, place: np.ndarray) -> tuple:
    """Of each (prefix, place) the words that follow and how often: (prefixes, places, where each begins, words, counts).
    prefix: numbers below the number of rows; following: codes up to `last`, which stands for the end of a piece."""
    key, count = np.unique(prefix * (last + 1) + following, return_counts=True)
    head, word = key // (last + 1), key % (last + 1)
    spot = place[word]
    order = np.lexsort((spot, head))
    head, word, spot, count = head[order], word[order], spot[order], count[order]
    new = np.ones(len(head), bool)
    new[1:] = (head[1:] != head[:-1]) | (spot[1:] != spot[:-1])
    at = np.flatnonzero(new)
    return head[at], spot[at], np.append(at, len(head)), word, count


def batches_of(found: tuple, lang: pa.Array, prefix: pa.Array, words: pa.Array, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Stripes as Arrow batches; lang and prefix are those of each stripe, words the names of codes (the last one null)."""
    _, spot, at, word, count = found
    for lo in range(0, len(spot), rows):
        hi = min(lo + rows, len(spot))
        offsets = pa.array(at[lo : hi + 1] - at[lo], pa.int32())
        nexts = pa.ListArray.from_arrays(offsets, words.take(pa.array(word[at[lo] : at[hi]])))
        counts = pa.ListArray.from_arrays(offsets, pa.array(count[at[lo] : at[hi]], pa.int64()))
        yield pa.RecordBatch.from_arrays([lang.slice(lo, hi - lo), prefix.slice(lo, hi - lo), pa.array(spot[lo:hi].astype(np.int32)), nexts, counts], NAMES)


def named(words: pa.Array) -> pa.Array:
    """Names of codes with a null at the end. Bytes are taken for text as they are."""
    return pa.concat_arrays([words.cast(pa.binary()), pa.array([None], pa.binary())]).view(pa.string())


def word_stripes(texts: DataFrame) -> DataFrame:
    """Stripes of single words; a null next word is the end of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, text in arrow_steps(batches, STEP):
            w = Words(langs, text)
            n = len(w.word)
            own, prefix = np.unique(w.lang * n + w.code, return_inverse=True)
            following = np.where(w.more, np.append(w.code[1:], 0), n)
            places = np.append((w.hash % np.uint64(PLACES)).astype(np.int64), 0)
            found = stripes(prefix, following, n, places)
            yield from batches_of(found, w.lang_name.take(pa.array(own[found[0]] // max(1, n))), w.word.take(pa.array(own[found[0]] % max(1, n))).cast(pa.binary()).view(pa.string()), named(w.word))

    return texts.mapInArrow(run, STRIPE)


def pair_stripes(texts: DataFrame, bitmap) -> DataFrame:
    """Stripes of pairs, where the pair and the one that follows it are both in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        mask = np.uint64(8 * len(bits) - 1)
        for langs, text in arrow_steps(batches, STEP):
            w = Words(langs, text)
            n = len(w.word)
            h = mixed(w.lang_hash[w.lang[:-1]], w.hash[w.code[:-1]], w.hash[w.code[1:]]) & mask
            often = w.more[:-1] & (bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(often[:-1] & often[1:])
            one, head = np.unique(w.lang[at] * n + w.code[at], return_inverse=True)
            own, prefix = np.unique(head * n + w.code[at + 1], return_inverse=True)
            found = stripes(prefix, w.code[at + 2], n, np.append((w.hash % np.uint64(PLACES)).astype(np.int64), 0))
            first, second = one[own[found[0]] // max(1, n)], own[found[0]] % max(1, n)
            parts = [w.word.take(pa.array(x)).cast(pa.binary()) for x in (first % max(1, n), second)]
            yield from batches_of(found, w.lang_name.take(pa.array(first // max(1, n))), pc.binary_join_element_wise(*parts, b" ").view(pa.string()), named(w.word))

    return texts.mapInArrow(run, STRIPE)


def merged(found: DataFrame) -> DataFrame:
    """lang, prefix, place, next and n: stripes of a prefix added element by element. They are shuffled as stripes, once."""
    dealt = found.repartition("lang", "prefix", "place")
    each = dealt.select("lang", "prefix", "place", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    return each.groupBy("lang", "prefix", "place", F.col("e.nexts").alias("next")).agg(F.sum("e.counts").alias("n"))


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """Bytes in which the bit of each pair (lang, prefix, next) is set, a power of two of them, for any number of pairs."""
    n = pairs.count()
    bits = 64
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.fromiter((xxhash.xxh64_intdigest(x) for x in c.cast(pa.binary()).to_pylist()), np.uint64, len(b)) for c in b.columns]
            at = mixed(*h) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(3)).astype(np.int64)), pa.array((1 << (at & np.uint64(7)).astype(np.int64)))], ["byte", "bit"])

    rows = pairs.select("lang", "prefix", "next").mapInArrow(run, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("b")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("b").to_numpy()
    return out


def whole(c: Column) -> Column:
    return c.cast("decimal(15,0)")


def phrases(docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's `top` phrases of two or three words that occur `least` times
    or more and are not taken up by a longer one of at least `covered` hundredths of their count."""
    spark = docs.sparkSession
    texts = spread(docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text")).where("text is not null"))

    # elements of rare extensions, and ends of pieces, are added up in one: the sums of prefixes need no more of them
    ones = merged(word_stripes(texts)).groupBy("lang", "prefix", F.when(F.col("next").isNotNull() & (F.col("n") >= least), F.col("next")).alias("next"), "place").agg(F.sum("n").alias("n"))
    path = fresh_path(spark, "stripes")
    ones.select("lang", "prefix", "next", "n").write.parquet(path)
    ones = spark.read.parquet(path)
    words = ones.groupBy("lang", "prefix").agg(F.sum("n").alias("f"))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    pairs = ones.where("next is not null")
    bitmap = spark.sparkContext.broadcast(pair_bitmap(pairs))
    threes = cut(merged(pair_stripes(texts, bitmap)).where(F.col("n") >= least))

    phrase = F.concat_ws(" ", "prefix", "next")
    parts = cut(words.where(F.col("f") >= least).select("lang", F.col("prefix").alias("part"), "f").union(pairs.select("lang", phrase.alias("part"), F.col("n").alias("f"))))
    found = pairs.select("lang", phrase.alias("phrase"), F.col("n").alias("a"), F.lit(None).cast("string").alias("x"), F.col("prefix").alias("y"), F.col("next").alias("z"))
    split = F.split("prefix", " ")
    found = found.union(threes.select("lang", phrase.alias("phrase"), F.col("n").alias("a"), split[0].alias("x"), split[1].alias("y"), F.col("next").alias("z")))
    cuts = F.when(F.col("x").isNull(), F.array(F.struct(F.lit(1).alias("k"), F.col("y").alias("first"), F.col("z").alias("rest")))).otherwise(
        F.array(F.struct(F.lit(1).alias("k"), F.col("x").alias("first"), F.concat_ws(" ", "y", "z").alias("rest")), F.struct(F.lit(2).alias("k"), F.concat_ws(" ", "x", "y").alias("first"), F.col("z").alias("rest")))
    )
    cuts = found.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    known = cuts
    for side, name in (("first", "l"), ("rest", "r")):
        of = parts.select(F.struct("lang", F.col("part")).alias("key"), F.col("f").alias(name))
        known = join_groups(known.withColumn("key", F.struct("lang", F.col(side).alias("part"))), of, "key", name, BROADCAST_PARTS).drop("key", side)
    known = known.withColumn("top", whole(F.col("a")) * whole(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("bottom", whole(F.col("l")) * whole(F.col("r")))
    scored = known.withColumn("score", F.expr("top div bottom")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))

    inside = threes.select("lang", F.explode(F.array("prefix", F.concat_ws(" ", split[1], "next"))).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = [F.desc("s.score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = kept.withColumn("salt", salt).withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("i") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
     f1 AS MATERIALIZED (SELECT lang, x AS p, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
     f2 AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10),
     f3 AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10),
     n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
     c AS (SELECT c.lang, c.x || ' ' || c.y AS phrase, 2 AS words, c.f AS a, 1 AS k, u.f AS l, v.f AS r FROM f2 c JOIN f1 u ON c.lang = u.lang AND c.x = u.p JOIN f1 v ON c.lang = v.lang AND c.y = v.p
           UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, 3, c.f, 1, u.f, v.f FROM f3 c JOIN f1 u ON c.lang = u.lang AND c.x = u.p JOIN f2 v ON c.lang = v.lang AND c.y = v.x AND c.z = v.y
           UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, 3, c.f, 2, u.f, v.f FROM f3 c JOIN f2 u ON c.lang = u.lang AND c.x = u.x AND c.y = u.y JOIN f1 v ON c.lang = v.lang AND c.z = v.p),
     s AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM c),
     b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s) WHERE i = 1),
     m AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, x || ' ' || y AS phrase, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY ALL),
     t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
           FROM b LEFT JOIN m ON b.lang = m.lang AND b.phrase = m.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT t.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM t JOIN n ON t.lang = n.lang WHERE rank <= 2000
"""
