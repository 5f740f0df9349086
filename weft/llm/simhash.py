"""SimHash near-duplicates by multi-index hashing: Hamming balls within fingerprint segments, verified distances.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints that differ in at most three bits differ in at
most one bit of some segment, so each fingerprint looks up the 33 values in the ball of radius one around each of its
segments. Fetched fingerprints are compared in full, and linked documents form components.

Defined results: a null text is an empty text; a text of fewer words than a shingle has one shingle, all its words; one
of no words has fingerprint zero, linked like any other. Repeated rows and equal ids are rows of their own; rows without an
id are linked like others but name no component (one of such rows only has a null component_id, and drop_near_copies, which
drops by id, keeps them); an empty table gives no rows; other columns, whatever their names, are ignored. A bit is set if more than half of the hashes have it; ties give zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import components
from weft.llm.common import cut, join_groups, spread, steps, text_rows, without

#: Members of one look-up value that are compared at a time. A value with more is cut into blocks of about this many,
#: and every two blocks are compared, so no limit drops a candidate.
UNIT = 500
#: So many of the largest look-up values, and of the most frequent fingerprints, are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text."""
    found = text.encode().lower().split()  # bytes: A-Z only are lowered, and only ASCII white space splits
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(whole[a:b], seed) for a, b in zip(begins.tolist(), ends[k - 1 :].tolist())], ">u8", len(found) - k + 1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and its fingerprint fp (a long of the same 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            found = np.array([fingerprint(x, words, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], ["doc_id", "fp"])

    return spread(text_rows(docs)).mapInArrow(run, "doc_id long, fp long")


def look_ups(fps: DataFrame) -> DataFrame:
    """fp, exact and key: the two segments of each fingerprint (33 bits with the segment's number), and the values one bit away."""
    second = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))
    rows = fps.select("fp", F.explode(F.array(F.shiftrightunsigned("fp", 32), second)).alias("own"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    return rows.select("fp", "own", F.explode(flips).alias("flip")).select("fp", (F.col("flip") == 0).alias("exact"), F.col("own").bitwiseXOR(F.col("flip")).alias("key"))


def forest(fp: np.ndarray, exact: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join whatever is linked among a unit's members; of two members one at least has the value itself."""
    n = len(fp)
    root = np.arange(n)
    for i in np.flatnonzero(exact):  # only whole rows of distances: n at a time
        near = np.bitwise_count(fp ^ fp[i]) <= radius
        low = (met := root[near]).min()
        if (met != low).any():
            to = np.arange(n)
            to[met] = low
            root = to[root]
    other = np.flatnonzero(root != np.arange(n))
    return list(zip(fp[other].tolist(), fp[root[other]].tolist()))


def linked(radius: int):
    """Edges of every unit, from rows sorted by unit; small units of one size are compared side by side."""

    def of(units: pd.DataFrame) -> pd.DataFrame:
        change = np.ones(len(units), bool)
        names = units[["key", "one", "two"]].to_numpy()
        change[1:] = (names[1:] != names[:-1]).any(1)
        begin = np.flatnonzero(change)
        size = np.diff(np.append(begin, len(units)))
        fp, exact = units["fp"].to_numpy().view(np.uint64), units["exact"].to_numpy()
        a, b = [], []
        for n in np.unique(size[(size > 1) & (size <= 32)]).tolist():
            at = begin[size == n][:, None] + np.arange(n)
            f, e = fp[at], exact[at]
            for i in range(n):
                for j in range(i + 1, n):
                    on = (e[:, i] | e[:, j]) & (np.bitwise_count(f[:, i] ^ f[:, j]) <= radius)
                    a.append(f[on, i])
                    b.append(f[on, j])
        for at, n in zip(begin[size > 32].tolist(), size[size > 32].tolist()):
            if edges := forest(fp[at : at + n], exact[at : at + n], radius):
                x, y = np.array(edges, np.uint64).T
                a.append(x)
                b.append(y)
        if not a:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in batches:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            last = part.iloc[-1] if len(part) else None
            if last is None:
                continue
            same = (part["key"] == last["key"]) & (part["one"] == last["one"]) & (part["two"] == last["two"])
            rest = part[same]
            yield of(part[~same])
        if rest is not None and len(rest):
            yield of(rest)

    return run


def links(fps: DataFrame, radius: int = 3, unit: int = UNIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join exactly what a chain of links joins.

    Of the look-ups only those are kept whose value some fingerprint has itself and that have company there. A value with
    many members is cut into blocks by a hash, and each pair of blocks is a unit of its own; a unit emits a forest of
    links, never all pairs. So memory for a unit is bounded, and no row is dropped.
    """
    if radius > 3:
        raise ValueError("two segments with balls of radius one cover at most three bits")
    probes = look_ups(fps)
    crowd = probes.groupBy("key").agg(F.count("*").alias("n"), F.max("exact").alias("held")).where("held and n > 1")
    members = join_groups(probes, cut(crowd.select("key", "n")), "key", "n", BROADCAST_GROUPS).where("n is not null").withColumn("blocks", F.ceil(F.col("n") / unit))
    block = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("long")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("one"), F.greatest("block", x).alias("two")))
    units = members.withColumn("block", block).select("key", "fp", "exact", F.explode(pairs).alias("p")).select("key", "p.one", "p.two", "fp", "exact")
    names = ["key", "one", "two"]
    return units.repartition(*names).sortWithinPartitions(*names).mapInPandas(linked(radius), "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach."""
    each = cut(fingerprints(docs, words))
    firsts = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    classes = components.connected(links(firsts.select("fp"), radius))
    least = firsts.join(classes, firsts["fp"] == classes["node"]).groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = classes.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    of = cut(firsts.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id")))
    return join_groups(each, of, "fp", "n", BROADCAST_GROUPS).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component stays, that with the smallest id, with all its columns."""
    return without(docs, near_groups(docs).where("doc_id <> component_id"))
