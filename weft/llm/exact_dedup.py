"""Exact de-duplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Defined results: a null text is an empty text; empty texts are equal to each other; repeated rows and equal ids are
rows of their own (the smallest id stays; of several rows with that id all stay under the same keep_id); a row without an
id stays only where no row of its group has one (its keep_id is null then), and drop_copies, which drops by id, keeps all
rows without one; an empty table gives no rows; other columns are ignored. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, join_groups, text_rows, without

#: A run of white space, unless it is one space already.
SPACE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

#: So many of the largest groups (a hash of 16 bytes, an id, a number) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash, most: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document.

    Hashes and ids are grouped with pre-aggregation, so a group of any size arrives as one row for each task. Bytes are
    compared the same way: of each hash that occurs more than once the least and the greatest text are taken within tasks
    and then over the cluster; where they are equal, so are all between them. Groups with different texts (collisions of
    the hash) are grouped again by the text itself. Rows get their group without a hot key (join_groups).
    """
    rows = text_rows(docs).select("doc_id", normalised(F.col("text")).alias("t"))
    hashes = cut(rows.select("doc_id", hashed(F.col("t")).alias("h"), F.unhex(F.sha2(F.col("t"), 256)).alias("sha")))
    groups = cut(hashes.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    texts = join_groups(rows.select(hashed(F.col("t")).alias("h"), "t"), groups.select("h", "n"), "h", "n", most).where("n is not null")
    mixed = cut(texts.groupBy("h").agg(F.min("t").alias("least"), F.max("t").alias("most")).where("least <> most").select("h"))
    out = join_groups(hashes, groups, "h", "n", most)
    keep, size = F.coalesce("first_id", F.when(F.col("n").isNull(), F.col("doc_id"))), F.coalesce("n", F.lit(1).cast("long"))
    if not mixed.isEmpty():
        collided = rows.select("doc_id", hashed(F.col("t")).alias("h"), "t").join(mixed, "h", "left_semi")
        again = collided.groupBy("h", "t").agg(F.min("doc_id").alias("keep2"), F.count("*").alias("n2")).select("h", F.unhex(F.sha2("t", 256)).alias("sha"), "keep2", "n2")
        out = out.join(cut(again), ["h", "sha"], "left")
        met = F.col("n2").isNotNull()
        keep, size = F.when(met, F.col("keep2")).otherwise(keep), F.coalesce("n2", size)
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Rows with equal ids share their fate."""
    return without(docs, exact_groups(docs).where("not kept"))


ORACLE = r"""
WITH r AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM r
"""
