"""Connected components of an edge table, by rounds of distributed star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the edges (a, b).

    Each round turns the neighbourhood of every node towards its smallest member (large star, then small star), until no
    edge changes; the number of rounds grows with the logarithm of the longest path. Rounds are cut by checkpoints in the
    shared folder, so a lost executor costs one round. Minima are pre-aggregated before they are shuffled, and a hub of
    many edges is the key of plain joins only. An empty table gives no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: neighbours greater than a node hang from the smallest of its neighbours and itself
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours hang from the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = cut(small)
        changed = after.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() != now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if not changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
