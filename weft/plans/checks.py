"""Registered queries: refusals of proposals, of index documents and of snapshots with too many files."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import changes as C
from weft.operators import proposals as P
from weft.operators import retrieval as R
from weft.plans.registry import query
from weft.sources.tables import table


@query(
    "qa_proposal_problems",
    """SELECT o_orderkey::VARCHAR AS proposal_id, CASE WHEN o_orderpriority IS NULL THEN 'summary' WHEN o_orderstatus = 'F' THEN 'changes of the intent' WHEN o_custkey % 11 = 0 THEN 'change: header'
              WHEN bool_or(l_partkey % 97 = 0) THEN 'change: path' WHEN count(*) > count(DISTINCT l_partkey) THEN 'repeated path' WHEN o_custkey % 7 = 0 THEN 'citation of another commit'
              WHEN bool_or(l_partkey % 13 = 0) THEN 'unknown file' WHEN bool_or(l_partkey % 17 = 0) THEN 'stale base hash' END AS reason
       FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus, o_custkey""",
)
def proposal_problems(spark, sf_dir):
    """An order proposes a change of the file of each part in its lines."""
    text = lambda c: F.col(c).cast("string")
    part = F.col("l_partkey")
    path = F.concat(F.when(part % 97 == 0, "src/../..").otherwise("src/./x/.."), F.lit("/p"), text("l_partkey"), F.lit(".py"))
    clean = F.concat(F.lit("src/p"), text("l_partkey"), F.lit(".py"))
    diff = F.concat(F.lit("--- a/"), F.when(F.col("o_custkey") % 11 == 0, F.concat(clean, F.lit("x"))).otherwise(clean), F.lit("\n+++ b/"), clean, F.lit("\n@@ -1 +1 @@\n-a\n+b\n"))
    base = F.concat(F.lit("sha256:"), F.lpad(text("l_partkey"), 12, "0"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct().join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    change = F.struct(path.alias("path"), base.alias("base_content_hash"), diff.alias("unified_diff"))
    # a path that escapes comes after the header in a change's order of checks, so the first change decides by its own
    change = F.struct(F.when(F.col("o_custkey") % 11 == 0, clean).otherwise(path).alias("path"), base.alias("base_content_hash"), diff.alias("unified_diff"))
    grouped = lines.groupBy("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").agg(F.collect_list(change).alias("file_changes"))
    cited = F.struct(F.when(F.col("o_custkey") % 7 == 0, "other").otherwise("c").alias("commit_sha"), F.lit("a.py").alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    rows = grouped.select(
        text("o_orderkey").alias("proposal_id"), F.lit("s").alias("session_id"), F.lit("u").alias("user_id"), F.lit("n").alias("snapshot_id"), F.lit("c").alias("base_commit_sha"),
        F.when(F.col("o_orderstatus") == "F", "EXPLAIN").otherwise("PATCH").alias("intent"), F.col("o_orderpriority").alias("summary"), F.lit("LOW").alias("risk_level"), "file_changes", F.array(cited).alias("citations"),
    )
    key = lambda p: F.lpad(p.cast("string"), 12, "0")
    parts = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().where("l_partkey % 13 <> 0")
    files = parts.select(F.lit("c").alias("base_commit_sha"), clean.alias("path"), F.concat(F.lit("sha256:"), F.when(part % 17 == 0, "changed......").otherwise(key(part))).alias("content_hash"))
    return P.problems(rows, files).select("proposal_id", "reason")


@query(
    "retrieval_index_problems",
    """SELECT 'n' || c_nationkey AS snapshot_id, 'c' || c_custkey % 1000 AS artifact_id, CASE WHEN c_custkey % 31 = 0 THEN 'empty' WHEN n > 1 THEN 'repeated' WHEN c_custkey % 29 = 0 THEN 'source reference' WHEN c_custkey % 23 = 0 THEN 'hash' ELSE 'commit' END AS reason
       FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 1000) AS n, min(CASE WHEN c_custkey % 19 = 0 THEN 'd' ELSE 'c' END) OVER (PARTITION BY c_nationkey) AS f FROM customer)
       WHERE c_custkey % 31 = 0 OR n > 1 OR c_custkey % 29 = 0 OR c_custkey % 23 = 0 OR CASE WHEN c_custkey % 19 = 0 THEN 'd' ELSE 'c' END <> f""",
)
def index_problems(spark, sf_dir):
    k = F.col("c_custkey")
    ref = F.struct(F.when(k % 19 == 0, "d").otherwise("c").alias("commit_sha"), F.lit("a.py").alias("path"), F.when(k % 29 == 0, 0).otherwise(1).alias("start_line"), F.lit(1).alias("end_line"), F.when(k % 23 == 0, "other").otherwise("h").alias("content_hash"))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("snapshot_id"), F.concat(F.lit("c"), (k % 1000).cast("string")).alias("artifact_id"), F.when(k % 31 != 0, F.col("c_name")).alias("name"), F.lit("h").alias("content_hash"), ref.alias("source_ref"))
    return R.index_problems(rows)


@query("changes_overfull", "SELECT l_orderkey AS snapshot_id, count(*) AS files FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6")
def overfull(spark, sf_dir):
    return C.overfull(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id")), "snapshot_id", 6)
