"""Registered queries: parser sets, file hashes, refusals, display names, answers, versions, scopes and decoded events."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import extract as X
from weft.operators import governance as A
from weft.operators import ops as O
from weft.operators import qa as Q
from weft.operators import retrieval as R
from weft.operators import wiki as W
from weft.plans.registry import query
from weft.sources.tables import table


@query(
    "extract_parser_sets",
    """WITH v AS (SELECT DISTINCT p_brand, p_type || '@' || p_size AS version FROM part)
    SELECT p_brand, 'registry@2:' || left(sha256(string_agg(version, chr(0) ORDER BY version)), 16) AS parser_set FROM v GROUP BY p_brand""",
)
def parser_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.concat("p_type", F.lit("@"), F.col("p_size").cast("string")).alias("version"))
    return X.parser_set_versions(rows, ["p_brand"])


@query(
    "qa_file_hashes",
    """SELECT 'f/' || o_orderkey AS path, md5(o_orderkey::VARCHAR) AS content_hash FROM orders
    WHERE o_orderstatus = 'O' AND o_custkey % 3 = 1 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def file_hashes(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderstatus") == "O", "FILE").otherwise("CLASS")
    commit = F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string"))
    artifacts = table(spark, sf_dir, "orders").select(F.concat(F.lit("f/"), key).alias("path"), kind.alias("kind"), commit.alias("commit_sha"), F.md5(key.cast("binary")).alias("content_hash"))
    cited = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("./f/"), F.col("l_orderkey").cast("string")).alias("path"))
    return Q.file_hashes(artifacts, cited, "c1")


@query(
    "wiki_refused_graphs",
    """SELECT o_custkey AS revision, CASE WHEN n IS NULL THEN 'empty' ELSE 'truncated' END AS reason
    FROM (SELECT DISTINCT o_custkey FROM orders UNION SELECT c_custkey FROM customer) LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = o_custkey
    WHERE n IS NULL OR n > 12""",
)
def refused_graphs(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("revision"))
    revisions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("revision")).union(nodes).distinct()
    return W.refused_graphs(revisions, nodes, "revision", 12)


@query(
    "wiki_display_names",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'q.' || c_custkey WHEN c_custkey % 5 <> 0 THEN c_name ELSE 'c:' || c_custkey END AS display_name FROM customer""",
)
def display_names(spark, sf_dir):
    k = F.col("c_custkey")
    qualified = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit("q."), k.cast("string")))
    shown = W.display_name(qualified, F.when(k % 5 != 0, F.col("c_name")), F.concat(F.lit("c:"), k.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", shown.alias("display_name"))


@query(
    "qa_gated",
    f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{Q.INSUFFICIENT}' ELSE text END AS answer FROM conversations",
)
def gated(spark, sf_dir):
    citations = F.when(F.col("turn") % 2 != 0, F.array("role")).when(F.col("turn") % 4 == 0, F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), citations.alias("citations"))
    return Q.gated(rows).select("conv_id", "turn", "answer")


@query(
    "qa_selected_citations",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority || '|' || o_orderstatus WHEN 3 THEN 'x|' || o_orderstatus END AS selected FROM orders""",
)
def selected(spark, sf_dir):
    at = (F.col("o_orderkey") % 4).cast("int")
    found = Q.selected(F.array("o_orderstatus", "o_orderpriority", F.lit("x")), F.array(at, F.lit(1), at))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, "|").alias("selected"))


@query(
    "qa_version_gaps",
    """WITH h AS (SELECT user_id AS proposal_id, event_id, event_id % 7 AS version, lag(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT * FROM h WHERE before IS NOT NULL AND version <> before + 1""",
)
def version_gaps(spark, sf_dir):
    history = table(spark, sf_dir, "events").select(F.col("user_id").alias("proposal_id"), "event_id", (F.col("event_id") % 7).alias("version"))
    return Q.version_gaps(history, order="event_id")


@query("access_scope", "SELECT event_id FROM events WHERE user_id % 4 = 1 AND event_type = 'click'")
def scope(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).cast("string").alias("tenant_id"), F.col("event_type").alias("repository_id"))
    return A.in_scope(rows, "1", "click").select("event_id")


@query(
    "ops_decoded_events",
    """WITH p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"snapshot_id":"s' || event_id || '"}' WHEN 1 THEN '{"snapshot_id":"s","more":1}' ELSE '{"snapshot_id":' END AS payload FROM events)
    SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'unknown field' WHEN 2 THEN 'invalid json' END AS reason, CASE WHEN event_id % 3 = 0 THEN 's' || event_id END AS snapshot_id, sha256(payload) AS payload_digest FROM p""",
)
def decoded_events(spark, sf_dir):
    k = F.col("event_id")
    payload = F.when(k % 3 == 0, F.concat(F.lit('{"snapshot_id":"s'), k.cast("string"), F.lit('"}'))).when(k % 3 == 1, '{"snapshot_id":"s","more":1}').otherwise('{"snapshot_id":')
    rows = O.decoded_events(table(spark, sf_dir, "events").select("event_id", payload.alias("payload")), "snapshot_id string")
    return rows.select("event_id", "reason", F.when(F.col("reason").isNull(), F.col("p.snapshot_id")).alias("snapshot_id"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"))


@query(
    "retrieval_documents",
    """SELECT 'doc_' || left(sha256(p_partkey || chr(0) || 'c1' || chr(0)), 24) AS document_id, p_partkey::VARCHAR AS artifact_id, 'src/' || p_partkey || '.go' AS path,
    trim(regexp_replace(concat_ws(' ', p_name, p_brand || '.' || p_name, p_type, 'FUNCTION', 'go', 'src/' || p_partkey || '.go', 'brand ' || p_brand || ' size ' || p_size), ' +', ' ', 'g')) AS text FROM part""",
)
def documents(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("src/"), key, F.lit(".go"))
    artifacts = table(spark, sf_dir, "part").select(
        key.alias("artifact_id"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"),
        F.col("p_type").alias("signature"),
        F.lit("FUNCTION").alias("kind"),
        F.lit("go").alias("language"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")).alias("attributes"),
        F.struct(path.alias("path"), F.lit("c1").alias("commit_sha")).alias("source_ref"),
    )
    return R.documents_of(artifacts).select("document_id", "artifact_id", "path", "text")
