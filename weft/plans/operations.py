"""Registered queries: access and operations over events and orders, wiki tables over the graph, questions over turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import governance as A
from weft.operators import ops as O
from weft.operators import qa as Q
from weft.operators import validate as V
from weft.operators import wiki as W
from weft.plans.graph import EDGES, NODES, edges_of, nodes_of
from weft.plans.registry import query
from weft.sources import tables as S
from weft.sources.tables import table


def events_of(spark, sf_dir):
    return table(spark, sf_dir, "events")


NOW = "TIMESTAMP '2030-01-01 00:00:00'"


@query("access_grants", "WITH g AS (SELECT c_custkey AS client, CASE WHEN c_custkey % 5 = 0 THEN 'REVOKED' ELSE 'ACTIVE' END AS status, CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '1990-01-01' END AS expires, c_custkey % 3 AS r FROM customer) SELECT o_orderkey, CASE WHEN g.client IS NULL THEN 'NO_GRANT' WHEN status <> 'ACTIVE' THEN 'INACTIVE' WHEN expires <= o_orderdate THEN 'EXPIRED' WHEN r <> 0 AND r <> o_orderkey % 3 THEN 'REPOSITORY_DENIED' WHEN o_orderkey % 4 = 0 THEN 'PERMISSION_DENIED' END AS reason FROM orders LEFT JOIN g ON o_custkey = g.client")
def grants(spark, sf_dir):
    k = F.col("c_custkey")
    given = table(spark, sf_dir, "customer").select(k.alias("client_id"), F.when(k % 5 == 0, "REVOKED").otherwise("ACTIVE").alias("status"), F.when(k % 7 == 0, F.lit("1990-01-01").cast("timestamp")).alias("expires_at"), F.when(k % 3 == 0, F.array(F.lit("*"))).otherwise(F.array((k % 3).cast("string"))).alias("repository_scopes"), F.array(F.lit("read")).alias("permission_scopes"))
    o = F.col("o_orderkey")
    calls = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("client_id"), (o % 3).cast("string").alias("repository_id"), F.when(o % 4 == 0, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("read"))).alias("required"), F.col("o_orderdate").alias("at"))
    return A.authorised(calls, given).select("o_orderkey", "reason")


@query("access_rate_limit", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, ts, i, ts AS opened, 1 AS used, true AS allowed FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.ts, e.i, CASE WHEN e.ts >= w.opened + INTERVAL 1 DAY THEN e.ts ELSE w.opened END, CASE WHEN e.ts >= w.opened + INTERVAL 1 DAY THEN 1 WHEN w.used < 2 THEN w.used + 1 ELSE w.used END, e.ts >= w.opened + INTERVAL 1 DAY OR w.used < 2
FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) SELECT event_id, allowed FROM w""")
def rate_limit(spark, sf_dir):
    calls = events_of(spark, sf_dir).select("user_id", "ts", "event_id", F.lit(1).alias("cost"))
    return A.limited(calls, "user_id", "ts", "event_id", "cost", 2, 86400.0).select("event_id", "allowed")


@query("access_invocations", "SELECT event_type AS capability, CASE WHEN event_id % 5 = 0 THEN 'DENIED' WHEN event_id % 7 = 0 THEN 'RATE_LIMITED' WHEN event_id % 11 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, count(*) AS n FROM events GROUP BY ALL")
def invocations(spark, sf_dir):
    e = F.col("event_id")
    code = F.when(e % 5 == 0, "EXPIRED").when(e % 7 == 0, "RATE_LIMITED").when(e % 11 == 0, "TIMEOUT")
    return events_of(spark, sf_dir).select(F.col("event_type").alias("capability"), A.status(code).alias("status")).groupBy("capability", "status").agg(F.count("*").alias("n"))


@query("ops_retry_schedule", "SELECT event_id, least(2.0 * power(2.0, event_id % 9), 300.0)::DOUBLE AS delay_s, event_id % 9 + 1 >= 8 AS dead FROM events")
def retry(spark, sf_dir):
    rows = events_of(spark, sf_dir).select("event_id", (F.col("event_id") % 9 + 1).alias("delivery_count"))
    return O.retry_schedule(rows, 2, 300, 8).select("event_id", "delay_s", "dead")


@query("ops_due", "SELECT event_id FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) ORDER BY ts, event_id LIMIT 100")
def due(spark, sf_dir):
    rows = events_of(spark, sf_dir).select("event_id", F.col("ts").alias("next_attempt_at"))
    now = rows.agg(F.expr("max(next_attempt_at) - INTERVAL 1 DAY")).first()[0]
    return O.due(rows, F.lit(now), 100).select("event_id")


@query("ops_leases", "SELECT CASE WHEN o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01' THEN 'LOST' WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def leases(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(O.lease_status(status, F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("ops_attempts", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INTEGER AS attempt FROM events")
def attempts(spark, sf_dir):
    rows = events_of(spark, sf_dir).withColumn("job", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return O.attempts(rows, "job", ["ts", "event_id"]).select("event_id", "attempt")


@query("ops_superseded", "SELECT o_orderkey, CASE WHEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM orders")
def superseded(spark, sf_dir):
    return O.superseded(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "status")


@query("ops_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 30 = 0) AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0)")
def orphans(spark, sf_dir):
    return O.orphans(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderkey % 30 = 0").select(F.col("o_custkey").alias("c_custkey")), events_of(spark, sf_dir).where("event_id % 2 = 0").select(F.col("user_id").alias("c_custkey")))


@query("ops_claimable", "WITH r AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 = 0), t AS (SELECT o_custkey, count(*) AS n FROM r GROUP BY 1) SELECT o_orderkey AS job_id FROM orders LEFT JOIN t USING (o_custkey) WHERE o_orderstatus = 'O' AND o_orderkey % 10 <> 0 AND coalesce(n, 0) < 2")
def claimable(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("tenant_id"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("DONE").alias("status"))
    return O.claimable(jobs, jobs.where("job_id % 10 = 0").select("job_id", "tenant_id"), 1 << 40, 2).select("job_id")


@query("ops_retention", "SELECT count(*) AS deleted FROM events WHERE event_type IN ('error', 'view') AND ts < (SELECT min(ts) + INTERVAL 5 DAY FROM events)")
def retention(spark, sf_dir):
    rows = events_of(spark, sf_dir).withColumnRenamed("ts", "at")
    cutoff = rows.agg(F.expr("min(at) + INTERVAL 5 DAY")).first()[0]
    return O.retained(rows, F.col("event_type").isin("error", "view"), F.lit(cutoff))[1]


@query("ops_gauges", f"SELECT count(*) FILTER (event_type = 'click') AS click, epoch({NOW})::BIGINT - floor(epoch(min(ts) FILTER (event_type = 'click')))::BIGINT AS click_oldest_s, count(*) FILTER (event_type = 'error') AS error, epoch({NOW})::BIGINT - floor(epoch(min(ts) FILTER (event_type = 'error')))::BIGINT AS error_oldest_s FROM events")
def gauges(spark, sf_dir):
    return O.gauges(events_of(spark, sf_dir), "event_type", "ts", F.lit("2030-01-01").cast("timestamp"), ["click", "error"])


@query("ops_pending", "SELECT event_type, count(*) AS pending FROM events GROUP BY ROLLUP (event_type)")
def pending(spark, sf_dir):
    return O.pending(events_of(spark, sf_dir), "event_type")


@query("ops_histogram", "WITH b AS (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0])::DOUBLE AS le) SELECT event_type, le, count(*) AS n FROM events JOIN b ON value <= le GROUP BY ALL")
def histogram(spark, sf_dir):
    return O.histogram(events_of(spark, sf_dir), ["event_type"], "value", [1.0, 5.0, 10.0, 50.0, 100.0])


@query("ops_progress", "SELECT event_id, floor(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 100 / count(*) OVER (PARTITION BY user_id))::BIGINT AS percent FROM events")
def progress(spark, sf_dir):
    return O.progress(events_of(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("event_id", "percent")


@query("ops_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    return O.tumbling(events_of(spark, sf_dir), "ts", "1 hour", ["event_type"])


@query("ops_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * i AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY ALL")
def sliding(spark, sf_dir):
    return O.sliding(events_of(spark, sf_dir), "ts", "1 hour", "30 minutes")


@query("ops_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def sessions(spark, sf_dir):
    return O.sessions(events_of(spark, sf_dir), "ts", "6 hours", ["user_id"])


@query(
    "ops_transitions",
    """WITH h AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'BUILDING' WHEN 'click' THEN 'SUCCEEDED' WHEN 'purchase' THEN 'CANCELLED' ELSE 'FAILED' END AS status FROM events),
         s AS (SELECT user_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM h)
       SELECT user_id, before, status AS after, count(*) AS n FROM s WHERE before <> status
       AND NOT (before = 'PENDING' AND status IN ('BUILDING', 'CANCELLED', 'FAILED')) AND NOT (before = 'BUILDING' AND status IN ('SUCCEEDED', 'FAILED', 'CANCELLED')) GROUP BY ALL""",
)
def transitions(spark, sf_dir):
    """Events of a user as the statuses of one build job."""
    of = F.col("event_type")
    status = F.when(of == "signup", "PENDING").when(of == "view", "BUILDING").when(of == "click", "SUCCEEDED").when(of == "purchase", "CANCELLED").otherwise("FAILED")
    history = events_of(spark, sf_dir).withColumn("status", status)
    return V.illegal_transitions(history, "user_id", "status", ["ts", "event_id"]).groupBy("user_id", "before", "after").agg(F.count("*").alias("n"))


@query("tables_newest", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def newest(spark, sf_dir):
    return S.newest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("tables_keyset_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 51")
def keyset(spark, sf_dir):
    return S.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100, 50)


@query("tables_insert_new", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def insert_new(spark, sf_dir):
    rows = events_of(spark, sf_dir)
    return S.insert_new(rows.union(rows), rows.where("event_id % 3 = 0"), "event_id").select("event_id")


@query("tables_conflicts", "SELECT event_id FROM events WHERE event_id % 4 = 0")
def conflicts(spark, sf_dir):
    rows = events_of(spark, sf_dir).select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("value").cast("string")).cast("binary"), 256).alias("fingerprint"))
    other = rows.withColumn("fingerprint", F.when(F.col("event_id") % 4 == 0, F.lit("other")).otherwise(F.col("fingerprint")))
    return S.conflicts(other, rows, "event_id").select("event_id")


@query("wiki_edge_rows", f"WITH {NODES}, {EDGES}, e AS (SELECT * FROM edges WHERE relation_type = 'CALLS' ORDER BY edge_id, from_node_id, to_node_id LIMIT 20) SELECT edge_id, relation_type, a.name AS from_name, b.name AS to_name FROM e JOIN nodes a ON a.node_id = from_node_id JOIN nodes b ON b.node_id = to_node_id")
def edge_rows(spark, sf_dir):
    return W.edge_rows(edges_of(spark, sf_dir), nodes_of(spark, sf_dir), ["CALLS"])


@query("wiki_interfaces", f"WITH {NODES} SELECT node_id, name FROM nodes WHERE entity_type IN ('INTERFACE', 'FUNCTION') ORDER BY node_id LIMIT 20")
def interfaces(spark, sf_dir):
    return nodes_of(spark, sf_dir).where(F.col("entity_type").isin("INTERFACE", "FUNCTION")).orderBy("node_id").limit(W.SHOWN).select("node_id", "name")


CITED = "r AS (SELECT 'c' || l_suppkey % 3 AS commit_sha, CASE WHEN l_partkey % 13 = 0 THEN '../x' ELSE 'p' || l_partkey % 50 END AS path, 's' AS symbol_id, l_linenumber AS start_line, l_linenumber + l_suppkey % 3 - 1 AS end_line, 'h' AS content_hash FROM lineitem)"


def refs_of(spark, sf_dir):
    k = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("commit_sha"), F.when(F.col("l_partkey") % 13 == 0, "../x").otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"))).alias("path"), F.lit("s").alias("symbol_id"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_suppkey") % 3 - 1).alias("end_line"), F.lit("h").alias("content_hash"))


@query("wiki_citations", f"WITH {CITED} SELECT DISTINCT * FROM r WHERE path <> '../x' AND end_line >= start_line ORDER BY path, start_line, end_line, symbol_id, commit_sha LIMIT 20")
def citations(spark, sf_dir):
    return W.citations(refs_of(spark, sf_dir))


@query("wiki_majority_commit", f"WITH {CITED} SELECT commit_sha, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, commit_sha LIMIT 1")
def majority(spark, sf_dir):
    return W.majority_commit(refs_of(spark, sf_dir))


@query("wiki_pages", "SELECT conv_id AS page_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS content_md, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS content_hash FROM conversations GROUP BY conv_id")
def pages(spark, sf_dir):
    return W.assemble(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("position"), "text"))


@query("wiki_revisions", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS revision_no, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NOT NULL AS superseded FROM orders")
def revisions(spark, sf_dir):
    return W.revision_numbers(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "revision_no", "superseded")


INTENT = "CASE WHEN contains(q, '调用链') OR contains(q, '调用关系') OR contains(q, 'call chain') OR contains(q, 'calls') OR contains(q, '调用路径') THEN 'CALL_CHAIN' WHEN contains(q, '影响') OR contains(q, '改动') OR contains(q, '变更') OR contains(q, 'impact') OR contains(q, 'affected') THEN 'IMPACT_ANALYSIS' WHEN contains(q, '故障') OR contains(q, '报错') OR contains(q, '失败') OR contains(q, '排查') OR contains(q, 'bug') OR contains(q, 'error') OR contains(q, 'fail') OR contains(q, 'debug') THEN 'TROUBLESHOOTING' WHEN contains(q, '架构') OR contains(q, '模块') OR contains(q, '设计') OR contains(q, 'architecture') OR contains(q, 'module') OR contains(q, 'design') THEN 'ARCHITECTURE' ELSE 'GENERAL' END"


@query("qa_intent", f"SELECT conv_id, turn, {INTENT} AS intent, CASE {INTENT} WHEN 'CALL_CHAIN' THEN 4 WHEN 'IMPACT_ANALYSIS' THEN 3 WHEN 'GENERAL' THEN 1 ELSE 2 END AS depth FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user')")
def intent(spark, sf_dir):
    i = Q.intent(F.col("text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", i.alias("intent"), Q.depth(i).alias("depth"))


@query("qa_pinning", "SELECT user_id AS conversation_id, count(DISTINCT event_type) AS snapshots FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def pinning(spark, sf_dir):
    return Q.unpinned(events_of(spark, sf_dir).select(F.col("user_id").alias("conversation_id"), F.col("event_type").alias("snapshot_id")))


@query("qa_evidence", f"WITH {CITED}, v AS (SELECT *, path <> '../x' AND end_line >= start_line AS ok FROM r) SELECT count(*) FILTER (NOT ok) AS invalid, count(*) FILTER (ok AND commit_sha <> 'c1') AS other_commit FROM v")
def evidence(spark, sf_dir):
    return Q.evidence(refs_of(spark, sf_dir), "c1")[1]
