"""Registered queries: facts by status, strict builds, event schemas, payloads, retries, answers and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import paths as P
from weft.functions.text import fingerprint, stable_id
from weft.operators import graph as G
from weft.operators import layout as L
from weft.operators import ops as O
from weft.operators import qa as Q
from weft.operators import retrieval as R
from weft.operators import validate as V
from weft.operators import wiki as W
from weft.plans.graph import EDGES, ID, NODES, artifacts_of, edges_of, nodes_of, relations_of
from weft.plans.registry import query
from weft.sources import tables as S
from weft.sources.tables import table

STATUS = "s AS (SELECT p_brand AS name, 'p:' || p_partkey AS artifact_id FROM part), r AS (SELECT 'x' || c_custkey AS relation_id, 'c:' || c_custkey AS from_ref, CASE WHEN c_custkey % 7 = 0 THEN 'module:m' || (c_custkey % 5) ELSE 'symbol:Brand#' || (c_custkey % 60) END AS to_ref FROM customer), f AS (SELECT relation_id, list_sort(list(DISTINCT artifact_id)) AS c FROM r JOIN s ON to_ref = 'symbol:' || name GROUP BY relation_id), t AS (SELECT r.*, c, CASE WHEN to_ref LIKE 'module:%' THEN 'EXTERNAL' WHEN len(c) = 1 THEN 'RESOLVED' WHEN len(c) > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status FROM r LEFT JOIN f USING (relation_id))"


def symbols_of(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("artifact_id"))


def status_of(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    to = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("module:m"), (F.col("c_custkey") % 5).cast("string"))).otherwise(F.concat(F.lit("symbol:Brand#"), (F.col("c_custkey") % 60).cast("string")))
    relations = table(spark, sf_dir, "customer").select(F.concat(F.lit("x"), key).alias("relation_id"), F.lit("CALLS").alias("kind"), F.concat(F.lit("c:"), key).alias("from_ref"), to.alias("to_ref"), F.lit(1.0).alias("confidence"))
    return G.resolve_symbols(relations, symbols_of(spark, sf_dir))


def two(prefix, a, b):
    return f"'{prefix}_' || substring(sha256(encode({a}) || '\\x00'::BLOB || encode({b}) || '\\x00'::BLOB), 1, 24)"


@query("graph_facts", f"WITH {STATUS} SELECT {ID.format(p='edge', x='relation_id')} AS edge_id, CASE WHEN status IN ('RESOLVED', 'EXTERNAL') THEN 'CALLS' ELSE 'UNCERTAIN_RELATION' END AS relation_type, {ID.format(p='node', x='from_ref')} AS from_node_id, CASE status WHEN 'RESOLVED' THEN {ID.format(p='node', x='c[1]')} WHEN 'EXTERNAL' THEN {ID.format(p='external', x='to_ref')} ELSE {ID.format(p='issue', x='relation_id')} END AS to_node_id FROM t UNION ALL SELECT {two('edge', 'relation_id', 'x')}, 'POSSIBLE_TARGET', {ID.format(p='issue', x='relation_id')}, {ID.format(p='node', x='x')} FROM (SELECT relation_id, unnest(c) AS x FROM t WHERE status = 'AMBIGUOUS')")
def facts(spark, sf_dir):
    return G.facts(status_of(spark, sf_dir), symbols_of(spark, sf_dir)).drop("confidence")


@query("graph_external_nodes", f"WITH {STATUS} SELECT DISTINCT {ID.format(p='external', x='to_ref')} AS node_id, to_ref AS external_identity FROM t WHERE status = 'EXTERNAL'")
def external(spark, sf_dir):
    return G.external_nodes(status_of(spark, sf_dir))


@query("graph_diagnostics", f"WITH {STATUS} SELECT {ID.format(p='issue', x='relation_id')} AS issue_id, from_ref AS source, to_ref AS reference, coalesce(len(c), 0)::INTEGER AS n FROM t WHERE status IN ('AMBIGUOUS', 'UNRESOLVED') AND from_ref IN ('c:1', 'c:2', 'c:3', 'c:4', 'c:5') ORDER BY issue_id LIMIT 101")
def diagnostics(spark, sf_dir):
    rows, roots = status_of(spark, sf_dir), [f"c:{i}" for i in range(1, 6)]
    issues = rows.where(F.col("status").isin("AMBIGUOUS", "UNRESOLVED") & F.col("from_ref").isin(roots)).withColumn("issue_id", stable_id("issue", F.col("relation_id")))
    nodes = issues.select(F.col("issue_id").alias("node_id"), F.lit(G.ISSUE).alias("entity_type"), F.col("to_ref").alias("name"))
    edges = issues.select(F.col("from_ref").alias("from_node_id"), F.col("issue_id").alias("to_node_id"))
    named = issues.select("issue_id", F.explode("candidates").alias("candidate"))
    found = G.diagnostics(edges, nodes, roots, named)
    return found.select("issue_id", "source", "reference", F.coalesce(F.size("candidates"), F.lit(0)).alias("n"))


@query("graph_symbol", f"WITH {NODES} SELECT node_id, entity_type, name FROM nodes WHERE node_id = 'p:7'")
def symbol(spark, sf_dir):
    return G.symbol(nodes_of(spark, sf_dir).withColumn("artifact_id", F.col("node_id")), "p:7").select("node_id", "entity_type", "name")


@query("graph_strict_build", "WITH l AS (SELECT 'l' || l_orderkey || '.' || l_linenumber AS id, CASE WHEN l_suppkey % 40 = 0 THEN 1.5 ELSE 1 - l_discount END AS c FROM lineitem) SELECT 0::BIGINT AS repeated_artifact_id, (SELECT count(*) FROM (SELECT id FROM l GROUP BY id HAVING count(*) > 1)) AS repeated_relation_id, (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0) AS other_commit, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS missing_source, (SELECT count(*) FROM l WHERE c > 1) AS bad_confidence")
def strict(spark, sf_dir):
    artifacts = artifacts_of(spark, sf_dir).withColumn("commit_sha", F.when((F.col("kind") == "FILE") & F.col("artifact_id").rlike("00$|:0$"), "other").otherwise("c"))
    return G.strict_problems(artifacts, relations_of(spark, sf_dir), "c")


@query("graph_node_rows", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x' || event_id END AS external_identity FROM events")
def node_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type")).alias("attributes_json"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("external_identity"))
    return G.node_rows(rows).select("event_id", F.col("properties")["external_identity"].alias("external_identity"))


@query(
    "graph_published_events",
    f"""WITH {NODES} SELECT 'graph.published.v1:' || entity_type AS event_id, 'graph.published.v1' AS event_type, entity_type AS aggregate_id,
        '{{"tenant_id":"t","repository_id":"r","snapshot_id":"s","commit_sha":"c","revision_id":"' || entity_type || '","event_id":"' || entity_type
        || '","parser_result_version":"1","graph_schema_version":"1","algorithm_version":"1","build_policy_version":"1","quality_status":"HEALTHY","nodes":' || count(*)
        || ',"edges":0,"unresolved_targets":0,"ambiguous_relations":0,"input_artifacts":' || count(*) || ',"written_artifacts":' || count(*)
        || ',"invalid_artifacts":0,"input_relations":0,"written_relations":0,"invalid_relations":0,"resolution_counts":{{}},"error_counts":{{}},"error_samples":[],"trace_id":"t"}}' AS payload,
        NULL::VARCHAR AS reason FROM nodes GROUP BY entity_type""",
)
def published(spark, sf_dir):
    rows = nodes_of(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"))
    n, zero, of = F.col("n"), F.lit(0), F.col("entity_type")
    ids = {"tenant_id": F.lit("t"), "repository_id": F.lit("r"), "snapshot_id": F.lit("s"), "commit_sha": F.lit("c"), "revision_id": of, "event_id": of}
    versions = {c: F.lit("1") for c in ("parser_result_version", "graph_schema_version", "algorithm_version", "build_policy_version")}
    counts = {"nodes": n, "edges": zero, "unresolved_targets": zero, "ambiguous_relations": zero, "input_artifacts": n, "written_artifacts": n, "invalid_artifacts": zero, "input_relations": zero, "written_relations": zero, "invalid_relations": zero}
    none = F.create_map().cast("map<string,int>")
    samples = F.array().cast("array<struct<record_type: string, record_id: string, error_code: string>>")
    events = O.payloads(rows, "graph.published.v1", of, **ids, **versions, quality_status=F.lit("HEALTHY"), **counts, resolution_counts=none, error_counts=none, error_samples=samples, trace_id=F.lit("t"))
    return O.schema_problems(events)


@query("diagram_source_links", f"WITH {NODES} SELECT node_id, 'c' AS commit_sha, entity_type || '/' || name AS path FROM nodes WHERE entity_type IN ('MODULE', 'REPOSITORY')")
def source_links(spark, sf_dir):
    rows = nodes_of(spark, sf_dir).where(F.col("entity_type").isin("MODULE", "REPOSITORY"))
    return rows.select("node_id", F.lit("c").alias("commit_sha"), F.concat_ws("/", "entity_type", "name").alias("path"))


@query("diagram_pruned", f"WITH {NODES}, {EDGES} SELECT node_id FROM nodes WHERE node_id = 'n:7' OR node_id IN (SELECT to_node_id FROM edges WHERE from_node_id = 'n:7' AND relation_type IN ('CONTAINS', 'DEPENDS_ON')) AND entity_type IN ('MODULE', 'INTERFACE', 'REPOSITORY')")
def pruned(spark, sf_dir):
    view = L.projected(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), "REPOSITORY_MAP", 0, None, ["MODULE", "INTERFACE", "REPOSITORY"], ["CONTAINS", "DEPENDS_ON"])
    return L.pruned(*view, ["n:7"], 2, most_frontier=None)[0].select("node_id")


KIND = "CASE event_id % 4 WHEN 0 THEN 'index.ready.v1' WHEN 1 THEN 'wiki.published.v1' WHEN 2 THEN 'parse.failed.v1' ELSE 'no.such.v1' END"


@query("ops_event_schemas", f"SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'unknown type' WHEN event_id % 4 = 1 THEN 'unknown field' WHEN event_id % 4 = 2 THEN 'unknown field' WHEN event_id % 3 = 0 THEN 'bad revision_id' WHEN event_id % 5 = 0 THEN 'bad documents' WHEN event_id % 7 = 0 THEN 'missing algorithm_version' END AS reason FROM events")
def schemas(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "index.ready.v1").when(e % 4 == 1, "wiki.published.v1").when(e % 4 == 2, "parse.failed.v1").otherwise("no.such.v1")
    revision, version = F.when(e % 3 == 0, "").otherwise("i"), F.when(e % 7 != 0, "1")
    payload = F.to_json(F.struct(revision.alias("revision_id"), F.lit("s").alias("snapshot_id"), F.lit("").alias("commit_sha"), F.when(e % 5 == 0, -1).otherwise(1).alias("documents"), F.lit(0).alias("vectors"), version.alias("algorithm_version")))
    return O.schema_problems(table(spark, sf_dir, "events").select("event_id", kind.alias("event_type"), payload.alias("payload"))).select("event_id", "reason")


@query("ops_retried", "SELECT o_orderkey, (o_orderkey % 4 + 1)::INTEGER AS retry_count FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 4 < 3")
def retried(spark, sf_dir):
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("DONE").alias("status"), (k % 2 == 0).alias("retryable"), (k % 4).cast("int").alias("retry_count"))
    return O.retried(jobs, 3).select("o_orderkey", "retry_count")


@query("ops_baseline_conflicts", "WITH l AS (SELECT o_custkey, max(o_orderkey) AS latest FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN l USING (o_custkey) WHERE o_orderkey - 1 <> latest")
def baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    latest = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("snapshot_id"))
    return O.baseline_conflicts(rows.withColumn("parent_snapshot_id", F.col("o_orderkey") - 1), latest, ["o_custkey"]).select("o_orderkey")


@query("ops_result_state", "SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'error_code' WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'progress' WHEN o_orderkey % 7 = 0 AND o_orderstatus = 'P' THEN 'status' END AS problem, count(*) AS n FROM orders GROUP BY 1")
def result_state(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    job = F.when(s == "F", "FAILED").when(s == "O", "SUCCEEDED").otherwise("RUNNING")
    rows = table(spark, sf_dir, "orders").select(job.alias("job_status"), F.when((s == "P") & (k % 7 == 0), "FAILED").otherwise(job).alias("snapshot_status"), F.when((s == "O") & (k % 5 == 0), 90).otherwise(100).alias("progress"), F.when(k % 3 == 0, "").otherwise("E").alias("error_code"))
    return rows.groupBy(O.result_problem().alias("problem")).agg(F.count("*").alias("n"))


@query("tables_active_revision", "SELECT o_custkey, count(*) FILTER (o_orderkey = m) AS n, true AS valid FROM orders JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) USING (o_custkey) GROUP BY o_custkey")
def active(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("revision_id"))
    return S.active(rows, rows.groupBy("o_custkey").agg(F.max("revision_id").alias("revision_id")), ["o_custkey"]).drop("revision_id")


@query("tables_jobs_with_snapshots", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def jobs(spark, sf_dir):
    snapshots = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(snapshots, "o_custkey").select("o_orderkey", "c_name")


@query("tables_fingerprints", "SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}') AS fingerprint FROM customer")
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fingerprint("c_custkey", "c_mktsegment").alias("fingerprint"))


@query("wiki_languages_and_paths", "SELECT (SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') FROM documents) AS languages, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT source AS p FROM documents ORDER BY p LIMIT 20)) AS paths")
def languages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.col("source").alias("path"))
    return W.languages_and_paths(rows).select(F.array_join("languages", ",").alias("languages"), F.array_join("paths", ",").alias("paths"))


@query("wiki_totals", "SELECT conv_id, count(*) AS citations, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY conv_id")
def totals(spark, sf_dir):
    return W.totals(table(spark, sf_dir, "conversations").withColumn("cited", F.array("role")), "conv_id", "cited", "text")


@query("wiki_page_problems", "SELECT 'src' || i AS slug, 'missing' AS problem FROM (SELECT unnest([97, 98]) AS i) UNION ALL SELECT DISTINCT source, 'unknown' FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT source, 'citations' FROM documents WHERE source = 'src1' GROUP BY 1")
def page_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("slug"), F.when(F.col("source") == "src1", F.array(F.lit(9))).otherwise(F.array(F.lit(1))).alias("citation_indexes"))
    return W.page_problems(rows, ["src1", "src2", "src97", "src98"], 5)


@query("qa_answers", "WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, any_value(n) || ' facts' || chr(10) || string_agg(i || '. order ' || o_orderkey, chr(10) ORDER BY i) AS answer FROM f WHERE i <= 10 GROUP BY o_custkey")
def answers(spark, sf_dir):
    return Q.answer_text(table(spark, sf_dir, "orders"), "o_custkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), ["o_orderkey"])


@query("qa_evidence_budget", "SELECT conv_id, turn, role, left(text, greatest(500 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT) AS text FROM conversations")
def budget(spark, sf_dir):
    return Q.evidence_budget(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "text", 500).select("conv_id", "turn", "role", "text")


@query("qa_expanded", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 3 <> 0")
def expanded(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return Q.expanded(rows, rows.where("conv_id % 3 = 0"), "conv_id").select("conv_id", "turn")


@query("quality_capacity", "SELECT c_custkey, strlen('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}')::INTEGER AS record_bytes FROM customer WHERE strlen('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}') > 46")
def capacity(spark, sf_dir):
    return V.over_capacity(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 46).select("c_custkey", "record_bytes")


@query("quality_revision_mismatches", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'o_orderstatus,o_totalprice' WHEN o_orderkey % 2 = 0 THEN 'o_orderstatus' ELSE 'o_totalprice' END AS different FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def revision_mismatches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    other = rows.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return V.mismatches(rows, other, "o_orderkey", ["o_orderstatus", "o_totalprice"]).select("o_orderkey", F.array_join("different", ",").alias("different"))


@query("quality_artifacts", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'INVALID_ARTIFACT_TYPE' WHEN p_partkey % 8 = 0 THEN 'INVALID_ARTIFACT_DATA' WHEN p_size % 7 = 0 OR p_partkey % 11 = 0 THEN 'INVALID_ARTIFACT_SOURCE_REF' END AS error_code FROM part")
def artifacts(spark, sf_dir):
    k = F.col("p_partkey")
    ref = F.struct(F.lit("c").alias("commit_sha"), F.when(k % 11 == 0, "../x").otherwise(F.col("p_name")).alias("path"), F.lit(1).alias("start_line"), (F.col("p_size") % 7).alias("end_line"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 9 == 0, "THING").otherwise("FILE").alias("kind"), F.when(k % 8 == 0, " ").otherwise(F.col("p_name")).alias("name"), ref.alias("source_ref"))
    return V.classify_artifacts(rows).select("p_partkey", "error_code")


@query("paths_text_kind_and_language", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'DOCUMENT' ELSE 'CONFIG' END AS kind, CASE doc_id % 4 WHEN 1 THEN 'python' WHEN 2 THEN lang END AS language, doc_id % 3 = 0 AS moving FROM documents")
def kinds(spark, sf_dir):
    k = F.col("doc_id")
    path = F.concat(F.lit("a/b"), F.when(k % 4 == 0, ".MD").when(k % 4 == 1, ".py").when(k % 4 == 2, ".go").otherwise(".cfg"))
    properties = F.when(k % 4 == 2, F.create_map(F.lit("language"), F.col("lang")))
    ref = F.when(k % 3 == 0, F.when(k % 2 == 0, "refs/heads/x").otherwise("HEAD")).otherwise("abc123")
    return table(spark, sf_dir, "documents").select("doc_id", P.text_kind(path).alias("kind"), L.language(properties, path).alias("language"), P.moving_ref(ref).alias("moving"))


@query("retrieval_reranked", "SELECT doc_id, n_chars::DOUBLE AS score FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10")
def reranked(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit(1.0).alias("score"), "n_chars")
    return R.reranked(hits, lambda h: h.withColumn("score", F.col("n_chars").cast("double"))).select("doc_id", "score")


@query("qa_question_check", "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 8000 THEN 'too long' WHEN turn % 3 = 0 THEN 'no read permission' END AS problem FROM conversations")
def question_check(spark, sf_dir):
    allowed = F.when(F.col("turn") % 3 == 0, F.array(F.lit("write"))).otherwise(F.array(F.lit("read")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.question_problem(F.col("text"), allowed).alias("problem"))


@query("qa_stale_proposals", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def stale(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path, digest = F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256)
    changes = d.select("doc_id", path, F.when(F.col("doc_id") % 5 == 0, "old").otherwise(digest).alias("base_content_hash"))
    return Q.stale_proposals(changes, d.where("doc_id % 7 <> 0").select(path, digest.alias("content_hash"))).select("doc_id")


@query("wiki_publication_conflicts", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'changed' ELSE 'stale' END AS reason FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def publication(spark, sf_dir):
    k = F.col("o_orderkey")
    stored = table(spark, sf_dir, "orders").select("o_orderkey", k.cast("string").alias("slug"), F.lit("s").alias("snapshot_id"), F.lit("h").alias("content_hash"), F.lit(5).alias("revision_no"))
    new = stored.withColumn("content_hash", F.when(k % 2 == 0, "other").otherwise("h")).withColumn("revision_no", F.when(k % 3 == 0, 5).otherwise(6))
    return W.publication_conflicts(new, stored.drop("o_orderkey")).select("o_orderkey", "reason")
