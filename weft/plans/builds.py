"""Registered queries: a whole build over the star-schema tables, and the event of its publication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.operators import build as B
from weft.operators import graph as G
from weft.operators import ops as O
from weft.plans.registry import query
from weft.sources.tables import table

RELATIONS = """l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS t, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
r AS (SELECT *, CASE WHEN t % 50 = 3 THEN 'EXTERNAL' WHEN t % 7 = 0 THEN 'AMBIGUOUS' WHEN t % 11 = 0 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status FROM l),
c AS (SELECT *, CASE WHEN status IN ('RESOLVED', 'AMBIGUOUS') AND t % 500 = 0 THEN 'RELATION_REFERENCES_INVALID_ARTIFACT' WHEN s % 40 = 0 THEN 'INVALID_RELATION_CONFIDENCE' END AS code FROM r),
e AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM part WHERE p_partkey % 500 = 0) AS x,
             count(*) AS n, count(code) AS bad, count(*) FILTER (code IS NULL AND status = 'UNRESOLVED') AS u, count(*) FILTER (code IS NULL AND status = 'AMBIGUOUS') AS m,
             count(*) FILTER (code IS NULL AND status = 'EXTERNAL') AS f, count(*) FILTER (code LIKE 'REL%') AS isolated, count(*) FILTER (code LIKE 'INV%') AS unsure FROM c)"""


def inputs(spark, sf_dir):
    """Orders are files and parts functions, some without a name; lines are calls of four statuses, some too sure."""
    text = lambda c: F.col(c).cast("string")
    ref = lambda path, symbol: F.struct(F.lit("c").alias("commit_sha"), path.alias("path"), symbol.alias("symbol_id"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    row = lambda t, key, letter, kind, name: table(spark, sf_dir, t).select(F.concat(F.lit(letter), text(key)).alias("artifact_id"), F.lit(kind).alias("kind"), name.alias("name"), ref(F.concat(F.lit("src/"), text(key)), F.concat(F.lit(letter), text(key))).alias("source_ref"), F.create_map(F.lit("table"), F.lit(t)).alias("attributes"))
    artifacts = row("orders", "o_orderkey", "o:", "FILE", F.col("o_orderpriority")).union(row("part", "p_partkey", "p:", "FUNCTION", F.when(F.col("p_partkey") % 500 != 0, F.col("p_name"))))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("t"), F.min("l_suppkey").alias("s"))
    status = F.when(F.col("t") % 50 == 3, "EXTERNAL").when(F.col("t") % 7 == 0, "AMBIGUOUS").when(F.col("t") % 11 == 0, "UNRESOLVED").otherwise("RESOLVED")
    source, target = F.concat(F.lit("o:"), text("l_orderkey")), F.concat(F.lit("p:"), text("t"))
    relations = lines.withColumn("status", status).select(
        F.concat_ws(".", F.lit("l"), text("l_orderkey"), text("l_linenumber")).alias("relation_id"),
        F.lit("CALLS").alias("kind"),
        source.alias("from_ref"),
        F.when(F.col("status") == "RESOLVED", target).alias("to_ref"),
        "status",
        F.when(F.col("status") == "EXTERNAL", F.concat(F.lit("module:"), text("t"))).alias("external_identity"),
        F.when(F.col("status") == "AMBIGUOUS", F.array(source, target)).alias("candidates"),
        F.when(F.col("s") % 40 == 0, 1.5).otherwise(0.5).alias("confidence"),
        ref(F.lit("src/x"), F.lit(None).cast("string")).alias("evidence"),
    )
    return artifacts, relations


def built(spark, sf_dir):
    artifacts, relations = inputs(spark, sf_dir)
    root = f"{G.shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    job = B.Job("t", "r", "s", "rev1", "c", artifacts.count(), relations.count(), trace_id="trace")
    free = B.Limits(artifacts=2**40, relations=2**40, revision_bytes=2**60, invalid_artifacts=2**40, invalid_artifact_ratio=0.1, invalid_relations=2**40, invalid_relation_ratio=0.1)
    return B.entries(spark, [B.build(artifacts, relations, root, job, free)])


@query(
    "graph_build_flow",
    f"""WITH {RELATIONS} SELECT 'rev1' AS revision_id, CASE WHEN x + bad > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS quality_status, o + p - x AS nodes, n - bad AS edges, u AS unresolved_targets, m AS ambiguous_relations,
        o + p AS input_artifacts, x AS invalid_artifacts, n AS input_relations, n - bad AS written_relations, bad AS invalid_relations, nullif(f, 0) AS external, nullif(isolated, 0) AS isolated, nullif(unsure, 0) AS unsure, least(20, x + bad) AS samples FROM e""",
)
def flow(spark, sf_dir):
    codes, states = F.col("error_counts"), F.col("resolution_counts")
    return built(spark, sf_dir).select(
        "revision_id", "quality_status", "nodes", "edges", "unresolved_targets", "ambiguous_relations", "input_artifacts", "invalid_artifacts", "input_relations", "written_relations", "invalid_relations",
        F.try_element_at(states, F.lit("EXTERNAL")).alias("external"), F.try_element_at(codes, F.lit("RELATION_REFERENCES_INVALID_ARTIFACT")).alias("isolated"), F.try_element_at(codes, F.lit("INVALID_RELATION_CONFIDENCE")).alias("unsure"), F.size("error_samples").cast("long").alias("samples"),
    )


@query("graph_build_event", f"WITH {RELATIONS} SELECT 'graph.published.v1:rev1' AS event_id, 'rev1' AS aggregate_id, NULL::VARCHAR AS reason, (o + p - x)::VARCHAR AS nodes, (n - bad)::VARCHAR AS edges, m::VARCHAR AS ambiguous FROM e")
def event(spark, sf_dir):
    told = O.schema_problems(B.published(built(spark, sf_dir)))
    get = lambda c: F.get_json_object("payload", f"$.{c}")
    return told.select("event_id", "aggregate_id", "reason", get("nodes").alias("nodes"), get("edges").alias("edges"), get("ambiguous_relations").alias("ambiguous"))
