"""Registered queries: a graph over the star-schema tables, its build, its checks and its traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import graph as G
from weft.operators import validate as V
from weft.plans.registry import query
from weft.sources.tables import table

NODES = """nodes AS (SELECT 'r:' || r_regionkey AS node_id, 'REPOSITORY' AS entity_type, r_name AS name FROM region
UNION ALL SELECT 'n:' || n_nationkey, 'MODULE', n_name FROM nation UNION ALL SELECT 'c:' || c_custkey, 'CLASS', c_name FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'INTERFACE', s_name FROM supplier UNION ALL SELECT 'p:' || p_partkey, 'FUNCTION', p_name FROM part
UNION ALL SELECT 'o:' || o_orderkey, 'FILE', o_orderstatus FROM orders)"""
EDGES = """edges AS (SELECT 'DEPENDS_ON' AS relation_type, 'n:' || n_nationkey AS from_node_id, 'r:' || n_regionkey AS to_node_id, 1.0::DOUBLE AS confidence, 'nr' || n_nationkey AS edge_id FROM nation
UNION ALL SELECT 'CONTAINS', 'n:' || c_nationkey, 'c:' || c_custkey, 1.0, 'nc' || c_custkey FROM customer
UNION ALL SELECT 'CONTAINS', 'n:' || s_nationkey, 's:' || s_suppkey, 1.0, 'ns' || s_suppkey FROM supplier
UNION ALL SELECT 'CONTAINS', 'c:' || o_custkey, 'o:' || o_orderkey, 1.0, 'co' || o_orderkey FROM orders
UNION ALL SELECT 'CALLS', 'o:' || l_orderkey, 'p:' || l_partkey, 1 - l_discount, 'op' || l_orderkey || '.' || l_linenumber FROM lineitem)"""


def nodes_of(spark, sf_dir):
    parts = [("region", "r", "r_regionkey", "REPOSITORY", "r_name"), ("nation", "n", "n_nationkey", "MODULE", "n_name"), ("customer", "c", "c_custkey", "CLASS", "c_name"), ("supplier", "s", "s_suppkey", "INTERFACE", "s_name"), ("part", "p", "p_partkey", "FUNCTION", "p_name"), ("orders", "o", "o_orderkey", "FILE", "o_orderstatus")]
    found = [table(spark, sf_dir, t).select(F.concat(F.lit(k + ":"), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name")) for t, k, key, kind, name in parts]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def edges_of(spark, sf_dir):
    ref = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
    one = F.lit(1.0)

    def part(t, kind, a, b, confidence, *ident):
        return table(spark, sf_dir, t).select(F.lit(kind).alias("relation_type"), a.alias("from_node_id"), b.alias("to_node_id"), confidence.alias("confidence"), F.concat(*ident).alias("edge_id"))

    return (
        part("nation", "DEPENDS_ON", ref("n", "n_nationkey"), ref("r", "n_regionkey"), one, F.lit("nr"), F.col("n_nationkey").cast("string"))
        .unionByName(part("customer", "CONTAINS", ref("n", "c_nationkey"), ref("c", "c_custkey"), one, F.lit("nc"), F.col("c_custkey").cast("string")))
        .unionByName(part("supplier", "CONTAINS", ref("n", "s_nationkey"), ref("s", "s_suppkey"), one, F.lit("ns"), F.col("s_suppkey").cast("string")))
        .unionByName(part("orders", "CONTAINS", ref("c", "o_custkey"), ref("o", "o_orderkey"), one, F.lit("co"), F.col("o_orderkey").cast("string")))
        .unionByName(part("lineitem", "CALLS", ref("o", "l_orderkey"), ref("p", "l_partkey"), 1 - F.col("l_discount"), F.lit("op"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")))
    )


@query("graph_entity_counts", f"WITH {NODES} SELECT entity_type, count(*) AS n FROM nodes GROUP BY entity_type")
def entity_counts(spark, sf_dir):
    return nodes_of(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n")).orderBy("entity_type")


@query("graph_unrooted", f"WITH {NODES} SELECT node_id, entity_type, name FROM nodes WHERE entity_type IN ('CLASS', 'MODULE') ORDER BY node_id LIMIT 500")
def unrooted(spark, sf_dir):
    return nodes_of(spark, sf_dir).where(F.col("entity_type").isin("CLASS", "MODULE")).orderBy("node_id").limit(G.LIMIT)


BFS = f"""WITH RECURSIVE {NODES}, {EDGES}, walk AS (SELECT node_id, 0 AS distance FROM nodes WHERE node_id IN ('n:7', 'n:8')
UNION SELECT e.to_node_id, distance + 1 FROM walk JOIN edges e ON e.from_node_id = walk.node_id WHERE distance < 2),
visited AS (SELECT node_id, min(distance) AS distance FROM walk GROUP BY node_id)"""


@query("graph_bfs", f"{BFS} SELECT * FROM visited ORDER BY distance, node_id LIMIT 500")
def bfs(spark, sf_dir):
    return G.bounded(G.traverse(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), ["n:7", "n:8"], depth=2, most_frontier=None))[0]


@query("graph_bfs_report", f"{BFS} SELECT count(*) AS visited, count(*) > 500 AS truncated FROM visited")
def bfs_report(spark, sf_dir):
    return G.bounded(G.traverse(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), ["n:7", "n:8"], depth=2, most_frontier=None))[1]


@query("graph_bfs_both", f"""WITH {NODES}, {EDGES}, b AS (SELECT from_node_id AS s, to_node_id AS t FROM edges WHERE relation_type <> 'CALLS' UNION ALL SELECT to_node_id, from_node_id FROM edges WHERE relation_type <> 'CALLS'),
h1 AS (SELECT DISTINCT t FROM b WHERE s = 'c:5'), h2 AS (SELECT DISTINCT b.t FROM b JOIN h1 ON b.s = h1.t), a AS (SELECT 'c:5' AS node_id, 0 AS distance UNION ALL SELECT t, 1 FROM h1 UNION ALL SELECT t, 2 FROM h2)
SELECT node_id, min(distance) AS distance FROM a GROUP BY node_id""")
def bfs_both(spark, sf_dir):
    return G.traverse(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), ["c:5"], "BOTH", ["CONTAINS", "DEPENDS_ON"], depth=2, most_frontier=None)


@query("graph_bfs_blocked", f"""WITH {NODES}, {EDGES}, a AS (SELECT 'n:3' AS node_id, 0 AS distance UNION ALL SELECT to_node_id, 1 FROM edges JOIN nodes n ON n.node_id = to_node_id WHERE from_node_id = 'n:3' AND entity_type IN ('MODULE', 'INTERFACE', 'FUNCTION'))
SELECT node_id, min(distance) AS distance FROM a GROUP BY node_id""")
def bfs_blocked(spark, sf_dir):
    return G.traverse(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), ["n:3"], entity_types=["MODULE", "INTERFACE", "FUNCTION"], depth=3, most_frontier=None)


@query("graph_induced_edges", f"{BFS} SELECT edge_id, relation_type, from_node_id, to_node_id FROM edges WHERE from_node_id IN (SELECT node_id FROM visited) AND to_node_id IN (SELECT node_id FROM visited) ORDER BY edge_id")
def induced_edges(spark, sf_dir):
    visited = G.traverse(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), ["n:7", "n:8"], depth=2, most_frontier=None)
    return G.induced(edges_of(spark, sf_dir), visited, most_edges=None).select("edge_id", "relation_type", "from_node_id", "to_node_id").orderBy("edge_id")


@query("graph_call_chain", f"WITH {EDGES}, a AS (SELECT 'o:' || (SELECT min(o_orderkey) FROM orders) AS node_id, 0 AS distance UNION ALL SELECT to_node_id, 1 FROM edges WHERE relation_type = 'CALLS' AND from_node_id = 'o:' || (SELECT min(o_orderkey) FROM orders)) SELECT node_id, min(distance) AS distance FROM a GROUP BY node_id ORDER BY 2, 1 LIMIT 100")
def call_chain(spark, sf_dir):
    root = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return G.call_chain(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), f"o:{root}")


@query("graph_integrity", f"WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM edges WHERE from_node_id NOT IN (SELECT node_id FROM nodes)) AS from_missing, (SELECT count(*) FROM edges WHERE to_node_id NOT IN (SELECT node_id FROM nodes)) AS to_missing, (SELECT count(*) FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(*) > 1)) AS node_id_repeated, (SELECT count(*) FROM (SELECT edge_id FROM edges GROUP BY 1 HAVING count(*) > 1)) AS edge_id_repeated")
def integrity(spark, sf_dir):
    return G.integrity(nodes_of(spark, sf_dir), edges_of(spark, sf_dir))


RELATIONS = "rel AS (SELECT 'l' || l_orderkey || '.' || l_linenumber AS relation_id, 'CALLS' AS kind, 'o:' || l_orderkey AS from_ref, CASE WHEN l_partkey % 50 = 0 THEN 'p:-' || l_partkey ELSE 'p:' || l_partkey END AS to_ref, CASE WHEN l_suppkey % 40 = 0 THEN 1.5 ELSE 1 - l_discount END AS confidence FROM lineitem)"
ID = "'{p}_' || substring(sha256(encode({x}) || '\\x00'::BLOB), 1, 24)"


def relations_of(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("l"), text("l_orderkey"), F.lit("."), text("l_linenumber")).alias("relation_id"),
        F.lit("CALLS").alias("kind"),
        F.concat(F.lit("o:"), text("l_orderkey")).alias("from_ref"),
        F.concat(F.when(F.col("l_partkey") % 50 == 0, "p:-").otherwise("p:"), text("l_partkey")).alias("to_ref"),
        F.when(F.col("l_suppkey") % 40 == 0, 1.5).otherwise(1 - F.col("l_discount")).alias("confidence"),
    )


def artifacts_of(spark, sf_dir):
    return nodes_of(spark, sf_dir).where(F.col("entity_type").isin("FILE", "FUNCTION")).select(F.col("node_id").alias("artifact_id"), F.col("entity_type").alias("kind"), "name")


@query("graph_build_nodes", f"WITH {NODES}, {RELATIONS} SELECT {ID.format(p='node', x='node_id')} AS node_id, entity_type, node_id AS artifact_id, name FROM nodes WHERE entity_type IN ('FILE', 'FUNCTION') UNION ALL SELECT {ID.format(p='issue', x='relation_id')}, 'UNRESOLVED', NULL, to_ref FROM rel WHERE to_ref NOT IN (SELECT node_id FROM nodes)")
def build_nodes(spark, sf_dir):
    return G.revision(artifacts_of(spark, sf_dir), relations_of(spark, sf_dir))[0]


@query("graph_build_edges", f"WITH {NODES}, {RELATIONS} SELECT {ID.format(p='edge', x='relation_id')} AS edge_id, CASE WHEN n.node_id IS NULL THEN 'UNCERTAIN_RELATION' ELSE kind END AS relation_type, {ID.format(p='node', x='from_ref')} AS from_node_id, CASE WHEN n.node_id IS NULL THEN {ID.format(p='issue', x='relation_id')} ELSE {ID.format(p='node', x='to_ref')} END AS to_node_id, round(confidence, 6) AS confidence FROM rel LEFT JOIN nodes n ON n.node_id = to_ref")
def build_edges(spark, sf_dir):
    return G.revision(artifacts_of(spark, sf_dir), relations_of(spark, sf_dir))[1].withColumn("confidence", F.round("confidence", 6))


@query("graph_build_stats", f"WITH {NODES}, {RELATIONS} SELECT (SELECT count(*) FROM nodes WHERE entity_type IN ('FILE', 'FUNCTION')) + count(*) FILTER (to_ref NOT IN (SELECT node_id FROM nodes)) AS nodes, count(*) FILTER (to_ref NOT IN (SELECT node_id FROM nodes)) AS unresolved, 0::BIGINT AS ambiguous, count(*) AS edges FROM rel")
def build_stats(spark, sf_dir):
    return G.stats(*G.revision(artifacts_of(spark, sf_dir), relations_of(spark, sf_dir)))


@query("graph_resolve_symbols", "WITH s AS (SELECT p_brand AS name, 'p:' || p_partkey AS artifact_id FROM part), r AS (SELECT 'x' || c_custkey AS relation_id, CASE WHEN c_custkey % 7 = 0 THEN 'module:m' || c_custkey ELSE 'symbol:Brand#' || (c_custkey % 60) END AS to_ref FROM customer), f AS (SELECT relation_id, list_sort(list(DISTINCT artifact_id)) AS c FROM r JOIN s ON to_ref = 'symbol:' || name GROUP BY relation_id) SELECT relation_id, to_ref, CASE WHEN to_ref LIKE 'module:%' THEN 'EXTERNAL' WHEN len(c) = 1 THEN 'RESOLVED' WHEN len(c) > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status, CASE WHEN len(c) = 1 THEN c[1] END AS target, coalesce(len(c), 0)::INTEGER AS n FROM r LEFT JOIN f USING (relation_id)")
def resolve_symbols(spark, sf_dir):
    symbols = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("artifact_id"))
    key = F.col("c_custkey").cast("string")
    relations = table(spark, sf_dir, "customer").select(F.concat(F.lit("x"), key).alias("relation_id"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("module:m"), key)).otherwise(F.concat(F.lit("symbol:Brand#"), (F.col("c_custkey") % 60).cast("string"))).alias("to_ref"))
    return G.resolve_symbols(relations, symbols).select("relation_id", "to_ref", "status", "target", F.coalesce(F.size("candidates"), F.lit(0)).alias("n"))


CODES = f"{RELATIONS}, codes AS (SELECT relation_id, to_ref, CASE WHEN to_ref LIKE 'p:-%' THEN 'RELATION_REFERENCES_INVALID_ARTIFACT' WHEN confidence > 1 THEN 'INVALID_RELATION_CONFIDENCE' END AS error_code FROM rel)"


def classified(spark, sf_dir):
    invalid = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p:-"), F.col("p_partkey").cast("string")).alias("artifact_id"))
    return V.classify_relations(relations_of(spark, sf_dir), invalid)


@query("quality_error_counts", f"WITH {CODES} SELECT error_code, count(*) AS n FROM codes WHERE error_code IS NOT NULL GROUP BY error_code")
def error_counts(spark, sf_dir):
    return V.error_counts(classified(spark, sf_dir))


@query("quality_error_sample", f"WITH {CODES} SELECT relation_id, error_code FROM codes WHERE error_code IS NOT NULL ORDER BY relation_id LIMIT 20")
def error_sample(spark, sf_dir):
    return V.error_sample(classified(spark, sf_dir), "relation_id").select("relation_id", "error_code")


@query("quality_quarantine", f"WITH {CODES} SELECT relation_id FROM codes WHERE error_code IS NULL")
def quarantine(spark, sf_dir):
    return V.split(classified(spark, sf_dir))[0].select("relation_id")


@query("quality_gate", f"WITH {CODES} SELECT count(*) AS total, count(error_code) AS invalid, round(count(error_code) / count(*), 6) AS ratio, CASE WHEN count(error_code) / count(*) > 0.1 THEN 'FAILED' WHEN count(error_code) > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM codes")
def gate(spark, sf_dir):
    return V.gate(classified(spark, sf_dir), most_ratio=0.1).withColumn("ratio", F.round("ratio", 6))


@query("quality_duplicates", "SELECT l_orderkey, count(*) AS copies, count(DISTINCT l_partkey) AS kinds FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 1")
def duplicates(spark, sf_dir):
    return V.conflicting(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_partkey"))


@query("quality_page_stream", "SELECT count(*) FILTER (o_orderkey <= before) AS out_of_order, count(*) AS n, count(*) = (SELECT count(*) FROM orders) AS complete FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)")
def page_stream(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return V.page_stream(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", rows.count())


@query("quality_key_uniqueness", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_uniqueness(spark, sf_dir):
    return V.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
