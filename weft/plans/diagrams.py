"""Registered queries: diagram projections of the graph over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import layout as L
from weft.plans.graph import EDGES, NODES, edges_of, nodes_of
from weft.plans.registry import query

VIEW = f"{NODES}, {EDGES}, v AS (SELECT node_id, name, entity_type FROM nodes WHERE entity_type IN ('INTERFACE', 'MODULE', 'REPOSITORY') ORDER BY node_id LIMIT 3000), e AS (SELECT * FROM edges WHERE relation_type IN ('CONTAINS', 'DEPENDS_ON') AND confidence >= 0.95 AND from_node_id IN (SELECT node_id FROM v) AND to_node_id IN (SELECT node_id FROM v))"


def view(spark, sf_dir):
    return L.projected(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), "REPOSITORY_MAP", 0.95, 3000, ["MODULE", "INTERFACE", "REPOSITORY"], ["CONTAINS", "DEPENDS_ON"])


@query("diagram_edges", f"WITH {VIEW} SELECT edge_id, from_node_id, to_node_id FROM e")
def edges(spark, sf_dir):
    return view(spark, sf_dir)[1].select("edge_id", "from_node_id", "to_node_id")


@query("diagram_grid", f"WITH {VIEW}, p AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i, ceil(sqrt(count(*) OVER ()))::BIGINT AS c FROM v) SELECT node_id, (i % c * 220)::DOUBLE AS x, (i // c * 140)::DOUBLE AS y FROM p")
def grid(spark, sf_dir):
    return L.grid(view(spark, sf_dir)[0])


@query("diagram_radial", f"WITH {VIEW}, p AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i, count(*) OVER () AS n FROM v) SELECT node_id, round(greatest(180, n * 28.0) * cos(2 * pi() * i / n))::DOUBLE + 0 AS x, round(greatest(180, n * 28.0) * sin(2 * pi() * i / n))::DOUBLE + 0 AS y FROM p")
def radial(spark, sf_dir):
    return L.radial(view(spark, sf_dir)[0])


@query("diagram_dag", f"WITH {NODES}, {EDGES}, v AS (SELECT node_id FROM nodes WHERE entity_type IN ('REPOSITORY', 'MODULE', 'CLASS', 'INTERFACE')), l AS (SELECT node_id, CASE WHEN node_id LIKE 'n:%' THEN 0 ELSE 1 END AS layer FROM v) SELECT node_id, (layer * 260)::DOUBLE AS x, ((row_number() OVER (PARTITION BY layer ORDER BY node_id) - 1) * 140)::DOUBLE AS y FROM l")
def dag(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir).where(F.col("entity_type").isin("REPOSITORY", "MODULE", "CLASS", "INTERFACE"))
    arcs = edges_of(spark, sf_dir).where(F.col("relation_type").isin("CONTAINS", "DEPENDS_ON"))
    return L.dag(nodes, L.closed(arcs, nodes))


@query("diagram_mermaid", f"WITH {NODES}, {EDGES}, v AS (SELECT node_id, name FROM nodes WHERE entity_type IN ('REPOSITORY', 'MODULE')), e AS (SELECT * FROM edges WHERE relation_type = 'DEPENDS_ON'), l AS (SELECT 0 AS part, node_id AS k, '  n' || substring(sha256(node_id), 1, 12) || '[\"' || name || '\"]' AS line FROM v UNION ALL SELECT 1, edge_id || '|' || from_node_id || '|' || to_node_id, '  n' || substring(sha256(from_node_id), 1, 12) || ' -->|' || relation_type || '| n' || substring(sha256(to_node_id), 1, 12) FROM e) SELECT 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, k) AS mermaid FROM l")
def mermaid(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir).where(F.col("entity_type").isin("REPOSITORY", "MODULE"))
    return L.mermaid(nodes, edges_of(spark, sf_dir).where("relation_type = 'DEPENDS_ON'"))
