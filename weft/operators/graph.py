"""The code graph: building a revision from artifacts and relations, its checks, and bounded traversals."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import stable_id

#: Bounds of a query and of a call chain.
MOST_DEPTH, MOST_NODES, MOST_EDGES, MOST_ROOTS, MOST_FRONTIER = 10, 10_000, 50_000, 128, 10_000
LIMIT, CHAIN_DEPTH, MOST_CHAIN_DEPTH, CHAIN_LIMIT = 500, 2, 6, 100
ISSUE = "UNRESOLVED"
#: Symbols of one name that a task holds at most, about, and units of pairs a core that all pairs are dealt in.
PART, UNITS = 32_768, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a session without a cluster may do without that setting, and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the cluster shares."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def resolved(relations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Relations with status and target: RESOLVED if `to_ref` is an artifact's id, else UNRESOLVED."""
    known = artifacts.select(F.col("artifact_id").alias("target"))
    return relations.join(known, F.col("to_ref") == F.col("target"), "left").withColumn("status", F.when(F.col("target").isNotNull(), "RESOLVED").otherwise(ISSUE))


def missing_sources(relations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Relations whose source is no artifact; a build refuses any."""
    return relations.join(artifacts.select(F.col("artifact_id").alias("from_ref")), "from_ref", "left_anti")


def resolve_symbols(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol references resolved by name: one match RESOLVED, several AMBIGUOUS with sorted candidates, none UNRESOLVED;
    modules and packages are EXTERNAL. symbols: name, artifact_id. Candidates are gathered once a name, before the join."""
    by_name = symbols.groupBy(F.col("name").alias("_name")).agg(F.array_sort(F.collect_set("artifact_id")).alias("candidates"))
    by_name = by_name.select("*", F.size("candidates").alias("_n"), F.get("candidates", F.lit(0)).alias("_first"))  # all that most callers join
    rows = relations.withColumn("_name", symbol_name()).join(by_name, "_name", "left")
    n = F.coalesce("_n", F.lit(0))
    external = F.col("to_ref").rlike("^(module|package):")
    told = rows.withColumn("status", F.when(external, "EXTERNAL").when(n == 1, "RESOLVED").when(n > 1, "AMBIGUOUS").otherwise(ISSUE)).withColumn("target", F.when(n == 1, F.col("_first")))
    return told.drop("_name", "_n", "_first")


def symbol_name() -> Column:
    """The name that a relation's `to_ref` asks for, or null."""
    return F.when(F.col("to_ref").startswith("symbol:"), F.substring_index("to_ref", ":", -1))


def candidates_of(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """relations with a row for each symbol of their name: candidate, and its node. symbols: name, artifact_id.

    The pairs of a name are a grid: its symbols are cut into parts, its relations into blocks, and a part and a block are a unit.
    A name has its share of all units, whose number depends on the cluster and not on the tables; so there is no hot name, and
    what is shuffled grows with the rows and not with their pairs, while a part has about PART symbols at most."""
    units = UNITS * relations.sparkSession.sparkContext.defaultParallelism
    known = symbols.select(F.col("name").alias("_name"), F.col("artifact_id").alias("candidate")).where("_name is not null and candidate is not null").distinct()
    asked = relations.withColumn("_name", symbol_name())
    pairs = known.groupBy("_name").agg(F.count("*").alias("_s")).join(asked.groupBy("_name").agg(F.count("*").alias("_r")), "_name").withColumn("_pairs", F.col("_s").cast("decimal(19,0)") * F.col("_r").cast("decimal(19,0)"))  # exact, so the grid is the same wherever it is made
    share = F.col("_pairs").cast("double") * units / F.col("_all").cast("double")
    parts = F.greatest(F.ceil(F.col("_s") / PART), F.least("_s", F.round(F.sqrt(share * F.col("_s") / F.col("_r"))).cast("long"), F.ceil(share)))
    grid = pairs.crossJoin(F.broadcast(pairs.agg(F.sum("_pairs").alias("_all")))).withColumn("_parts", parts)
    grid = grid.select("_name", "_parts", F.least("_r", F.ceil(share / F.col("_parts"))).alias("_blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    unit = ["_name", "_part", "_block"]
    left = asked.join(grid, "_name").withColumn("_block", own("relation_id", "_blocks")).withColumn("_part", each("_parts")).select(*relations.columns, *unit)
    right = known.withColumn("candidate_node", stable_id("node", F.col("candidate"))).join(grid, "_name").withColumn("_part", own("candidate", "_parts")).withColumn("_block", each("_blocks")).select(*unit, "candidate", "candidate_node")
    return left.repartition(2 * units, *unit).join(right.repartition(2 * units, *unit).hint("merge"), unit).select(*relations.columns, "candidate", "candidate_node")


def revision(artifacts: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a revision. A relation without a known target becomes an issue node and an uncertain edge."""
    nodes = artifacts.select(stable_id("node", F.col("artifact_id")).alias("node_id"), F.col("kind").alias("entity_type"), "artifact_id", "name")
    rows = resolved(relations, artifacts)
    issue = stable_id("issue", F.col("relation_id"))
    issues = rows.where(F.col("status") == ISSUE).select(issue.alias("node_id"), F.lit(ISSUE).alias("entity_type"), F.lit(None).cast("string").alias("artifact_id"), F.col("to_ref").alias("name"))
    edges = rows.select(
        stable_id("edge", F.col("relation_id")).alias("edge_id"),
        F.when(F.col("status") == "RESOLVED", F.col("kind")).otherwise("UNCERTAIN_RELATION").alias("relation_type"),
        stable_id("node", F.col("from_ref")).alias("from_node_id"),
        F.when(F.col("status") == "RESOLVED", stable_id("node", F.col("target"))).otherwise(issue).alias("to_node_id"),
        "confidence",
    )
    return nodes.unionByName(issues), edges


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    a, b = nodes.select(F.col("node_id").alias("from_node_id")), nodes.select(F.col("node_id").alias("to_node_id"))
    return edges.join(a, "from_node_id", "left_semi").join(b, "to_node_id", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame, most_edges: int | None = MOST_EDGES) -> DataFrame:
    """All edges whose two ends are among the nodes; more than most_edges (None: no budget) are refused, never cut off."""
    found = closed(edges, nodes)
    if most_edges is not None:
        found = cut(found)
        if (n := found.limit(most_edges + 1).count()) > most_edges:
            raise ValueError(f"{n} induced edges or more are over the budget of {most_edges}")
    return found


def connected_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without the issues that no edge reaches."""
    ends = edges.select(F.col("to_node_id").alias("node_id"))
    return nodes.where(F.col("entity_type") != ISSUE).unionByName(nodes.where(F.col("entity_type") == ISSUE).join(ends, "node_id", "left_semi"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, unresolved and ambiguous."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("entity_type") == ISSUE).alias("unresolved"), F.count_if(F.col("entity_type") == "AMBIGUOUS").alias("ambiguous"))
    return n.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def steps_of(edges: DataFrame, direction: str, types: list[str] | None) -> DataFrame:
    """Steps a traversal may take, as source and target."""
    if direction not in ("OUTGOING", "INCOMING", "BOTH"):
        raise ValueError(f"unknown direction {direction}")
    if types:
        edges = edges.where(F.col("relation_type").isin(types))
    out = edges.select(F.col("from_node_id").alias("source"), F.col("to_node_id").alias("target"))
    back = edges.select(F.col("to_node_id").alias("source"), F.col("from_node_id").alias("target"))
    return {"OUTGOING": out, "INCOMING": back}.get(direction) or out.union(back)


def traverse(nodes: DataFrame, edges: DataFrame, roots: list[str], direction: str = "OUTGOING", relation_types: list[str] | None = None, entity_types: list[str] | None = None, depth: int = 2, most_frontier: int | None = MOST_FRONTIER) -> DataFrame:
    """node_id and distance of every node within depth: each with its smallest distance; nodes of other types block the way.

    One join of the frontier with the edges a hop; the visited set is written to the shared folder, never collected."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be from 0 to {MOST_DEPTH}")
    if not 0 < len(roots) <= MOST_ROOTS:
        raise ValueError(f"1 to {MOST_ROOTS} roots")
    allowed = nodes.where(F.col("entity_type") != ISSUE)
    if entity_types:
        allowed = allowed.where(F.col("entity_type").isin(entity_types))
    allowed = allowed.select("node_id")
    step = steps_of(edges, direction, relation_types)
    visited = cut(allowed.where(F.col("node_id").isin(list(roots))).select("node_id", F.lit(0).alias("distance")))
    if visited.count() != len(set(roots)):
        raise ValueError("a root is missing or filtered out")
    frontier = visited
    for hop in range(1, depth + 1):
        near = frontier.select(F.col("node_id").alias("source")).join(step, "source").select(F.col("target").alias("node_id")).distinct()
        frontier = cut(near.join(visited, "node_id", "left_anti").join(allowed, "node_id", "left_semi").select("node_id", F.lit(hop).alias("distance")))
        n = frontier.count()
        if not n:
            break
        if most_frontier is not None and n > most_frontier:
            raise ValueError(f"a frontier of {n} nodes is over the budget of {most_frontier}")
        visited = visited.union(frontier)
    return visited


def bounded(visited: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """The nearest nodes up to a limit, and one row that tells how many were visited and whether some are left out."""
    if not 0 <= limit <= MOST_NODES:
        raise ValueError(f"limit must be from 0 to {MOST_NODES}")
    report = visited.agg(F.count("*").alias("visited")).withColumn("truncated", F.col("visited") > limit)
    return visited.orderBy("distance", "node_id").limit(limit), report


def call_chain(nodes: DataFrame, edges: DataFrame, root: str, depth: int = CHAIN_DEPTH, limit: int = CHAIN_LIMIT) -> DataFrame:
    """The traversal along calls."""
    if not 0 < depth <= MOST_CHAIN_DEPTH:
        raise ValueError(f"depth must be from 1 to {MOST_CHAIN_DEPTH}")
    return bounded(traverse(nodes, edges, [root], relation_types=["CALLS"], depth=depth), limit)[0]


def diagnostics(edges: DataFrame, nodes: DataFrame, roots: list[str], candidates: DataFrame, limit: int = CHAIN_LIMIT) -> DataFrame:
    """Issues that begin at a root, with their sorted candidates. candidates: issue_id, candidate."""
    issues = nodes.where(F.col("entity_type") == ISSUE).select(F.col("node_id").alias("issue_id"), F.col("name").alias("reference"))
    rows = edges.where(F.col("from_node_id").isin(list(roots))).select(F.col("from_node_id").alias("source"), F.col("to_node_id").alias("issue_id")).join(issues, "issue_id")
    rows = cut(rows.orderBy("issue_id").limit(limit + 1))  # few, so only their candidates are gathered
    named = candidates.join(F.broadcast(rows.select("issue_id").distinct()), "issue_id", "left_semi").groupBy("issue_id").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))
    return rows.join(named, "issue_id", "left").orderBy("issue_id")


def packed(ident: Column) -> Column:
    """An id in fewer bytes: the letters before 24 hex digits, a NUL byte and the digits' 12 bytes; other ids as they are, after
    a NUL byte. Different ids stay different."""
    short = F.concat(F.regexp_extract(ident, "^[a-z]+", 0).cast("binary"), F.lit(b"\0"), F.unhex(F.substring(ident, -24, 24)))
    return F.when(ident.rlike(r"^[a-z]+_[0-9a-f]{24}\z"), short).when(ident.isNotNull(), F.concat(F.lit(b"\0"), ident.cast("binary")))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges whose source or target is no node, repeated node ids, repeated edge ids."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    end = lambda table, c, **n: table.select(packed(F.col(c)).alias("id"), *(n.get(k, zero).alias(k) for k in ("node", "source", "target")))
    ends = end(nodes, "node_id", node=one).union(end(edges, "from_node_id", source=one)).union(end(edges, "to_node_id", target=one))
    each = ends.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("node", "source", "target")))
    missing = lambda c: F.coalesce(F.sum(F.when(F.col("id").isNull() | (F.col("node") == 0), F.col(c))), zero)
    out = each.agg(missing("source").alias("from_missing"), missing("target").alias("to_missing"), F.count_if(F.col("node") > 1).alias("node_id_repeated"))
    twice = edges.groupBy(packed(F.col("edge_id"))).count().where("count > 1").agg(F.count("*").alias("edge_id_repeated"))
    out = out.crossJoin(F.broadcast(twice))
    return out


def facts(relations: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Edges of resolved relations by status: RESOLVED to its target, EXTERNAL to an external node, AMBIGUOUS to an issue
    and from it to each candidate, UNRESOLVED to an issue.

    symbols (name, artifact_id): where relations were resolved by them, candidates are met there and not carried as lists."""
    source, issue = stable_id("node", F.col("from_ref")), stable_id("issue", F.col("relation_id"))
    row = lambda where, kind, a, b, *parts: where.select(stable_id("edge", *parts).alias("edge_id"), kind.alias("relation_type"), a.alias("from_node_id"), b.alias("to_node_id"), "confidence")
    rid, status = F.col("relation_id"), F.col("status")
    known = row(relations.where(status == "RESOLVED"), F.col("kind"), source, stable_id("node", F.col("target")), rid)
    outside = row(relations.where(status == "EXTERNAL"), F.col("kind"), source, stable_id("external", F.col("to_ref")), rid)
    unsure = row(relations.where(status.isin("AMBIGUOUS", ISSUE)), F.lit("UNCERTAIN_RELATION"), source, issue, rid)
    unclear = relations.where(status == "AMBIGUOUS").withColumn("issue", issue)
    if symbols is None:
        each = unclear.select("relation_id", "confidence", "issue", F.explode("candidates").alias("candidate")).withColumn("candidate_node", stable_id("node", F.col("candidate")))
    else:
        each = candidates_of(unclear.select("relation_id", "confidence", "issue", "to_ref"), symbols)
    possible = row(each, F.lit("POSSIBLE_TARGET"), F.col("issue"), F.col("candidate_node"), rid, F.col("candidate"))
    return known.unionByName(outside).unionByName(unsure).unionByName(possible)


def external_nodes(relations: DataFrame) -> DataFrame:
    """One node for each external reference."""
    return relations.where("status = 'EXTERNAL'").select("to_ref").distinct().select(stable_id("external", F.col("to_ref")).alias("node_id"), F.col("to_ref").alias("external_identity"))


def symbol(nodes: DataFrame, artifact: str) -> DataFrame:
    """The node of one artifact."""
    return nodes.where((F.col("artifact_id") == artifact) & (F.col("entity_type") != ISSUE)).limit(1)


def node_rows(rows: DataFrame) -> DataFrame:
    """Stored rows as nodes: attributes out of their JSON, an external identity among them."""
    attributes = F.coalesce(F.from_json("attributes_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    more = F.when(F.col("external_identity").isNotNull(), F.create_map(F.lit("external_identity"), F.col("external_identity"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.withColumn("properties", F.map_concat(attributes, more)).drop("attributes_json")


def strict_problems(artifacts: DataFrame, relations: DataFrame, commit: str) -> DataFrame:
    """One row of what a strict build refuses: repeated ids, other commits, missing sources, confidences out of range."""
    twice = lambda df, c: df.groupBy(c).count().where("count > 1").agg(F.count("*").alias(f"repeated_{c}"))
    out = twice(artifacts, "artifact_id").crossJoin(F.broadcast(twice(relations, "relation_id")))
    out = out.crossJoin(F.broadcast(artifacts.agg(F.count_if(~F.col("commit_sha").eqNullSafe(commit)).alias("other_commit"))))
    out = out.crossJoin(F.broadcast(missing_sources(relations, artifacts).agg(F.count("*").alias("missing_source"))))
    return out.crossJoin(F.broadcast(relations.agg(F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("bad_confidence"))))
