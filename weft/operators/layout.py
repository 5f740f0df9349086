"""Diagram projections: view filters, source links, layouts and Mermaid text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.paths import extension
from weft.operators.graph import MOST_FRONTIER, closed, cut, traverse

#: Entity and relation types of each view (none: all), languages of extensions, distances on the canvas.
VIEWS = {
    "REPOSITORY_MAP": ([], []),
    "MODULE_DEPENDENCY": (["MODULE", "PACKAGE", "FILE"], ["IMPORTS", "DEPENDS_ON"]),
    "CLASS_DIAGRAM": (["CLASS", "INTERFACE"], ["EXTENDS", "IMPLEMENTS"]),
    "CALL_GRAPH": (["FUNCTION", "METHOD", "SYMBOL"], ["CALLS"]),
    "DATA_FLOW": (["FUNCTION", "METHOD", "SYMBOL", "CONFIG"], ["CALLS", "DEPENDS_ON"]),
}
LANGUAGES = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java"}
MOST_NODES = 5000


def view_filters(view: str, entities: list[str] = (), relations: list[str] = ()) -> tuple[list[str] | None, list[str] | None]:
    """A view's types, cut down to those asked for; None allows all, an empty list nothing."""
    own = VIEWS[view]
    both = lambda default, asked: (sorted(set(default) & set(asked)) if default else sorted(set(asked))) if asked else (default or None)
    return both(own[0], entities), both(own[1], relations)


def projected(nodes: DataFrame, edges: DataFrame, view: str, least_confidence: float = 0.0, limit: int | None = 500, entities: list[str] = (), relations: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The nodes of a view in id order, and the confident edges between them. limit None: all nodes, for what is pruned after."""
    if limit is not None and not 0 < limit <= MOST_NODES:
        raise ValueError(f"limit must be from 1 to {MOST_NODES}")
    kinds, types = view_filters(view, entities, relations)
    if kinds is not None:
        nodes = nodes.where(F.col("entity_type").isin(kinds))
    if types is not None:
        edges = edges.where(F.col("relation_type").isin(types))
    if limit is not None:
        nodes = nodes.orderBy("node_id").limit(limit)
    return nodes, closed(edges.where(F.col("confidence") >= least_confidence), nodes)


def pruned(nodes: DataFrame, edges: DataFrame, roots: list[str], depth: int, most_frontier: int | None = MOST_FRONTIER) -> tuple[DataFrame, DataFrame]:
    """What of a projection can be reached from its roots; a frontier over most_frontier (None: no budget) is refused."""
    reached = traverse(nodes, edges, roots, depth=depth, most_frontier=most_frontier).select("node_id")
    kept = nodes.join(reached, "node_id", "left_semi")
    return kept, closed(edges, kept)


def language(properties: Column, path: Column) -> Column:
    """The language property, else by extension, else null."""
    return F.coalesce(properties["language"], F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[extension(path)])


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes of a projection (at most MOST_NODES) with their place in id order and their number."""
    return nodes.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("i"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))


def grid(nodes: DataFrame) -> DataFrame:
    """Positions row by row on a grid that is about square."""
    columns = F.ceil(F.sqrt(F.col("n"))).cast("long")
    return placed(nodes).select("node_id", (F.col("i") % columns * 220).cast("double").alias("x"), (F.floor(F.col("i") / columns) * 140).cast("double").alias("y"))


def radial(nodes: DataFrame) -> DataFrame:
    """Positions on a circle that grows with their number; one node alone lies in the middle."""
    radius, turn = F.greatest(F.lit(180.0), F.col("n") * 28.0), 2 * F.pi() * F.col("i") / F.col("n")
    at = lambda f: F.when(F.col("n") == 1, 0.0).otherwise(F.round(radius * f(turn))) + 0.0
    return placed(nodes).select("node_id", at(F.cos).alias("x"), at(F.sin).alias("y"))


def chains(arcs: DataFrame) -> DataFrame:
    """node_id, up and steps of every node with one predecessor: the nearest node above it that has none or several, and how
    far that is; up is null for what hangs from a cycle. Pointers are doubled, so rounds grow as the logarithm of the longest chain."""
    single = arcs.groupBy("node_id").agg(F.count("*").alias("n"), F.first("source").alias("up")).where("n = 1").select("node_id", "up", F.lit(1).cast("long").alias("steps"))
    now = cut(single)
    most = max(1, now.count()).bit_length() + 1
    for _ in range(most):
        above = now.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        met = now.join(above, "up", "left")
        now = cut(met.select("node_id", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open")))
        if not now.where("open").limit(1).count():
            return now.drop("open")
        now = now.drop("open")
    ends = now.select("node_id").withColumnRenamed("node_id", "up").withColumn("looped", F.lit(True))
    return cut(now.join(ends, "up", "left").select("node_id", F.when(F.col("looped").isNull(), F.col("up")).alias("up"), "steps"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id and layer: the longest path from a node without predecessors; what lies in or behind cycles comes after all.

    Nodes with one predecessor are placed by the chain that they hang from. Of the others each round peels those none of
    whose predecessors is left, so there are as many rounds as such nodes on a path."""
    ids = cut(nodes.select("node_id"))
    arcs = edges.where("from_node_id <> to_node_id").select(F.col("from_node_id").alias("source"), F.col("to_node_id").alias("node_id")).distinct()
    arcs = cut(arcs.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids, "node_id", "left_semi"))
    hung = chains(arcs)
    left = cut(ids.join(hung.select("node_id"), "node_id", "left_anti"))
    above = hung.select(F.col("node_id").alias("source"), F.col("up"), "steps", F.lit(True).alias("hangs"))
    into = arcs.join(left, "node_id", "left_semi").join(above, "source", "left")
    into = into.select("node_id", F.when(F.col("hangs"), F.col("up")).otherwise(F.col("source")).alias("source"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    into = cut(into.groupBy("node_id", "source").agg(F.max("steps").alias("steps")))
    stuck = into.where("source is null").select("node_id").distinct()  # behind a cycle of single predecessors
    done = None
    while True:
        waits = into.join(left.select(F.col("node_id").alias("source")), "source", "left_semi").select("node_id").union(stuck).distinct()
        ready = left.join(waits, "node_id", "left_anti")
        if done is None:
            ready = cut(ready.select("node_id", F.lit(0).cast("long").alias("layer")))
        else:
            from_done = into.join(done.select(F.col("node_id").alias("source"), F.col("layer").alias("base")), "source")
            best = from_done.groupBy("node_id").agg(F.max(F.col("base") + F.col("steps")).alias("layer"))
            ready = cut(ready.join(best, "node_id").select("node_id", "layer"))
        if not ready.count():
            break
        done = ready if done is None else cut(done.union(ready))
        left = cut(left.join(ready.select("node_id"), "node_id", "left_anti"))
    if done is None:
        return ids.select("node_id", F.lit(0).alias("layer"))
    tails = hung.join(done.select(F.col("node_id").alias("up"), "layer"), "up").select("node_id", (F.col("layer") + F.col("steps")).alias("layer"))
    found = cut(done.union(tails))
    last = found.agg(F.max("layer")).first()[0] + 1
    return ids.join(found, "node_id", "left").select("node_id", F.coalesce("layer", F.lit(last)).cast("int").alias("layer"))


def dag(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Positions by layer, and by id within a layer."""
    row = F.row_number().over(Window.partitionBy("layer").orderBy("node_id")) - 1
    return layers(nodes, edges).select("node_id", (F.col("layer") * 260).cast("double").alias("x"), (row * 140).cast("double").alias("y"))


def mermaid_id(ident: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.sha2(ident.cast("binary"), 256), 1, 12))


def escaped(label: Column) -> Column:
    """A label without characters that end or mark up a Mermaid string."""
    out = label
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("\n", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the Mermaid text of a projection, nodes and then edges in id order."""
    a = nodes.select(F.lit(0).alias("part"), F.col("node_id").alias("k"), F.concat(F.lit("  "), mermaid_id(F.col("node_id")), F.lit('["'), escaped(F.col("name")), F.lit('"]')).alias("line"))
    b = edges.select(F.lit(1).alias("part"), F.concat_ws("|", "edge_id", "from_node_id", "to_node_id").alias("k"), F.concat(F.lit("  "), mermaid_id(F.col("from_node_id")), F.lit(" -->|"), F.col("relation_type"), F.lit("| "), mermaid_id(F.col("to_node_id"))).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "line"))), lambda x: x["line"])
    return a.union(b).agg(F.concat(F.lit("flowchart LR\n"), F.array_join(ordered, "\n")).alias("mermaid"))


def cached(projections: DataFrame, query_hash: str, revision: str, now: Column) -> DataFrame:
    """Stored projections of the same query and revision that have not expired."""
    return projections.where((F.col("query_hash") == query_hash) & (F.col("revision_id") == revision) & (F.col("expires_at") > now))
