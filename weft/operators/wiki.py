"""Wiki tables and pages: groups, edge rows, citations, assembly, revisions and publication checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages in their order, rows shown of a list.
SLUGS = ["overview", "architecture", "modules", "key-flows", "interfaces", "development-guide"]
SHOWN = 20
CITATION = ["commit_sha", "path", "symbol_id", "start_line", "end_line", "content_hash"]


def top_per_group(rows: DataFrame, group: str, order: list, most: int = SHOWN) -> DataFrame:
    """The first rows of each group, and how many more there are (negative: none are left out)."""
    sized = rows.groupBy(group).agg((F.count("*") - most).alias("omitted"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= most)
    return first.join(sized, group)


def display_name(qualified: Column, name: Column, ident: Column) -> Column:
    """The qualified name, else the name, else the id."""
    return F.coalesce(F.nullif(F.trim(qualified), F.lit("")), F.nullif(F.trim(name), F.lit("")), ident)


def slugs(wanted: list[str] | None = None) -> list[str]:
    """Wanted pages in canonical order, all by default."""
    if unknown := set(wanted or ()) - set(SLUGS):
        raise ValueError(f"unknown pages: {sorted(unknown)}")
    return [s for s in SLUGS if not wanted or s in wanted]


def edge_rows(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, most: int = SHOWN) -> DataFrame:
    """The first edges with the display names of their ends."""
    picked = (edges.where(F.col("relation_type").isin(kinds)) if kinds else edges).orderBy("edge_id", "from_node_id", "to_node_id").limit(most)
    name = lambda c: nodes.select(F.col("node_id").alias(f"{c}_node_id"), F.col("name").alias(f"{c}_name"))
    return picked.join(name("from"), "from_node_id").join(name("to"), "to_node_id").select("edge_id", "relation_type", "from_name", "to_name")


def citations(refs: DataFrame, most: int = SHOWN) -> DataFrame:
    """Valid references, each once, in order, the first of them."""
    path = F.col("path")
    valid = (F.coalesce("commit_sha", F.lit("")) != "") & (path != "") & ~path.rlike(r"^/|(^|/)\.\.(/|$)") & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    return refs.where(valid).select(*CITATION).dropDuplicates(CITATION).orderBy("path", "start_line", "end_line", "symbol_id", "commit_sha").limit(most)


def majority_commit(refs: DataFrame) -> DataFrame:
    """The most frequent commit, the smallest of several."""
    return refs.where(F.coalesce("commit_sha", F.lit("")) != "").groupBy("commit_sha").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "commit_sha").limit(1)


def assemble(sections: DataFrame, page: str = "page_id") -> DataFrame:
    """Markdown of each page from its sections (page, position, text), and its hash."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    text = F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n")
    return sections.groupBy(page).agg(text.alias("content_md")).withColumn("content_hash", F.sha2(F.col("content_md").cast("binary"), 256))


def revision_numbers(pages: DataFrame, keys: list[str], created: list[str]) -> DataFrame:
    """Revisions of each page numbered from 1, and whether a later one supersedes it."""
    w = Window.partitionBy(*keys).orderBy(*created)
    return pages.withColumn("revision_no", F.row_number().over(w)).withColumn("superseded", F.lead(created[-1]).over(w).isNotNull())


def publication_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New pages that a stored one contradicts: another hash for the same snapshot and slug, or a stale revision number."""
    old = stored.select("slug", F.col("snapshot_id").alias("old_snapshot"), F.col("content_hash").alias("old_hash"), F.col("revision_no").alias("old_no"))
    reason = F.when((F.col("snapshot_id") == F.col("old_snapshot")) & (F.col("content_hash") != F.col("old_hash")), "changed").when(F.col("revision_no") <= F.col("old_no"), "stale")
    return new.join(old, "slug").withColumn("reason", reason).where("reason IS NOT NULL")


def languages_and_paths(files: DataFrame, most: int = SHOWN) -> DataFrame:
    """One row: distinct languages, and the first distinct paths; paths are cut to the first before they are gathered."""
    languages = files.agg(F.array_sort(F.collect_set("language")).alias("languages"))
    first = files.select("path").distinct().orderBy("path").limit(most).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return languages.crossJoin(F.broadcast(first))


def page_problems(generated: DataFrame, wanted: list[str], citations_at_hand: int) -> DataFrame:
    """What is wrong with generated pages (slug, citation_indexes): unknown, repeated or missing slugs, indexes out of range."""
    asked = generated.sparkSession.createDataFrame([(s,) for s in wanted], "slug string")
    unknown = generated.join(asked, "slug", "left_anti").select("slug", F.lit("unknown").alias("problem"))
    missing = asked.join(generated, "slug", "left_anti").select("slug", F.lit("missing").alias("problem"))
    twice = generated.groupBy("slug").count().where("count > 1").select("slug", F.lit("repeated").alias("problem"))
    cited = generated.where(F.exists("citation_indexes", lambda i: (i < 1) | (i > citations_at_hand)) | (F.size("citation_indexes") == 0)).select("slug", F.lit("citations").alias("problem"))
    return unknown.union(missing).union(twice).union(cited)


def totals(rows: DataFrame, key: str, citations_column: str, text: str) -> DataFrame:
    """Citations and bytes of text of each key."""
    return rows.groupBy(key).agg(F.sum(F.size(citations_column)).alias("citations"), F.sum(F.octet_length(text)).alias("bytes"))


def refused_graphs(revisions: DataFrame, nodes: DataFrame, key: str, limit: int) -> DataFrame:
    """Revisions of which no page is made, with the reason: their graph has no nodes, or more than the limit lets through."""
    counts = nodes.groupBy(key).agg(F.count("*").alias("n"))
    reason = F.when(F.col("n").isNull(), "empty").when(F.col("n") > limit, "truncated")
    return revisions.select(key).join(counts, key, "left").withColumn("reason", reason).where("reason IS NOT NULL").select(key, "reason")
