"""Wiki pages of many graph revisions at once: six pages in two locales, out of the graph's tables, each with its citations.

Every page is a union of small pieces of text (revision, slug, place, both languages), made by aggregates and ranked lists;
lists are cut to their first rows before they are gathered, so a page is as long as its counts of types and modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import stable_id
from weft.operators import wiki

#: Locales (the first is the default), and the words of the pages in each.
LOCALES = ["zh-CN", "en-US"]
TITLES = {
    "overview": ("项目概览", "Project Overview"),
    "architecture": ("系统架构", "System Architecture"),
    "modules": ("模块说明", "Modules"),
    "key-flows": ("关键流程", "Key Flows"),
    "interfaces": ("接口与关键符号", "Interfaces and Key Symbols"),
    "development-guide": ("开发指南", "Development Guide"),
}
WORDS = {
    "generated": ("本页根据当前代码快照的知识图谱自动生成；所有统计均限定于该快照。", "This page is generated from the current snapshot's knowledge graph; all counts are snapshot-scoped."),
    "type": ("实体类型", "Entity type"),
    "count": ("数量", "Count"),
    "entities": ("实体总数", "Total entities"),
    "relations": ("关系总数", "total relations"),
    "principal": ("下表展示代码实体间已解析出的主要依赖关系。", "The table lists the principal dependency relationships resolved from code."),
    "code": ("代码实体", "Code entities"),
    "omitted": ("- 其余实体已省略。\n", "- Remaining entities omitted.\n"),
    "paths": ("以下调用链来自静态关系抽取，未解析目标会显式保留。", "The following call paths come from static relationship extraction; unresolved targets remain explicit."),
    "no symbols": ("当前快照未解析到接口、函数或方法实体。\n", "No interface, function, or method entities were resolved for this snapshot.\n"),
    "languages": ("已识别语言", "Detected Languages"),
    "source paths": ("主要源码路径", "Primary Source Paths"),
    "nothing": ("- 暂无可用信息。", "- No information available."),
    "refresh": ("修改代码后应重新解析目标提交，并仅在图谱修订就绪后刷新受影响的 Wiki 页面。\n", "After changing code, parse the target commit again and refresh affected Wiki pages only after the graph revision is ready.\n"),
    "evidence": ("源码依据", "Source Evidence"),
    "from": ("来源", "From"),
    "relation": ("关系", "Relation"),
    "to": ("目标", "To"),
    "no relations": ("未解析到对应关系", "No matching relationships resolved"),
}
SYMBOLS = ["INTERFACE", "FUNCTION", "METHOD"]
REF = wiki.CITATION


def piece(rows: DataFrame, slug: str, part: int, group: Column, place: Column, zh: Column, en: Column | None = None) -> DataFrame:
    """revision_id, slug, where the text stands (part, group, place), and the text in both languages."""
    return rows.select("revision_id", F.lit(slug).alias("slug"), F.struct(F.lit(part).alias("part"), group.cast("string").alias("group"), place.cast("long").alias("place")).alias("at"), zh.alias("zh"), (zh if en is None else en).alias("en"))


def says(rows: DataFrame, slug: str, part: int, form: str, *words: str) -> DataFrame:
    """A fixed piece for each revision: the form with these words in it."""
    zh, en = (form.format(*((TITLES | WORDS)[w][i] for w in words)) for i in (0, 1))
    return piece(rows, slug, part, F.lit(""), F.lit(0), F.lit(zh), F.lit(en))


def first(rows: DataFrame, most: int, *order: str, by: tuple[str, ...] = ("revision_id",)) -> DataFrame:
    """The first rows of each revision (or group), with their place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)


def relation_table(revisions: DataFrame, nodes: DataFrame, edges: DataFrame, slug: str, part: int, most: int) -> list[DataFrame]:
    """The first edges with the names of their ends, or a row that says that there are none."""
    name = lambda c: nodes.select("revision_id", F.col("node_id").alias(f"{c}_node_id"), F.col("shown").alias(f"{c}_name"))
    rows = first(edges, most, "edge_id").join(name("from"), ["revision_id", "from_node_id"], "left").join(name("to"), ["revision_id", "to_node_id"], "left")
    end = lambda c: F.coalesce(f"{c}_name", F.lit(""))
    line = F.concat(F.lit("| `"), end("from"), F.lit("` | "), "relation_type", F.lit(" | `"), end("to"), F.lit("` |\n"))
    none = revisions.join(edges.select("revision_id").distinct(), "revision_id", "left_anti")
    return [says(revisions, slug, part, "| {} | {} | {} |\n|---|---|---|\n", "from", "relation", "to"), piece(rows, slug, part + 1, F.lit(""), F.col("place"), line), says(none, slug, part + 1, "| {} | - | - |\n", "no relations")]


def refused(revisions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """revision_id and reason of the revisions of which no page is made: without nodes, or without a valid source reference."""
    there = nodes.select("revision_id").distinct().withColumn("some", F.lit(True))
    sound = evidence(nodes, edges, 1).select("revision_id").distinct().withColumn("grounded", F.lit(True))
    told = revisions.join(there, "revision_id", "left").join(sound, "revision_id", "left")
    return told.select("revision_id", F.when(F.col("some").isNull(), "empty").when(F.col("grounded").isNull(), "no evidence").alias("reason")).where("reason is not null")


def evidence(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The first valid references of each revision, each once, in order (place)."""
    refs = nodes.select("revision_id", "source_ref.*").unionByName(edges.select("revision_id", "evidence.*"), allowMissingColumns=True).select("revision_id", *REF)
    path = F.coalesce("path", F.lit(""))
    valid = (F.coalesce("commit_sha", F.lit("")) != "") & (path != "") & ~path.rlike(r"^/|(^|/)\.\.(/|$)") & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    return first(refs.where(valid).dropDuplicates(), most, "path", "start_line", "end_line", "symbol_id", "commit_sha", "content_hash")


def pages(revisions: DataFrame, nodes: DataFrame, edges: DataFrame, slugs: list[str] | None = None, locales: list[str] | None = None, stored: DataFrame | None = None, most: int = wiki.SHOWN) -> DataFrame:
    """A row for each revision, locale and slug: title, content_md, citations, page_id, parent_page_id, revision_no, content_hash.

    revisions: revision_id, tenant_id, repository_id, snapshot_id. nodes: revision_id, node_id, entity_type, name,
    qualified_name, source_ref, language. edges: revision_id, edge_id, relation_type, from_node_id, to_node_id, evidence.
    stored: pages there are (page_id, revision_no), whose numbers go on. `refused` revisions have no pages."""
    wanted, spark = wiki.slugs(slugs), revisions.sparkSession
    locales = locales or LOCALES[:1]
    if unknown := set(locales) - set(LOCALES):
        raise ValueError(f"unknown locales: {sorted(unknown)}")
    revisions = revisions.join(refused(revisions, nodes, edges).select("revision_id"), "revision_id", "left_anti")
    nodes = nodes.join(revisions.select("revision_id"), "revision_id", "left_semi").withColumn("shown", wiki.display_name(F.col("qualified_name"), F.col("name"), F.col("node_id")))
    edges = edges.join(revisions.select("revision_id"), "revision_id", "left_semi")
    none, own = F.lit(""), revisions.select("revision_id")
    parts: list[DataFrame] = []

    if "overview" in wanted:
        counts = nodes.groupBy("revision_id", "entity_type").agg(F.count("*").alias("n"))
        sums = own.join(nodes.groupBy("revision_id").agg(F.count("*").alias("n")), "revision_id").join(edges.groupBy("revision_id").agg(F.count("*").alias("m")), "revision_id", "left")
        total = lambda i: F.concat(F.lit(f"\n{WORDS['entities'][i]}："), F.col("n").cast("string"), F.lit(f"；{WORDS['relations'][i]}："), F.coalesce("m", F.lit(0)).cast("string"), F.lit("。\n"))
        parts += [says(own, "overview", 0, "# {}\n\n{}\n\n| {} | {} |\n|---|---:|\n", "overview", "generated", "type", "count")]
        parts += [piece(counts, "overview", 1, F.col("entity_type"), F.lit(0), F.concat(F.lit("| "), "entity_type", F.lit(" | "), F.col("n").cast("string"), F.lit(" |\n")))]
        parts += [piece(sums, "overview", 2, none, F.lit(0), total(0), total(1))]
    if "architecture" in wanted:
        parts += [says(own, "architecture", 0, "# {}\n\n{}\n\n", "architecture", "principal"), *relation_table(own, nodes, edges, "architecture", 1, most)]
    if "modules" in wanted:
        module = F.when(F.col("source_ref.path").contains("/"), F.substring_index("source_ref.path", "/", 1)).otherwise("root")
        grouped = nodes.withColumn("module", module)
        sizes = grouped.groupBy("revision_id", "module").agg(F.count("*").alias("n"))
        head = lambda i: F.concat(F.lit("## `"), "module", F.lit(f"`\n\n{WORDS['code'][i]}："), F.col("n").cast("string"), F.lit("\n\n"))
        rest = lambda i: F.concat(F.when(F.col("n") > most, WORDS["omitted"][i]).otherwise(""), F.lit("\n"))
        listed = first(grouped, most, "shown", "node_id", by=("revision_id", "module"))
        parts += [says(own, "modules", 0, "# {}\n\n", "modules"), piece(sizes, "modules", 1, F.col("module"), F.lit(0), head(0), head(1)), piece(sizes, "modules", 1, F.col("module"), F.lit(2**40), rest(0), rest(1))]
        parts += [piece(listed, "modules", 1, F.col("module"), F.col("place"), F.concat(F.lit("- `"), "shown", F.lit("` ("), "entity_type", F.lit(")\n")))]
    if "key-flows" in wanted:
        calls = edges.where("relation_type = 'CALLS'")
        parts += [says(own, "key-flows", 0, "# {}\n\n{}\n\n", "key-flows", "paths"), *relation_table(own, nodes, calls, "key-flows", 1, most)]
    if "interfaces" in wanted:
        symbols = nodes.where(F.col("entity_type").isin(SYMBOLS))
        bare = own.join(symbols.select("revision_id").distinct(), "revision_id", "left_anti")
        parts += [says(own, "interfaces", 0, "# {}\n\n", "interfaces"), piece(first(symbols, most, "node_id"), "interfaces", 1, none, F.col("place"), F.concat(F.lit("- `"), "shown", F.lit("` — "), "entity_type", F.lit("\n"))), says(bare, "interfaces", 1, "{}", "no symbols")]
    if "development-guide" in wanted:
        extension = F.lower(F.regexp_extract("source_ref.path", r"\.([^./]*)$", 1))
        languages = nodes.select("revision_id", F.explode(F.array("language", extension)).alias("item")).where(F.coalesce("item", none) != "").distinct()
        paths = first(nodes.select("revision_id", F.col("source_ref.path").alias("item")).where("item is not null").distinct(), most, "item").drop("place")
        for part, rows, title in ((0, languages, "languages"), (2, paths, "source paths")):
            lists = own.join(rows.groupBy("revision_id").agg(F.array_sort(F.collect_list("item")).alias("items")), "revision_id", "left")
            text = lambda i, lists=lists: F.coalesce(F.concat(F.lit("- `"), F.array_join("items", "`\n- `"), F.lit("`")), F.lit(WORDS["nothing"][i]))
            parts += [says(own, "development-guide", part, "# {}\n\n## {}\n\n" if not part else "\n\n## {1}\n\n", "development-guide", title), piece(lists, "development-guide", part + 1, none, F.lit(0), text(0), text(1))]
        parts += [says(own, "development-guide", 4, "\n{}", "refresh")]
    cited = evidence(nodes, edges, most)
    line = F.concat(F.lit("- `"), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("`"), F.when(F.coalesce("symbol_id", none) != "", F.concat(F.lit(" (`"), "symbol_id", F.lit("`)"))).otherwise(""), F.lit("\n"))
    refs = cited.groupBy("revision_id").agg(F.array_sort(F.collect_list(F.struct("place", *REF, line.alias("line")))).alias("refs"))
    heading = [f"\n## {w}\n\n" for w in WORDS["evidence"]]
    lines = F.array_join(F.transform("refs", lambda r: r["line"]), "")
    every = spark.createDataFrame([(s,) for s in wanted], "slug string")

    text = reduce(DataFrame.unionByName, parts)
    bodies = text.groupBy("revision_id", "slug").agg(F.array_sort(F.collect_list(F.struct("at", "zh", "en"))).alias("p"))
    both = bodies.join(F.broadcast(every), "slug").join(refs, "revision_id")
    body = lambda c, i: F.concat(F.array_join(F.transform("p", lambda x: x[c]), ""), F.lit(heading[i]), lines)
    each = F.array(*(F.struct(F.lit(name).alias("locale"), body(c, i).alias("text"), F.element_at(F.create_map(*(F.lit(x) for s in TITLES for x in (s, TITLES[s][i]))), F.col("slug")).alias("title")) for i, (name, c) in enumerate(zip(LOCALES, ("zh", "en"))) if name in locales))
    out = both.select("revision_id", "slug", "refs", F.explode(each).alias("e")).join(revisions, "revision_id")
    page = lambda slug: stable_id("page", F.col("tenant_id"), F.col("repository_id"), F.col("e.locale"), slug)
    out = out.withColumn("page_id", page(F.col("slug"))).withColumn("content_md", F.regexp_replace("e.text", r"^\s+|\s+$", ""))
    has_overview = F.lit("overview" in wanted)
    if stored is not None:
        newest = stored.groupBy("page_id").agg(F.max("revision_no").alias("stored_no"))
        out = out.join(newest, "page_id", "left")
        if "overview" not in wanted:
            old = newest.select(F.col("page_id").alias("parent"), F.lit(True).alias("parent_there"))
            out = out.withColumn("parent", page(F.lit("overview"))).join(old, "parent", "left")
            has_overview = F.coalesce("parent_there", F.lit(False))
    else:
        out = out.withColumn("stored_no", F.lit(0))
    citations = F.transform("refs", lambda r: F.struct(*(r[c].alias(c) for c in REF)))
    told = F.concat("content_md", F.array_join(F.transform("refs", lambda r: F.concat(F.lit("\0"), F.concat_ws(":", *(F.coalesce(r[c].cast("string"), none) for c in ("commit_sha", "path", "symbol_id", "start_line", "end_line", "content_hash"))))), ""))
    parent = F.when((F.col("slug") != "overview") & has_overview, page(F.lit("overview")))
    number = F.coalesce("stored_no", F.lit(0)) + 1
    return out.select("revision_id", "snapshot_id", F.col("e.locale").alias("locale"), "slug", F.col("e.title").alias("title"), "content_md", citations.alias("citations"), "page_id", parent.alias("parent_page_id"), number.cast("long").alias("revision_no"), F.concat(F.lit("sha256:"), F.sha2(told.cast("binary"), 256)).alias("content_hash"))
