"""Registered queries: paths, changes and extraction over pages, and over sources derived from the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import paths as P
from weft.operators import changes as C
from weft.operators import extract as X
from weft.operators import structure as S
from weft.plans.registry import query
from weft.sources.tables import table

RAW = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^?#]*)', 1)"
PATHS = rf"raw AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '../' || {RAW} WHEN page_id % 7 = 0 THEN ' ./' || replace({RAW}, '/', '\') || '/' ELSE {RAW} || '/p' || page_id || CASE WHEN page_id % 3 = 0 THEN '.py' WHEN page_id % 3 = 1 THEN '.md' ELSE '.bin' END END AS path, html FROM pages), c AS (SELECT *, array_to_string(list_filter(string_split(replace(trim(path), '\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') AS clean FROM raw)"
PROBLEM = "CASE WHEN path LIKE '../%' OR path LIKE '%/../%' THEN 'escapes' WHEN clean = '' THEN 'empty' END"


def raw_of(spark, sf_dir):
    p = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+/([^?#]*)", 1)
    i = F.col("page_id")
    end = F.when(i % 3 == 0, ".py").when(i % 3 == 1, ".md").otherwise(".bin")
    path = F.when(i % 11 == 0, F.concat(F.lit("../"), p)).when(i % 7 == 0, F.concat(F.lit(" ./"), F.replace(p, F.lit("/"), F.lit("\\")), F.lit("/"))).otherwise(F.concat(p, F.lit("/p"), i.cast("string"), end))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.col("html").alias("content"))


@query("paths_canonical", f"WITH {PATHS} SELECT page_id, CASE WHEN {PROBLEM} IS NULL THEN clean END AS path, {PROBLEM} AS problem FROM c")
def canonical(spark, sf_dir):
    p = F.col("path")
    return raw_of(spark, sf_dir).select("page_id", P.canonical_path(p).alias("path"), P.path_problem(p).alias("problem"))


@query("paths_glob", f"WITH {PATHS} SELECT page_id FROM c WHERE {PROBLEM} IS NULL AND regexp_matches(clean, '^(?:.*/)?p[^/]*\\.py$')")
def glob(spark, sf_dir):
    rows = raw_of(spark, sf_dir).select("page_id", P.canonical_path(F.col("path")).alias("path"))
    return rows.where(P.included(F.col("path"), ["**/p*.py"])).select("page_id")


@query("paths_repository_url", r"SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'https://' || lower(regexp_extract(url, '^https://([^/?#]+)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1), '/+$', ''), '\.git$', '') END AS repository FROM pages")
def repository(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.repository_url(F.col("url")).alias("repository"))


@query("paths_module_groups", f"WITH {PATHS}, g AS (SELECT CASE WHEN contains(clean, '/') THEN string_split(clean, '/')[1] ELSE 'root' END AS module, clean, page_id FROM c WHERE {PROBLEM} IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY clean, page_id) AS i, count(*) OVER (PARTITION BY module) AS n FROM g) SELECT module, clean AS path, n - 5 AS omitted FROM r WHERE i <= 5")
def module_groups(spark, sf_dir):
    from weft.operators import wiki

    rows = raw_of(spark, sf_dir).select("page_id", P.canonical_path(F.col("path")).alias("path")).where("path IS NOT NULL")
    return wiki.top_per_group(rows.withColumn("module", P.first_segment(F.col("path"))), "module", ["path", "page_id"], 5).select("module", "path", "omitted")


@query("files_admission", f"WITH {PATHS} SELECT page_id, CASE WHEN clean LIKE '%.py' THEN 'python' WHEN clean LIKE '%.md' THEN 'text' END AS parser, CASE WHEN clean NOT LIKE '%.py' AND clean NOT LIKE '%.md' THEN 'unsupported' WHEN strlen(html) > 2097152 THEN 'too_large' WHEN contains(html, chr(0)) THEN 'binary' END AS skipped FROM c WHERE {PROBLEM} IS NULL")
def admission(spark, sf_dir):
    rows = raw_of(spark, sf_dir).withColumn("path", P.canonical_path(F.col("path"))).where("path IS NOT NULL")
    return C.admitted(rows).select("page_id", "parser", "skipped")


OLD = "old AS (SELECT 'd/' || doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT 'd/' || doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 6 <> 0)"


def snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.where("doc_id % 5 <> 0").select(path, F.md5(F.col("text").cast("binary")).alias("content_hash")), d.where("doc_id % 6 <> 0").select(path, F.md5(changed.cast("binary")).alias("content_hash"))


@query("changes_snapshot_diff", f"WITH {OLD} SELECT path, CASE WHEN o.h IS NULL THEN 'ADDED' WHEN n.h IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS kind FROM old o FULL JOIN new n USING (path) WHERE o.h IS DISTINCT FROM n.h")
def snapshot_diff(spark, sf_dir):
    return C.snapshot_diff(*snapshots(spark, sf_dir))


@query("changes_carried_forward", f"WITH {OLD} SELECT path, h AS content_hash FROM new UNION ALL SELECT path, h FROM old WHERE path NOT IN (SELECT path FROM new) AND path NOT IN (SELECT 'd/' || doc_id FROM documents WHERE doc_id % 4 = 0)")
def carried(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    gone = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    return C.carried_forward(old, new, gone)


CHANGES = "ch AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'src/' ELSE 'lib/' END || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'src/' ELSE 'lib/' END || 'old' || o_orderkey END AS old_path, CASE WHEN o_orderkey % 3 = 0 THEN 'RENAMED' WHEN o_orderkey % 3 = 1 THEN 'MODIFIED' ELSE 'DELETED' END AS kind FROM orders)"


def changes_of(spark, sf_dir):
    k = F.col("o_orderkey")
    key = k.cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.when(k % 4 == 0, "src/").otherwise("lib/"), key).alias("path"),
        F.when(k % 3 == 0, F.concat(F.when(k % 5 == 0, "src/").otherwise("lib/"), F.lit("old"), key)).alias("old_path"),
        F.when(k % 3 == 0, "RENAMED").when(k % 3 == 1, "MODIFIED").otherwise("DELETED").alias("kind"),
    )


@query("changes_rename_boundary", f"WITH {CHANGES}, f AS (SELECT *, path LIKE 'src/%' AS new, coalesce(old_path LIKE 'src/%', false) AS was FROM ch) SELECT CASE WHEN was AND NOT new THEN old_path ELSE path END AS path, CASE WHEN was AND NOT new THEN 'DELETED' WHEN kind = 'RENAMED' AND NOT was THEN 'ADDED' ELSE kind END AS kind, CASE WHEN was AND new THEN old_path END AS old_path FROM f WHERE new OR was")
def rename_boundary(spark, sf_dir):
    return C.within(C.normalised(changes_of(spark, sf_dir))[0], ["src/**"])


@query("changes_deleted_paths", f"WITH {CHANGES} SELECT path FROM ch WHERE kind = 'DELETED' UNION SELECT old_path FROM ch WHERE kind = 'RENAMED'")
def deleted(spark, sf_dir):
    return C.deleted_paths(changes_of(spark, sf_dir))


@query("changes_listing", f"WITH {CHANGES} SELECT path, old_path, kind FROM ch")
def listing(spark, sf_dir):
    nul = F.lit("\0")
    letter = F.when(F.col("kind") == "RENAMED", "R100").when(F.col("kind") == "MODIFIED", "M").otherwise("D")
    entry = F.concat(letter, nul, F.coalesce(F.concat("old_path", nul), F.lit("")), F.col("path"), nul)
    rows = changes_of(spark, sf_dir).select(entry.alias("entry"), F.regexp_extract("path", "([0-9]{1,4})$", 1).alias("g"))
    return C.decode_listing(rows.groupBy("g").agg(F.array_join(F.collect_list("entry"), "").alias("listing")))


@query("extract_lines", "SELECT page_id::VARCHAR AS path, count(*) AS lines FROM (SELECT page_id, unnest(string_split(html, chr(10))) FROM pages) GROUP BY page_id")
def lines(spark, sf_dir):
    return X.lines_of(pages_of(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("lines"))


def pages_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))


STOP = ", ".join(f"'{w}'" for w in X.NO_CALLS)


@query(
    "extract_calls",
    rf"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS text, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages),
         n AS (SELECT page_id, line, regexp_extract(text, '^\s*(?:export\s+|pub\s+|async\s+)*(?:def|function|fn|func|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS declared,
               unnest(list_distinct(regexp_extract_all(text, '\b([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?)\s*\(', 1))) AS name FROM l)
       SELECT page_id::VARCHAR AS path, line::INTEGER AS line, 'symbol:' || name AS target, 'CALLS' AS kind, 0.65::DOUBLE AS confidence FROM n WHERE name NOT IN ({STOP}) AND name <> declared""",
)
def calls(spark, sf_dir):
    return X.calls(X.lines_of(pages_of(spark, sf_dir)))


def sources_of(spark, sf_dir):
    """A Python file for each supplier: a class with a base, a method for each column, and a function after it."""
    key = F.col("s_suppkey").cast("string")
    content = F.concat(F.lit("import base_"), F.col("s_nationkey").cast("string"), F.lit("\n\nclass Supplier"), key, F.lit("(Nation"), F.col("s_nationkey").cast("string"), F.lit("):\n    def name(self):\n        return load("), key, F.lit(")\n\n    def balance(self):\n        return ledger.read(self)\n\ndef run"), key, F.lit("():\n    return go()\n"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), key, F.lit(".py")).alias("path"), content.alias("content"), F.lit("python").alias("parser"))


@query("extract_python", "SELECT 'src/s' || s_suppkey || '.py' AS path, unnest(['CLASS', 'METHOD', 'METHOD', 'FUNCTION']) AS kind, unnest(['Supplier' || s_suppkey, 'Supplier' || s_suppkey || '.name', 'Supplier' || s_suppkey || '.balance', 'run' || s_suppkey]) AS qualified_name, unnest([3, 4, 7, 10]) AS start_line, unnest([8, 5, 8, 11]) AS end_line FROM supplier")
def python(spark, sf_dir):
    return S.parts(sources_of(spark, sf_dir)).select("path", "kind", "qualified_name", "start_line", "end_line")


@query("extract_imports", "SELECT 'src/s' || s_suppkey || '.py' AS path, 1 AS line, 'module:base_' || s_nationkey AS target, 'IMPORTS' AS kind, 1.0::DOUBLE AS confidence FROM supplier")
def imports(spark, sf_dir):
    return X.imports(X.lines_of(sources_of(spark, sf_dir)))


@query("extract_bases", "SELECT 'src/s' || s_suppkey || '.py' AS path, 3 AS line, 'symbol:Nation' || s_nationkey AS target, 'EXTENDS' AS kind, 0.9::DOUBLE AS confidence FROM supplier")
def bases(spark, sf_dir):
    return X.bases(X.lines_of(sources_of(spark, sf_dir)))


@query("extract_indented_ends", "SELECT 'src/s' || s_suppkey || '.py' AS path, unnest([1, 3, 4, 5, 7, 8, 10, 11]) AS line, unnest([1, 8, 5, 5, 8, 8, 11, 11]) AS end_line FROM supplier")
def indented(spark, sf_dir):
    return X.indented_ends(X.lines_of(sources_of(spark, sf_dir)))


@query("extract_dependencies", "SELECT p_brand || '/package.json' AS path, 'package:lib' || p_size AS target, 'DEPENDS_ON' AS kind, 0.95::DOUBLE AS confidence FROM part GROUP BY p_brand, p_size")
def dependencies(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("lib"), F.col("p_size").cast("string")).alias("name")).distinct()
    packages = rows.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("name", F.lit("^1").alias("v")))).alias("dependencies"))
    return X.dependencies(packages.select(F.concat("p_brand", F.lit("/package.json")).alias("path"), F.to_json(F.struct("dependencies")).alias("content")))
