"""Registered query: wiki pages of a graph a region, customers calling suppliers of their nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import pages as P
from weft.plans.registry import query
from weft.sources.tables import table


def graph(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), text("n_regionkey")).alias("revision_id"))
    revisions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), text("r_regionkey")).alias("revision_id"), F.lit("t").alias("tenant_id"), F.col("r_name").alias("repository_id"), F.lit("s").alias("snapshot_id"))
    ref = lambda path, ident, last: F.struct(F.lit("c").alias("commit_sha"), path.alias("path"), ident.alias("symbol_id"), F.lit(1).alias("start_line"), last.cast("int").alias("end_line"), F.lit("h").alias("content_hash"))
    c, s = F.concat(F.lit("c"), text("c_custkey")), F.concat(F.lit("s"), text("s_suppkey"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    own = ref(F.concat(F.lower("c_mktsegment"), F.lit("/c"), (F.col("c_custkey") % 7).cast("string"), F.lit(".java")), c, 1 + F.col("c_custkey") % 5)
    none = F.lit(None).cast("string")
    nodes = customers.select("revision_id", c.alias("node_id"), F.lit("CLASS").alias("entity_type"), F.col("c_name").alias("name"), none.alias("qualified_name"), own.alias("source_ref"), none.alias("language"))
    nodes = nodes.union(suppliers.select("revision_id", s, F.lit("INTERFACE"), F.col("s_name"), F.lit(""), ref(F.concat(F.lit("s"), (F.col("s_suppkey") % 3).cast("string"), F.lit(".go")), s, F.lit(9)), F.lit("golang")))
    least = suppliers.groupBy("n_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    calls = F.when(F.col("c_acctbal") > 5000, "CALLS").otherwise("DEPENDS_ON")
    edges = customers.join(least, "n_nationkey").select("revision_id", F.concat(F.lit("e"), text("c_custkey")).alias("edge_id"), calls.alias("relation_type"), c.alias("from_node_id"), s.alias("to_node_id"), own.alias("evidence"))
    return revisions, nodes, edges


def oracle() -> str:
    """Every page as one list of pieces, put together in order."""
    words = lambda i: {k: v[i] for k, v in (P.TITLES | P.WORDS).items()}
    quoted = lambda text: "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def locale(i: int) -> str:
        w = words(i)
        table = f"| {w['from']} | {w['relation']} | {w['to']} |\n|---|---|---|\n"
        rows = [f"SELECT revision_id, '{slug}' AS slug, 0 AS a, '' AS b, 0 AS c, {quoted(text)} AS x FROM v" for slug, text in (
            ("overview", f"# {w['overview']}\n\n{w['generated']}\n\n| {w['type']} | {w['count']} |\n|---|---:|\n"), ("architecture", f"# {w['architecture']}\n\n{w['principal']}\n\n{table}"), ("modules", f"# {w['modules']}\n\n"),
            ("key-flows", f"# {w['key-flows']}\n\n{w['paths']}\n\n{table}"), ("interfaces", f"# {w['interfaces']}\n\n"), ("development-guide", f"# {w['development-guide']}\n\n## {w['languages']}\n\n"),
        )]
        rows += ["SELECT revision_id, 'overview', 1, entity_type, 0, '| ' || entity_type || ' | ' || count(*) || ' |' || chr(10) FROM n GROUP BY revision_id, entity_type"]
        rows += [f"SELECT revision_id, 'overview', 2, '', 0, {quoted(chr(10) + w['entities'] + '：')} || count(*) || {quoted('；' + w['relations'] + '：')} || (SELECT count(*) FROM e WHERE e.revision_id = n.revision_id) || {quoted('。' + chr(10))} FROM n GROUP BY revision_id"]
        for slug, where in (("architecture", "true"), ("key-flows", "relation_type = 'CALLS'")):
            rows += [f"SELECT revision_id, '{slug}', 1, '', i, '| `' || c_name || '` | ' || relation_type || ' | `' || s_name || '` |' || chr(10) FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY edge_id) AS i FROM e WHERE {where}) WHERE i <= 20"]
        rows += [f"SELECT revision_id, 'modules', 1, module, 0, '## `' || module || {quoted('`' + chr(10) * 2 + w['code'] + '：')} || count(*) || chr(10) || chr(10) FROM n GROUP BY revision_id, module"]
        rows += ["SELECT revision_id, 'modules', 1, module, i, '- `' || name || '` (' || entity_type || ')' || chr(10) FROM (SELECT *, row_number() OVER (PARTITION BY revision_id, module ORDER BY name, node_id) AS i FROM n) WHERE i <= 20"]
        rows += [f"SELECT revision_id, 'modules', 1, module, 99, CASE WHEN count(*) > 20 THEN {quoted(w['omitted'])} ELSE '' END || chr(10) FROM n GROUP BY revision_id, module"]
        rows += ["SELECT revision_id, 'interfaces', 1, '', i, '- `' || name || '` — ' || entity_type || chr(10) FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY node_id) AS i FROM n WHERE entity_type = 'INTERFACE') WHERE i <= 20"]
        rows += ["SELECT revision_id, 'development-guide', 1, '', 0, string_agg('- `' || l || '`', chr(10) ORDER BY l) FROM (SELECT revision_id, language AS l FROM n WHERE language IS NOT NULL UNION SELECT revision_id, string_split(path, '.')[-1] FROM n) GROUP BY revision_id"]
        rows += [f"SELECT revision_id, 'development-guide', 2, '', 0, {quoted(chr(10) * 2 + '## ' + w['source paths'] + chr(10) * 2)} || string_agg('- `' || path || '`', chr(10) ORDER BY path) || {quoted(chr(10) + w['refresh'])} FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY path) AS i FROM (SELECT DISTINCT revision_id, path FROM n)) WHERE i <= 20 GROUP BY revision_id"]
        titles = " ".join(f"WHEN '{s}' THEN '{t[i]}'" for s, t in P.TITLES.items())
        return f"""SELECT '{P.LOCALES[i]}' AS locale, b.revision_id, slug, CASE slug {titles} END AS title, rtrim(string_agg(x, '' ORDER BY a, b, c) || {quoted(chr(10) + '## ' + w['evidence'] + chr(10) * 2)} || any_value(lines), chr(10)) AS content_md
            FROM ({' UNION ALL '.join(rows)}) b JOIN cited USING (revision_id) GROUP BY b.revision_id, slug"""

    return f"""WITH k AS (SELECT n_nationkey, 'r' || n_regionkey AS revision_id FROM nation),
        n AS (SELECT revision_id, 'c' || c_custkey AS node_id, 'CLASS' AS entity_type, c_name AS name, lower(c_mktsegment) || '/c' || c_custkey % 7 || '.java' AS path, lower(c_mktsegment) AS module, 1 + c_custkey % 5 AS last, NULL AS language FROM customer JOIN k ON c_nationkey = n_nationkey
              UNION ALL SELECT revision_id, 's' || s_suppkey, 'INTERFACE', s_name, 's' || s_suppkey % 3 || '.go', 'root', 9, 'golang' FROM supplier JOIN k ON s_nationkey = n_nationkey),
        v AS (SELECT DISTINCT revision_id FROM n),
        m AS (SELECT s_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY 1),
        e AS (SELECT revision_id, 'e' || c_custkey AS edge_id, CASE WHEN c_acctbal > 5000 THEN 'CALLS' ELSE 'DEPENDS_ON' END AS relation_type, c_name, s_name FROM customer JOIN k ON c_nationkey = n_nationkey JOIN m ON s_nationkey = c_nationkey JOIN supplier ON s_suppkey = s),
        cited AS (SELECT revision_id, string_agg('- `' || path || ':1-' || last || '` (`' || node_id || '`)' || chr(10), '' ORDER BY i) AS lines
                  FROM (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY path, last, node_id) AS i FROM (SELECT DISTINCT revision_id, path, last, node_id FROM n)) WHERE i <= 20 GROUP BY revision_id),
        p AS ({locale(0)} UNION ALL {locale(1)})
        SELECT revision_id, locale, slug, title, content_md, 20::INTEGER AS n_citations, 'page_' || substring(sha256('t' || chr(0) || r_name || chr(0) || locale || chr(0) || slug || chr(0)), 1, 24) AS page_id,
               CASE WHEN slug <> 'overview' THEN 'page_' || substring(sha256('t' || chr(0) || r_name || chr(0) || locale || chr(0) || 'overview' || chr(0)), 1, 24) END AS parent_page_id FROM p JOIN region ON 'r' || r_regionkey = revision_id"""


@query("wiki_generated_pages", oracle())
def generated(spark, sf_dir):
    rows = P.pages(*graph(spark, sf_dir), locales=P.LOCALES)
    return rows.select("revision_id", "locale", "slug", "title", "content_md", F.size("citations").alias("n_citations"), "page_id", "parent_page_id")
