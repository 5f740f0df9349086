"""Registered queries: structure of sources in five languages, one file an order, one method a line of it.

Files differ by the lines of their orders; every second method has its parameters over several lines, and strings and
comments hold brackets. The SQL derives places by running sums of the lines' sizes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators import structure as S
from weft.plans.registry import query
from weft.sources.tables import table

#: Of each language: the file's ending, the lines before the methods, those of a method over several lines and of a short
#: one, the lines after the methods. {k} order, {c} customer, {n} line, {p} the line before it (or itself), {t} part.
SOURCES = {
    "python": ("py", ["import mod{c}", "", "class Order{k}(Base{c}, Row):"], ["    def line{n}(", "        self, qty={n}", "    ):", '        return self.line{p}() + part{t}("}}{{ f(")  # g(2)', ""], ["    def line{n}(self):", "        return part{t}(1)", ""], []),
    "typescript": ("ts", ["import {{ Base }} from './mod{c}';", "export class Order{k}<T> extends Base{c}<T> implements Row {{"], ["  line{n}(", "    qty: number = {n},", "  ): number {{", "    return this.line{p}() + part{t}(`}}{{ f(`);", "  }}"], ["  async line{n}(x: string): Promise<number> {{", '    return part{t}("}}"); // }} g(2)', "  }}"], ["}}"]),
    "java": ("java", ["import app.mod{c};", "public class Order{k}<T> extends Base{c}<T> implements Row {{"], ["  public int line{n}(", "      int qty,", "      String s) throws Bad {{", "    return line{p}({n}) + part{t}('}}');", "  }}"], ["  static int line{n}(String x) {{", '    return part{t}("}} f("); /* }} g(2) */', "  }}"], ["}}"]),
    "rust": ("rs", ["use mod{c};", "pub struct Order{k}<T> {{ id: T }}", "impl<T: Base{c}> Order{k}<T> {{"], ["    pub fn line{n}(", "        &self,", "    ) -> i64 {{", "        line{p}(self) + part{t}('}}')", "    }}"], ["    fn line{n}(x: &'static str) -> i64 {{", '        part{t}("}} f(") // }} g(2)', "    }}"], ["}}"]),
    "go": ("go", ["package orders", "", 'import "mod{c}"', "", "type Order{k} struct {{", "\tid int // }}", "}}"], ["func (o *Order{k}) line{n}(", "\tqty int,", ") int {{", "\treturn o.line{p}({n}) + part{t}('}}')", "}}"], ["func line{n}(x string) int {{", '\treturn part{t}("}} f(") // }} g(2)', "}}"], []),
}


def filled(lines: list[str], columns: dict[str, str]):
    """A column: the lines, with columns in their places."""
    parts = []
    for piece in ("\n".join(lines) + "\n").replace("{{", "\1").replace("}}", "\2").split("{"):
        head, close, rest = piece.partition("}")
        parts += [F.col(columns[head]).cast("string"), F.lit(rest.replace("\1", "{").replace("\2", "}"))] if close else [F.lit(piece.replace("\1", "{").replace("\2", "}"))]
    return F.concat(*parts)


def sources(spark, sf_dir, language: str):
    """path, content and parser of a file for each order with lines."""
    ending, head, long, short, tail = SOURCES[language]
    before = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(before, "l_linenumber").alias("before"))
    names = {"k": "l_orderkey", "n": "l_linenumber", "p": "before", "t": "l_partkey"}
    text = F.when(F.col("l_linenumber") % 2 == 1, filled(long, names)).otherwise(filled(short, names))
    bodies = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("t")))), lambda x: x["t"]), "").alias("body"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(bodies, F.col("o_orderkey") == F.col("l_orderkey"))
    content = F.concat(filled(head, {"k": "o_orderkey", "c": "o_custkey"}), "body", F.lit("".join(x.replace("}}", "}") + "\n" for x in tail)))
    return orders.select(F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit("." + ending)).alias("path"), content.alias("content"), F.lit(language).alias("parser"))


def outline(spark, sf_dir, language: str):
    """path, kind, name, target, first and last line: artifacts (without a target), and relations by qualified names."""
    return S.listed(sources(spark, sf_dir, language))


def oracle(language: str) -> str:
    ending, head, long, short, tail = SOURCES[language]
    stem = {"python": "'src/o' || k", "rust": "'src/o' || k", "go": "'orders'"}.get(language, f"'src/o' || k || '.{ending}'")
    dot = "::" if language == "rust" else "."
    owner = f"{stem} || '{dot}Order' || k"
    odd = "n % 2 = 1"
    method = f"({owner} || '{dot}line' || %s)" if language != "go" else f"(CASE WHEN %s % 2 = 1 THEN {owner} ELSE {stem} END || '.line' || %s)"
    name, before = (method.replace("%s", x) for x in ("n", "p"))
    gap = 1 if language == "python" else 0  # the blank line after a method
    end = f"place + CASE WHEN {odd} THEN {len(long) - 1 - gap} ELSE {len(short) - 1 - gap} END"
    call = f"place + CASE WHEN {odd} THEN 3 ELSE 1 END"
    root, top = f"'src/o' || k || '.{ending}'", {"python": 3, "rust": 2, "go": 5}.get(language, 2)
    class_end = {"python": "total - 1", "rust": "2", "go": "7"}.get(language, "total + 1")
    container = {"rust": root, "go": "'orders'"}.get(language, owner)
    kind = f"CASE WHEN {odd} THEN 'METHOD' ELSE 'FUNCTION' END" if language == "go" else "'METHOD'"
    # the call of the line before: bound, a symbol, or none (Rust leaves a function's own name out)
    target = {"python": before, "typescript": "'symbol:this.line' || p", "java": "'symbol:line' || p", "rust": before, "go": before}[language]
    module = "'app.mod' || c" if language == "java" else "'./mod' || c" if language == "typescript" else "'mod' || c"
    import_line = 3 if language == "go" else 1
    importer = "'orders'" if language == "go" else root
    rows = [
        f"SELECT path, 'FILE', {root}, NULL, 1, total + 1 + {len(tail)} FROM o",
        f"SELECT path, 'IMPORT', {module}, NULL, {import_line}, {import_line} FROM o",
        f"SELECT path, 'IMPORTS', {importer}, 'module:' || {module}, {import_line}, {import_line} FROM o",
        f"SELECT path, 'CLASS', {owner}, NULL, {top}, {class_end} FROM o",
        f"SELECT path, 'CONTAINS', {'%s' % (chr(39) + 'orders' + chr(39)) if language == 'go' else root}, {owner}, {top}, {top} FROM o",
        f"SELECT path, {kind}, {name}, NULL, place, {end} FROM l",
        f"SELECT path, 'CONTAINS', {container}, {name}, place, place FROM l",
        f"SELECT path, 'CALLS', {name}, 'symbol:part' || t, {call}, {call} FROM l",
        f"SELECT path, 'CALLS', {name}, {target}, {call}, {call} FROM l WHERE {odd}" + (" AND p <> n" if language == "rust" else ""),
    ]
    if language == "go":
        rows += [f"SELECT path, 'MODULE', 'orders', NULL, 1, 1 FROM o", f"SELECT path, 'CONTAINS', {root}, 'orders', 1, 1 FROM o"]  # noqa: F541
    elif language != "rust":
        rows += [f"SELECT path, 'EXTENDS', {owner}, 'symbol:Base' || c, {top}, {top} FROM o", f"SELECT path, '{'EXTENDS' if language == 'python' else 'IMPLEMENTS'}', {owner}, 'symbol:Row', {top}, {top} FROM o"]
    rows[0] = rows[0].replace("SELECT path, 'FILE'", "SELECT path, 'FILE' AS kind").replace(f"{root}, NULL, 1, total", f"{root} AS name, NULL AS target, 1 AS first, total").replace(" FROM o", " AS last FROM o")
    return f"""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS t, CASE WHEN l_linenumber % 2 = 1 THEN {len(long)} ELSE {len(short)} END AS size,
            coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), l_linenumber) AS p FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey),
        l AS (SELECT *, 'src/o' || k || '.{ending}' AS path, {len(head)} + 1 + sum(size) OVER (PARTITION BY k ORDER BY n) - size AS place FROM s),
        o AS (SELECT o_orderkey AS k, o_custkey AS c, 'src/o' || o_orderkey || '.{ending}' AS path, {len(head)} + sum(size) AS total FROM orders JOIN s ON o_orderkey = s.k GROUP BY ALL)
        SELECT path, kind, name, target, first::INTEGER AS first, last::INTEGER AS last FROM ({' UNION ALL '.join(rows)})"""


def register(language: str) -> None:
    @query(f"extract_structure_{language}", oracle(language))
    def structure(spark, sf_dir):
        return outline(spark, sf_dir, language)


for each in SOURCES:
    register(each)
