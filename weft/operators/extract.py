"""Artifacts and relations out of source files.

Calls, imports, bases and manifests are column expressions over lines, for files without a parser of their own. Nested
structure, with calls bound to their functions, is `weft.operators.structure`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words before a bracket that are no calls, and what a name is.
NO_CALLS = ["if", "for", "while", "switch", "catch", "return", "new", "function", "def", "class", "super", "this"]
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
CONFIDENCE = {"CALLS": 0.65, "IMPORTS": 1.0, "EXTENDS": 0.9, "IMPLEMENTS": 0.9, "DEPENDS_ON": 0.95, "CONTAINS": 1.0}


def lines_of(files: DataFrame, content: str = "content") -> DataFrame:
    """path, line (from 1) and text of every line."""
    return files.select("path", F.posexplode(F.split(F.col(content).cast("string"), "\n")).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def called(text: Column) -> Column:
    """Distinct names before an opening bracket, without keywords and without the name that the line declares."""
    names = F.regexp_extract_all(text, F.lit(rf"\b({NAME}(?:\.{NAME})?)\s*\("), 1)
    declared = F.regexp_extract(text, rf"^\s*(?:export\s+|pub\s+|async\s+)*(?:def|function|fn|func|class)\s+({NAME})", 1)
    return F.array_except(F.array_distinct(names), F.array(*map(F.lit, NO_CALLS), declared))


def calls(lines: DataFrame) -> DataFrame:
    """A call relation for each name and line."""
    return lines.select("path", "line", F.explode(called(F.col("text"))).alias("name")).select("path", "line", F.concat(F.lit("symbol:"), "name").alias("target"), F.lit("CALLS").alias("kind"), F.lit(CONFIDENCE["CALLS"]).alias("confidence"))


def imports(lines: DataFrame) -> DataFrame:
    """Import relations of Python, TypeScript, Java and Rust lines."""
    forms = [r"^\s*import\s+([A-Za-z_][\w.]*)\s*;?\s*$", r"^\s*from\s+([\w.]+)\s+import\b", r"""^\s*import\b.*\bfrom\s+['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]""", r"^\s*(?:pub\s+)?use\s+([\w:]+)"]
    name = F.coalesce(*(F.nullif(F.regexp_extract("text", f, 1), F.lit("")) for f in forms))
    return lines.select("path", "line", name.alias("name")).where("name IS NOT NULL").select("path", "line", F.concat(F.lit("module:"), "name").alias("target"), F.lit("IMPORTS").alias("kind"), F.lit(CONFIDENCE["IMPORTS"]).alias("confidence"))


def bases(lines: DataFrame) -> DataFrame:
    """Relations to what a class line extends and implements."""
    python = F.regexp_extract("text", r"^\s*class\s+\w+\s*\(([^)]*)\)\s*:", 1)
    extends = F.regexp_extract("text", r"\b(?:class|interface)\s+\w+[^{]*\bextends\s+([\w., ]+?)(?:\s+implements\b|\s*\{|$)", 1)
    implements = F.regexp_extract("text", r"\bimplements\s+([\w., ]+?)(?:\s*\{|$)", 1)
    each = F.array(F.struct(F.lit("EXTENDS").alias("kind"), F.concat_ws(",", python, extends).alias("names")), F.struct(F.lit("IMPLEMENTS").alias("kind"), implements.alias("names")))
    rows = lines.select("path", "line", F.explode(each).alias("e")).select("path", "line", "e.kind", F.explode(F.split("e.names", ",")).alias("name"))
    name = F.trim("name")
    return rows.where((name != "") & ~name.contains("=")).select("path", "line", F.concat(F.lit("symbol:"), name).alias("target"), "kind", F.lit(CONFIDENCE["EXTENDS"]).alias("confidence"))


def dependencies(files: DataFrame) -> DataFrame:
    """Packages that manifests name: package.json, requirements.txt, pom.xml and go.mod."""
    base, text = F.lower(F.substring_index("path", "/", -1)), F.col("content").cast("string")
    sections = [F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{s}"), "map<string,string>")), F.array().cast("array<string>")) for s in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    python = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)"), 1)
    maven = F.regexp_extract_all(text, F.lit(r"<artifactId>\s*([^<\s]+)\s*</artifactId>"), 1)
    go = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[\w./-]+)\s+v\d"), 1)
    names = F.when(base == "package.json", F.concat(*sections)).when(base == "requirements.txt", python).when(base == "pom.xml", maven).when(base == "go.mod", go)
    return files.select("path", F.explode(F.array_sort(F.array_distinct(names))).alias("name")).select("path", F.concat(F.lit("package:"), "name").alias("target"), F.lit("DEPENDS_ON").alias("kind"), F.lit(CONFIDENCE["DEPENDS_ON"]).alias("confidence"))


def indented_ends(lines: DataFrame) -> DataFrame:
    """end_line of every line: the last before a later line that is indented no deeper; blank lines end nothing."""
    own = F.char_length(F.regexp_extract("text", r"^([ \t]*)", 1))
    filled = lines.where(F.trim("text", F.lit(" \t\r")) != "").select("path", "line", own.alias("indent"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lines come by path and number; open ones are a stack, so each is pushed and popped once."""
        now, stack, before = None, [], 0
        for batch in batches:
            closed = []
            for path, line, indent in zip(batch["path"], batch["line"], batch["indent"]):
                if path != now:
                    closed += [(now, n, before) for n, _ in stack]
                    now, stack = path, []
                while stack and indent <= stack[-1][1]:
                    closed.append((now, stack.pop()[0], before))
                stack.append((line, indent))
                before = line
            yield pd.DataFrame(closed, columns=["path", "line", "end_line"])
        yield pd.DataFrame([(now, n, before) for n, _ in stack], columns=["path", "line", "end_line"])

    return filled.repartition("path").sortWithinPartitions("path", "line").mapInPandas(run, "path string, line int, end_line int")


def stripped(text: Column) -> Column:
    """A line without its strings and the comments that end on it."""
    return F.regexp_replace(text, r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|/\*.*?\*/|//.*$""", "")


def brace_depth(lines: DataFrame) -> DataFrame:
    """Lines with the depth of braces after them; strings and comments do not count."""
    bare = stripped(F.col("text"))
    balance = F.char_length(F.regexp_replace(bare, "[^{]", "")) - F.char_length(F.regexp_replace(bare, "[^}]", ""))
    return lines.withColumn("depth", F.sum(balance).over(Window.partitionBy("path").orderBy("line")))


#: Fixed value: what the version of a set of parsers begins with.
PARSER_SET = "registry@2:"


def parser_set_versions(parsers: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """For each key the version of its whole set of parsers: a digest of the sorted distinct versions."""
    joined = F.array_join(F.array_sort(F.collect_set(version)), "\0")
    return parsers.groupBy(*keys).agg(F.concat(F.lit(PARSER_SET), F.substring(F.sha2(joined.cast("binary"), 256), 1, 16)).alias("parser_set"))
