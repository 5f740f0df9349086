"""Change sets between snapshots: decoding, normalising, filtering, admission of files, and carrying files forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import paths as P

KINDS = ["ADDED", "MODIFIED", "DELETED", "RENAMED", "TYPE_CHANGED"]
MOST_BYTES, MOST_FILES = 2 << 20, 100_000
#: Parsers by extension, or by name for files without a telling one.
PARSERS = {
    ".py": "python",
    **dict.fromkeys([".ts", ".tsx", ".js", ".jsx", ".mts", ".cts"], "typescript"),
    ".java": "java",
    ".rs": "rust",
    ".go": "go",
    **dict.fromkeys([".md", ".mdx", ".rst", ".txt", ".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".properties", ".mod", "dockerfile", "makefile", "requirements.txt"], "text"),
}
#: What a letter of a name-status listing means.
LETTERS = {"A": "ADDED", "M": "MODIFIED", "D": "DELETED", "T": "TYPE_CHANGED"}


def decode_listing(rows: DataFrame, column: str = "listing") -> DataFrame:
    """Changes out of name-status listings with NUL between fields: letter, path, and for renames and copies the new path.

    Records are matched one after another within their row, in time that grows with the listing; an unknown letter gives kind
    null, which normalising refuses, and fields at the end that make no whole record are left out."""
    field, gap = r"[^\x00]++", r"\x00++"
    record = rf"\G\x00*+(?:[RC][^\x00]*+{gap}{field}{gap}{field}|[^RC\x00][^\x00]*+{gap}{field})"
    each = rows.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(record), F.lit(0))).alias("r"))
    each = each.select(F.filter(F.split("r", "\0"), lambda x: x != "").alias("f"))
    three = F.size("f") == 3
    changes = each.select(F.get("f", F.lit(0)).alias("letter"), F.when(three, F.get("f", F.lit(2))).otherwise(F.get("f", F.lit(1))).alias("path"), F.when(three, F.get("f", F.lit(1))).alias("old_path"))
    one = F.substring("letter", 1, 1)
    kind = F.when(one == "R", "RENAMED").when(one == "C", "ADDED")
    for letter, name in LETTERS.items():
        kind = kind.when(one == letter, name)
    return changes.select("path", F.when(one == "R", F.col("old_path")).alias("old_path"), kind.alias("kind"))


def normalised(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes with canonical paths, each once, and those that are refused with a reason."""
    rows = changes.select(F.col("path").alias("raw"), P.canonical_path(F.col("path")).alias("path"), P.canonical_path(F.col("old_path")).alias("old_path"), "kind")
    rename = F.col("kind") == "RENAMED"
    reason = F.when(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), "kind").when(F.col("path").isNull(), "path").when(rename & F.col("old_path").isNull(), "old path missing").when(~rename & F.col("old_path").isNotNull(), "old path unexpected")
    told = rows.withColumn("reason", reason)
    return told.where("reason IS NULL").select("path", "kind", "old_path").dropDuplicates(), told.where("reason IS NOT NULL").select("raw", "kind", "reason")


def within(changes: DataFrame, patterns: list[str]) -> DataFrame:
    """Changes inside the patterns; a rename over their border becomes an addition or a deletion."""
    new, old = P.included(F.col("path"), patterns), P.included(F.col("old_path"), patterns)
    rename = F.col("kind") == "RENAMED"
    leaves, enters = rename & old & ~new, rename & ~old & new
    return changes.where(new | (rename & old)).select(
        F.when(leaves, F.col("old_path")).otherwise(F.col("path")).alias("path"),
        F.when(leaves, "DELETED").when(enters, "ADDED").otherwise(F.col("kind")).alias("kind"),
        F.when(rename & new & old, F.col("old_path")).alias("old_path"),
    )


def deleted_paths(changes: DataFrame) -> DataFrame:
    """Paths that are gone: deleted ones and old names."""
    return changes.where("kind = 'DELETED'").select("path").union(changes.where("kind = 'RENAMED'").select("old_path")).distinct()


def routed(files: DataFrame) -> DataFrame:
    """Files with their parser, by extension or else by name; null if none."""
    table = F.create_map(*(F.lit(x) for kv in PARSERS.items() for x in kv))
    return files.withColumn("parser", F.coalesce(table[P.extension(F.col("path"))], table[F.lower(P.basename(F.col("path")))]))


def admitted(files: DataFrame) -> DataFrame:
    """Files with the reason for which they are skipped, or null: unsupported, too_large, binary."""
    content = F.col("content").cast("binary")
    binary = F.position(F.lit(b"\0"), content) > 0
    invalid = ~F.is_valid_utf8(content.cast("string"))
    return routed(files).withColumn("skipped", F.when(F.col("parser").isNull(), "unsupported").when(F.octet_length(content) > MOST_BYTES, "too_large").when(binary | invalid, "binary"))


def overfull(files: DataFrame, key: str, most: int = MOST_FILES) -> DataFrame:
    """Snapshots with more files than one may have; such a snapshot is refused whole."""
    return files.groupBy(key).agg(F.count("*").alias("files")).where(F.col("files") > most)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and kind of what differs between two tables of path and content_hash."""
    a, b = old.select("path", F.col("content_hash").alias("before")), new.select("path", F.col("content_hash").alias("after"))
    kind = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "DELETED").when(F.col("before") != F.col("after"), "MODIFIED")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind")).where("kind IS NOT NULL")


def carried_forward(parent: DataFrame, child: DataFrame, gone: DataFrame) -> DataFrame:
    """A child snapshot whole: its own rows, and the parent's rows of paths that neither changed nor went."""
    touched = child.select("path").union(gone.select("path")).distinct()
    return parent.join(touched, "path", "left_anti").unionByName(child)
