"""Change proposals as rows: each file change, and the proposal around them, with the first reason against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.qa import LIFECYCLE, RISKS

#: Changes and bytes of diff that a proposal has at most; intents.
MOST_CHANGES, MOST_BYTES = 20, 1 << 20
INTENTS = ["EXPLAIN", "REFACTOR", "PATCH"]


def cleaned(path: Column) -> Column:
    """A path without empty and `.` segments, each `..` having taken the segment before it; `.` if nothing is left."""
    last = lambda seen: F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(".."))
    fold = lambda seen, s: (
        F.when((s == "") | (s == "."), seen).when((s == "..") & (last(seen) != ".."), F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(s)))
    )
    parts = F.aggregate(F.split(F.trim(path, F.lit(" \t\r\n")), "/"), F.array().cast("array<string>"), fold)
    return F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/"))


def change_problem(path: Column, base: Column, diff: Column, clean: Column) -> Column:
    """Why one file change is refused, or null. clean: the path as `cleaned`."""
    path, base = F.coalesce(path, F.lit("")), F.coalesce(base, F.lit(""))
    text = F.replace(F.coalesce(diff, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    head = F.concat(F.lit("--- a/"), clean, F.lit("\n+++ b/"), clean, F.lit("\n"))
    rest = F.substring(text, F.char_length(head) + 1, F.char_length(text))
    other = F.lit(False)
    for mark in LIFECYCLE:
        other = other | rest.contains(mark)
    return (
        F.when(path.rlike(r"[\r\n\x00]|^/") | (clean == ".") | clean.rlike(r"^\.\.(/|$)"), "path")
        .when(~base.startswith("sha256:") | (F.char_length(base) < 15), "base hash")
        .when((F.trim(text, F.lit(" \t\n\r")) == "") | text.contains("GIT binary patch") | text.contains("\0"), "text")
        .when(~text.startswith(head) | ~text.contains("\n@@ "), "header")
        .when(other, "lifecycle")
    )


def problems(proposals: DataFrame, files: DataFrame | None = None, most_changes: int = MOST_CHANGES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Proposals with the first reason against them, or null.

    proposals: proposal_id (a key), session_id, user_id, snapshot_id, base_commit_sha, intent, summary, risk_level,
    file_changes (path, base_content_hash, unified_diff) and citations (source references). files: base_commit_sha, path and
    content_hash of files; where it is given, each change must name a known file and its hash at the base commit."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    each = proposals.select("proposal_id", "base_commit_sha", F.posexplode("file_changes").alias("at", "c")).select("proposal_id", "base_commit_sha", "at", "c.*").withColumn("clean", cleaned(F.coalesce("path", F.lit(""))))
    each = each.withColumn("problem", change_problem(F.col("path"), F.col("base_content_hash"), F.col("unified_diff"), F.col("clean")))
    each = each.select("proposal_id", "base_commit_sha", "at", "clean", "problem", F.octet_length("unified_diff").cast("long").alias("bytes"), F.col("base_content_hash").alias("base"))
    stale = F.lit(None).cast("string")
    if files is not None:  # met here, so that changes are made once
        known = files.select(F.col("base_commit_sha"), F.col("path").alias("clean"), "content_hash").dropDuplicates(["base_commit_sha", "clean"])
        each = each.join(known, ["base_commit_sha", "clean"], "left")
        differs = ~F.col("base").eqNullSafe(F.col("content_hash"))
        unknown = F.max((differs & F.col("content_hash").isNull()).cast("int")) == 1
        stale = F.when(unknown, "unknown file").when(F.max(differs.cast("int")) == 1, "stale base hash")
    bad = F.col("problem").isNotNull()
    sums = each.groupBy("proposal_id").agg(F.count("*").alias("_changes"), F.size(F.collect_set("clean")).cast("long").alias("_paths"), F.sum("bytes").alias("_bytes"), F.min_by(F.when(bad, F.col("problem")), F.when(bad, F.col("at"))).alias("_first"), stale.alias("_stale"))
    rows = proposals.join(sums, "proposal_id", "left")
    changes, explains, first = F.coalesce("_changes", F.lit(0)), F.col("intent") == "EXPLAIN", F.col("_first")
    cited = F.coalesce(F.size("citations"), F.lit(0))
    unsound = lambda c: blank(c["commit_sha"]) | blank(c["path"]) | c["path"].rlike(r"^/|(^|/)\.\.(/|$)") | ~F.coalesce((c["start_line"] >= 1) & (c["end_line"] >= c["start_line"]), F.lit(False))
    reason = (
        F.when(blank(F.col("proposal_id")) | blank(F.col("session_id")) | blank(F.col("user_id")) | blank(F.col("snapshot_id")) | blank(F.col("base_commit_sha")), "identity")
        .when(blank(F.col("summary")), "summary")
        .when(~F.coalesce(F.col("risk_level").isin(RISKS), F.lit(False)), "risk")
        .when(~F.coalesce(F.col("intent").isin(INTENTS), F.lit(False)), "intent")
        .when(explains != (changes == 0), "changes of the intent")
        .when(changes > most_changes, "number of changes")
        .when(first.isNotNull(), F.concat(F.lit("change: "), first))
        .when(F.col("_paths") < changes, "repeated path")
        .when(F.col("_bytes") > most_bytes, "bytes of diff")
        .when(cited <= 0, "no citation")
        .when(F.exists("citations", unsound), "citation")
        .when(F.exists("citations", lambda c: c["commit_sha"] != F.col("base_commit_sha")), "citation of another commit")
    )
    return rows.withColumn("reason", F.coalesce(reason, F.col("_stale"))).drop("_changes", "_paths", "_bytes", "_first", "_stale")
