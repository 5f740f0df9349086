"""Validation of artifacts and relations, quarantine of bad rows, and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.graph import cut

#: Kinds, and codes in the order in which they are tried.
ARTIFACT_KINDS = ["FILE", "MODULE", "CLASS", "INTERFACE", "FUNCTION", "METHOD", "IMPORT", "CONFIG", "DOCUMENT"]
RELATION_KINDS = ["CONTAINS", "CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "DEPENDS_ON"]
SAMPLE = 20
#: Bytes of relations with a refused candidate that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 * 1024**2
JOB_TRANSITIONS = [("PENDING", "BUILDING"), ("PENDING", "CANCELLED"), ("PENDING", "FAILED"), ("BUILDING", "SUCCEEDED"), ("BUILDING", "FAILED"), ("BUILDING", "CANCELLED")]
ATTEMPT_TRANSITIONS = [("RUNNING", "SUCCEEDED"), ("RUNNING", "FAILED"), ("RUNNING", "LOST"), ("RUNNING", "CANCELLED")]
CANDIDATE_TRANSITIONS = [("STAGING", "SEALED"), ("STAGING", "FAILED")]


def valid_source_ref(ref: str = "source_ref") -> Column:
    """Whether a source reference has a commit, a relative path that does not escape, and lines in order."""
    path = F.col(f"{ref}.path")
    text = lambda c: F.coalesce(F.trim(F.col(f"{ref}.{c}")), F.lit("")) != ""
    inside = ~F.coalesce(path, F.lit("")).rlike(r"^(/|[A-Za-z]:|\\)|(^|/)\.\.(/|$)")
    lines = (F.col(f"{ref}.start_line") >= 1) & (F.col(f"{ref}.end_line") >= F.col(f"{ref}.start_line"))
    return F.coalesce(text("commit_sha") & text("path") & inside & lines, F.lit(False))


def classify_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts with the first error code that holds, or null."""
    data = F.coalesce(F.trim("name"), F.lit("")) == ""
    code = F.when(~F.coalesce(F.col("kind").isin(ARTIFACT_KINDS), F.lit(False)), "INVALID_ARTIFACT_TYPE").when(data, "INVALID_ARTIFACT_DATA").when(~valid_source_ref(), "INVALID_ARTIFACT_SOURCE_REF")
    return artifacts.withColumn("error_code", code)


def classify_relations(relations: DataFrame, invalid: DataFrame) -> DataFrame:
    """Relations with the first error code that holds, or null. invalid: artifact_id of artifacts that were refused.

    relations: from_ref, to_ref, kind, confidence and, where they are known, candidates (ids that an ambiguous name may mean),
    evidence (a source reference), status (RESOLVED, EXTERNAL, AMBIGUOUS, UNRESOLVED) and external_identity."""
    bad = invalid.select(F.col("artifact_id").alias("bad_id")).distinct()
    rows, has = relations, set(relations.columns)
    for c in ("from_ref", "to_ref"):
        rows = rows.join(bad.select(F.col("bad_id").alias(f"bad_{c}")), F.col(c) == F.col(f"bad_{c}"), "left")
    is_now = lambda status: F.coalesce(F.col("status") == status, F.lit(False)) if "status" in has else F.lit(True)
    isolated = F.col("bad_from_ref").isNotNull() | (F.col("bad_to_ref").isNotNull() & is_now("RESOLVED"))
    confidence = F.col("confidence").cast("double")
    more = F.when(F.lit(False), "")
    if "candidates" in has:
        each = relations.select("from_ref", "to_ref", "kind", "candidates").withColumn("candidate", F.explode("candidates")).join(bad, F.col("candidate") == F.col("bad_id"), "left_semi")
        hit = cut(each.select(F.col("from_ref").alias("hit_from"), F.col("to_ref").alias("hit_to"), F.col("kind").alias("hit_kind"), F.col("candidates").alias("hit_candidates")).distinct())
        if (hit.agg(F.sum(F.octet_length(F.to_json(F.struct(*hit.columns))).cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
            hit = F.broadcast(hit)  # so that rows with all they carry are not shuffled
        rows = rows.join(hit, F.col("from_ref").eqNullSafe(F.col("hit_from")) & F.col("to_ref").eqNullSafe(F.col("hit_to")) & F.col("kind").eqNullSafe(F.col("hit_kind")) & F.col("candidates").eqNullSafe(F.col("hit_candidates")), "left")
        isolated = isolated | (F.col("hit_candidates").isNotNull() & is_now("AMBIGUOUS"))
    if "status" in has:
        count = F.coalesce(F.size("candidates"), F.lit(0)) if "candidates" in has else F.lit(0)
        outside = F.coalesce(F.trim("external_identity"), F.lit("")) != "" if "external_identity" in has else F.lit(False)
        target = F.coalesce(F.trim("to_ref"), F.lit("")) != ""
        known = F.coalesce(F.col("status"), F.lit(""))
        more = (
            F.when((known == "EXTERNAL") & (~outside | target | (count > 0)), "INVALID_EXTERNAL_IDENTITY")
            .when((known == "AMBIGUOUS") & ((count < 2) | target | outside), "INVALID_AMBIGUOUS_RELATION")
            .when((known == "UNRESOLVED") & (target | outside | (count > 0)), "INVALID_UNRESOLVED_RELATION")
            .when(~known.isin("RESOLVED", "EXTERNAL", "AMBIGUOUS", "UNRESOLVED"), "INVALID_RESOLUTION_STATUS")
        )
    code = (
        F.when(isolated, "RELATION_REFERENCES_INVALID_ARTIFACT")
        .when(~F.coalesce(F.col("kind").isin(RELATION_KINDS), F.lit(False)), "INVALID_RELATION_TYPE")
        .when(confidence.isNull() | F.isnan(confidence) | ~confidence.between(0, 1), "INVALID_RELATION_CONFIDENCE")
        .when(~valid_source_ref("evidence") if "evidence" in has else F.lit(False), "INVALID_RELATION_SOURCE_REF")
        .otherwise(more)
    )
    return rows.withColumn("error_code", code).select(*relations.columns, "error_code")


def split(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return classified.where("error_code IS NULL").drop("error_code"), classified.where("error_code IS NOT NULL")


def error_counts(classified: DataFrame) -> DataFrame:
    return classified.where("error_code IS NOT NULL").groupBy("error_code").agg(F.count("*").alias("n"))


def error_sample(classified: DataFrame, key: str, most: int = SAMPLE) -> DataFrame:
    """The first bad rows in id order."""
    return classified.where("error_code IS NOT NULL").orderBy(key).limit(most)


def gate(classified: DataFrame, most: int | None = None, most_ratio: float = 1.0) -> DataFrame:
    """One row: total, invalid, ratio (0 of nothing) and status."""
    row = classified.agg(F.count("*").alias("total"), F.count("error_code").alias("invalid")).withColumn("ratio", F.when(F.col("total") == 0, 0.0).otherwise(F.col("invalid") / F.col("total")))
    over = (F.col("ratio") > most_ratio) if most is None else (F.col("ratio") > most_ratio) | (F.col("invalid") > most)
    return row.withColumn("status", F.when(over, "FAILED").when(F.col("invalid") > 0, "DEGRADED").otherwise("HEALTHY"))


def over_capacity(rows: DataFrame, most_bytes: int = 256 * 1024) -> DataFrame:
    """Rows whose JSON is longer than a record may be."""
    return rows.withColumn("record_bytes", F.octet_length(F.to_json(F.struct(*rows.columns)))).where(F.col("record_bytes") > most_bytes)


def conflicting(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Keys that occur with more than one content."""
    return rows.groupBy(key).agg(F.count("*").alias("copies"), F.count_distinct(content).alias("kinds")).where("kinds > 1")


def page_stream(rows: DataFrame, stream: str, order: list[str], key: str, declared: int) -> DataFrame:
    """One row: keys out of order in their stream, rows, and whether they are as many as declared."""
    before = F.lag(key).over(Window.partitionBy(stream).orderBy(*order))
    return rows.select(key, before.alias("before")).agg(F.count_if(F.col(key) <= F.col("before")).alias("out_of_order"), F.count("*").alias("n")).withColumn("complete", F.col("n") == declared)


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def illegal_transitions(history: DataFrame, key: str, status: str, order: list[str], allowed: list[tuple[str, str]] = JOB_TRANSITIONS) -> DataFrame:
    """Changes of status that are not allowed."""
    table = history.sparkSession.createDataFrame(allowed, "before string, after string")
    steps = history.select(key, F.lag(status).over(Window.partitionBy(key).orderBy(*order)).alias("before"), F.col(status).alias("after")).where("before IS NOT NULL AND before <> after")
    return steps.join(F.broadcast(table), ["before", "after"], "left_anti")


def mismatches(stored: DataFrame, expected: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Names of the columns in which a stored row and the expected one differ."""
    pairs = stored.alias("s").join(expected.alias("e"), key)
    names = F.array_compact(F.array(*(F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")), c) for c in columns)))
    return pairs.select(key, names.alias("different")).where(F.size("different") > 0)
