"""The build of a graph revision as one flow: metadata, artifacts, relations, quality, seal, activation.

Bad rows are quarantined and counted; broken parser data (rows without identity, counts or commits other than declared,
resolved relations without a target) and data beyond capacity refuse the whole build; so does quality below the policy.
Each table is written by one Spark job; what reaches the driver is counts. Classified relations are written once, and all that
is told of them is read there; that copy goes when the quarantine and the sound relations are written. A refused build
activates nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import stable_id
from weft.operators import graph, validate
from weft.operators.ops import payloads
from weft.sources import revisions


class Refused(ValueError):
    """A build that must not be tried again with the same data; `code` says why."""

    def __init__(self, code: str, stage: str, message: str):
        super().__init__(f"{code} in {stage}: {message}")
        self.code, self.stage = code, stage


#: The limits and the policy of a build where the caller names no others.
@dataclass(frozen=True)
class Limits:
    artifacts: int = 1_000_000
    relations: int = 5_000_000
    record_bytes: int = 256 * 1024
    properties: int = 256
    candidates: int = 100
    revision_bytes: int = 4 * 1024**3
    samples: int = 20
    invalid_artifacts: int = 100
    invalid_artifact_ratio: float = 0.001
    invalid_relations: int = 500
    invalid_relation_ratio: float = 0.001


@dataclass(frozen=True)
class Job:
    """What a build is for. declared_*: the counts that the parser's manifest tells."""

    tenant_id: str
    repository_id: str
    snapshot_id: str
    revision_id: str
    commit_sha: str
    declared_artifacts: int
    declared_relations: int
    parser_result_version: str = "1"
    graph_schema_version: str = "1"
    algorithm_version: str = "1"
    build_policy_version: str = "1"
    trace_id: str = ""
    parent: str | None = None


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def record_bytes(rows: DataFrame) -> Column:
    return F.octet_length(F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != "error_code"))))


def checked(rows: DataFrame, key: str, hard: Column, lists: Column, commit: Column, job: Job) -> dict:
    """Counts of classified rows in one aggregate; conflicts of identity in another. Rows of one id and content count once."""
    size = record_bytes(rows)
    sums = rows.agg(
        F.count("*").alias("input"),
        F.count("error_code").alias("invalid"),
        F.count_if(hard).alias("broken"),
        F.count_if(~commit.eqNullSafe(F.lit(job.commit_sha)) & F.col("error_code").isNull()).alias("other_commit"),
        F.coalesce(F.max(size), F.lit(0)).alias("largest"),
        F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(lists), F.lit(0)).alias("longest_list"),
    )
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return {**sums.first().asDict(), "repeated": repeated}


def refuse(stage: str, n: dict, declared: int, most: int, most_list: int, before: int, limits: Limits, most_invalid: int, most_ratio: float) -> None:
    if n["broken"]:
        raise Refused("PARSER_RESULT_INVALID", stage, f"{n['broken']} rows without a sound identity")
    if n["repeated"]:
        raise Refused("PARSER_RESULT_INVALID", stage, "an identity occurs more than once")
    if n["input"] != declared or n["other_commit"]:
        raise Refused("PARSER_RESULT_CHANGED", stage, f"{n['input']} rows, {declared} declared; {n['other_commit']} of another commit")
    if n["input"] > most or n["largest"] > limits.record_bytes or n["longest_list"] > most_list or before + n["bytes"] > limits.revision_bytes:
        raise Refused("BUILD_CAPACITY_EXCEEDED", stage, f"{n['input']} rows, {n['bytes']} bytes, {n['largest']} in the largest, a list of {n['longest_list']}")
    if n["invalid"] > most_invalid or n["input"] and n["invalid"] / n["input"] > most_ratio:
        raise Refused("GRAPH_VALIDATION_FAILED", "quality", f"{n['invalid']} of {n['input']} rows are invalid in {stage}")


def seal(job: Job, folder: str, expected: dict, rows: DataFrame) -> None:
    """What was written, held against what should be: counts, scope, and both ends of every edge. rows: any DataFrame of the session."""
    spark = rows.sparkSession
    nodes, edges, facts = (spark.read.parquet(f"{folder}/{t}") for t in ("nodes", "edges", "relations"))
    scope = lambda t: F.count_if(~(F.col("tenant_id").eqNullSafe(job.tenant_id) & F.col("repository_id").eqNullSafe(job.repository_id) & F.col("snapshot_id").eqNullSafe(job.snapshot_id) & F.col("revision_id").eqNullSafe(job.revision_id))).alias("foreign")
    n = nodes.agg(F.count_if(F.col("artifact_id").isNotNull()).alias("nodes"), scope(nodes)).first()
    m = facts.agg(F.count("*").alias("relations"), scope(facts)).first()
    loose = graph.integrity(nodes.select("node_id"), edges).first().asDict()
    found = {"nodes": n["nodes"], "relations": m["relations"], "foreign": n["foreign"] + m["foreign"], **loose}
    want = {"nodes": expected["nodes"], "relations": expected["relations"], "foreign": 0, **dict.fromkeys(loose, 0)}
    if found != want:
        raise Refused("GRAPH_INTEGRITY_FAILED", "seal", str({k: (found[k], want[k]) for k in want if found[k] != want[k]}))


def build(artifacts: DataFrame, relations: DataFrame, root: str, job: Job, limits: Limits = Limits()) -> dict:
    """Build, seal and activate a revision under `root`; its stored entry, with statistics and quality.

    artifacts: artifact_id, kind, name, source_ref (with commit_sha, symbol_id), attributes. relations: relation_id, kind,
    from_ref, to_ref, status, external_identity, candidates, confidence, evidence."""
    spark = artifacts.sparkSession
    _, now = revisions.active_entry(spark, root)
    if (now or {}).get("revision_id") != job.parent:
        raise revisions.Conflict(f"{(now or {}).get('revision_id')} is active, not {job.parent}")
    folder = revisions.attempt(root, job.revision_id)
    scope = [F.lit(getattr(job, c)).alias(c) for c in ("tenant_id", "repository_id", "snapshot_id", "revision_id")]
    write = lambda rows, name: rows.select(*scope, "*").write.option("compression", "zstd").parquet(f"{folder}/{name}")

    first = validate.classify_artifacts(artifacts)
    symbol = F.col("source_ref.symbol_id")
    hard = blank("artifact_id") | F.coalesce((symbol != "") & (symbol != F.col("artifact_id")), F.lit(False))
    a = checked(first, "artifact_id", hard, F.size("attributes"), F.col("source_ref.commit_sha"), job)
    refuse("artifact_pages", a, job.declared_artifacts, limits.artifacts, limits.properties, 0, limits, limits.invalid_artifacts, limits.invalid_artifact_ratio)
    good, bad = validate.split(first)
    write(bad.select(F.lit("artifact").alias("record_type"), F.col("artifact_id").alias("record_id"), "error_code"), "quarantine/artifacts")
    bad = spark.read.parquet(f"{folder}/quarantine/artifacts").select(F.col("record_id").alias("artifact_id"))

    validate.classify_relations(relations, bad).write.option("compression", "zstd").parquet(f"{folder}/classified")
    second = spark.read.parquet(f"{folder}/classified")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    hard = blank("relation_id") | blank("from_ref") | F.coalesce((F.col("status") == "RESOLVED") & (blank("to_ref") | ~blank("external_identity") | ~none("candidates")), F.lit(False))
    r = checked(second, "relation_id", hard, F.size("candidates"), F.col("evidence.commit_sha"), job)
    refuse("relation_pages", r, job.declared_relations, limits.relations, limits.candidates, a["bytes"], limits, limits.invalid_relations, limits.invalid_relation_ratio)
    sound, unsound = validate.split(second)
    write(unsound.select(F.lit("relation").alias("record_type"), F.col("relation_id").alias("record_id"), "error_code"), "quarantine/relations")
    write(sound, "relations")
    sound = spark.read.parquet(f"{folder}/relations")
    revisions.remove(spark, f"{folder}/classified")

    node = lambda rows, kind, ident, artifact, name: rows.select(ident.alias("node_id"), kind.alias("entity_type"), artifact.alias("artifact_id"), name.alias("name"))
    no_one = F.lit(None).cast("string")
    nodes = node(good, F.col("kind"), stable_id("node", F.col("artifact_id")), F.col("artifact_id"), F.col("name"))
    issues = sound.where(F.col("status").isin("AMBIGUOUS", "UNRESOLVED"))
    nodes = nodes.union(node(issues, F.col("status"), stable_id("issue", F.col("relation_id")), no_one, F.col("relation_id")))
    outside = sound.where("status = 'EXTERNAL'").select("external_identity").distinct()
    nodes = nodes.union(node(outside, F.lit("EXTERNAL"), stable_id("external", F.col("external_identity")), no_one, F.col("external_identity")))
    write(nodes, "nodes")
    told = sound.withColumn("target", F.col("to_ref")).withColumn("to_ref", F.when(F.col("status") == "EXTERNAL", F.col("external_identity")).otherwise(F.col("to_ref")))
    write(graph.facts(told), "edges")

    quarantine = spark.read.parquet(f"{folder}/quarantine/artifacts", f"{folder}/quarantine/relations")
    codes = {x["error_code"]: x["n"] for x in quarantine.groupBy("error_code").agg(F.count("*").alias("n")).collect()}
    states = {x["status"]: x["n"] for x in sound.groupBy("status").agg(F.count("*").alias("n")).collect()}
    sample = [x.asDict() for x in quarantine.orderBy("record_type", "record_id", "error_code").select("record_type", "record_id", "error_code").limit(limits.samples).collect()]
    stats = {"nodes": a["input"] - a["invalid"], "edges": r["input"] - r["invalid"], "unresolved_targets": states.get("UNRESOLVED", 0), "ambiguous_relations": states.get("AMBIGUOUS", 0)}
    quality = {f"{k}_{t}": n for t, x in (("artifacts", a), ("relations", r)) for k, n in (("input", x["input"]), ("written", x["input"] - x["invalid"]), ("invalid", x["invalid"]))}
    status = "DEGRADED" if a["invalid"] or r["invalid"] else "HEALTHY"
    seal(job, folder, {"nodes": stats["nodes"], "relations": stats["edges"]}, artifacts)

    told = {c: getattr(job, c) for c in ("tenant_id", "repository_id", "snapshot_id", "commit_sha", "parser_result_version", "graph_schema_version", "algorithm_version", "build_policy_version", "trace_id")}
    manifest = {**told, "quality_status": status, **stats, **quality, "resolution_counts": states, "error_counts": codes, "error_samples": sample}
    revisions.put_new(spark, f"{folder}/manifest.json", json.dumps({"revision_id": job.revision_id, **manifest}, sort_keys=True))
    return revisions.activate(spark, root, job.revision_id, folder, job.parent, **manifest)


COUNTS = ["nodes", "edges", "unresolved_targets", "ambiguous_relations", "input_artifacts", "written_artifacts", "invalid_artifacts", "input_relations", "written_relations", "invalid_relations"]
TEXTS = ["tenant_id", "repository_id", "snapshot_id", "commit_sha", "revision_id", "parser_result_version", "graph_schema_version", "algorithm_version", "build_policy_version", "trace_id", "quality_status"]
FIELDS = [*TEXTS, *COUNTS, "resolution_counts", "error_counts", "error_samples"]
ENTRY = ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} long" for c in COUNTS), "resolution_counts map<string,long>", "error_counts map<string,long>", "error_samples array<struct<record_type: string, record_id: string, error_code: string>>"])


def entries(spark, found: list[dict]) -> DataFrame:
    """Stored entries as rows."""
    return spark.createDataFrame([tuple(e[n] for n in FIELDS) for e in found], ENTRY)


def published(revision: DataFrame) -> DataFrame:
    """The event of each revision's publication, all its fields from the revision itself."""
    ident = F.concat(F.lit("graph.published.v1:"), "revision_id")
    ids = {c: F.col(c) for c in ("tenant_id", "repository_id", "snapshot_id", "commit_sha", "revision_id")}
    versions = {c: F.col(c) for c in ("parser_result_version", "graph_schema_version", "algorithm_version", "build_policy_version")}
    rest = {c: F.col(c) for c in ("resolution_counts", "error_counts", "error_samples", "trace_id")}
    return payloads(revision, "graph.published.v1", F.col("revision_id"), **ids, event_id=ident, **versions, quality_status=F.col("quality_status"), **{c: F.col(c) for c in COUNTS}, **rest)
