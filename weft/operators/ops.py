"""Operations tables: event checks, outbox schedules, leases, retention, gauges and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of a duration histogram's buckets, in seconds.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
PARSE_COMPLETED = "snapshot_id string, commit_sha string, artifact_count long, relation_count long, deleted_paths array<string>, skipped_count long"


def decoded_events(events: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Events with their payload as `p`; a payload that is no such object, or has other fields, gives a reason."""
    names = F.array(*(F.lit(f.split()[0]) for f in schema.split(",")))
    rows = events.withColumn("p", F.from_json(F.col(payload), schema)).withColumn("keys", F.json_object_keys(F.col(payload)))
    reason = F.when(F.col("keys").isNull(), "invalid json").when(F.size(F.array_except("keys", names)) > 0, "unknown field")
    return rows.withColumn("reason", reason).drop("keys")


def event_problem(types: dict[str, str]) -> Column:
    """Why an event envelope is refused, or null: ids, type with its producer, version."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != F.coalesce(F.col(c).cast("string"), F.lit("?"))
    producer = F.create_map(*(F.lit(x) for kv in types.items() for x in kv))[F.col("event_type")]
    return F.when(F.col("event_id").isNull() | blank("event_id"), "event_id").when(producer.isNull(), "event_type").when(F.col("producer") != producer, "producer").when(F.col("payload_version") != 1, "payload_version")


def envelope_problem(types: dict[str, str], scope: dict[str, Column] | None = None) -> Column:
    """Why a whole envelope with its trusted scope is refused, or null: as event_problem, and besides identities that are empty
    or not trimmed, no time, no payload, and a trace that is another than the scope's (where that has one).

    scope: tenant_id, repository_id and, where they are known, snapshot_id and trace_id, from headers and not from payloads."""
    loose = lambda c: F.coalesce(c.cast("string"), F.lit("")).rlike(r"^$|^\s|\s$")
    scope = scope or {c: F.col(c) for c in ("tenant_id", "repository_id")}
    reason = F.when(F.lit(False), "")
    for name, value in scope.items():
        if name != "trace_id":
            reason = reason.when(loose(value), f"scope {name}")
    for name in ("event_id", "event_type", "aggregate_id", "trace_id"):
        reason = reason.when(loose(F.col(name)), name)
    reason = reason.when(F.col("occurred_at").isNull(), "occurred_at").when(F.col("payload").isNull(), "payload").when(event_problem(types).isNotNull(), event_problem(types))
    trace = scope.get("trace_id", F.lit(""))
    return reason.when((F.coalesce(trace, F.lit("")) != "") & ~trace.eqNullSafe(F.col("trace_id")), "trace_id of the scope")


def retry_schedule(rows: DataFrame, base: float, most: float, attempts: int) -> DataFrame:
    """Rows with the delay before their next delivery, doubled each time up to a limit, and whether they are given up."""
    n = F.col("delivery_count")
    return rows.withColumn("delay_s", F.least(F.lit(float(base)) * F.pow(F.lit(2.0), n - 1), F.lit(float(most)))).withColumn("dead", n >= attempts)


def due(rows: DataFrame, now: Column, most: int) -> DataFrame:
    """The rows that are due, the earliest first."""
    return rows.where(F.col("next_attempt_at") <= now).orderBy("next_attempt_at", "event_id").limit(most)


def lease_status(status: Column, lease: Column, now: Column) -> Column:
    """RUNNING with a lease that has ended becomes LOST."""
    return F.when((status == "RUNNING") & (lease.isNull() | (lease <= now)), "LOST").otherwise(status)


def attempts(rows: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Attempts of each job, numbered from 1."""
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(job).orderBy(*order)))


def superseded(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Revisions with their status: the newest of a key is ACTIVE, all before it SUPERSEDED."""
    later = F.lead(order[-1]).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("status", F.when(later.isNull(), "ACTIVE").otherwise("SUPERSEDED"))


def orphans(candidates: DataFrame, *used: DataFrame) -> DataFrame:
    """Candidates that none of the tables of used ids names."""
    for ids in used:
        candidates = candidates.join(ids, ids.columns[0], "left_anti")
    return candidates


def claimable(jobs: DataFrame, running: DataFrame, most: int, most_tenant: int) -> DataFrame:
    """Queued jobs without a live lease whose tenant and the whole have room. running: job_id, tenant_id."""
    by_tenant = running.groupBy("tenant_id").agg(F.count("*").alias("tenant_running"))
    room = running.agg(F.count("*").alias("all_running"))
    free = jobs.where("status = 'PENDING'").join(running.select("job_id"), "job_id", "left_anti").join(by_tenant, "tenant_id", "left").crossJoin(F.broadcast(room))
    return free.where((F.coalesce("tenant_running", F.lit(0)) < most_tenant) & (F.col("all_running") < most)).drop("tenant_running", "all_running")


def retained(rows: DataFrame, finished: Column, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and one row that tells how many finished before the cut-off go."""
    gone = finished & (F.col("at") < cutoff)
    return rows.where(~F.coalesce(gone, F.lit(False))), rows.agg(F.count_if(gone).alias("deleted"))


def gauges(rows: DataFrame, status: str, at: str, now: Column, names: list[str]) -> DataFrame:
    """One row: how many rows have each status, and the age of the oldest in seconds."""
    cells = []
    for n in names:
        cells.append(F.count_if(F.col(status) == n).alias(n.lower()))
        cells.append((F.unix_timestamp(now) - F.unix_timestamp(F.min(F.when(F.col(status) == n, F.col(at))))).alias(f"{n.lower()}_oldest_s"))
    return rows.agg(*cells)


def pending(rows: DataFrame, tenant: str) -> DataFrame:
    """Rows of each tenant, and of all in a row without one."""
    return rows.rollup(tenant).agg(F.count("*").alias("pending"))


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[float] = BUCKETS) -> DataFrame:
    """For each key and bound the number of values up to it; each value meets its bucket once, then counts are summed."""
    edges = F.array(*map(F.lit, bounds))
    place = F.size(F.filter(edges, lambda b: b < F.col("v")))
    counts = rows.select(*keys, F.col(value).alias("v")).where("v IS NOT NULL").select(*keys, place.alias("place")).groupBy(*keys, "place").count()
    every = counts.select(*keys, "count", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(bounds) - 1)), lambda i: i >= F.col("place"))).alias("i"))
    return every.groupBy(*keys, "i").agg(F.sum("count").alias("n")).select(*keys, F.get(edges, F.col("i")).alias("le"), "n")


def progress(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with the integer percentage of their key that is done with them."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("percent", F.floor(F.row_number().over(w.orderBy(*order)) * 100 / F.count("*").over(w)).cast("long"))


def tumbling(events: DataFrame, at: str, length: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts by window of a length; for streams late rows are waited for."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, length).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, at: str, length: str, slide: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, length, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: rows less than a gap apart."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("s"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("s.start").alias("start"), "n")


#: The fields of each event type's payload. Kinds: string; text (a string that is not empty); count and one
#: (whole numbers from 0 and from 1); flag; strings; texts (distinct, none empty); counts (an object of whole numbers from
#: 0); samples (objects of record_type, record_id and error_code); a list: one of its values. A question mark: may be absent.
SCHEMAS = {
    "parse.completed.v1": {"snapshot_id": "string", "commit_sha": "string", "artifact_count": "count", "relation_count": "count", "deleted_paths": "strings?", "skipped_count": "count?"},
    "parse.failed.v1": {"snapshot_id": "string", "error_code": "string", "retryable": "flag"},
    "graph.published.v1": {
        **dict.fromkeys(["tenant_id", "repository_id", "snapshot_id", "commit_sha", "revision_id", "event_id", "parser_result_version", "graph_schema_version", "algorithm_version", "build_policy_version"], "text"),
        "quality_status": ["HEALTHY", "DEGRADED"],
        **dict.fromkeys(["nodes", "edges", "unresolved_targets", "ambiguous_relations", "input_artifacts", "written_artifacts", "invalid_artifacts", "input_relations", "written_relations", "invalid_relations"], "count"),
        "resolution_counts": "counts",
        "error_counts": "counts",
        "error_samples": "samples",
        "trace_id": "text",
    },
    "index.ready.v1": {"revision_id": "text", "snapshot_id": "text", "commit_sha": "string", "documents": "count", "vectors": "count", "algorithm_version": "text"},
    "wiki.published.v1": {"job_id": "text", "snapshot_id": "text", "graph_revision_id": "text", "page_ids": "texts", "page_count": "one", "locale": ["zh-CN", "en-US"], "model": "text", "prompt_version": "text", "token_usage": "count"},
    "qa.run.completed.v1": {"run_id": "text", "conversation_id": "text", "snapshot_id": "text", "status": ["COMPLETED"], "citation_count": "count", "insufficient_evidence": "flag", "token_usage": "count", "latency_ms": "count", "model": "text", "prompt_version": "text"},
    "proposal.applied.v1": {"proposal_id": "text", "session_id": "text", "snapshot_id": "text", "base_commit_sha": "text", "applied_commit_sha": "string", "file_count": "one", "principal_id": "text"},
}
#: Who sends each type.
PRODUCERS = {"parse.completed.v1": "repository-parser", "parse.failed.v1": "repository-parser", "graph.published.v1": "code-knowledge-graph", "index.ready.v1": "code-rag", "wiki.published.v1": "ai-wiki", "proposal.applied.v1": "coding-assistant"}


def conforms(field: str, kind: str | list[str], document: str) -> Column:
    """Whether a field of a JSON document (a variant column) is of a kind of SCHEMAS."""
    get = lambda t: F.try_variant_get(document, f"$.{field}", t)
    shape, text, number = F.schema_of_variant(get("variant")), get("string"), get("bigint")
    empty = shape.isin("ARRAY<VOID>", "ARRAY<>")
    if isinstance(kind, list):
        return (shape == "STRING") & text.isin(kind)
    kind = kind.rstrip("?")
    if kind == "samples":
        return empty | ((shape == "ARRAY<OBJECT<error_code: STRING, record_id: STRING, record_type: STRING>>") & F.forall(get("array<struct<error_code: string, record_id: string, record_type: string>>"), lambda x: (x["error_code"] != "") & (x["record_id"] != "") & (x["record_type"] != "")))
    if kind == "counts":
        return shape.isin("OBJECT<>") | (shape.rlike("^OBJECT<[^<>]*>$") & ~shape.rlike(": (?!BIGINT)") & F.forall(F.map_values(get("map<string,bigint>")), lambda x: x >= 0))
    if kind in ("strings", "texts"):
        items = get("array<string>")
        plain = empty | (shape == "ARRAY<STRING>")
        return plain if kind == "strings" else plain & F.forall(items, lambda x: x != "") & (F.size(F.array_distinct(items)) == F.size(items))
    return {"string": shape == "STRING", "text": (shape == "STRING") & (text != ""), "flag": shape == "BOOLEAN", "count": (shape == "BIGINT") & (number >= 0), "one": (shape == "BIGINT") & (number >= 1)}[kind]


def schema_problems(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Events with the reason for which their payload does not conform to its type, or null; one pass, no split by type."""
    keys = F.json_object_keys(F.col(payload))
    reason = F.when(keys.isNull(), "invalid json")
    for kind, fields in SCHEMAS.items():
        own = F.col("event_type") == kind
        reason = reason.when(own & (F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0), "unknown field")
        for field, shape in fields.items():
            there = F.array_contains(keys, field)
            if not str(shape).endswith("?"):
                reason = reason.when(own & ~there, f"missing {field}")
            reason = reason.when(own & there & ~F.coalesce(conforms(field, shape, "_document"), F.lit(False)), f"bad {field}")
    told = events.withColumn("_document", F.try_parse_json(F.col(payload)))
    return told.withColumn("reason", F.when(~F.coalesce(F.col("event_type").isin(*SCHEMAS), F.lit(False)), "unknown type").otherwise(reason)).drop("_document")


def payloads(rows: DataFrame, kind: str, ident: Column, **fields: Column) -> DataFrame:
    """Events of a type with their payload as JSON; ids follow from the aggregate, so that they are the same each time."""
    return rows.select(F.concat(F.lit(f"{kind}:"), ident.cast("string")).alias("event_id"), F.lit(kind).alias("event_type"), ident.cast("string").alias("aggregate_id"), F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("payload"))


def retried(jobs: DataFrame, most: int) -> DataFrame:
    """Failed jobs that may be tried again, pending once more."""
    return jobs.where((F.col("status") == "FAILED") & F.col("retryable") & (F.col("retry_count") < most)).withColumn("status", F.lit("PENDING")).withColumn("retry_count", F.col("retry_count") + 1)


def baseline_conflicts(results: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose parent is not the latest snapshot any more. latest: keys, snapshot_id."""
    now = latest.select(*keys, F.col("snapshot_id").alias("latest_id"))
    return results.join(now, keys, "left").where(~F.col("parent_snapshot_id").eqNullSafe(F.col("latest_id")))


def result_problem() -> Column:
    """Why a job, its snapshot and their fields do not fit, or null."""
    return F.when(F.col("job_status") != F.col("snapshot_status"), "status").when((F.col("job_status") == "SUCCEEDED") & (F.col("progress") != 100), "progress").when((F.col("job_status") == "FAILED") & (F.coalesce("error_code", F.lit("")) == ""), "error_code")
