"""Structured Streaming: event sources, the trigger consumer with its idempotent effect, gauges, and rate limits with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.ops import PARSE_COMPLETED, PRODUCERS, event_problem, schema_problems
from weft.sources.revisions import exists, folders

ENVELOPE = "event_id string, event_type string, aggregate_id string, occurred_at timestamp, producer string, payload_version int, trace_id string, payload string, tenant_id string, repository_id string"
#: The event types that the consumer takes.
TAKEN = {k: PRODUCERS[k] for k in ("parse.completed.v1", "parse.failed.v1")}


def event_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of envelopes from JSON files; tenant and repository are columns of their own, not taken from payloads."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def sorted_out(events: DataFrame, parser_version: str = "") -> tuple[DataFrame, DataFrame]:
    """Build requests, and rejected events with the reason and a digest of their payload; failures of parsing are neither.

    parser_version: the version of parsers whose results the builds are of, which is part of a build's fingerprint."""
    rows = schema_problems(events).withColumn("p", F.from_json("payload", PARSE_COMPLETED))
    p = F.col("p")
    completed = F.col("event_type") == "parse.completed.v1"
    blank = F.when(completed & (F.coalesce(F.trim(p["snapshot_id"]), F.lit("")) == ""), "snapshot_id")
    told = rows.withColumn("reason", F.coalesce(event_problem(TAKEN), F.col("reason"), blank))
    good = told.where(completed & F.col("reason").isNull()).select("event_id", "event_type", "payload", "tenant_id", "repository_id", p["snapshot_id"].alias("snapshot_id"), F.sha2(F.concat_ws("\0", "tenant_id", "repository_id", p["snapshot_id"], F.lit(parser_version)).cast("binary"), 256).alias("fingerprint"))
    return good, rejections(told.where("reason IS NOT NULL"))


def rejections(rows: DataFrame) -> DataFrame:
    """event_id, event_type, reason and a digest of the payload."""
    return rows.select("event_id", "event_type", "reason", F.sha2(F.coalesce("payload", F.lit("")).cast("binary"), 256).alias("payload_digest"))


#: Tables of keys are cut into so many folders by a hash of the key; a batch reads those of its own keys.
BUCKETS = 256


def unknown(rows: DataFrame, path: str, key: str, batch: int) -> DataFrame:
    """One row for each key that earlier batches have not brought, with its bucket. Of what is there only the keys are read,
    in the folders of this batch's keys."""
    spark = rows.sparkSession
    new = rows.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    if not exists(spark, path):
        return new
    mine = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    there = spark.read.schema(f"{key} string, bucket int, batch long").parquet(path).where(F.col("bucket").isin(mine) & (F.col("batch") != batch)).select(key, "bucket")
    return new.join(there, [key, "bucket"], "left_anti")


def appended(rows: DataFrame, path: str, key: str, batch: int) -> None:
    """Append rows whose key is not there yet. A batch that is run again replaces its own folders, so its effect is once."""
    new = unknown(rows, path, key, batch).withColumn("batch", F.lit(batch))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def brought(spark: SparkSession, path: str, key: str, batch: int) -> int:
    """How many rows a batch added to a table of `appended`."""
    return spark.read.schema(f"{key} string, bucket int, batch long").parquet(path).where(F.col("batch") == batch).count()


def admitted(requests: DataFrame, path: str, batch: int, per_tenant: int, in_all: int, finished: DataFrame | None = None) -> DataFrame:
    """requests with `admitted`: whether fewer builds than the quotas are pending, those of smaller event_id first.

    What each tenant was granted so far is a table of one row a tenant under `path`, a version a batch; a batch reads the
    version before it and writes its own, so running it again has the same effect. finished: tenant_id and n, the builds that
    have ended; pending is what was granted less these."""
    spark = requests.sparkSession
    before = spark.createDataFrame([], "tenant_id string, granted long")
    if exists(spark, path):
        versions = [int(n.split("=")[1]) for n in folders(spark, path) if n.startswith("batch=")]
        if earlier := [v for v in versions if v < batch]:
            before = spark.read.schema("tenant_id string, granted long").parquet(f"{path}/batch={max(earlier)}")
    ended = finished.groupBy("tenant_id").agg(F.sum("n").alias("ended")) if finished is not None else spark.createDataFrame([], "tenant_id string, ended long")
    known = before.join(ended, "tenant_id", "left").select("tenant_id", "granted", F.greatest(F.col("granted") - F.coalesce("ended", F.lit(0)), F.lit(0)).alias("pending"))
    left_in_all = max(0, in_all - (known.agg(F.coalesce(F.sum("pending"), F.lit(0))).first()[0]))
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("event_id"))
    near = requests.withColumn("place", place).join(known.select("tenant_id", "pending"), "tenant_id", "left")
    near = near.where(F.col("place") + F.coalesce("pending", F.lit(0)) <= per_tenant)
    chosen = near.orderBy("event_id").limit(left_in_all).select("event_id", F.lit(True).alias("admitted")).persist()
    more = requests.join(chosen, "event_id", "left_semi").groupBy("tenant_id").agg(F.count("*").alias("more"))
    now = before.join(more, "tenant_id", "full").select("tenant_id", (F.coalesce("granted", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("granted"))
    now.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return requests.join(chosen, "event_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def consume(events: DataFrame, requests: str, rejected: str, checkpoint: str, most_pending: int | None = None, most_in_all: int | None = None, finished: Callable[[], DataFrame] | None = None, gauges: str | None = None) -> StreamingQuery:
    """Turn events into build requests, once for each fingerprint, and keep what is rejected, once for each event.

    most_pending, most_in_all: quotas of pending builds of a tenant and of all (see `admitted`), over all batches; a request
    that exists already is accepted and takes nothing of them, and one over a quota is told as rejected and may come again.
    gauges: where each batch leaves a row of counts."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        good, bad = sorted_out(rows)
        if most_pending is not None or most_in_all is not None:  # what is over the limit is told, not lost
            told = admitted(unknown(good, requests, "fingerprint", number).drop("bucket"), f"{requests}-quota", number, most_pending or 2**62, most_in_all or 2**31 - 1, finished and finished())
            bad = bad.union(rejections(told.where("not admitted").withColumn("reason", F.lit("over the limit of pending builds"))))
            good = told.where("admitted").drop("admitted")
        appended(good.drop("event_type", "payload"), requests, "fingerprint", number)
        appended(bad, rejected, "event_id", number)
        if gauges is not None:
            counts = rows.agg(F.count("*").alias("events"), F.count_distinct("tenant_id").alias("tenants"), F.min("occurred_at").alias("oldest"), F.max("occurred_at").alias("newest"))
            spark = rows.sparkSession
            new = F.lit(brought(spark, requests, "fingerprint", number)), F.lit(brought(spark, rejected, "event_id", number))
            counts.withColumn("requests", new[0]).withColumn("rejected", new[1]).write.mode("overwrite").parquet(f"{gauges}/batch={number}")
        rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without those whose id has come before within the watermark."""
    return events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["event_id"])


def gauge_stream(events: DataFrame, name: str) -> StreamingQuery:
    """Counts by type, kept up to date in a table in memory."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("occurred_at").alias("newest")).writeStream.outputMode("complete").format("memory").queryName(name).start()


def limited_stream(calls: DataFrame, capacity: int, seconds: float) -> DataFrame:
    """Calls (key, at, cost) with `allowed`, under a limit of units in a window that begins with a key's first call."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (float("-inf"), 0)
        for rows in batches:
            rows = rows.sort_values("at", kind="stable")
            allowed = []
            for t, cost in zip(rows["at"].astype("datetime64[us]").astype("int64") / 1e6, rows["cost"]):
                if t >= opened + seconds:
                    opened, used = t, 0
                ok = used + cost <= capacity
                used += int(cost) * ok
                allowed.append(bool(ok))
            yield rows.assign(allowed=allowed)
        state.update((float(opened), int(used)))

    return calls.groupBy("key").applyInPandasWithState(decide, "key string, at timestamp, cost int, allowed boolean", "opened double, used int", "append", GroupStateTimeout.NoTimeout)


def event_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publish events to a table, each event_id once, whichever batch brings it again."""
    return events.writeStream.foreachBatch(lambda rows, number: appended(rows, path, "event_id", number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
