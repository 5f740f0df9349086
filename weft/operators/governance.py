"""Access: grants, rate limits, statuses of invocations, isolation of tenants."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units that each capability costs.
CAPABILITIES = {"search_code": 1, "get_symbol": 1, "find_call_chain": 2, "get_wiki_page": 1, "ask_repository": 5, "wiki_page": 1}


def capabilities(spark) -> DataFrame:
    """capability and units."""
    return spark.createDataFrame(list(CAPABILITIES.items()), "capability string, units int")


def authorised(calls: DataFrame, grants: DataFrame) -> DataFrame:
    """Calls with the reason for which their grant refuses them, or null.

    calls: client_id, repository_id, required (array), at; grants: client_id, status, expires_at, repository_scopes,
    permission_scopes."""
    rows = calls.join(grants, "client_id", "left")
    scope = F.array_contains("repository_scopes", "*") | F.array_contains("repository_scopes", F.col("repository_id"))
    reason = (
        F.when(F.col("status").isNull(), "NO_GRANT")
        .when(F.col("status") != "ACTIVE", "INACTIVE")
        .when(F.col("expires_at").isNotNull() & (F.col("expires_at") <= F.col("at")), "EXPIRED")
        .when(~F.coalesce(scope, F.lit(False)), "REPOSITORY_DENIED")
        .when(F.size(F.array_except("required", "permission_scopes")) > 0, "PERMISSION_DENIED")
    )
    return rows.withColumn("reason", reason).select(*calls.columns, "reason")


def limited(calls: DataFrame, key: str, at: str, order: str, cost: str, capacity: int, seconds: float) -> DataFrame:
    """Calls with `allowed` and `retry_after`, under a limit of units in a window for each key.

    A window begins at the first call after the last one ended; a refused call uses nothing. The state of a key is three
    numbers: rows are dealt by key, sorted, and streamed, so that no key's calls are held in memory."""
    out = calls.select(key, at, order, cost)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, opened, used = None, 0.0, 0
        for batch in batches:
            allowed, wait = [], []
            times = batch[at].astype("datetime64[us]").astype("int64") / 1e6
            for k, t, c in zip(batch[key], times, batch[cost]):
                if k != who or t >= opened + seconds:
                    who, opened, used = k, t, 0
                ok = used + c <= capacity
                used += c * ok
                allowed.append(ok)
                wait.append(0.0 if ok else opened + seconds - t)
            yield batch.assign(allowed=allowed, retry_after=wait)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", allowed boolean, retry_after double"
    return out.repartition(key).sortWithinPartitions(key, at, order).mapInPandas(run, schema)


def status(error: Column) -> Column:
    """The status of an invocation by its error code."""
    return F.when(error.isNull() | (error == ""), "SUCCEEDED").when(error.isin("PERMISSION_DENIED", "REPOSITORY_DENIED", "EXPIRED", "INACTIVE", "NO_GRANT"), "DENIED").when(error == "RATE_LIMITED", "RATE_LIMITED").otherwise("FAILED")


def in_scope(rows: DataFrame, tenant: str, repository: str, snapshot: str | None = None) -> DataFrame:
    """The rows of one tenant's repository; both are required."""
    if not tenant or not repository:
        raise ValueError("tenant and repository are required")
    rows = rows.where((F.col("tenant_id") == tenant) & (F.col("repository_id") == repository))
    return rows if snapshot is None else rows.where(F.col("snapshot_id") == snapshot)
