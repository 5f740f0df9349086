"""Admission over batches and tenants, once-only effects after a batch is run again, and a row of gauges a batch."""

import json

from weft.streaming import jobs


def event(i, tenant, snapshot):
    payload = json.dumps({"snapshot_id": snapshot, "commit_sha": "c", "artifact_count": 1, "relation_count": 0, "deleted_paths": ["a"], "skipped_count": 1})
    return (f"e{i:02}", "parse.completed.v1", "a", None, "repository-parser", 1, "t", payload, tenant, "repo")


def test_quotas_hold_over_batches_and_tenants(spark, tmp_path):
    source, requests, rejected, gauges = (str(tmp_path / x) for x in ("in", "requests", "rejected", "gauges"))
    ended = {"n": 0}

    def finished():
        return spark.createDataFrame([("a", ended["n"])], "tenant_id string, n long")

    def run(*events):
        spark.createDataFrame(list(events), jobs.ENVELOPE).coalesce(1).write.mode("append").json(source)
        jobs.consume(jobs.event_files(spark, source), requests, rejected, str(tmp_path / "c"), most_pending=3, most_in_all=5, finished=finished, gauges=gauges).awaitTermination()
        return {r.event_id for r in spark.read.parquet(requests).collect()}, {r.event_id for r in spark.read.parquet(rejected).collect()} if (tmp_path / "rejected").exists() and any((tmp_path / "rejected").glob("bucket=*")) else set()

    assert run(event(1, "a", "s1"), event(2, "a", "s2"), event(3, "b", "s1")) == ({"e01", "e02", "e03"}, set())
    # a has one left of three; what exists already is accepted and takes nothing; the whole quota leaves two
    assert run(event(4, "a", "s1"), event(5, "a", "s3"), event(6, "a", "s4"), event(7, "b", "s2"), event(8, "b", "s3")) == ({"e01", "e02", "e03", "e05", "e07"}, {"e06", "e08"})
    assert run(event(9, "c", "s1"))[1] == {"e06", "e08", "e09"}
    ended["n"] = 2  # two builds of a have ended, and refused requests may come again
    assert run(event(10, "a", "s4"), event(11, "c", "s1"), event(12, "c", "s2"))[0] == {"e01", "e02", "e03", "e05", "e07", "e10", "e11"}
    rows = {r.batch: (r.events, r.tenants, r.requests, r.rejected) for r in spark.read.parquet(gauges).collect()}
    assert rows == {0: (3, 2, 3, 0), 1: (5, 2, 2, 2), 2: (1, 1, 0, 1), 3: (3, 2, 2, 1)}


def test_a_batch_that_is_run_again_has_the_same_effect(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b")], "fingerprint string, tenant_id string")
    path, quota = str(tmp_path / "t"), str(tmp_path / "q")
    asked = spark.createDataFrame([("e1", "a"), ("e2", "a"), ("e3", "b")], "event_id string, tenant_id string")
    for _ in range(2):
        jobs.appended(rows, path, "fingerprint", 7)
        assert spark.read.parquet(path).count() == jobs.brought(spark, path, "fingerprint", 7) == 2
        got = {r.event_id: r.admitted for r in jobs.admitted(asked, quota, 7, 1, 10).collect()}
        assert got == {"e1": True, "e2": False, "e3": True}
    jobs.appended(rows, path, "fingerprint", 8)
    assert jobs.brought(spark, path, "fingerprint", 8) == 0 and spark.read.parquet(path).count() == 2
    assert {r.event_id for r in jobs.admitted(asked, quota, 8, 2, 3).where("admitted").collect()} == {"e1"}
    assert jobs.admitted(asked, quota, 9, 5, 0).where("admitted").count() == 0
