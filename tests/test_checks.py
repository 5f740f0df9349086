"""Refusals: proposals as wholes, index documents, overfull snapshots, audit rows."""

from datetime import datetime

from pyspark.sql import functions as F

from weft.operators import changes as C
from weft.operators import proposals as P
from weft.operators import retrieval as R
from weft.sources import tables as T

REF = "struct<commit_sha: string, path: string, start_line: int, end_line: int>"
SCHEMA = f"proposal_id string, session_id string, user_id string, snapshot_id string, base_commit_sha string, intent string, summary string, risk_level string, file_changes array<struct<path: string, base_content_hash: string, unified_diff: string>>, citations array<{REF}>"


def test_paths_are_cleaned(spark):
    cases = {"a/b": "a/b", " ./a//b/ ": "a/b", "a/../b": "b", "a/../../b": "../b", "..": "..", "": ".", "a/..": ".", "./.": ".", "../../x": "../../x", "a/b/../../..": ".."}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want string")
    assert [(r.p, r.got) for r in rows.withColumn("got", P.cleaned(F.col("p"))).collect() if r.got != r.want] == []


def test_proposals_as_wholes(spark):
    def change(path="x/y.py", base="sha256:12345678", diff=None, clean=None):
        c = clean or path
        return (path, base, diff if diff is not None else f"--- a/{c}\n+++ b/{c}\n@@ -1 +1 @@\n-a\n+b\n")

    cite = ("c", "a.py", 1, 2)

    def proposal(want, intent="PATCH", changes=(change(),), citations=(cite,), summary="s", risk="LOW", commit="c", session="s"):
        return want, (session, "u", "n", commit, intent, summary, risk, list(changes), list(citations))

    cases = [
        proposal(None),
        proposal(None, "EXPLAIN", ()),
        proposal(None, changes=[change(), change("x//z/../w.py", clean="x/w.py")]),
        proposal("identity", session=" "),
        proposal("summary", summary=None),
        proposal("risk", risk="NONE"),
        proposal("intent", "OTHER"),
        proposal("changes of the intent", "EXPLAIN"),
        proposal("changes of the intent", changes=()),
        proposal("number of changes", changes=[change(f"f{i}") for i in range(21)]),
        proposal("change: path", changes=[change(), change("a/../../b", clean="../b")]),
        proposal("change: base hash", changes=[change(base="sha256:1")]),
        proposal("change: header", changes=[change("a/../b.py", clean="a/../b.py")]),
        proposal("change: lifecycle", changes=[change(diff="--- a/x/y.py\n+++ b/x/y.py\n@@ -1 +1 @@\nrename to z\n")]),
        proposal("repeated path", changes=[change(), change("x/./y.py", clean="x/y.py")]),
        proposal("bytes of diff", changes=[change(diff="--- a/x/y.py\n+++ b/x/y.py\n@@ -1 +1 @@\n" + "+" * (1 << 20))]),
        proposal("no citation", citations=()),
        proposal("citation", citations=[cite, ("c", "../x", 1, 1)]),
        proposal("citation of another commit", citations=[cite, ("d", "x", 1, 1)]),
        proposal("unknown file", changes=[change(), change("gone.py")]),
        proposal("stale base hash", changes=[change(base="sha256:87654321")]),
    ]
    rows = spark.createDataFrame([(str(i), *p) for i, (_, p) in enumerate(cases)], SCHEMA)
    files = spark.createDataFrame([("c", "x/y.py", "sha256:12345678"), ("c", "x/w.py", "sha256:12345678"), ("d", "gone.py", "sha256:12345678")], "base_commit_sha string, path string, content_hash string")
    found = {int(r.proposal_id): r.reason for r in P.problems(rows, files).collect()}
    assert [(i, found[i], want) for i, (want, _) in enumerate(cases) if found[i] != want] == []
    assert P.problems(rows.limit(0), files).count() == 0


def test_index_documents_are_refused(spark):
    ref = "struct<commit_sha: string, path: string, start_line: int, end_line: int, content_hash: string>"
    good = ("c", "a.py", 1, 2, "h")
    rows = [("s", "a", "A", "h", good), ("s", "b", " ", "h", good), ("s", "c", "C", "h", good), ("s", "c", "C", "h", good), ("s", "d", "D", "h", ("c", "/x", 1, 2, "h")), ("s", "e", "E", "other", good), ("s", "f", "F", "h", ("d", "a.py", 1, 2, "h")), ("t", "a", "A", "h", ("d", "a.py", 1, 2, "h"))]
    table = spark.createDataFrame(rows, f"snapshot_id string, artifact_id string, name string, content_hash string, source_ref {ref}")
    found = sorted((r.snapshot_id, r.artifact_id, r.reason) for r in R.index_problems(table).collect())
    assert found == [("s", "b", "empty"), ("s", "c", "repeated"), ("s", "c", "repeated"), ("s", "d", "source reference"), ("s", "e", "hash"), ("s", "f", "commit")]


def test_overfull_snapshots_and_audit_rows(spark, tmp_path):
    many = spark.range(100_001).select(F.lit("big").alias("s")).union(spark.range(100_000).select(F.lit("full")))
    assert [tuple(r) for r in C.overfull(many, "s").collect()] == [("big", 100_001)]
    for result in ("SUCCEEDED", "FAILED"):
        T.append_audit(spark.range(2), str(tmp_path / "a"), datetime(2024, 1, 1), result)
    got = spark.read.parquet(str(tmp_path / "a"))
    assert got.columns == ["id", "started_at", "ended_at", "result"] and sorted(r.result for r in got.where("ended_at > started_at").collect()) == ["FAILED", "FAILED", "SUCCEEDED", "SUCCEEDED"]


def test_whole_envelopes(spark):
    from weft.operators import ops as O

    def envelope(want, **more):
        base = {"event_id": "e", "event_type": "t.v1", "aggregate_id": "a", "occurred_at": datetime(2024, 1, 1), "producer": "p", "payload_version": 1, "trace_id": "x", "payload": "{}", "tenant_id": "t", "repository_id": "r", "header_trace": "x", "want": want}
        return tuple({**base, **more}.values())

    cases = [envelope(None), envelope(None, header_trace=None), envelope("trace_id of the scope", header_trace="y"), envelope("event_id", event_id="e "), envelope("event_type", event_type=" t.v1"), envelope("event_type", event_type="other"), envelope("aggregate_id", aggregate_id=None), envelope("trace_id", trace_id=""), envelope("occurred_at", occurred_at=None), envelope("payload", payload=None), envelope("producer", producer="q"), envelope("payload_version", payload_version=2), envelope("scope tenant_id", tenant_id=" t")]
    rows = spark.createDataFrame(cases, "event_id string, event_type string, aggregate_id string, occurred_at timestamp, producer string, payload_version int, trace_id string, payload string, tenant_id string, repository_id string, header_trace string, want string")
    problem = O.envelope_problem({"t.v1": "p"}, {"tenant_id": F.col("tenant_id"), "repository_id": F.col("repository_id"), "trace_id": F.col("header_trace")})
    assert [(r.want, r.got) for r in rows.withColumn("got", problem).collect() if r.want != r.got] == []
