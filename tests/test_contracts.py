"""Fixed values and contracts: event payloads, one valid and several invalid of each type; relations; changes; calls; streams."""

import json

import pytest
from pyspark.sql import functions as F

from weft.operators import changes as C
from weft.operators import extract as X
from weft.operators import governance as A
from weft.operators import layout as L
from weft.operators import ops as O
from weft.operators import qa as Q
from weft.operators import retrieval as R
from weft.operators import validate as V
from weft.streaming import jobs

#: A value of each kind, and values that are not of it.
GOOD = {"string": "", "text": "x", "count": 0, "one": 1, "flag": False, "strings": ["a", "a"], "texts": ["a", "b"], "counts": {"a": 0}, "samples": [{"record_type": "t", "record_id": "i", "error_code": "e"}]}
BAD = {"string": [1, None], "text": ["", 2], "count": [-1, "1", 1.5], "one": [0, True], "flag": ["true", 1], "strings": [[1], "a"], "texts": [["a", "a"], [""]], "counts": [{"a": -1}, {"a": "x"}, []], "samples": [[{"record_type": "t"}], [{"record_type": "t", "record_id": "", "error_code": "e"}], {}]}


def test_payloads_of_every_type(spark):
    rows, want = [], []
    for kind, fields in O.SCHEMAS.items():
        name = lambda s: "list" if isinstance(s, list) else s.rstrip("?")
        whole = {f: s[0] if isinstance(s, list) else GOOD[name(s)] for f, s in fields.items()}
        cases = [(whole, None), (whole | {"more": 1}, "unknown field")]
        for f, s in fields.items():
            without = {k: v for k, v in whole.items() if k != f}
            cases.append((without, None if str(s).endswith("?") else f"missing {f}"))
            cases += [(whole | {f: bad}, f"bad {f}") for bad in (["NONE", 1] if isinstance(s, list) else BAD[name(s)])]
        cases += [({f: [] if name(s) in ("strings", "texts", "samples") else {} if name(s) == "counts" else v for (f, s), v in zip(fields.items(), whole.values())}, None)]
        for payload, reason in cases:
            rows.append((len(want), kind, json.dumps(payload)))
            want.append(reason)
    rows += [(len(want), "no.such.v1", "{}"), (len(want) + 1, "parse.failed.v1", "no json"), (len(want) + 2, None, None)]
    want += ["unknown type", "invalid json", "unknown type"]
    found = {r.i: r.reason for r in O.schema_problems(spark.createDataFrame(rows, "i int, event_type string, payload string")).collect()}
    assert [(rows[i], found[i]) for i in range(len(want)) if found[i] != want[i]] == []


def test_relations_have_all_codes(spark):
    good = ("c", "a/b.py", 1, 2)
    rows = [
        ("ok", "a", "b", "CALLS", 0.5, [], good, "RESOLVED", None),
        ("RELATION_REFERENCES_INVALID_ARTIFACT", "bad", "b", "CALLS", 0.5, [], good, "RESOLVED", None),
        ("RELATION_REFERENCES_INVALID_ARTIFACT", "a", None, "CALLS", 0.5, ["x", "bad"], good, "AMBIGUOUS", None),
        ("INVALID_RELATION_TYPE", "a", "b", "LIKES", 0.5, [], good, "RESOLVED", None),
        ("INVALID_RELATION_CONFIDENCE", "a", "b", "CALLS", float("nan"), [], good, "RESOLVED", None),
        ("INVALID_RELATION_SOURCE_REF", "a", "b", "CALLS", 0.5, [], ("c", "../x", 1, 2), "RESOLVED", None),
        ("INVALID_EXTERNAL_IDENTITY", "a", None, "CALLS", 0.5, [], good, "EXTERNAL", " "),
        ("ok", "a", None, "CALLS", 0.5, [], good, "EXTERNAL", "npm:x"),
        ("INVALID_AMBIGUOUS_RELATION", "a", None, "CALLS", 0.5, ["x"], good, "AMBIGUOUS", None),
        ("ok", "a", None, "CALLS", 0.5, ["x", "y"], good, "AMBIGUOUS", None),
        ("INVALID_UNRESOLVED_RELATION", "a", "b", "CALLS", 0.5, [], good, "UNRESOLVED", None),
        ("INVALID_RESOLUTION_STATUS", "a", "b", "CALLS", 0.5, [], good, "MAYBE", None),
    ]
    schema = "want string, from_ref string, to_ref string, kind string, confidence double, candidates array<string>, evidence struct<commit_sha: string, path: string, start_line: int, end_line: int>, status string, external_identity string"
    found = V.classify_relations(spark.createDataFrame(rows, schema), spark.createDataFrame([("bad",)], "artifact_id string")).collect()
    assert len(found) == len(rows) and [(r.want, r.error_code) for r in found if r.want != (r.error_code or "ok")] == []


def test_diffs_of_proposals(spark):
    head = "--- a/x/y.py\n+++ b/x/y.py\n"
    body = "@@ -1 +1 @@\n-a\n+b\n"
    base = "sha256:12345678"
    cases = [
        ("x/y.py", base, head + body, None),
        ("x/y.py", base, (head + body).replace("\n", "\r\n"), None),
        ("../y.py", base, head + body, "path"),
        ("x/y.py", "sha256:1234567", head + body, "base hash"),
        ("x/y.py", "12345678", head + body, "base hash"),
        ("x/y.py", base, " \n", "text"),
        ("x/y.py", base, head + body + "GIT binary patch", "text"),
        ("x/y.py", base, "text\n" + head + body, "header"),
        ("x/y.py", base, head, "header"),
        ("z.py", base, head + body, "header"),
        ("x/y.py", base, "--- a/x/y.py\n+++ /dev/null\n" + body, "header"),
        ("x/y.py", base, head + body + "--- a/z.py\n+++ b/z.py\n" + body, "lifecycle"),
        ("x/y.py", base, head + body + "rename to z.py\n", "lifecycle"),
    ]
    rows = spark.createDataFrame([(i, p, h, d, "LOW") for i, (p, h, d, _) in enumerate(cases)], "i int, path string, base_content_hash string, unified_diff string, risk string")
    found = {r.i: r.p for r in rows.select("i", Q.proposal_problem().alias("p")).collect()}
    assert [found[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_calls_routes_views_and_units(spark):
    text = spark.createDataFrame([("def f(a): return print($x(1)) + this.y (2) + this(3) + f(1) + super(1)",), ("export function g(x) { assert(h()) }",)], "text string")
    assert [sorted(r.n) for r in text.select(X.called(F.col("text")).alias("n")).collect()] == [["print", "this.y", "x"], ["assert", "h"]]
    assert {k: C.PARSERS[k] for k in (".mts", ".jsx", ".yaml", "requirements.txt", ".properties")} == {".mts": "typescript", ".jsx": "typescript", ".yaml": "text", "requirements.txt": "text", ".properties": "text"}
    assert L.VIEWS["CALL_GRAPH"] == (["FUNCTION", "METHOD", "SYMBOL"], ["CALLS"]) and "PACKAGE" in L.VIEWS["MODULE_DEPENDENCY"][0]
    assert {r.capability: r.units for r in A.capabilities(spark).collect()}["ask_repository"] == 5
    lines = "a\n  b\n    c\n\n  d\ne".split("\n")
    table = spark.createDataFrame([("p", i, t) for i, t in enumerate(lines, 1)] + [("q", 1, "x"), ("q", 2, " y")], "path string, line int, text string")
    assert {(r.path, r.line): r.end_line for r in X.indented_ends(table).collect()} == {("p", 1): 5, ("p", 2): 3, ("p", 3): 3, ("p", 5): 5, ("p", 6): 6, ("q", 1): 2, ("q", 2): 2}


def test_a_reranker_may_only_change_scores(spark):
    hits = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.4)], "doc_id long, path string, score double")
    assert [r.doc_id for r in R.reranked(hits, lambda h: h.withColumn("score", 1 - F.col("score"))).collect()] == [2, 1]
    for bad in (lambda h: h.withColumn("path", F.lit("z")), lambda h: h.drop("path"), lambda h: h.union(h), lambda h: h.withColumn("score", F.lit(float("nan")))):
        with pytest.raises(ValueError, match="reranker"):
            R.reranked(hits, bad)


def test_requests_over_the_limit_are_told(spark, tmp_path):
    source, requests, rejected = (str(tmp_path / x) for x in ("in", "requests", "rejected"))
    payload = lambda i: json.dumps({"snapshot_id": f"s{i}", "commit_sha": "c", "artifact_count": 1, "relation_count": 0, "deleted_paths": ["a"], "skipped_count": 1})
    spark.createDataFrame([(f"e{i}", "parse.completed.v1", "a", None, "repository-parser", 1, "t", payload(i), "tenant", "repo") for i in range(5)], jobs.ENVELOPE).coalesce(1).write.json(source)
    jobs.consume(jobs.event_files(spark, source), requests, rejected, str(tmp_path / "c"), most_pending=3).awaitTermination()
    assert {r.event_id for r in spark.read.parquet(requests).collect()} == {"e0", "e1", "e2"}
    assert {(r.event_id, r.reason) for r in spark.read.parquet(rejected).collect()} == {(e, "over the limit of pending builds") for e in ("e3", "e4")}


def test_new_contract_queries_match_their_sql(spark):
    import duckdb

    from weft.plans import contracts, registry

    names = [n for n, f in registry.QUERIES.items() if f.__module__ == contracts.__name__]
    assert len(names) == 10
    base = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("part", "orders", "lineitem", "customer", "conversations", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    for n in names:
        got = registry.QUERIES[n](spark, base)
        order = sorted(got.columns)
        want = db.execute(f"SELECT {', '.join(order)} FROM ({registry.ORACLES[n]})").fetchall()
        assert want and sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, want)), n


def test_event_sink_publishes_each_event_once(spark, tmp_path):
    from weft.streaming import jobs

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("e1", "t"), ("e2", "t")], "event_id string, event_type string").write.json(source)
    for want in (["e1", "e2"], ["e1", "e2", "e3"]):  # the second run brings an old event and a new one
        jobs.event_sink(jobs.event_files(spark, source), out, str(tmp_path / "checkpoint")).awaitTermination()
        assert sorted(r[0] for r in spark.read.parquet(out).select("event_id").collect()) == want
        spark.createDataFrame([("e2", "t"), ("e3", "t")], "event_id string, event_type string").write.mode("append").json(source)
