"""The build as one flow: gate, quarantine, seal, activation; what refuses it, and what a refusal leaves."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from weft.operators import build as B
from weft.operators import graph as G
from weft.sources import revisions as R

REF = "struct<commit_sha: string, path: string, symbol_id: string, start_line: int, end_line: int>"
ARTIFACT = f"artifact_id string, kind string, name string, source_ref {REF}, attributes map<string,string>"
RELATION = f"relation_id string, kind string, from_ref string, to_ref string, status string, external_identity string, candidates array<string>, confidence double, evidence {REF}"
HERE = ("c", "a/b.py", None, 1, 2)


def art(i, kind="CLASS", name="x", ref=None, attributes=None):
    return (i, kind, name, ref or ("c", "a/b.py", i, 1, 2), attributes or {})


def rel(i, a="a", b="b", status="RESOLVED", outside=None, candidates=None, confidence=0.5, evidence=HERE):
    return (i, "CALLS", a, b, status, outside, candidates, confidence, evidence)


ARTIFACTS = [art("a"), art("b"), art("d", "FUNCTION")]
RELATIONS = [rel("r1"), rel("r2", "b", None, "EXTERNAL", "module:os"), rel("r3", "b", None, "AMBIGUOUS", None, ["a", "d"]), rel("r4", "d", None, "UNRESOLVED")]
FREE = B.Limits(invalid_artifact_ratio=0.5, invalid_relation_ratio=0.5)


@pytest.fixture
def run(spark, tmp_path):
    def go(artifacts=ARTIFACTS, relations=RELATIONS, limits=FREE, revision="rev1", parent=None, **job):
        told = {"declared_artifacts": len(artifacts), "declared_relations": len(relations), **job}
        j = B.Job("t", "r", "s", revision, "c", parent=parent, **told)
        return B.build(spark.createDataFrame(artifacts, ARTIFACT), spark.createDataFrame(relations, RELATION), f"file://{tmp_path}/g", j, limits)

    go.root = f"file://{tmp_path}/g"
    return go


def test_a_healthy_build(spark, run):
    entry = run()
    assert (entry["quality_status"], entry["nodes"], entry["edges"], entry["unresolved_targets"], entry["ambiguous_relations"]) == ("HEALTHY", 3, 4, 1, 1)
    assert entry["resolution_counts"] == {"RESOLVED": 1, "EXTERNAL": 1, "AMBIGUOUS": 1, "UNRESOLVED": 1} and entry["error_samples"] == []
    nodes, edges = R.current(spark, run.root, "nodes"), R.current(spark, run.root, "edges")
    assert sorted(r.entity_type for r in nodes.collect()) == ["AMBIGUOUS", "CLASS", "CLASS", "EXTERNAL", "FUNCTION", "UNRESOLVED"]
    assert sorted(r.relation_type for r in edges.collect()) == ["CALLS", "CALLS", "POSSIBLE_TARGET", "POSSIBLE_TARGET", "UNCERTAIN_RELATION", "UNCERTAIN_RELATION"]
    event = B.published(B.entries(spark, [entry])).first()
    payload = json.loads(event.payload)
    assert payload["event_id"] == event.event_id == "graph.published.v1:rev1" and payload["nodes"] == 3 and payload["resolution_counts"]["EXTERNAL"] == 1 and len(payload) == 25


def test_bad_rows_are_quarantined_and_what_refers_to_them(spark, run):
    artifacts = [*ARTIFACTS, art("bad", "TABLE"), art("e", name=" "), art("f", ref=("c", "../x", "f", 1, 1))]
    relations = [*RELATIONS, rel("r5", "bad", "a"), rel("r6", "a", "e"), rel("r7", "a", None, "AMBIGUOUS", None, ["a", "f"]), rel("r8", confidence=float("nan")), rel("r9", "a", None, "AMBIGUOUS", None, ["a"]), rel("s1", "a", "f", "EXTERNAL", "x")]
    entry = run(artifacts, relations, dataclasses.replace(FREE, invalid_relation_ratio=0.7, samples=4))
    assert entry["quality_status"] == "DEGRADED" and entry["invalid_artifacts"] == 3 and entry["invalid_relations"] == 6 and entry["edges"] == 4
    assert entry["error_counts"] == {"INVALID_ARTIFACT_TYPE": 1, "INVALID_ARTIFACT_DATA": 1, "INVALID_ARTIFACT_SOURCE_REF": 1, "RELATION_REFERENCES_INVALID_ARTIFACT": 3, "INVALID_RELATION_CONFIDENCE": 1, "INVALID_AMBIGUOUS_RELATION": 1, "INVALID_EXTERNAL_IDENTITY": 1}
    assert [(s["record_type"], s["record_id"]) for s in entry["error_samples"]] == [("artifact", "bad"), ("artifact", "e"), ("artifact", "f"), ("relation", "r5")]


@pytest.mark.parametrize(
    "artifacts, relations, more, code",
    [
        ([*ARTIFACTS, art(" ")], RELATIONS, {}, "PARSER_RESULT_INVALID"),
        ([*ARTIFACTS, art("z", ref=("c", "p", "other", 1, 1))], RELATIONS, {}, "PARSER_RESULT_INVALID"),
        ([*ARTIFACTS, art("a", name="y")], RELATIONS, {}, "PARSER_RESULT_INVALID"),
        (ARTIFACTS, [*RELATIONS, rel("r9", b=None)], {}, "PARSER_RESULT_INVALID"),
        (ARTIFACTS, [*RELATIONS, rel("r9", candidates=["a", "b"])], {}, "PARSER_RESULT_INVALID"),
        (ARTIFACTS, [*RELATIONS, rel("r9", a="")], {}, "PARSER_RESULT_INVALID"),
        (ARTIFACTS, RELATIONS, {"declared_artifacts": 4}, "PARSER_RESULT_CHANGED"),
        (ARTIFACTS, RELATIONS, {"declared_relations": 3}, "PARSER_RESULT_CHANGED"),
        ([*ARTIFACTS, art("z", ref=("other", "p", "z", 1, 1))], RELATIONS, {}, "PARSER_RESULT_CHANGED"),
        (ARTIFACTS, RELATIONS, {"limits": dataclasses.replace(FREE, relations=3)}, "BUILD_CAPACITY_EXCEEDED"),
        ([*ARTIFACTS, art("z", name="n" * 300_000)], RELATIONS, {}, "BUILD_CAPACITY_EXCEEDED"),
        (ARTIFACTS, RELATIONS, {"limits": dataclasses.replace(FREE, candidates=1)}, "BUILD_CAPACITY_EXCEEDED"),
        (ARTIFACTS, RELATIONS, {"limits": dataclasses.replace(FREE, revision_bytes=500)}, "BUILD_CAPACITY_EXCEEDED"),
        ([*ARTIFACTS, art("z", "TABLE")], RELATIONS, {"limits": B.Limits()}, "GRAPH_VALIDATION_FAILED"),
        (ARTIFACTS, [*RELATIONS, rel("r9", confidence=2.0)], {"limits": B.Limits()}, "GRAPH_VALIDATION_FAILED"),
        (ARTIFACTS, [*RELATIONS, rel("r9", b="nowhere")], {}, "GRAPH_INTEGRITY_FAILED"),
    ],
)
def test_refusals_leave_the_pointer(spark, run, artifacts, relations, more, code):
    R.activate(spark, run.root, "old", "somewhere", None)
    with pytest.raises(B.Refused) as e:
        run(artifacts, relations, parent="old", **more)
    assert e.value.code == code
    assert R.active_entry(spark, run.root)[1]["revision_id"] == "old"


def test_activation_is_one_of_several(spark, run):
    first = run()
    with pytest.raises(R.Conflict):
        run(revision="rev2", parent=None)
    second = run(revision="rev2", parent="rev1")
    assert R.active_entry(spark, run.root) == (2, second) and second["parent_revision_id"] == first["revision_id"]
    assert not R.put_new(spark, f"{run.root}/active/{2:012d}.json", "{}")  # a number is given once
    with pytest.raises(R.Conflict):
        R.activate(spark, run.root, "rev3", "x", "rev1")
    assert R.active_entry(spark, run.root) == (2, second)


def test_a_writer_that_died_leaves_no_half_revision(spark, run, monkeypatch):
    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(B, "seal", die)
    with pytest.raises(RuntimeError, match="lost"):
        run()
    assert R.active_entry(spark, run.root) == (0, None)
    with pytest.raises(ValueError, match="no revision"):
        R.current(spark, run.root)
    monkeypatch.undo()
    assert run()["nodes"] == 3 and R.current(spark, run.root, "edges").count() == 6


def test_empty_inputs(run):
    assert (run([], [])["nodes"], run.root and 0) == (0, 0)


def test_publication(spark, tmp_path):
    root, rows = f"file://{tmp_path}/index", spark.range(3)
    assert R.publish(rows, root, "i1", "h1") and not R.publish(rows, root, "i2", "h1")
    with pytest.raises(ValueError, match="READY"):
        R.publish(rows, root, "i2", "h2", "BUILDING")
    rows.write.parquet(R.attempt(root, "i2"))  # an attempt that died before it was named
    assert R.publish(spark.range(5), root, "i2", "h2") and R.current(spark, root).count() == 5
    with pytest.raises(R.Conflict):
        R.publish(rows, root, "i2", "h3")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        G.shared_dir(Session())
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_relations_are_classified_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    relations = spark.createDataFrame(RELATIONS, RELATION).withColumn("confidence", F.udf(told, "double")("confidence"))
    job = B.Job("t", "r", "s", "rev1", "c", len(ARTIFACTS), len(RELATIONS))
    entry = B.build(spark.createDataFrame(ARTIFACTS, ARTIFACT), relations, f"file://{tmp_path}/g", job, FREE)
    assert entry["edges"] == 4 and seen.value <= 2 * len(RELATIONS)  # a second time at most for the joins of candidates
    assert sorted(x.name for x in next((tmp_path / "g/revisions/rev1").iterdir()).iterdir() if x.is_dir()) == ["edges", "nodes", "quarantine", "relations"]


def test_integrity_of_odd_ids(spark):
    a, b = "node_" + "0a" * 12, "issue_" + "0a" * 12
    nodes = [(x,) for x in (a, a, b, None, None, "", a.upper(), a + "\n", "x")]
    edges = [("edge_" + "1" * 24, a, b), ("edge_" + "1" * 24, "node_" + "0A" * 12, None), ("e", a.upper(), a + "\n"), ("e", "", "\0x"), (None, "x", "\0" + a), (None, "gone", a[5:])]
    found = G.integrity(spark.createDataFrame(nodes, "node_id string"), spark.createDataFrame(edges, "edge_id string, from_node_id string, to_node_id string"))
    assert found.first().asDict() == {"from_missing": 2, "to_missing": 4, "node_id_repeated": 2, "edge_id_repeated": 3}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the two rows of counts; ends meet in one grouping
