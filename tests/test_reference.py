"""The code-knowledge operators on small fixtures."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weft.functions import paths as P
from weft.functions import text as T
from weft.operators import changes as C
from weft.operators import extract as X
from weft.operators import structure
from weft.operators import governance as A
from weft.operators import graph as G
from weft.operators import layout as L
from weft.operators import ops as O
from weft.operators import qa as Q
from weft.operators import retrieval as R
from weft.operators import validate as V
from weft.operators import wiki as W
from weft.plans import diagrams, files, graph, more, operations, registry, retrieval  # noqa: F401
from weft.sources import tables as S
from weft.streaming import jobs

REF = "struct<commit_sha:string,path:string,symbol_id:string,start_line:int,end_line:int,content_hash:string>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 70


@pytest.mark.parametrize("text,want", [("HandlePayment payment_handler2X", ["handle", "payment", "payment_handler2", "x"]), ("", []), ("a-b ÉtéÉ", ["a", "b", "été", "é"])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text))) == want


def test_symbol_score_takes_the_first_term_that_fits(spark):
    terms = F.array(*map(F.lit, ["handle", "handlepayment", "payment"]))
    score = lambda *q: one(spark, T.symbol_score(terms, F.array(*map(F.lit, q))))
    assert score("payment") == 1.0 and score("pay") == 0.6 and score("p") == 0.0
    assert score("handlepayment") == 0.6  # "handle" comes first and is a prefix
    assert score("payment", "nothing") == 0.5


def test_stable_id(spark):
    import hashlib

    assert one(spark, T.stable_id("doc", F.lit("a"), F.lit("b"))) == "doc_" + hashlib.sha256(b"a\0b\0").hexdigest()[:24]


def test_hash_vectors(spark):
    import hashlib

    rows = T.hash_vectors(spark.createDataFrame([(1, ["ab", "cde"])], "k long, tokens array<string>"), "k", F.col("tokens"), 32)
    joined, want = "ab cde", {}
    for f in ["ab", "cde", *(joined[i : i + n] for n in (3, 4) for i in range(len(joined) - n + 1))]:
        d = hashlib.sha256(f.encode()).digest()
        b = int.from_bytes(d[:8], "little") % 32
        want[b] = want.get(b, 0) + (1 if d[8] % 2 == 0 else -1)
    norm = math.sqrt(sum(x * x for x in want.values()))
    assert {r.bucket: pytest.approx(r.weight) for r in rows.collect()} == {b: x / norm for b, x in want.items() if x}


@pytest.mark.parametrize("path,want", [("a/b.py", "a/b.py"), (" .\\a\\\\b ", "a/b"), ("../x", None), ("a/../b", None), ("/a", None), ("C:\\a", None), ("", None), ("a..b/c", "a..b/c")])
def test_canonical_path(spark, path, want):
    assert one(spark, P.canonical_path(F.lit(path))) == want


def test_globs():
    hit = lambda g, p: bool(re.match(P.glob_regex(g), p))
    assert hit("src/**", "src/a/b.ts") and not hit("src/*", "src/a/b.ts") and hit("**/x.?", "x.c") and hit("**/x.?", "a/b/x.c") and hit("src/foo..bar/**", "src/foo..bar/z") and not hit("a.b", "axb")
    with pytest.raises(ValueError):
        P.glob_regex("src/../secret/**")


def test_rename_boundary(spark):
    rows = spark.createDataFrame([("lib/a", "src/a", "RENAMED"), ("src/b", "lib/b", "RENAMED"), ("src/c", "src/d", "RENAMED"), ("lib/x", None, "ADDED")], "path string, old_path string, kind string")
    found = {tuple(r) for r in C.within(C.normalised(rows)[0], ["src/**"]).collect()}
    assert found == {("src/a", "DELETED", None), ("src/b", "ADDED", None), ("src/c", "RENAMED", "src/d")}
    bad = spark.createDataFrame([("a", "b", "ADDED"), ("a", None, "RENAMED"), ("a", None, "COPIED"), ("../a", None, "ADDED")], "path string, old_path string, kind string")
    assert C.normalised(bad)[0].count() == 0 and {r.reason for r in C.normalised(bad)[1].collect()} == {"old path unexpected", "old path missing", "kind", "path"}


def test_listing(spark):
    text = "M\0a.py\0R090\0old.py\0new.py\0C100\0x\0y\0D\0z\0Q\0w\0"
    found = {tuple(r) for r in C.decode_listing(spark.createDataFrame([(text,)], "listing string")).collect()}
    assert found == {("a.py", None, "MODIFIED"), ("new.py", "old.py", "RENAMED"), ("y", None, "ADDED"), ("z", None, "DELETED"), ("w", None, None)}


def test_admission(spark):
    rows = spark.createDataFrame([("a.py", b"x"), ("i.bin", b"\0\1"), ("b.ts", b"\0\1"), ("c.go", b"\xff\xfe"), ("big.java", b"x" * (C.MOST_BYTES + 1)), ("Dockerfile", b"FROM x")], "path string, content binary")
    assert {r.path: r.skipped for r in C.admitted(rows).collect()} == {"a.py": None, "i.bin": "unsupported", "b.ts": "binary", "c.go": "binary", "big.java": "too_large", "Dockerfile": None}


PYTHON = "import os\n\nclass Service(Base):\n    async def run(\n        self):\n        issue(1)\n\ndef main():\n    pass\n"
JAVA = "package x;\n/* class No { */\npublic class A extends B implements C, D {\n  public int size() {\n    return load(1);\n  }\n}\n"


def test_extraction(spark):
    rows = spark.createDataFrame([("a.py", PYTHON, "python"), ("A.java", JAVA, "java")], "path string, content string, parser string")
    found = {(r.path, r.kind, r.qualified_name): (r.start_line, r.end_line) for r in structure.parts(rows).collect()}
    assert found == {("a.py", "CLASS", "Service"): (3, 6), ("a.py", "METHOD", "Service.run"): (4, 6), ("a.py", "FUNCTION", "main"): (8, 9), ("A.java", "CLASS", "A"): (3, 7), ("A.java", "METHOD", "A.size"): (4, 6)}
    lines = X.lines_of(rows)
    assert {r.target for r in X.imports(lines).collect()} == {"module:os"}
    assert {(r.kind, r.target) for r in X.bases(lines).collect()} == {("EXTENDS", "symbol:Base"), ("EXTENDS", "symbol:B"), ("IMPLEMENTS", "symbol:C"), ("IMPLEMENTS", "symbol:D")}
    assert {"symbol:issue", "symbol:load"} <= {r.target for r in X.calls(lines).collect()}
    assert X.brace_depth(lines).where("path = 'A.java'").agg(F.max("depth")).first()[0] == 2


def test_manifests(spark):
    rows = spark.createDataFrame([("w/package.json", '{"dependencies": {"b": "1", "a": "2"}, "devDependencies": {"c": "3"}}'), ("requirements.txt", "flask==1\n# no\nnumpy>=2\n"), ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"), ("pom.xml", "<artifactId>junit</artifactId>")], "path string, content string")
    assert {r.target for r in X.dependencies(rows).collect()} == {f"package:{x}" for x in ("a", "b", "c", "flask", "numpy", "github.com/a/b", "junit")}


def graph_of(spark):
    nodes = spark.createDataFrame([("a", "CLASS"), ("b", "FUNCTION"), ("c", "FUNCTION"), ("d", "FUNCTION"), ("u", "UNRESOLVED")], "node_id string, entity_type string").withColumn("name", F.col("node_id"))
    edges = spark.createDataFrame([("e1", "CONTAINS", "a", "b", 1.0), ("e2", "CALLS", "b", "c", 0.6), ("e3", "CALLS", "c", "b", 0.9), ("e4", "CALLS", "c", "d", 0.9), ("e5", "UNCERTAIN_RELATION", "d", "u", 0.5)], "edge_id string, relation_type string, from_node_id string, to_node_id string, confidence double")
    return nodes, edges


def test_traversal(spark):
    nodes, edges = graph_of(spark)
    reach = lambda *a, **k: {r.node_id: r.distance for r in G.traverse(nodes, edges, *a, **k).collect()}
    assert reach(["a"], depth=10) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert reach(["d"], "INCOMING", ["CALLS"], depth=2) == {"d": 0, "c": 1, "b": 2}
    assert reach(["b"], "BOTH", entity_types=["FUNCTION"], depth=1) == {"b": 0, "c": 1}
    assert reach(["a", "c"], depth=0) == {"a": 0, "c": 0}
    for bad in (lambda: reach(["zz"]), lambda: reach(["u"]), lambda: reach(["a"], depth=11), lambda: reach([]), lambda: reach(["a"], "SIDEWAYS")):
        with pytest.raises(ValueError):
            bad()
    assert [r.node_id for r in G.call_chain(nodes, edges, "b").collect()] == ["b", "c", "d"]
    with pytest.raises(ValueError, match="budget"):
        G.traverse(nodes, edges, ["c"], depth=1, most_frontier=1)


def test_induced_edges_are_whole_or_refused(spark, monkeypatch):
    nodes, edges = graph_of(spark)
    ids = {r.node_id for r in nodes.collect()}
    want = {r.edge_id for r in edges.collect() if r.from_node_id in ids and r.to_node_id in ids}
    for most in (None, len(want)):
        assert {r.edge_id for r in G.induced(edges, nodes, most).collect()} == want
    with pytest.raises(ValueError, match="budget"):
        G.induced(edges, nodes, len(want) - 1)
    star = spark.range(50_005).select(F.concat(F.lit("e"), "id").alias("edge_id"), F.lit("CALLS").alias("relation_type"), F.lit("n:7").alias("from_node_id"), F.concat(F.lit("c:"), "id").alias("to_node_id"))
    ends = spark.range(50_005).select(F.concat(F.lit("c:"), "id").alias("node_id"), F.lit("CLASS").alias("entity_type")).union(spark.createDataFrame([("n:7", "MODULE"), ("n:8", "MODULE")], "node_id string, entity_type string"))
    monkeypatch.setattr(graph, "nodes_of", lambda *_: ends)
    monkeypatch.setattr(graph, "edges_of", lambda *_: star)
    assert graph.induced_edges(spark, "").count() == 50_005


def test_traversal_equals_breadth_first_search(spark):
    rng = random.Random(5)
    names = [f"n{i:02}" for i in range(40)]
    arcs = {(rng.choice(names), rng.choice(names)) for _ in range(70)}
    nodes = spark.createDataFrame([(n, "CLASS") for n in names], "node_id string, entity_type string")
    edges = spark.createDataFrame([(f"{a}{b}", "CALLS", a, b) for a, b in arcs], "edge_id string, relation_type string, from_node_id string, to_node_id string")
    want, front = {"n00": 0}, ["n00"]
    for d in range(1, 5):
        front = sorted({b for a, b in arcs if a in front and b not in want})
        want |= dict.fromkeys(front, d)
    assert {r.node_id: r.distance for r in G.traverse(nodes, edges, ["n00"], depth=4).collect()} == want


def test_build_and_integrity(spark):
    artifacts = spark.createDataFrame([("f", "FILE", "f"), ("g", "FUNCTION", "g")], "artifact_id string, kind string, name string")
    relations = spark.createDataFrame([("r1", "CONTAINS", "f", "g", 1.0), ("r2", "CALLS", "g", "symbol:issue", 0.65)], "relation_id string, kind string, from_ref string, to_ref string, confidence double")
    nodes, edges = G.revision(artifacts, relations)
    assert G.stats(nodes, edges).first().asDict() == {"nodes": 3, "unresolved": 1, "ambiguous": 0, "edges": 2}
    assert set(G.integrity(nodes, edges).first()) == {0}
    assert G.missing_sources(relations.union(relations.withColumn("from_ref", F.lit("no"))), artifacts).count() == 2
    symbols = spark.createDataFrame([("issue", "x"), ("issue", "y"), ("one", "z")], "name string, artifact_id string")
    asked = spark.createDataFrame([("1", "symbol:issue"), ("2", "symbol:one"), ("3", "symbol:no"), ("4", "module:m")], "relation_id string, to_ref string")
    found = {r.relation_id: (r.status, r.target, r.candidates) for r in G.resolve_symbols(asked, symbols).collect()}
    assert found == {"1": ("AMBIGUOUS", None, ["x", "y"]), "2": ("RESOLVED", "z", ["z"]), "3": ("UNRESOLVED", None, None), "4": ("EXTERNAL", None, None)}


def test_layers_put_cycles_last(spark):
    nodes, edges = graph_of(spark)
    assert {r.node_id: r.layer for r in L.layers(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 1, "u": 1}
    assert {(r.x, r.y) for r in L.radial(nodes.limit(1)).collect()} == {(0.0, 0.0)}
    assert L.grid(nodes).where("node_id = 'c'").first()[1:] == (440.0, 0.0)
    assert L.view_filters("CALL_GRAPH", ["CLASS"])[0] == [] and L.view_filters("REPOSITORY_MAP")[0] is None


def test_documents_and_hybrid_search(spark):
    rows = [("1", "FUNCTION", "HandlePayment", "pay.HandlePayment", "go", ("c", "internal/payment/a.go", "", 1, 2, ""), "func()", {"z": "1", "a": "2"}), ("2", "FUNCTION", "LoadConfig", "cfg.LoadConfig", "go", ("c", "internal/config/b.go", "", 1, 2, ""), "", None), ("3", "FUNCTION", "handlePayment", "web.handlePayment", "typescript", ("c", "web/c.ts", "", 1, 2, ""), "", None)]
    artifacts = spark.createDataFrame(rows, f"artifact_id string, kind string, name string, qualified_name string, language string, source_ref {REF}, signature string, attributes map<string,string>")
    docs = R.documents_of(artifacts).withColumn("tokens", T.tokens(F.col("text")))
    assert docs.where("artifact_id = '1'").first().text == "HandlePayment pay.HandlePayment func() FUNCTION go internal/payment/a.go a 2 z 1"
    picked = R.filtered(docs, languages=["GO"], prefixes=["internal/payment"])
    hits = R.hybrid(picked, "HandlePayment payment handler", None, 5, key="artifact_id").collect()
    assert [h.artifact_id for h in hits] == ["1"] and hits[0].reasons == ["SYMBOL", "KEYWORD", "SEMANTIC"]
    assert R.strategies(["bm25", "Vector", "KEYWORD"]) == ["KEYWORD", "SEMANTIC"]
    with pytest.raises(ValueError):
        R.strategies(["magic"])
    all_hits = R.hybrid(docs, "payment", ["KEYWORD"], 5, key="artifact_id")
    with pytest.raises(ValueError):
        R.reranked(all_hits, lambda h: h.withColumn("artifact_id", F.lit("9")), key="artifact_id")
    assert R.reranked(all_hits, key="artifact_id", k=1).count() == 1


def test_context_budget(spark):
    hits = spark.createDataFrame([(1, 0.9, "aaaa"), (2, 0.8, "bbbb"), (3, 0.7, "cc")], "doc_id long, score double, text string")
    assert [(r.text, r.cut) for r in R.context(hits, 6).collect()] == [("aaaa", False), ("bb", True)]


def test_validation(spark):
    good = ("c", "a/b.py", "", 1, 2, "")
    rows = spark.createDataFrame([("1", "FILE", "a", good), ("2", "THING", "a", good), ("3", "FILE", " ", good), ("4", "FILE", "a", ("c", "../b", "", 1, 2, "")), ("5", "FILE", "a", ("c", "b", "", 3, 2, ""))], f"artifact_id string, kind string, name string, source_ref {REF}")
    assert {r.artifact_id: r.error_code for r in V.classify_artifacts(rows).collect()} == {"1": None, "2": "INVALID_ARTIFACT_TYPE", "3": "INVALID_ARTIFACT_DATA", "4": "INVALID_ARTIFACT_SOURCE_REF", "5": "INVALID_ARTIFACT_SOURCE_REF"}
    gate = lambda **k: V.gate(V.classify_artifacts(rows), **k).first().status
    assert (gate(), gate(most=3), gate(most_ratio=0.5), V.gate(V.classify_artifacts(rows.limit(0))).first().status) == ("DEGRADED", "FAILED", "FAILED", "HEALTHY")
    history = spark.createDataFrame([("j", "PENDING", 1), ("j", "BUILDING", 2), ("j", "PENDING", 3)], "job string, status string, at int")
    assert [(r.before, r.after) for r in V.illegal_transitions(history, "job", "status", ["at"]).collect()] == [("BUILDING", "PENDING")]
    assert V.over_capacity(rows, 50).count() == 5


def test_rate_limit_window_begins_at_the_first_call(spark):
    calls = spark.createDataFrame([("k", 0, 1), ("k", 30, 1), ("k", 40, 1), ("k", 59, 1), ("k", 61, 1), ("m", 5, 3)], "key string, s int, cost int").withColumn("at", F.timestamp_seconds("s"))
    found = [(r.key, r.s, r.allowed, r.retry_after) for r in A.limited(calls, "key", "at", "s", "cost", 2, 60.0).orderBy("key", "s").collect()]
    assert found == [("k", 0, True, 0.0), ("k", 30, True, 0.0), ("k", 40, False, 20.0), ("k", 59, False, 1.0), ("k", 61, True, 0.0), ("m", 5, False, 60.0)]


def test_questions_and_proposals(spark):
    assert one(spark, Q.intent(F.lit("Who CALLS this?"))) == "CALL_CHAIN" and one(spark, Q.intent(F.lit("hello"))) == "GENERAL"
    assert one(spark, Q.question_problem(F.lit("x" * 8001), F.array(F.lit("read")))) == "too long"
    assert one(spark, Q.selected(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(2), F.lit(2), F.lit(1)))) == ["b", "a"]
    assert one(spark, Q.selected(F.array(F.lit("a")), F.array(F.lit(2)))) is None
    diff = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n"
    rows = spark.createDataFrame([("x", "LOW", diff), ("x", "LOW", diff + "rename from y\n"), ("y", "LOW", diff), ("x", "NONE", diff), ("../x", "LOW", diff)], "path string, risk string, unified_diff string").withColumn("base_content_hash", F.lit("sha256:12345678"))
    assert [r.p for r in rows.select(Q.proposal_problem().alias("p")).collect()] == [None, "lifecycle", "header", "risk", "path"]
    assert one(spark, Q.model_output(F.lit('```json\n{"a": 1}\n```'), "a int")).a == 1
    refs = spark.createDataFrame([("c", "a", "", 1, 1, ""), ("c", "a", "", 1, 1, ""), ("d", "a", "", 1, 1, ""), ("c", "../a", "", 1, 1, ""), ("c", "b", "", 2, 1, "")], "commit_sha string, path string, symbol_id string, start_line int, end_line int, content_hash string")
    assert W.majority_commit(refs).first().commit_sha == "c" and W.citations(refs).count() == 2
    kept, counts = Q.evidence(refs, "c")
    assert kept.count() == 1 and tuple(counts.first()) == (2, 1)


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s2")], "id int, v string, snapshot string")
    path = str(tmp_path / "t")
    S.replace_partition(rows, path, "snapshot")
    S.replace_partition(spark.createDataFrame([(3, "c", "s2")], "id int, v string, snapshot string"), path, "snapshot")
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 3}
    with pytest.raises(ValueError):
        S.keyset_page(rows, "id", None, 0)


def event(i, kind="parse.completed.v1", payload='{"snapshot_id": "s", "artifact_count": 1, "relation_count": 0, "commit_sha": "c"}', producer="repository-parser"):
    return (f"e{i}", kind, "a", None, producer, 1, "t", payload, "tenant", "repo")


def test_consumer_has_its_effect_once(spark, tmp_path):
    source, requests, rejected = (str(tmp_path / x) for x in ("in", "requests", "rejected"))
    first = [event(1), event(2), event(3, "other.v1"), event(4, payload='{"snapshot_id": "s", "more": 1}'), event(5, payload="no json"), event(6, "parse.failed.v1", '{"snapshot_id": "s", "error_code": "E", "retryable": true}'), event(8, payload='{"snapshot_id": "s", "artifact_count": 1, "commit_sha": "c"}')]
    spark.createDataFrame(first, jobs.ENVELOPE).coalesce(1).write.mode("append").json(source)
    jobs.consume(jobs.event_files(spark, source), requests, rejected, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([event(1), event(7), event(3, "other.v1")], jobs.ENVELOPE).coalesce(1).write.mode("append").json(source)
    jobs.consume(jobs.event_files(spark, source), requests, rejected, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(requests).count() == 1
    assert {r.event_id: r.reason for r in spark.read.parquet(rejected).collect()} == {"e3": "event_type", "e4": "unknown field", "e5": "invalid json", "e8": "missing relation_count"}


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:00:50"), ("b", "2024-01-01 00:01:10")], "kind string, at string").select("kind", F.col("at").cast("timestamp").alias("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    query = O.tumbling(stream, "at", "1 minute", ["kind"]).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.kind, r.n) for r in spark.table("tumbled").collect()} == {("a", 2), ("b", 1)}


def test_rate_limit_keeps_state_between_batches(spark, tmp_path):
    path = str(tmp_path / "calls")
    write = lambda rows: spark.createDataFrame(rows, "key string, s int, cost int").select("key", F.timestamp_seconds("s").alias("at"), "cost").coalesce(1).write.mode("append").parquet(path)
    write([("k", 0, 1), ("k", 1, 1)])
    stream = spark.readStream.schema("key string, at timestamp, cost int").parquet(path)
    query = jobs.limited_stream(stream, 2, 60.0).writeStream.format("memory").queryName("limited").start()
    query.processAllAvailable()
    write([("k", 2, 1), ("k", 60, 1)])
    query.processAllAvailable()
    query.stop()
    assert [r.allowed for r in spark.table("limited").orderBy("at").collect()] == [True, True, False, True]
