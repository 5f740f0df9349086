"""Steps whose work must be dealt over the cluster, or must not grow with what is not asked for."""

import hashlib
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

import __spark_entry__ as entry
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import changes as C
from weft.operators import graph as G
from weft.operators import ranking
from weft.operators import structure as S
from weft.sources.tables import spread, table

SMALL = "/root/testdata/sf0.001"


def test_candidates_of_other_roots_are_not_gathered(spark):
    plan = entry.queries()["graph_diagnostics"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert " IN (c:1,c:2" in plan[plan.index("Generate explode") :]  # the filter lies below the lists


def test_candidates_of_a_hot_name_are_dealt_over_tasks(spark):
    symbols = spark.range(3 * G.PART + 7).select(F.lit("hot").alias("name"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("artifact_id"))
    symbols = symbols.union(symbols.limit(5)).union(spark.createDataFrame([("one", "b1"), (None, "b2"), ("one", None)], "name string, artifact_id string"))
    asked = ["symbol:hot", "symbol:one", "symbol:none", "module:hot", "symbol:hot", None]
    relations = spark.createDataFrame([(f"r{i}", "CALLS", f"f{i}", x, 0.5) for i, x in enumerate(asked)], "relation_id string, kind string, from_ref string, to_ref string, confidence double")
    known = G.resolve_symbols(relations, symbols)
    got, lists = G.facts(known, symbols), G.facts(known)
    assert sorted(got.collect()) == sorted(lists.collect())
    assert got.where("relation_type = 'POSSIBLE_TARGET'").count() == 2 * (3 * G.PART + 7)
    pairs = G.candidates_of(relations, symbols)
    assert pairs.groupBy(F.spark_partition_id()).count().count() > 1


def test_what_candidates_shuffle_grows_with_rows_not_pairs(spark):
    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def shuffled(n: int) -> int:
        symbols = spark.range(10 * n).select(F.lit("hot").alias("name"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("artifact_id"))
        relations = spark.range(n).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("relation_id"), F.lit("symbol:hot").alias("to_ref"))
        before = written()
        assert G.candidates_of(relations, symbols).count() == 10 * n * n
        return written() - before

    assert shuffled(4000) < 5 * shuffled(1000)  # 16 times the pairs


def test_features_are_counted_where_their_row_lies(spark):
    rows = spark.createDataFrame([(1, ["ab", "cde", "ab"]), (2, []), (3, None), (4, ["é😀x", "y" * 40]), (5, ["the"] * 3), (5, ["cat", "the"])], "k long, tokens array<string>")
    for dimensions in (32, 256):
        got = {(r.k, r.bucket): r.weight for r in T.hash_vectors(rows, "k", F.col("tokens"), dimensions).collect()}
        sums: dict = {}
        for k, words in ((r.k, r.tokens or []) for r in rows.collect()):
            joined = " ".join(words)
            for f in words + [joined[i : i + n] for n in (3, 4) for i in range(len(joined) - n + 1)]:
                d = hashlib.sha256(f.encode()).digest()
                at = (k, int.from_bytes(d[:8], "little") % dimensions)
                sums[at] = sums.get(at, 0) + (-1 if d[8] % 2 else 1)
        norm = {k: sum(v * v for (j, _), v in sums.items() if j == k) ** 0.5 for k, _ in sums}
        assert got == {at: v / norm[at[0]] for at, v in sums.items() if v}
    plan = T.hash_vectors(rows, "k", F.col("tokens"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no feature is a row


def test_one_row_group_is_dealt_over_tasks(spark):
    docs = spread(table(spark, "/root/testdata/sf0.1", "documents"))
    sizes = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 2 * sum(sizes) / len(sizes)


def repeated(tmp_path, times: int, sizes: dict) -> str:
    """The smallest tables, with those of `sizes` (table: key columns and their span) repeated with shifted keys."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = pq.read_table(f"{SMALL}/{name}.parquet")
        parts = []
        for i in range(times if name in sizes else 1):
            one = rows
            for column, span in sizes.get(name, {}).items():
                at = one.schema.get_field_index(column)
                one = one.set_column(at, column, pc.add(one.column(column), i * span))
            parts.append(one)
        pq.write_table(pa.concat_tables(parts), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def held_against_sql(spark, folder: str, name: str) -> int:
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    want = sorted(db.execute(entry.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, entry.queries()[name](spark, folder).collect())) == want
    return len(want)


def test_a_projection_that_is_pruned_is_not_cut_first(spark, tmp_path):
    folder = repeated(tmp_path, 600, {"supplier": {"s_suppkey": 100_000}})
    assert pq.read_metadata(f"{folder}/supplier.parquet").num_rows > 5000
    assert held_against_sql(spark, folder, "diagram_pruned") > 1


def test_all_induced_edges_are_told(spark, tmp_path):
    folder = repeated(tmp_path, 700, {"customer": {"c_custkey": 1_000_000}, "orders": {"o_orderkey": 10_000_000, "o_custkey": 1_000_000}})
    assert held_against_sql(spark, folder, "graph_induced_edges") > 50_000


def test_outlines_are_made_a_few_files_at_a_time(spark):
    files = spark.range(450).select(F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("class A(B):\n    async def f(self):\n        g(1)\n").alias("content"), F.lit("python").alias("parser"))
    found = S.parsed(files)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # no data frame of nested objects
    got = {r.path: r for r in found.collect()}
    one = S.PARSERS["python"]("src/f7.py", files.first().content, None)
    assert len(got) == 450 and [a.asDict(True) for a in got["src/f7.py"].artifacts] == one.artifacts and [r.asDict(True) for r in got["src/f7.py"].relations] == one.relations


def test_outlines_are_listed_without_nested_rows(spark):
    one = "class A(B):\n    def f(self):\n        self.f()\n        self.é()\n    def f(self):\n        pass\n"
    rows = [("a.py", one, "python"), ("b.py", "def f(\n", "python"), ("c.zz", "x", "none"), ("d.py", None, "python"), ("e.rs", "fn a() { b(); }\nfn b() {}", "rust"), ("f.go", None, "go")]
    found = S.listed(spark.createDataFrame(rows, "path string, content string, parser string"))
    want = []
    for path, content, name in (rows[0], rows[3], rows[4]):
        out = S.PARSERS[name](path, content or "", None)
        names = {a["artifact_id"]: a["qualified_name"] for a in out.artifacts}
        want += [(path, a["kind"], a["qualified_name"], None, a["source_ref"]["start_line"], a["source_ref"]["end_line"]) for a in out.artifacts]
        want += [(path, r["kind"], names[r["from_id"]], names.get(r["to_ref"], r["to_ref"]), *[r["evidence"]["start_line"]] * 2) for r in out.relations]
    assert len(want) > 12 and sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    for language in ("typescript", "python", "rust"):
        plan = entry.queries()[f"extract_structure_{language}"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "relation_id" not in plan  # hashes that no column asks for are not made


def test_listings_are_decoded_in_one_pass(spark):
    long = "".join(f"M\0p{i}\0" for i in range(20_000))
    listings = [long, "\0M\0a\0\0R100\0old\0new\0C75\0x\0y\0D\0z\0X\0q\0", "R100\0old", "R100\0old\0", "M", "", None, "A\0R1\0T\0b", "R\0M\0D\0A\0é\0\0"]
    want = []
    for fields in ([f for f in (x or "").split("\0") if f] for x in listings):
        while len(fields) >= (3 if fields and fields[0][0] in "RC" else 2):
            n = 3 if fields[0][0] in "RC" else 2
            kind = {"R": "RENAMED", "C": "ADDED", **C.LETTERS}.get(fields[0][0])
            want.append((fields[n - 1], fields[1] if fields[0][0] == "R" else None, kind))
            fields = fields[n:]
    found = C.decode_listing(spark.createDataFrame([(x,) for x in listings], "listing string"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # a fold copies what it holds at each step


def test_tokens_are_counted_a_few_documents_at_a_time():
    tokens = pa.array([["a", "b", "a"]] * 1200 + [None], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1201)), tokens], ["key", "tokens"])
    got = list(ranking.counted({"a": 0, "c": 1})(iter([batch])))
    assert max(map(len, got)) <= 500 and sum(map(len, got)) == 1201
    assert pa.Table.from_batches(got).column("counts").to_pylist() == [[2]] * 1200 + [[]]


def test_changes_of_a_proposal_are_made_once(spark):
    plan = entry.queries()["qa_proposal_problems"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1  # their stale hashes are told in the same pass
