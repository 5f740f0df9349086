"""Question answering and change proposals as batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.paths import canonical_path
from weft.operators.wiki import CITATION

#: Words that tell an intent, tried in this order, and the depth of its graph query.
INTENTS = {
    "CALL_CHAIN": (["调用链", "调用关系", "call chain", "calls", "调用路径"], 4),
    "IMPACT_ANALYSIS": (["影响", "改动", "变更", "impact", "affected"], 3),
    "TROUBLESHOOTING": (["故障", "报错", "失败", "排查", "bug", "error", "fail", "debug"], 2),
    "ARCHITECTURE": (["架构", "模块", "设计", "architecture", "module", "design"], 2),
}
LONGEST_QUESTION, MOST_EVIDENCE, INSUFFICIENT = 8000, 30, "The evidence at hand is not sufficient for an answer."
RISKS = ["LOW", "MEDIUM", "HIGH"]


def intent(question: Column) -> Column:
    """The first intent one of whose words the question holds, or GENERAL."""
    q = F.lower(question)
    out = F.when(F.lit(False), "")
    for name, (words, _) in INTENTS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        out = out.when(hit, name)
    return out.otherwise("GENERAL")


def depth(name: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for n, (_, d) in INTENTS.items():
        out = out.when(name == n, d)
    return out.otherwise(1)


def question_problem(question: Column, permissions: Column) -> Column:
    """Why a question is refused, or null."""
    return F.when(F.coalesce(F.trim(question), F.lit("")) == "", "empty").when(F.char_length(question) > LONGEST_QUESTION, "too long").when(F.size(F.array_distinct(permissions)) != F.size(permissions), "repeated permission").when(~F.array_contains(permissions, "read"), "no read permission")


def expanded(questions: DataFrame, hits: DataFrame, key: str = "question_id") -> DataFrame:
    """The second round's queries: questions without a hit, with their intent's words added."""
    words = F.create_map(*(F.lit(x) for n, (w, _) in INTENTS.items() for x in (n, " ".join(w))))
    return questions.join(hits.select(key).distinct(), key, "left_anti").withColumn("question", F.concat_ws(" ", "question", words[intent(F.col("question"))]))


def evidence(refs: DataFrame, commit: str, most: int = MOST_EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """Citations of one commit, each once, in order; and one row of how many were invalid or of another commit."""
    path = F.col("path")
    ok = F.coalesce((path != "") & ~path.rlike(r"^/|(^|/)\.\.(/|$)") & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), F.lit(False))
    counts = refs.agg(F.count_if(~ok).alias("invalid"), F.count_if(ok & (F.col("commit_sha") != commit)).alias("other_commit"))
    return refs.where(ok & (F.col("commit_sha") == commit)).select(*CITATION).dropDuplicates().orderBy("path", "start_line", "end_line", "symbol_id").limit(most), counts


def gated(answers: DataFrame) -> DataFrame:
    """Answers without citations become the fixed one."""
    return answers.withColumn("answer", F.when(F.coalesce(F.size("citations"), F.lit(0)) <= 0, INSUFFICIENT).otherwise(F.col("answer")))


def selected(citations: Column, indexes: Column) -> Column:
    """Citations by index from 1, each once in the order given; null if an index is out of range."""
    bad = F.exists(indexes, lambda i: (i < 1) | (i > F.size(citations)))
    return F.when(~bad, F.transform(F.array_distinct(indexes), lambda i: F.element_at(citations, i)))


def unpinned(runs: DataFrame) -> DataFrame:
    """Conversations on more than one snapshot."""
    return runs.groupBy("conversation_id").agg(F.count_distinct("snapshot_id").alias("snapshots")).where("snapshots > 1")


#: What may not stand after the headers of a change to one file.
LIFECYCLE = ["\n--- a/", "\n+++ b/", "\n--- /dev/null", "\n+++ /dev/null", "diff --git ", "rename from ", "rename to ", "new file mode ", "deleted file mode "]


def proposal_problem() -> Column:
    """Why a file change is refused, or null: path, risk, hash of its base, textual diff, headers, changes of other files."""
    path, diff = F.coalesce("path", F.lit("")), F.replace(F.coalesce("unified_diff", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    clean = F.regexp_replace(F.trim(path), r"^(\./)+|/$", "")
    head = F.concat(F.lit("--- a/"), clean, F.lit("\n+++ b/"), clean, F.lit("\n"))
    rest = F.substring(diff, F.char_length(head) + 1, F.char_length(diff))
    base = F.coalesce("base_content_hash", F.lit(""))
    textual = (F.trim(diff, F.lit(" \t\n\r")) != "") & ~diff.contains("GIT binary patch") & ~diff.contains("\0")
    other = F.lit(False)
    for mark in LIFECYCLE:
        other = other | rest.contains(mark)
    return (
        F.when(path.rlike(r"[\r\n\x00]|^/|(^|/)\.\.(/|$)") | clean.isin("", "."), "path")
        .when(~F.coalesce(F.col("risk").isin(RISKS), F.lit(False)), "risk")
        .when(~base.startswith("sha256:") | (F.char_length(base) < 15), "base hash")
        .when(~textual, "text")
        .when(~diff.startswith(head) | ~diff.contains("\n@@ "), "header")
        .when(other, "lifecycle")
    )


def stale_proposals(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changes whose base hash is not the file's, or whose file is unknown."""
    known = files.select("path", F.col("content_hash").alias("current"))
    return changes.join(known, "path", "left").where(~F.col("base_content_hash").eqNullSafe(F.col("current")))


def version_gaps(history: DataFrame, key: str = "proposal_id", order: str = "updated_at") -> DataFrame:
    """Updates whose version is not one more than the one before."""
    before = F.lag("version").over(Window.partitionBy(key).orderBy(order))
    return history.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("version") != F.col("before") + 1))


def evidence_budget(rows: DataFrame, key: str, order: list[str], text: str, limit: int) -> DataFrame:
    """Rows of each key in order with text while a budget of characters lasts; later ones stay with what is left, or none."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(limit) - F.coalesce(F.sum(F.char_length(text)).over(w), F.lit(0)), F.lit(0)).cast("int")
    return rows.withColumn("left", left).withColumn(text, F.left(F.col(text), F.col("left"))).drop("left")


def model_output(text: Column, schema: str) -> Column:
    """A model's JSON out of its code fence; null if it does not parse."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


def prompt(nodes: Column, edges: Column, most: int = 40) -> Column:
    """A bounded JSON of nodes and edges for an external model."""
    return F.to_json(F.struct(F.slice(nodes, 1, most).alias("nodes"), F.slice(edges, 1, most).alias("edges")))


def answer_text(rows: DataFrame, key: str, line: Column, order: list[str], most: int = 10) -> DataFrame:
    """Structured answers: how many facts there are, and the first of them as numbered lines."""
    numbered = rows.select(key, F.struct(*order).alias("o"), line.alias("line"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("o"))
    first = numbered.withColumn("i", place).where(F.col("i") <= most).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: F.concat(x["i"].cast("string"), F.lit(". "), x["line"])), "\n").alias("lines"))
    counts = rows.groupBy(key).agg(F.count("*").alias("facts"))
    return first.join(counts, key).select(key, F.concat(F.col("facts").cast("string"), F.lit(" facts\n"), F.col("lines")).alias("answer"))


def file_hashes(artifacts: DataFrame, cited: DataFrame, commit: str) -> DataFrame:
    """path and content_hash of the files of one commit whose paths are cited; other artifacts and commits have no say."""
    files = artifacts.where((F.col("kind") == "FILE") & (F.col("commit_sha") == commit)).withColumn("path", canonical_path(F.col("path")))
    return files.join(cited.select(canonical_path(F.col("path")).alias("path")), "path", "left_semi").select("path", "content_hash")
