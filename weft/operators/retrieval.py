"""The hybrid retrieval index and its search: symbols, BM25, hashed vectors, graph neighbours, fusion and context."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions import vectors
from weft.operators import ranking
from weft.operators.graph import cut
from weft.operators.validate import valid_source_ref
from weft.sources.tables import small_batches

#: Weights of the strategies, BM25's parameters, scores of graph seeds and their neighbours.
WEIGHTS = {"SYMBOL": 0.35, "KEYWORD": 0.25, "SEMANTIC": 0.25, "GRAPH": 0.15}
ALIASES = {"BM25": "KEYWORD", "VECTOR": "SEMANTIC"}
K1, B = 1.2, 0.75
SEED_SCORE, NEIGHBOUR_SCORE, SEEDS = 1.0, 0.65, 5
CONTEXT_CHARACTERS, TOP_K, MOST_K = 24000, 10, 100


def strategies(names: list[str] | None) -> list[str]:
    """Strategies in upper case, aliases resolved, each once; all four by default."""
    found = [ALIASES.get(n.strip().upper(), n.strip().upper()) for n in names or WEIGHTS]
    if bad := [n for n in found if n not in WEIGHTS]:
        raise ValueError(f"unknown strategies: {bad}")
    return list(dict.fromkeys(found))


def documents_of(artifacts: DataFrame) -> DataFrame:
    """One index document for each artifact: text and symbol terms. Attributes follow in the order of their keys."""
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>")))), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    text = F.concat_ws(" ", "name", "qualified_name", "signature", "kind", "language", "source_ref.path", F.array_join(pairs, " "))
    return artifacts.select(
        T.stable_id("doc", F.col("artifact_id"), F.col("source_ref.commit_sha")).alias("document_id"),
        "artifact_id",
        F.col("kind").alias("chunk_type"),
        "language",
        F.col("source_ref.path").alias("path"),
        F.trim(F.regexp_replace(text, " +", " ")).alias("text"),
        T.symbol_terms(F.col("name"), F.col("qualified_name")).alias("symbol_terms"),
    )


def index_problems(artifacts: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """key, artifact_id and reason of the artifacts for which an index of their snapshot is refused: without id or name,
    repeated, with an unsound source reference, with another hash than its reference, of another commit than the snapshot's
    others (the smallest commit is taken for the snapshot's)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    twice = artifacts.groupBy(key, "artifact_id").agg(F.count("*").alias("copies")).where("copies > 1").select(key, "artifact_id", "copies")
    commits = artifacts.groupBy(key).agg(F.min("source_ref.commit_sha").alias("first_commit"))
    rows = artifacts.join(twice, [key, "artifact_id"], "left").join(commits, key)
    hashed = blank(F.col("content_hash")) | ~F.col("content_hash").eqNullSafe(F.col("source_ref.content_hash"))
    reason = F.when(blank(F.col("artifact_id")) | blank(F.col("name")), "empty").when(F.col("copies").isNotNull(), "repeated").when(~valid_source_ref(), "source reference").when(hashed, "hash").when(F.col("source_ref.commit_sha") != F.col("first_commit"), "commit")
    return rows.withColumn("reason", reason).where("reason is not null").select(key, "artifact_id", "reason")


def under(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of the prefixes or lies below one."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (path == p) | path.startswith(p.rstrip("/") + "/")
    return hit


def filtered(docs: DataFrame, languages: list[str] = (), kinds: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """The corpus of a search: filters come before all statistics."""
    if languages:
        docs = docs.where(F.lower("language").isin([x.lower() for x in languages]))
    if kinds:
        docs = docs.where(F.col("chunk_type").isin(list(kinds)))
    if prefixes:
        docs = docs.where(under(F.col("path"), prefixes))
    return docs


def occurrences(words: str, token: str) -> Column:
    return F.size(F.filter(words, lambda x: x == token))


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", words: str = "tokens") -> DataFrame:
    """key and keyword score of every document that holds a query token, divided by the highest.

    Term counts are taken inside each row, so that no token is shuffled, and checkpointed (a few
    numbers a row), so that texts are read and tokenised once; statistics are one aggregate row."""
    query = list(dict.fromkeys(query))
    if not query:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = cut(docs.select(key, F.size(words).alias("len"), *(occurrences(words, q).alias(f"tf{i}") for i, q in enumerate(query))))
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    total = F.lit(0.0)
    for i in range(len(query)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        total = total + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean))).otherwise(0.0)
    raw = rows.crossJoin(F.broadcast(stats)).select(key, total.alias("raw")).where("raw > 0")
    return raw.crossJoin(F.broadcast(raw.agg(F.max("raw").alias("most")))).select(key, (F.col("raw") / F.col("most")).alias("score"))


#: Distinct terms, and terms of all queries together, up to which queries are sent to the documents.
MOST_TERMS, MOST_ASKED = 200_000, 2_000_000


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int = TOP_K, key: str = "doc_id", words: str = "tokens") -> DataFrame:
    """query_id, rank, key and score of the k best documents of each query of a table (query_id, tokens).

    Queries go to the documents, as numbers of terms, while they have MOST_TERMS distinct terms and MOST_ASKED in all: rows
    are then counts of asked terms in a document, and nothing else is shuffled but each task's best. Larger tables of queries
    are joined by term (bm25_joined). Rows with equal keys are documents of their own; a null list of tokens is empty."""
    spark = docs.sparkSession
    asked = cut(queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term")).distinct())
    n_asked, n_terms = asked.agg(F.count("*"), F.count_distinct("term")).first()
    if n_terms > MOST_TERMS or n_asked > MOST_ASKED:
        return bm25_joined(docs, asked, k, key, words)
    told = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms")).orderBy("query_id").toArrow()
    terms = sorted({t for x in told.column("terms").to_pylist() for t in x})
    numbers = {t: i for i, t in enumerate(terms)}
    sent = spark.sparkContext.broadcast(ranking.Queries(told.column("query_id").to_pylist(), [np.array(sorted(numbers[t] for t in x), np.int64) for x in told.column("terms").to_pylist()]))
    kind = docs.schema[key].dataType.simpleString()
    small_batches(spark)  # a batch of tokens, and what is made of it, is in memory whole
    counts = docs.select(F.col(key).alias("key"), F.coalesce(words, F.array().cast("array<string>")).alias("tokens")).mapInArrow(ranking.counted(numbers), f"key {kind}, len long, terms array<int>, counts array<int>")
    counts = cut(counts)
    n, mean = counts.agg(F.count("*"), F.greatest(F.coalesce(F.avg("len"), F.lit(0.0)), F.lit(1e-9))).first()
    df = np.zeros(len(terms))
    for t, d in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[t] = d
    found = counts.mapInArrow(ranking.ranked(sent, np.log(1 + (n - df + 0.5) / (df + 0.5)), mean, k, K1, B), f"number long, key {kind}, raw double")
    order = Window.partitionBy("number").orderBy(F.round("raw", 9).desc(), "key")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("number")))
    names = spark.createDataFrame(pa.table({"number": pa.array(range(len(told)), pa.int64()), "query_id": told.column("query_id")}))
    return best.join(F.broadcast(names), "number").select("query_id", "rank", F.col("key").alias(key), "score")


def bm25_joined(docs: DataFrame, asked: DataFrame, k: int = TOP_K, key: str = "doc_id", words: str = "tokens") -> DataFrame:
    """As bm25_batch, for any number of queries: postings of asked terms are joined with the queries (query_id, term)."""
    terms = asked.select("term").distinct()
    rows = docs.select(key, F.size(words).alias("len"), F.explode(words).alias("term"))
    tf = rows.join(F.broadcast(terms) if terms.count() <= 200_000 else terms, "term").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    stats = docs.agg(F.count("*").alias("n"), F.greatest(F.avg(F.size(words)), F.lit(1e-9)).alias("mean"))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(stats)).select(key, "term", (F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))).alias("w"))
    scores = weighted.join(asked, "term").groupBy("query_id", key).agg(F.sum("w").alias("raw"))
    order = Window.partitionBy("query_id").orderBy(F.round("raw", 9).desc(), key)
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", key, (F.col("raw") / F.max("raw").over(Window.partitionBy("query_id"))).alias("score"))


def hash_similarity(docs: DataFrame, query: str, key: str = "doc_id", words: str = "tokens", dimensions: int = 256) -> DataFrame:
    """key and cosine of each document's hashed features with the query's, negative ones left out."""
    spark = docs.sparkSession
    asked = np.zeros(dimensions)
    for r in T.hash_vectors(spark.range(1).select(F.lit(0).alias("q"), T.tokens(F.lit(query)).alias("tokens")), "q", F.col("tokens"), dimensions).collect():
        asked[r["bucket"]] = r["weight"]
    return T.hash_sums(docs, key, F.col(words), dimensions).mapInArrow(vectors.cosines(asked, key), f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def expand(seeds: DataFrame, neighbours: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and graph score: seeds 1, what lies one edge from a seed 0.65, the higher of both. neighbours: key, other."""
    near = seeds.select(key).join(neighbours, key).select(F.col("other").alias(key), F.lit(NEIGHBOUR_SCORE).alias("score"))
    return seeds.select(key, F.lit(SEED_SCORE).alias("score")).union(near).groupBy(key).agg(F.max("score").alias("score"))


def hybrid(docs: DataFrame, query: str, wanted: list[str] | None = None, k: int = TOP_K, neighbours: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, the score of each strategy, the fused score and the reasons of the 4k best documents, before reranking.

    docs: key, tokens, symbol_terms. With GRAPH active symbol and keyword scores are computed too, because they make the
    seeds, but weigh only if asked for."""
    if not 0 <= k <= MOST_K:
        raise ValueError(f"top_k must be from 0 to {MOST_K}")
    active, k = strategies(wanted), k or TOP_K
    spark = docs.sparkSession
    asked = [r[0] for r in spark.range(1).select(F.explode(T.tokens(F.lit(query)))).collect()]
    terms = F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")
    out = docs.select(key, T.symbol_score(F.col("symbol_terms"), terms).alias("symbol"))
    out = out.join(bm25(docs, asked, key).withColumnRenamed("score", "keyword"), key, "left")
    if "SEMANTIC" in active:
        out = out.join(hash_similarity(docs, query, key).withColumnRenamed("score", "semantic"), key, "left")
    else:
        out = out.withColumn("semantic", F.lit(0.0))
    out = out.na.fill(0.0, ["symbol", "keyword", "semantic"])
    if "GRAPH" in active and neighbours is not None:
        strength = F.col("symbol") + F.col("keyword") + F.col("semantic")
        seeds = out.where(strength > 0).orderBy(strength.desc(), key).limit(SEEDS)
        out = out.join(expand(seeds, neighbours, key).withColumnRenamed("score", "graph"), key, "left").na.fill(0.0, ["graph"])
    else:
        out = out.withColumn("graph", F.lit(0.0))
    weight = sum(WEIGHTS[s] for s in active)
    fused = sum((F.col(s.lower()) * WEIGHTS[s] for s in active), F.lit(0.0)) / weight
    reasons = F.array_compact(F.array(*(F.when(F.col(s.lower()) > 0, s) for s in active)))
    return out.withColumn("score", F.round(fused, 9)).withColumn("reasons", reasons).where("score > 0").orderBy(F.desc("score"), key).limit(4 * k)


def reranked(hits: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None = None, k: int = TOP_K, key: str = "doc_id") -> DataFrame:
    """The k best after a reranker, whose result must be distinct rows of the candidates with finite scores from 0 up."""
    if rerank is None:
        return hits.orderBy(F.desc("score"), key).limit(k)
    found = rerank(hits)
    same = [c for c in hits.columns if c != "score"]  # a reranker may only change scores
    if missing := [c for c in same if c not in found.columns]:
        raise ValueError(f"reranker: columns {missing} are gone")
    foreign = found.select(*same).exceptAll(hits.select(*same)).count()
    twice = found.groupBy(key).count().where("count > 1").count()
    bad = found.where(F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") == float("inf"))).count()
    if foreign or twice or bad:
        raise ValueError(f"reranker: {foreign} foreign rows, {twice} repeated, {bad} bad scores")
    return found.orderBy(F.desc("score"), key).limit(k)


def context(hits: DataFrame, limit: int = CONTEXT_CHARACTERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits in rank order with as much text as still fits, the last one cut. hits are few: at most top_k."""
    before = F.coalesce(F.sum(F.char_length(text)).over(Window.orderBy(F.desc("score"), key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = hits.withColumn("before", before).where(F.col("before") < limit)
    left = F.greatest(F.lit(limit) - F.col("before"), F.lit(0)).cast("int")
    return rows.select(key, "score", F.left(text, left).alias("text"), (F.char_length(text) > left).alias("cut"))


def strategy_hits(hits: DataFrame) -> DataFrame:
    """One row: how many candidates each strategy scored."""
    return hits.agg(F.count("*").alias("candidates"), *(F.count_if(F.col(s.lower()) > 0).alias(f"{s.lower()}_hits") for s in WEIGHTS))


def index_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, distinct languages, and documents with a vector."""
    vector = F.count_if(F.size("embedding") > 0) if "embedding" in docs.columns else F.lit(0).cast("long")
    return docs.agg(F.count("*").alias("documents"), F.count_distinct(F.lower("language")).alias("languages"), vector.alias("with_vector"))
