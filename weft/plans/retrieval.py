"""Registered queries: retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import retrieval as R
from weft.plans.registry import query
from weft.sources.tables import spread, table

QUERY = "the thing of restHandle edand"
TOKENS = r"regexp_extract_all(lower(regexp_replace(coalesce({}, ''), '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g')), '[\p{{L}}\p{{Nd}}_]+')"
DOCS = f"docs AS MATERIALIZED (SELECT doc_id, lang AS language, source || '/' || doc_id || '.' || lang AS path, source, text, {TOKENS.format('text')} AS tokens FROM documents)"
Q = f"q AS (SELECT DISTINCT unnest({TOKENS.format(repr(QUERY))}) AS term)"
BM25 = f"""WITH {DOCS}, {Q},
n AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM docs),
tf AS MATERIALIZED (SELECT doc_id, len(tokens) AS l, term, len(list_filter(tokens, lambda x: x = term)) AS tf FROM docs, q),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
raw AS MATERIALIZED (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS raw FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY doc_id),
keyword AS (SELECT doc_id, raw / (SELECT max(raw) FROM raw) AS score FROM raw WHERE raw > 0)"""


def docs_of(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("lang").alias("language"), F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), "source", "text", T.tokens(F.col("text")).alias("tokens"))


@query("retrieval_tokens", f"WITH {DOCS} SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM docs")
def tokens(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"))


TERMS = f"list_sort(list_distinct(list_filter({TOKENS.format('source')} || {TOKENS.format('path')} || [lower(source), lower(path)], lambda x: x <> '')))"


@query("retrieval_symbol_terms", f"WITH {DOCS} SELECT doc_id, array_to_string({TERMS}, '|') AS terms FROM docs")
def symbol_terms(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.array_join(T.symbol_terms(F.col("source"), F.col("path")), "|").alias("terms"))


@query(
    "retrieval_symbol_scores",
    f"""WITH {DOCS}, t AS (SELECT doc_id, {TERMS} AS terms FROM docs), q AS (SELECT unnest(['src1', 'en', 'en', 'x', 'src12']) AS token, unnest([1, 2, 3, 4, 5]) AS i),
    h AS (SELECT doc_id, token, list_filter(terms, lambda x: x = token OR (strlen(token) >= 2 AND (starts_with(x, token) OR starts_with(token, x))))[1] AS hit FROM t, q)
    SELECT doc_id, round(least(1.0, sum(CASE WHEN hit IS NULL THEN 0 WHEN hit = token THEN 1 ELSE 0.6 END) / 5), 6)::DOUBLE AS score FROM h GROUP BY doc_id""",
)
def symbol_scores(spark, sf_dir):
    asked = F.array(*map(F.lit, ["src1", "en", "en", "x", "src12"]))
    return docs_of(spark, sf_dir).select("doc_id", F.round(T.symbol_score(T.symbol_terms(F.col("source"), F.col("path")), asked), 6).alias("score"))


@query("retrieval_bm25", f"{BM25} SELECT doc_id, round(score, 6) AS score FROM keyword ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def bm25(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    asked = [r[0] for r in spark.range(1).select(F.explode(T.tokens(F.lit(QUERY)))).collect()]
    return R.bm25(docs, asked).orderBy(F.round("score", 9).desc(), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query("retrieval_bm25_filtered", BM25.replace(" FROM documents)", " FROM documents WHERE lower(lang) = 'en' AND starts_with(source || '/', 'src1/'))") + " SELECT doc_id, round(score, 6) AS score FROM keyword ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def bm25_filtered(spark, sf_dir):
    docs = R.filtered(docs_of(spark, sf_dir), languages=["EN"], prefixes=["src1"])
    asked = [r[0] for r in spark.range(1).select(F.explode(T.tokens(F.lit(QUERY)))).collect()]
    return R.bm25(docs, asked).orderBy(F.round("score", 9).desc(), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "retrieval_batch",
    f"""WITH {DOCS}, q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM benchmark),
    n AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM docs), e AS (SELECT doc_id, len(tokens) AS l, unnest(tokens) AS term FROM docs),
    tf AS (SELECT doc_id, l, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS raw FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS rank FROM raw)
    SELECT query_id, rank::INTEGER AS rank, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM r WHERE rank <= 10""",
)
def batch(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("tokens"))
    return R.bm25_batch(docs_of(spark, sf_dir), asked).withColumn("score", F.round("score", 6))


FEATURES = """j AS MATERIALIZED (SELECT doc_id, tokens, string_split(array_to_string(tokens, ' '), '') AS s FROM docs),
f AS (SELECT doc_id, unnest(tokens || [s[i] || s[i + 1] || s[i + 2] for i in range(1, len(s) - 1)] || [s[i] || s[i + 1] || s[i + 2] || s[i + 3] for i in range(1, len(s) - 2)]) AS f FROM j),
c AS (SELECT doc_id, f, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT doc_id, ('0x' || substring(sha256(f), 1, 2))::INTEGER AS bucket, sum(n * CASE WHEN ('0x' || substring(sha256(f), 17, 2))::INTEGER % 2 = 0 THEN 1 ELSE -1 END) AS s FROM c GROUP BY ALL HAVING s <> 0),
v AS (SELECT doc_id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS weight FROM b)"""


@query("retrieval_hash_vectors", f"WITH {DOCS}, {FEATURES} SELECT doc_id, bucket, round(weight, 6) AS weight FROM v")
def hash_vectors(spark, sf_dir):
    return T.hash_vectors(docs_of(spark, sf_dir), "doc_id", F.col("tokens")).withColumn("weight", F.round("weight", 6))


@query("retrieval_cosine", "SELECT e.vec_id, round(greatest(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id LIMIT 10")
def cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 0").select(F.col("embedding").alias("asked"))
    scored = rows.crossJoin(F.broadcast(asked)).select("vec_id", F.greatest(T.dot(F.col("embedding"), F.col("asked")), F.lit(0.0)).alias("score"))
    return scored.orderBy(F.round("score", 9).desc(), "vec_id").limit(10).select("vec_id", F.round("score", 6).alias("score"))


HYBRID = BM25.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {FEATURES.replace('f AS (', 'f AS (', 1)},
qd AS (SELECT 0 AS doc_id, {TOKENS.format(repr(QUERY))} AS tokens), qj AS (SELECT doc_id, tokens, array_to_string(tokens, ' ') AS s FROM qd),
qf AS (SELECT unnest(tokens || [substring(s, i, 3) for i in range(1, length(s) - 1)] || [substring(s, i, 4) for i in range(1, length(s) - 2)]) AS f FROM qj),
qb AS (SELECT ('0x' || substring(sha256(f), 1, 2))::INTEGER AS bucket, sum(CASE WHEN ('0x' || substring(sha256(f), 17, 2))::INTEGER % 2 = 0 THEN 1 ELSE -1 END) AS s FROM qf GROUP BY ALL HAVING s <> 0),
qv AS (SELECT bucket, s / sqrt(sum(s * s) OVER ()) AS asked FROM qb),
semantic AS (SELECT doc_id, sum(weight * asked) AS score FROM v JOIN qv USING (bucket) GROUP BY doc_id HAVING sum(weight * asked) > 0),
hits AS (SELECT d.doc_id, coalesce(k.score, 0) AS keyword, coalesce(s.score, 0) AS semantic FROM docs d LEFT JOIN keyword k USING (doc_id) LEFT JOIN semantic s USING (doc_id)),
fused AS (SELECT doc_id, keyword, semantic, round((keyword * 0.25 + semantic * 0.25) / 0.5, 9) AS score FROM hits)"""


@query("retrieval_hybrid", HYBRID + " SELECT doc_id, round(keyword, 6) AS keyword, round(semantic, 6) AS semantic, round(score, 6) AS score, CASE WHEN keyword > 0 AND semantic > 0 THEN 'KEYWORD,SEMANTIC' WHEN keyword > 0 THEN 'KEYWORD' ELSE 'SEMANTIC' END AS reasons FROM fused WHERE score > 0 ORDER BY fused.score DESC, doc_id LIMIT 40")
def hybrid(spark, sf_dir):
    docs = docs_of(spark, sf_dir).withColumn("symbol_terms", T.symbol_terms(F.col("source"), F.col("path")))
    hits = R.hybrid(docs, QUERY, ["bm25", "vector"])
    return hits.select("doc_id", F.round("keyword", 6).alias("keyword"), F.round("semantic", 6).alias("semantic"), F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query("retrieval_graph_expansion", f"""{BM25}, seeds AS (SELECT doc_id FROM keyword ORDER BY round(score, 9) DESC, doc_id LIMIT 5),
near AS (SELECT b.doc_id, 0.65 AS score FROM seeds JOIN docs a USING (doc_id) JOIN docs b ON a.source = b.source AND b.doc_id = a.doc_id + 20)
SELECT doc_id, max(score)::DOUBLE AS score FROM (SELECT doc_id, 1.0 AS score FROM seeds UNION ALL SELECT * FROM near) GROUP BY doc_id""")
def graph_expansion(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    asked = [r[0] for r in spark.range(1).select(F.explode(T.tokens(F.lit(QUERY)))).collect()]
    seeds = R.bm25(docs, asked).orderBy(F.round("score", 9).desc(), "doc_id").limit(R.SEEDS)
    own = docs.select("doc_id", "source")
    neighbours = own.join(own.select((F.col("doc_id") - 20).alias("doc_id"), F.col("doc_id").alias("other"), F.col("source").alias("s2")), "doc_id").where("source = s2").select("doc_id", "other")
    return R.expand(seeds, neighbours)


@query("retrieval_context", f"""{BM25}, top AS (SELECT doc_id, round(score, 9) AS score, text FROM keyword JOIN docs USING (doc_id) ORDER BY round(score, 9) DESC, doc_id LIMIT 10),
b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM top)
SELECT doc_id, round(score, 6) AS score, left(text, (8000 - before)::BIGINT) AS text, length(text) > 8000 - before AS cut FROM b WHERE before < 8000""")
def context(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    asked = [r[0] for r in spark.range(1).select(F.explode(T.tokens(F.lit(QUERY)))).collect()]
    hits = R.bm25(docs, asked).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(10)
    return R.context(hits.join(docs.select("doc_id", "text"), "doc_id"), 8000).withColumn("score", F.round("score", 6))


@query("retrieval_index_stats", "SELECT count(*) AS documents, count(DISTINCT lower(lang)) AS languages, 0::BIGINT AS with_vector FROM documents")
def index_stats(spark, sf_dir):
    return R.index_stats(docs_of(spark, sf_dir))


@query("retrieval_strategy_hits", HYBRID + ", best AS (SELECT * FROM fused WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40) SELECT count(*) AS candidates, 0::BIGINT AS symbol_hits, count(*) FILTER (keyword > 0) AS keyword_hits, count(*) FILTER (semantic > 0) AS semantic_hits, 0::BIGINT AS graph_hits FROM best")
def strategy_hits(spark, sf_dir):
    docs = docs_of(spark, sf_dir).withColumn("symbol_terms", T.symbol_terms(F.col("source"), F.col("path")))
    return R.strategy_hits(R.hybrid(docs, QUERY, ["bm25", "vector"]))
