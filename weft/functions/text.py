"""Text functions as column expressions: tokens, symbol terms, hashed feature vectors, stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import vectors
from weft.sources.tables import small_batches


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; a capital after a small letter or digit begins a new one."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")), F.lit(r"[\p{L}\p{Nd}_]+"), 0)


def symbol_terms(name: Column, qualified: Column) -> Column:
    """Sorted distinct terms by which a symbol is found: tokens of both names, and both names whole."""
    name, qualified = F.coalesce(name, F.lit("")), F.coalesce(qualified, F.lit(""))
    return F.array_sort(F.array_distinct(F.filter(F.concat(tokens(name), tokens(qualified), F.array(F.lower(name), F.lower(qualified))), lambda x: x != "")))


def symbol_score(terms: Column, query: Column) -> Column:
    """Share of query tokens (repeats count) that hit a term: the first term in order that is equal counts 1, or 0.6 if
    one begins with the other and the token has two bytes at least."""

    def score(total: Column, token: Column) -> Column:
        long = F.octet_length(token) >= 2
        hits = F.filter(terms, lambda t: (t == token) | (long & (t.startswith(token) | token.startswith(t))))
        first = F.get(hits, F.lit(0))
        return total + F.when(first.isNull(), 0.0).when(first == token, 1.0).otherwise(0.6)

    summed = F.aggregate(query, F.lit(0.0), score)
    return F.when(F.size(query) == 0, 0.0).otherwise(F.least(F.lit(1.0), summed / F.size(query)))


def features(words: Column) -> Column:
    """Tokens, and the 3- and 4-grams of characters of the tokens joined by a space."""
    points = F.regexp_extract_all(F.array_join(words, " "), F.lit("(?s)."), 0)

    def grams(n: int) -> Column:  # the points shifted side by side; a lambda must not hold them, it would make them anew
        size = F.greatest(F.size(points) - n + 1, F.lit(0))
        shifted = F.arrays_zip(*(F.slice(points, F.lit(k + 1), size).alias(f"p{k}") for k in range(n)))
        return F.transform(shifted, lambda x: F.concat(*(x[f"p{k}"] for k in range(n))))

    return F.concat(words, grams(3), grams(4))


def feature_place(feature: Column, dimensions: int = 256) -> tuple[Column, Column]:
    """Bucket and sign of a feature: the first eight bytes of its SHA-256, little-endian, modulo the dimensions; bit 0 of
    byte eight."""
    digest = F.sha2(feature.cast("binary"), 256)
    if dimensions == 256:
        bucket = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    else:
        turned = F.concat(*(F.substring(digest, 1 + 2 * i, 2) for i in range(7, -1, -1)))
        bucket = F.pmod(F.conv(turned, 16, 10).cast("decimal(20,0)"), F.lit(dimensions)).cast("int")
    sign = F.when(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return bucket, sign


def hash_sums(rows: DataFrame, key: str, words: Column, dimensions: int = 256) -> DataFrame:
    """key and lists: for each row of the key the sums of the signs of its features in each bucket.

    Features are counted where their row lies, so each key is shuffled with one list; see `vectors`."""
    small_batches(rows.sparkSession)
    each = rows.select(F.col(key).alias("key"), words.alias("words")).mapInArrow(vectors.sums(dimensions), f"key {rows.schema[key].dataType.simpleString()}, sums array<int>")
    return each.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "key").groupBy("key").agg(F.collect_list("sums").alias("lists"))  # a set number, as a map follows


def hash_vectors(rows: DataFrame, key: str, words: Column, dimensions: int = 256) -> DataFrame:
    """key, bucket and weight: the unit vector of each key's features in sparse form."""
    return hash_sums(rows, key, words, dimensions).mapInArrow(vectors.units(dimensions, key), f"{key} {rows.schema[key].dataType.simpleString()}, bucket int, weight double")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; 0 where their lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the parts, each ended by a NUL byte."""
    joined = F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")).cast("binary"), F.lit(b"\0"))))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 24))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as one JSON object."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
