"""Sources and sinks: tables by name, keyset pages, newest rows, idempotent and immutable writes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cluster, unless it has many partitions a core. Partitions of files tell little about rows: a file that is
    cut into several may hold one row group, which one task then reads whole."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * want) if df.rdd.getNumPartitions() < 8 * want else df


#: Rows of an Arrow batch at most: texts and their tokens are long rows, and a batch is in memory whole.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Make Python maps of this session take at most BATCH_ROWS rows at a time."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keyset_page(rows: DataFrame, key: str, cursor: str | None, size: int = 100) -> DataFrame:
    """Up to size + 1 rows after the cursor in key order; a row beyond size means that there is another page."""
    if not 1 <= size <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    return (rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))).orderBy(key).limit(size + 1)


def newest(rows: DataFrame, keys: list[str], created: str, ident: str) -> DataFrame:
    """The newest row of each key, the larger id breaking ties; one aggregate, no sort of whole groups."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct(created, ident)).alias("r"))
    return best.select(*keys, "r.*")


def replace_partition(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write rows over exactly the partitions that they belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def insert_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet, one for each key."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def conflicts(rows: DataFrame, existing: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """Rows whose key is there with another fingerprint."""
    old = existing.select(F.col(key).alias("old_key"), F.col(fingerprint).alias("old_fingerprint"))
    return rows.join(old, (F.col(key) == F.col("old_key")) & (F.col(fingerprint) != F.col("old_fingerprint"))).drop("old_key")


def snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """path (relative to the folder) and content of every file of a checked-out snapshot."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.split("://")[-1].rstrip("/") + "/"
    return rows.select(F.substring_index("path", F.lit(root), -1).alias("path"), "content", F.col("length").alias("bytes"))


def active(revisions: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """The revision that the pointer of each key names; a pointer without exactly one revision is in error."""
    found = pointers.join(revisions.withColumnRenamed("revision_id", "stored_id"), keys, "left").where(F.col("stored_id").isNull() | (F.col("stored_id") == F.col("revision_id")))
    return found.groupBy(*keys, "revision_id").agg(F.count("stored_id").alias("n")).withColumn("valid", F.col("n") == 1)


def export_json(rows: DataFrame, path: str) -> None:
    """The rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str, started_at: datetime | None = None, result: str | None = None) -> None:
    """Add rows to an append-only table with when their work began and ended, and how."""
    told = rows.withColumn("started_at", F.lit(started_at).cast("timestamp")).withColumn("ended_at", F.current_timestamp()).withColumn("result", F.lit(result).cast("string"))
    told.write.mode("append").parquet(path)
