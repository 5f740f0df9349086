"""What the training-data operators share: inputs, the shared folder, folds and batches of rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one step inside a Python task holds at a time (a longer text makes a step of its own).
CHARS_PER_STEP = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session without a cluster may do without
    that setting, and gets a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder, so that the plan behind them ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text (null: empty); other columns of docs, whatever their names, are left out."""
    return docs.select(docs["doc_id"], F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *(docs[c] for c in more))


def fold(ident: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(ident.cast("string").cast("binary")) % n


#: Rows in an Arrow batch at most: texts are long rows, and a batch is in memory whole.
BATCH_ROWS = 500


def spread(df: DataFrame) -> DataFrame:
    """df ready for a Python map over texts: small Arrow batches, and dealt evenly over the cluster where its files give
    fewer partitions than there are cores (else a small input of one file would run in one task)."""
    spark = df.sparkSession
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    want = spark.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 2 else df


def steps(batches: Iterator[pa.RecordBatch], limit: int = CHARS_PER_STEP) -> Iterator[tuple[list, list]]:
    """(ids, texts) of bounded size out of the first two columns of Arrow batches; bounded memory for any batch size."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes = texts.value_lengths().to_pylist() if hasattr(texts, "value_lengths") else [len(x) for x in texts.to_pylist()]
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield ids[at:i], texts.slice(at, i - at).to_pylist()
                at, total = i, 0
            total += size
        if at < len(ids):
            yield ids[at:], texts.slice(at).to_pylist()


def arrow_steps(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) out of the first two columns of Arrow batches, as arrays of about `limit` characters: small batches are
    joined, large ones are cut between texts."""
    held: list[tuple[pa.Array, pa.Array]] = []
    total = 0

    def joined() -> tuple[pa.Array, pa.Array]:
        return tuple(pa.concat_arrays(list(x)) for x in zip(*held))

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        at = 0
        for i, size in enumerate(pc.binary_length(texts).to_pylist()):
            if total and total + size > limit:
                if i > at:
                    held.append((ids.slice(at, i - at), texts.slice(at, i - at)))
                yield joined()
                held, total, at = [], 0, i
            total += size
        if at < len(ids):
            held.append((ids.slice(at), texts.slice(at)))
    if held:
        yield joined()


_STATE: dict = {}


def worker_state(key, make):
    """What a worker remembers from task to task. Only one operator's state is kept: Spark reuses workers for other stages,
    whose memory an earlier operator's caches must not take."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


class Cache:
    """A bounded map of two generations: what a full generation did not see again is forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def all_of(self, keys: list, resolve) -> list:
        """The value of each key; resolve(list of distinct unknown keys) gives the values of those."""
        got = list(map(self.new.get, keys))
        at = [i for i, v in enumerate(got) if v is None]
        if at:
            old, known, miss = self.old, {}, {keys[i] for i in at}
            fresh = []
            for k in miss:
                v = old.get(k)
                if v is None:
                    fresh.append(k)
                else:
                    known[k] = v
            known.update(zip(fresh, resolve(fresh)))
            if len(self.new) + len(known) > self.size:
                self.old, self.new = self.new, {}
            self.new.update(known)
            for i in at:
                got[i] = known[keys[i]]
        return got


#: Up to so many ids are broadcast to leave rows out; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is not among those of gone."""
    gone = cut(gone.select(F.col("doc_id").alias("gone_id")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def small_parts(batches: Iterator[pa.RecordBatch], at: int, limit: int = CHARS_PER_STEP) -> Iterator[pa.RecordBatch]:
    """Batches cut between rows so that the texts of column number `at` have about `limit` bytes (a longer one is alone)."""
    for batch in batches:
        first, total = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
            if total and total + size > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        if first < batch.num_rows:
            yield batch.slice(first)


def row_filter(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs, with all their columns, for whose texts keep(texts) is true; null texts are given as empty."""
    at, rows = docs.columns.index("text"), docs.withColumn("text", docs["text"].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_parts(batches, at):
            yield part.filter(pa.array(keep([x or "" for x in part.column(at).to_pylist()]), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def most_frequent(rows: DataFrame, count: str, most: int) -> Column:
    """Whether a row's count is among the greatest, of which there are `most` or fewer; found from a histogram, so nothing
    is sorted, and what is left has a bounded share of the sum of all counts."""
    bucket = F.floor(F.log2(F.col(count)) * 16)
    seen = sorted(((r[0], r[1]) for r in rows.where(F.col(count) > 0).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, low = 0, None
    for b, n in seen:
        if (total := total + n) > most:
            break
        low = b
    return F.lit(False) if low is None else (F.col(count) > 0) & (bucket >= low)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """rows left-joined with groups (one row a key; column `size` is never null) without a hot key: the largest groups, `most`
    at most, are broadcast, and only rows of smaller ones are shuffled. Rows with a null key have no group."""
    hot = most_frequent(groups, size, most)
    first = rows.join(F.broadcast(groups.where(hot)), key, "left")
    cold = groups.where(~hot)
    if cold.isEmpty():
        return first
    met = F.col(size).isNotNull() | F.col(key).isNull()
    return first.where(met).unionByName(first.where(~met).select(*rows.columns).join(cold, key, "left").select(*first.columns))
