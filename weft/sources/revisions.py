"""Immutable revisions, and the pointer to the active one, in a folder on any file system that Spark reaches.

    revisions/<revision>/<attempt>/   tables of one attempt to write a revision; nothing names them until they are sealed
    active/<number>.json              one entry for each activation; that with the greatest number is active

An entry is written beside its place and renamed there, never over another. So a reader sees whole entries only, one of
several writers gets a number and the others are refused, and an attempt that died leaves no half revision: only files that
no entry names. (On stores whose rename is a copy, two writers at the same moment need a lock outside.)
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another revision is active than the one that a writer built on."""


def _context(spark: SparkSession, path: str):
    """Hadoop's view of the file system of a path, and the path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    where = hadoop.Path(path)
    return hadoop, where.getFileSystem(conf), hadoop.FileContext.getFileContext(where.toUri(), conf) if where.toUri().getScheme() else hadoop.FileContext.getFileContext(conf)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs, _ = _context(spark, path)
    return fs.exists(hadoop.Path(path))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    hadoop, fs, _ = _context(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hadoop.Path(path)) if s.isDirectory()]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads again."""
    hadoop, fs, _ = _context(spark, path)
    fs.delete(hadoop.Path(path), True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file appear whole; False if there is one of that name already."""
    hadoop, fs, context = _context(spark, path)
    folder, _, name = path.rpartition("/")
    beside = hadoop.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        context.rename(beside, hadoop.Path(path), options)
        return True
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise


def active_entry(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """The number and content of the active entry; 0 and None before the first."""
    hadoop, fs, _ = _context(spark, root)
    folder = hadoop.Path(f"{root}/active")
    if not fs.exists(folder):
        return 0, None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, None
    stream = fs.open(hadoop.Path(f"{root}/active/{max(numbers):012d}.json"))
    try:
        return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def attempt(root: str, revision: str) -> str:
    """A folder for one attempt to write a revision."""
    return f"{root}/revisions/{revision}/{uuid.uuid4().hex}"


def activate(spark: SparkSession, root: str, revision: str, folder: str, parent: str | None, **more) -> dict:
    """Make a revision the active one, if `parent` still is (None: if there is none); else Conflict."""
    number, now = active_entry(spark, root)
    if (now or {}).get("revision_id") != parent:
        raise Conflict(f"{(now or {}).get('revision_id')} is active, not {parent}")
    entry = {"revision_id": revision, "folder": folder, "parent_revision_id": parent, **more}
    if not put_new(spark, f"{root}/active/{number + 1:012d}.json", json.dumps(entry, sort_keys=True)):
        raise Conflict(f"another revision was activated after {parent}")
    return entry


def publish(rows: DataFrame, root: str, revision: str, content_hash: str, status: str = "READY") -> bool:
    """Write an immutable revision and make it active; False if the active one has the same content already. Only revisions
    that are READY are published. A revision whose earlier attempt died is simply written again."""
    if status != "READY":
        raise ValueError(f"a revision is published when it is READY, not {status}")
    spark = rows.sparkSession
    _, now = active_entry(spark, root)
    if now and now["content_hash"] == content_hash:
        return False
    if now and now["revision_id"] == revision:
        raise Conflict(f"revision {revision} has other content already")
    folder = attempt(root, revision)
    rows.write.mode("errorifexists").parquet(folder)
    activate(spark, root, revision, folder, now and now["revision_id"], content_hash=content_hash)
    return True


def current(spark: SparkSession, root: str, table: str = "") -> DataFrame:
    """The rows of the active revision, or of one of its tables."""
    _, now = active_entry(spark, root)
    if now is None:
        raise ValueError(f"no revision is active in {root}")
    return spark.read.parquet(f"{now['folder']}/{table}".rstrip("/"))
