"""WARC archives: written by Spark's own text writer, read back by a PySpark data source.

Writing: a record is its header lines, an empty line and its block; records end with two line breaks, which is the line
separator given to the text writer. So archives (one gzip stream a file) are committed like any other output of Spark.

Reading: `spark.read.format("warc")` plans a partition for each file. Equality and IN filters on record_type, and equality
filters on other header columns, are pushed into the reader, which parses a record's header first: payloads of records
that a filter drops, and all payloads if the option `payload` is "false", are skipped by their length and never copied or
decoded.

Defined results: a null payload is an empty one; a null url gives no target; line breaks in a url are percent-encoded;
payloads hold any bytes, record separators included, because lengths tell where they end; equal page ids give records
of their own (those with a group's smallest id are responses all); a page without an id is a response without a record id,
and no page revisits it; an empty table gives an archive without records; other columns of pages are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from weft.llm.common import cut, fresh_path, join_groups

VERSION, BREAK = "WARC/1.1", "\r\n"
#: The date of records whose source has none, so that an archive is the same whenever it is written.
DATE = "2020-01-01T00:00:00Z"
SHORTEST_REVISIT = 100
#: So many of the largest groups of equal payloads (a digest and an id) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 500_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header lines that the reader gives as columns.
COLUMNS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type", "payload_length": "X-Payload-Length"}
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", payload binary"


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


def opened(path: str):
    """A file of any store that pyarrow knows, by URI or plain path, decompressed if its name says so."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    raw = where.open_input_stream(name, compression=None)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, 1 << 20)


def listed(path: str) -> list[str]:
    """The archive files at a path, by URI if the path is one."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    info = where.get_file_info(name)
    found = where.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def skip(f, n: int) -> None:
    """Leave n bytes out; fewer than these are an error."""
    while n > 0:
        got = len(f.read(min(n, 1 << 20)))
        if not got:
            raise ValueError(f"the archive ends {n} bytes before its record")
        n -= got


def whole(f, n: int) -> bytes:
    """n bytes; fewer are an error."""
    found = f.read(n)
    if len(found) < n:
        raise ValueError(f"the archive ends {n - len(found)} bytes before its record")
    return found


def records(f, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header and payload of each record that `wanted` takes; the payload of an HTTP block comes after its empty line.

    A header line that begins with white space goes on the one before it. An archive that ends within a record is refused."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        name = ""
        while (line := f.readline()).strip():
            if line[:1] in b" \t" and name:
                head[name] += " " + line.decode("utf-8").strip()
                continue
            name, _, value = line.decode("utf-8").partition(":")
            name = name.strip().lower()
            head[name] = value.strip()
        if not line:
            raise ValueError("the archive ends within a record's header")
        size = int(head.get("content-length", 0))
        if not wanted(head):
            skip(f, size)
            continue
        if not payload:
            skip(f, size)
            yield head, None
            continue
        block = whole(f, size)
        if head.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield head, block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path = options["path"]
        self.names = names
        self.payload = options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in COLUMNS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Part]:
        return [Part(p) for p in listed(self.path)] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.path:
            return
        keys = {c: h.lower() for c, h in COLUMNS.items()}

        def wanted(head: dict[str, str]) -> bool:
            return all(head.get(keys[c]) in values for c, values in self.wanted.items())

        with opened(partition.path) as f:
            for head, payload in records(f, wanted, self.payload):
                yield tuple(payload if c == "payload" else head.get(keys[c]) for c in self.names)


class Warc(DataSource):
    """Records of the archives at `path`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema.names)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of archives: header columns and payload (null if payload is False: then no payload is read)."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def write(pages: DataFrame, path: str, most: int = BROADCAST_GROUPS) -> None:
    """Write a record for each page (page_id, url, html); of equal payloads of 100 bytes and more the one with the smallest
    page_id is a response, and the others revisit it.

    Groups come from digests alone, pre-aggregated, and are small beside the pages: they are broadcast, so payloads stay where
    they lie. Only beyond BROADCAST_GROUPS of them are payloads of smaller groups moved; short ones never are."""
    long = F.octet_length("payload") >= SHORTEST_REVISIT
    rows = pages.select(pages["page_id"], pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("d", F.unhex(F.sha2("payload", 256))).withColumn("k", F.when(long, F.col("d")))
    groups = cut(rows.where("k is not null").groupBy("k").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"))
    told = join_groups(rows, groups, "k", "copies", most)
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    block = F.concat(F.lit(HTTP.encode()), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(VERSION + BREAK),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("d")))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("first_id")))),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("X-Payload-Length", F.octet_length("payload").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(BREAK),
    )
    record = F.concat(head.cast("binary"), block).cast("string")  # a cast does not change bytes, valid UTF-8 or not
    told.select(record.alias("value")).write.option("lineSep", BREAK * 2).option("compression", "gzip").text(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and target_uri, from archives written and read back.

    Responses' lengths and digests are those of the payloads read; revisits have no payload, and give their header's."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).cast("long")
    full = F.col("record_type") == "response"
    return read(spark, path).select(
        page("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload")).otherwise(F.col("payload_length").cast("long")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", 8, 64)).alias("payload_digest"),
        "record_type",
        F.when(~full, page("refers_to")).alias("refers_to"),
        "target_uri",
    )


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
     g AS (SELECT page_id, url, octet_length(b) AS n, sha256(b) AS d, min(page_id) OVER (PARTITION BY b) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS target_uri
FROM g
"""
