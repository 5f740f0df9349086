"""Archives as files, groups of copies beyond the broadcast tier, rows without ids and clashing names."""

import collections
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from weft.llm import exact_dedup, warc

RECORD = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Target-URI: http://a/\r\n b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"


def archive(*payloads):
    return b"".join(RECORD % (b"resource", len(p), p) for p in payloads)


def test_plain_and_compressed_archives(spark, tmp_path):
    for name, data in (("a.warc", archive(b"one", b"")), ("b.warc.gz", gzip.compress(archive(b"two")) + gzip.compress(archive(b"x\r\n\r\nWARC/1.1")))):
        (tmp_path / name).write_bytes(data)
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"", b"one", b"two", b"x\r\n\r\nWARC/1.1"]
    assert {r.target_uri for r in rows} == {"http://a/ b"}, "folded header lines are joined"


@pytest.mark.parametrize("keep", [-1, -5, -8, -60, -75])
def test_archives_that_end_early_are_refused(keep, tmp_path):
    data = archive(b"one", b"twotwo")[:-4]
    (tmp_path / "t.warc").write_bytes(data[:keep])
    with warc.opened(str(tmp_path / "t.warc")) as f, pytest.raises(ValueError, match="ends"):
        list(warc.records(f, lambda head: True, True))
    with warc.opened(str(tmp_path / "t.warc")) as f, pytest.raises(ValueError, match="ends"):
        list(warc.records(f, lambda head: False, False))


@pytest.mark.parametrize("most", [0, 1, 1000])
def test_pages_in_groups_of_any_tier(spark, tmp_path, most):
    pages = [(i, "u", "<p>" + str(i % 7) * 200) for i in range(60)] + [(60, "u", "s"), (61, "u", "s"), (None, "u", "z" * 300), (None, "u", "z" * 300), (5, "u", "<p>" + "5" * 200), (70, None, None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("k", F.lit(1)).withColumn("copies", F.lit(2))
    warc.write(table, f"file://{tmp_path}/w", most)
    rows = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert collections.Counter(r.record_type for r in rows) == {"revisit": 53, "response": len(pages) - 53}
    by = {r.record_id: r for r in rows}
    assert by["<urn:page:59>"].refers_to == "<urn:page:3>" and by["<urn:page:61>"].record_type == "response"
    done = warc.round_trip(table).collect()
    assert collections.Counter(r.page_id for r in done) == collections.Counter(i for i, _, _ in pages)
    assert {r.payload_digest for r in done if r.page_id is None} == {hashlib.sha256(b"z" * 300).hexdigest()}


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda t: F.substring(t, 1, 1).cast("binary")])
@pytest.mark.parametrize("most", [0, 2, 1000])
def test_groups_of_any_tier_and_collisions(spark, hashed, most):
    texts = ["a  b", "a\tb", "a b", "b", "b", None, "", "ab", "ab", "c" * 1_000_000, "c" * 1_000_000] + ["hot"] * 40 + ["once", "only nulls", "only nulls", "hot"]
    ids = [*range(len(texts) - 3), None, None, None]
    ids[12] = 11
    docs = spark.createDataFrame([(i, x, "h", 1) for i, x in zip(ids, texts)], "doc_id long, text string, h string, n int").repartition(4)
    groups = collections.defaultdict(list)
    for i, x in zip(ids, texts):
        groups[" ".join((x or "").split()) if x else ""].append(i)
    want = collections.Counter()
    for text, own in groups.items():
        first = min((i for i in own if i is not None), default=None)
        for i in own:
            want[i, first, len(own), i == first, hashlib.sha256(text.encode()).hexdigest()] += 1
    rows = exact_dedup.exact_groups(docs, hashed, most).collect()
    assert collections.Counter(tuple(r) for r in rows) == want
    assert exact_dedup.exact_groups(docs.limit(0), hashed, most).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect())[None] == 3
