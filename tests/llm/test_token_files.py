"""Token files: round trips, ids of the library, random access, damaged files, and the size against the entropy."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weft.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start int, total string, block string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    words = ["alpha", "beta,", "#", "Gamma.", "déjà", "日本", "x1y2", "<|endoftext|>", "\n", "it's"]
    text = lambda n: " ".join(rng.choice(words, n))
    return [(int(i), text(int(rng.integers(1, 200)))) for i in rng.permutation(300)] + [(1000, None), (1001, ""), (-5, "minus"), (None, "no id"), (None, None), (500, text(70_000)), (500, text(40)), (500, text(40)), (7, "again"), (2**62, "far #")]


def library(rows):
    t = Tokenizer.from_file(PATH)
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows]


def folder(tmp_path, name="files"):
    return f"file://{tmp_path}/{name}"


def test_written_and_read_back(spark, rows, tmp_path):
    tf.write(made(spark, rows), folder(tmp_path), PATH, file_bytes=100_000)
    assert len([f for f in glob.glob(f"{tmp_path}/files/blocks/part-*")]) > 2
    parts = {}
    for r in tf.read(spark, folder(tmp_path)).collect():
        parts.setdefault((r.start, r.doc_id), []).append(r)
    got, at = [], 0
    for (start, doc), some in sorted(parts.items(), key=lambda x: x[0][0]):
        some.sort(key=lambda r: r.before)
        ids = [i for r in some for i in r.ids]
        assert start == at and len(ids) == some[0].total and [r.before for r in some] == np.cumsum([0, *(len(r.ids) for r in some[:-1])]).tolist()
        at += len(ids)
        got.append((doc, ids))
    want = library(rows)
    order = lambda x: (x[0] is not None, x[0] or 0)
    assert [g[0] for g in got] == [w[0] for w in sorted(want, key=order)]
    assert sorted(got, key=lambda x: (order(x), x[1])) == sorted(want, key=lambda x: (order(x), x[1]))

    flat = [i for _, ids in got for i in ids]
    for lo, hi in [(0, 1), (5, 5), (16_380, 16_400), (20_000, 60_123), (len(flat) - 3, len(flat) + 10)]:
        found = sorted(tf.window(spark, folder(tmp_path), lo, hi).collect())
        assert [i for r in found for i in r.ids] == flat[lo:hi] and (not found or found[0].at == lo)

    size = sum(len(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/files/blocks/part-*"))
    share = np.bincount(flat) / len(flat)
    entropy = -sum(p * np.log2(p) for p in share if p) / 8 * len(flat)
    assert size < 1.15 * entropy + 30 * len(rows)


def test_digests(spark, rows):
    want, at = [], 0
    for i, ids in sorted(((i, ids) for i, ids in library(rows) if i not in (500, 7, None)), key=lambda x: x[0]):
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = tf.digests(made(spark, rows), PATH).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id not in (500, 7, None)) == want
    assert len(got) == len(rows)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    long = next(ids for i, ids in library(rows) if len(ids) > 60_000)
    assert max((r.n_tokens, r.ids_crc32) for r in got) == (len(long), zlib.crc32(np.array(long, "<u4").tobytes()))


def test_empty_tables_and_one_id(spark, tmp_path):
    assert tf.digests(made(spark, []), PATH).count() == 0
    tf.write(made(spark, [(1, ""), (2, None)]), folder(tmp_path), PATH)
    assert sorted((r.doc_id, r.ids) for r in tf.read(spark, folder(tmp_path)).collect()) == [(1, [2]), (2, [2])]


def test_damage_is_refused(spark, rows, tmp_path):
    tf.write(made(spark, rows), folder(tmp_path), PATH, file_bytes=100_000)
    files = sorted(glob.glob(f"{tmp_path}/files/blocks/part-*"))
    raw = open(files[0], "rb").read()
    for at in (40, len(raw) // 2):
        for x in glob.glob(f"{tmp_path}/files/blocks/.part-*.crc"):
            open(x, "wb").close()
        open(files[0], "wb").write(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
        with pytest.raises(Exception, match="damaged|missing"):
            tf.read(spark, folder(tmp_path)).collect()
    mark = tf.MARK.encode()
    open(files[0], "wb").write(raw[raw.index(mark) + len(mark) :])
    with pytest.raises(ValueError, match="missing"):
        tf.read(spark, folder(tmp_path))


def test_any_frequencies_round_trip():
    rng = np.random.default_rng(8)
    for counts in ([1], [10**12, 1, 1], rng.integers(1, 5, 40_000), (rng.pareto(0.6, 3000) + 1).astype(np.int64)):
        counts = np.array(counts, np.int64)
        freq, bits = tf.frequencies(counts)
        assert freq.sum() == 1 << bits and freq.min() >= 1
        names = rng.permutation(60_000)[: len(counts)]
        table = tf.Table(names, freq, bits)
        ids = rng.choice(names, (3, 32 * 300), p=counts / counts.sum())
        for row, (states, places, words) in zip(ids, tf.encoded(ids, table)):
            assert (tf.decoded([(states[0], words, 300)], table)[0] == row).all()
            point = len(states) - 1
            assert (tf.decoded([(states[point], words[places[point] :], 300 - point * tf.STRIDE)], table)[0] == row[point * tf.STRIDE * tf.LANES :]).all()


def test_a_block_never_holds_the_mark():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 200, 40_000).astype("<u2")
    table = tf.Table(np.arange(200), *tf.frequencies(np.ones(200, np.int64)))
    pieces = [(int.from_bytes(b"ab" * 4, "little"), 1, 0, ids.tobytes(), len(ids))]
    plain = [b for x in tf.coded(iter(pieces), 0, np.dtype("<u2"), table) for b in x]
    for at in (69, 10_000, 10_001):  # in a name, in words
        mark = plain[1][at : at + 4]
        other = [b for x in tf.coded(iter(pieces), 0, np.dtype("<u2"), table, mark=mark) for b in x]
        assert all(mark not in b for b in other) and other[1] != plain[1]
        assert [i for b in other for i in tf.Read(b).ids(table)] == ids.tolist()
        assert tf.Read(other[1]).doc_ids == [pieces[0][0]]


def test_checksums_combine():
    rng = np.random.default_rng(1)
    raw = rng.bytes(5000)
    for a, b in [(0, 5000), (1, 4000), (2500, 2501), (4999, 5000)]:
        assert tf.moved(zlib.crc32(raw[:a]), 5000 - a) ^ tf.moved(zlib.crc32(raw[a:b]), 5000 - b) ^ tf.moved(zlib.crc32(raw[b:]), 0) == zlib.crc32(raw)
