"""Packing: the library's ids for mixed-case special tokens, long documents in parts, full sequences, equal and null ids."""

import collections

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from weft.llm import packing

WORDS = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def wanted(texts):
    return [[*e.ids, 2] for e in Tokenizer.from_file(WORDS).encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_the_librarys_for_odd_texts():
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "<|StartOfText|>.", "<|endoftext|>x. Y", "x<|startoftext|>, Y,", "\x01 a\x01b. C", "İs. it's don't, L'ÉTÉ.", "a\x0bb\x0cc\x85d　E,", "", " \n", "é. É,", "..., a.,b", "ΑΣ. ﬁn."]
    texts += [f"{a}{chr(c)}{b}" for c in range(0x20, 0x500) for a, b in (("x", "."), ("", ","), ("A.", "b"))]
    ids, ends = packing.encode_texts(pa.array(texts), WORDS)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == wanted(texts)


def test_long_documents_equal_ids_and_full_sequences(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(500)]
    texts = [" ".join(rng.choice(words, 150_000))] + [" ".join(rng.choice(words, n)) for n in rng.integers(1, 900, 300)] + [None]
    ids = [7, *range(100, 400), None]
    ids[5] = ids[6] = 100
    docs = spark.createDataFrame(list(zip(ids, texts)), SCHEMA).repartition(5)
    rows = packing.packed(docs, WORDS, range_bytes=100_000).collect()
    want = collections.Counter((i, tuple(x)) for i, x in zip(ids, wanted(texts)))
    assert len(want) == len(ids) and sum(r.length for r in rows) == sum(len(x) for _, x in want)
    for (i, x), _ in want.items():
        own = sorted((r for r in rows if r.doc_id == i and r.doc_tokens == len(x)), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and [y for r in own for y in r.ids] == list(x)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    full = sum(n == packing.LENGTH for n in sizes.values())
    tokens = sum(sizes.values())
    ranges = max(1, round(tokens * 2 / 100_000))
    assert all(n <= packing.LENGTH and not n & (n - 1) for n in sizes.values())
    assert full >= tokens // packing.LENGTH - ranges and len(sizes) - full <= 12 * ranges


def test_pieces_follow_the_curve(spark):
    """Within a range, sequences in order hold documents in the order of their places."""
    docs = spark.createDataFrame([(i, f"word{i % 7} " * (20 + i % 11)) for i in range(200)], SCHEMA)
    place = {r.doc_id: r.place for r in packing.tokenized(docs, WORDS).collect()}
    pieces = sorted((r.sequence_id, r.offset, place[r.doc_id]) for r in packing.packed(docs, WORDS).collect())
    assert [p for _, _, p in pieces] == sorted(p for _, _, p in pieces)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, place string, ids int")
    assert packing.packed(docs, WORDS).first().doc_id == 1
    assert packing.packed(docs.limit(0), WORDS).count() == 0
