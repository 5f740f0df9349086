"""The training-data operators against brute force, on small tables with nulls, ties, empty and long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import bpe, boosting, components, exact_dedup, packing, pii, pretokens, simhash, token_counts, toxicity, warc

MULTI, GPT, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
RANDOM = random.Random(3)
LETTERS = [*"ab's'tred  \n\t .,'lvm1٣é漢😀​　\x1c\x85\0'́Σİß", "<|endoftext|>", "A.", "É,"]
ODD = ["".join(RANDOM.choice(LETTERS) for _ in range(RANDOM.randrange(60))) for _ in range(3000)] + ["", "'s", "a" * 5000, " " * 3000, "ab" * 3000 + "'ll"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, h string, n string"


def docs_of(spark, texts):
    """Documents with columns whose names also occur inside the operators."""
    return spark.createDataFrame([(i, x, "en", "s", len(x or ""), "t", "h", "n") for i, x in enumerate(texts)], SCHEMA)


TEXTS = ["One two three four five six.", "one  two\tthree four five six.", "One two three four five six.", None, "", " ", "mail a.b@c.de or +1 (555) 555-0100", "x" * 20_000, "word " * 5000, "a b", "idiot scum", "One two three four five six."]


def test_pretokens_are_the_matches_of_the_pattern():
    pattern = regex.compile(P.PATTERN)
    pieces, counts = pretokens.slices(ODD)
    at = 0
    for text, n in zip(ODD, counts):
        assert pieces[at : at + n] == pattern.findall(text)
        at += n


def test_bpe_equals_the_library_and_decodes():
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(MULTI).rank, special_tokens={})
    for text, raw in zip(ODD, bpe.encode_texts(ODD, MULTI)):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.ranks(MULTI).decode(ids.astype(np.int64))[0] == text.encode()


def test_bpe_rows(spark):
    docs = docs_of(spark, TEXTS)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(MULTI).rank, special_tokens={})
    for r in bpe.digests(docs, MULTI).collect():
        text = TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    whole = bpe.encoded(docs, MULTI)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decoded(whole, MULTI).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    row = whole.where("doc_id = 0").first()
    assert [TEXTS[0].encode()[a:] for a in row.offsets][0] == TEXTS[0].encode() and len(row.offsets) == len(row.ids)
    assert bpe.digests(docs.limit(0), MULTI).count() == 0


def test_token_counts(spark):
    library = Tokenizer.from_file(GPT)
    texts = TEXTS + ODD[:500]
    want = [len(e.ids) for e in library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for r in token_counts.token_counts(docs_of(spark, texts), GPT).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), want[r.doc_id], want[r.doc_id] > 512)
    assert token_counts.token_counts(docs_of(spark, texts).limit(0), GPT).count() == 0


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda t: F.unhex(F.hex(F.length(t) % 3))])
def test_exact_dedup(spark, hashed):
    """A weak hash must not change the result: bytes are compared inside groups."""
    folded = [re.sub(r"[\x20\x09-\x0D]+", " ", x or "") for x in TEXTS]
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(docs_of(spark, TEXTS), hashed).collect()}
    assert len(rows) == len(TEXTS)
    for i, x in enumerate(folded):
        same = [j for j, y in enumerate(folded) if x == y]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept, rows[i].text_sha256) == (same[0], len(same), same[0] == i, hashlib.sha256(x.encode()).hexdigest())
    left = exact_dedup.drop_copies(docs_of(spark, TEXTS))
    assert left.columns == docs_of(spark, TEXTS).columns and left.count() == len(set(folded))
    assert exact_dedup.exact_groups(docs_of(spark, TEXTS).limit(0)).count() == 0


def slow_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_rows(spark):
    near = [" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(399)) + " other"]
    texts = TEXTS + near
    rows = {r.doc_id: r for r in simhash.near_groups(docs_of(spark, texts)).collect()}
    fps = [slow_fingerprint(x) for x in texts]
    classes = slow_components(set(fps))
    for i, f in enumerate(fps):
        assert rows[i].fingerprint == f"{f:016x}"
        assert rows[i].component_id == min(j for j, g in enumerate(fps) if classes[g] == classes[f])
    left = simhash.drop_near_copies(docs_of(spark, texts))
    assert left.columns == docs_of(spark, texts).columns and left.count() == len({r.component_id for r in rows.values()})
    assert simhash.near_groups(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("unit", [500, 8])
def test_simhash_links_join_what_brute_force_joins(spark, unit):
    """Chains, a crowded segment and far fingerprints, whole or cut into small blocks."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    fps = set(base) | {0, 1, 3}
    for b in base[:10]:
        for _ in range(20):
            b ^= sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(1, 6))))
            fps.add(b)
    fps |= {base[0] ^ (int(x) & 0xFFFFFFFF) for x in rng.integers(0, 1 << 32, 60)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), unit=unit)
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components.connected(edges).collect()}
    want = slow_components(fps)
    groups = collections.defaultdict(set)
    for f in fps:
        groups[want[f]].add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({roots.get(f, f) for f in fps})


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (502, 501), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components.connected(edges).collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}
    assert components.connected(edges.limit(0)).count() == 0


def test_base_spans_equal_the_patterns():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    letters = [*"ab@.-+() 1234590%\né", "4111111111111111", "1.2.3.4", "a@b.c", "+1 (555) 555-0100 ", "300.1.1.1"]
    for _ in range(20_000):
        text = "".join(RANDOM.choice(letters) for _ in range(RANDOM.randrange(40)))
        want = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][k]:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(text) == sorted(want)


def test_pii_adds_other_formats_and_leaves_decoys():
    found = lambda x: pii.told(sorted(pii.base_spans(x) + pii.added_spans([x], [pii.base_spans(x)], *pii.model())[0]))
    assert found("john (at) example (dot) org") == "email:0:27"
    assert found("call (555) 234-5678 now") == "phone:5:19"
    assert found("ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334 ok") == "ip:3:42"
    assert found("card 4111.1111.1111.1111 x") == "card:5:24"
    for clean in ("on 2020-01-02 we met", "order 123456789 total", "look at the dot com", "version 1.2.3", "the price was 1,000,000 in 1999"):
        assert found(clean) == ""
    assert pii.emails("a" * 200_000 + "@") is not None and list(pii.emails("a" * 200_000 + "@ x")) == []


def test_pii_rows_and_redaction(spark):
    rows = {r.doc_id: r for r in pii.span_digests(docs_of(spark, TEXTS)).collect()}
    assert (rows[6].n_email, rows[6].n_phone, rows[6].spans) == (1, 1, "email:5:13,phone:17:34")
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in rows.values())
    clean = {r.doc_id: r.text for r in pii.redacted(docs_of(spark, TEXTS)).collect()}
    assert clean[6] == "mail <email> or <phone>" and clean[3] is None and clean[0] == TEXTS[0]
    assert pii.redacted(docs_of(spark, TEXTS)).columns == docs_of(spark, TEXTS).columns
    assert pii.personal(docs_of(spark, TEXTS)).where("doc_id = 6").first().spans[0].kind == "email"


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.Trees().fit(x[:1500], y[:1500])
    assert ((trees.odds(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_packing(spark):
    texts = TEXTS + ODD[:300] + ["copy of a text"] * 50
    library = Tokenizer.from_file(WORDS)
    want = [[*e.ids, 2] for e in library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    rows = packing.packed(docs_of(spark, texts), WORDS).collect()
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.packed(docs_of(spark, texts), WORDS, with_ids=False).collect()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.doc_tokens == len(want[r.doc_id])
        if (r.doc_id, r.start) in digests and r.start == 0 and r.length == r.doc_tokens:
            assert digests[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, ids in enumerate(want):
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        size = sum(r.length for r in own)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and size <= 4096 and not size & (size - 1)
    assert packing.packed(docs_of(spark, texts).limit(0), WORDS).count() == 0


def test_hilbert_curve_visits_every_cell_in_steps_of_one():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1).tolist()) == {1}


def test_warc(spark):
    body = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n é</p>"
    pages = spark.createDataFrame([(1, "http://a/b", body), (2, "http://c\r\nX: y", body), (3, None, None), (4, "u", "short"), (5, "u", "short"), (0, "v", "y" * 150)], "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    rows = {r.page_id: r for r in warc.round_trip(pages).collect()}
    size = lambda x: len((x or "").encode())
    for page in pages.collect():
        r = rows[page.page_id]
        assert (r.payload_bytes, r.payload_digest) == (size(page.html), hashlib.sha256((page.html or "").encode()).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in rows.items()} == {i: ("response", None) for i in (0, 1, 3, 4, 5)} | {2: ("revisit", 1)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_filters_are_pushed(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "z" * 200) for i in range(5)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    found = warc.read(spark, f"file://{tmp_path}/w").where("record_type = 'response'")
    assert [bytes(r.payload) for r in found.collect()] == [b"z" * 200]
    assert warc.read(spark, f"file://{tmp_path}/w", payload=False).where("target_uri = 'http://h/3'").first().payload is None
    reader = warc.WarcReader({"path": "x"}, ["record_type", "payload"])
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")]))
    assert reader.wanted == {"record_type": {"revisit"}} and len(left) == 1


def test_toxicity_holds_out_a_fold_and_finds_unseen_spellings(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    texts, toxic = [], []
    for i in range(2000):
        bad = i % 3 == 0
        texts.append(" ".join(rng.choices(words, k=40) + rng.choices(["stupidest", "worthless", "moronic"], k=3) * bad))
        toxic.append(int(bad))
    unseen = ["stupid worthles " + " ".join(words[:20]), " ".join(words[20:45]), None, ""]
    docs = docs_of(spark, texts + unseen)
    labels = spark.createDataFrame([(i, t, 0) for i, t in enumerate(toxic)] + [(0, None, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    rows = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(rows) == 2004 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [i for i in range(2000) if rows[i].held_out]
    assert np.mean([rows[i].predicted == toxic[i] for i in held]) > 0.97
    assert rows[2000].score > 0.5 > rows[2001].score and rows[2002].score == rows[2003].score
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in rows.items() if not r.predicted}
    none = toxicity.scored(docs, labels.limit(0)).collect()
    assert all(not r.predicted for r in none) and toxicity.scored(docs.limit(0), labels).count() == 0


def test_toxicity_learns_from_the_ends_of_long_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    toxic = [i % 2 for i in range(300)]
    texts = [" ".join(rng.choices(words, k=1700) + ["stupidest worthless moronic"] * t) for t in toxic]
    assert all(" ".join(x.split()[:-3])[:8001][8000:] for x in texts)
    labels = spark.createDataFrame([(i, t, 0) for i, t in enumerate(toxic)], "doc_id long, toxic int, quality int")
    rows = {r.doc_id: r for r in toxicity.scored(docs_of(spark, texts), labels).collect()}
    assert np.mean([r.predicted == toxic[i] for i, r in rows.items() if r.held_out]) > 0.97
    bag = toxicity.bag_of(" ".join(f"sameend{i}" for i in range(40_000)))
    want = toxicity.subwords([b"sameend%d" % i for i in range(40_000)])[0]
    assert np.array_equal(np.bincount(bag >> toxicity.COUNT_BITS, bag & toxicity.MOST), np.bincount(want))


def test_simhash_equal_ids_null_ids_and_hot_values(spark, monkeypatch):
    """Against all pairs of fingerprints; many copies, texts without words, rows without ids, and groups beyond a broadcast."""
    import random

    from weft.llm import simhash

    monkeypatch.setattr(simhash, "BROADCAST_GROUPS", 2)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts)] + [(200 + i, texts[0]) for i in range(60)] + [(300, texts[1]), (300, texts[2]), (None, texts[3]), (None, "lone text of nobody else"), (400, ""), (401, None), (402, " \n")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    ids = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted(((i, f"{f:016x}", ids[r]) for (i, _), f, r in zip(rows, fps, root)), key=str)
    assert sorted((tuple(r) for r in simhash.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str) == want
    assert sum(r.doc_id is None for r in simhash.drop_near_copies(docs).collect()) == 2
