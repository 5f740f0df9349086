"""The pipeline's stages, alone and together, against brute force on a small corpus."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weft.llm import near_copies, pii

RNG = random.Random(9)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(3, 8))) for _ in range(400)]


def prose(n=120):
    return " ".join(RNG.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """200 toxic and 400 clean labelled texts, then copies, near copies, personal data, an empty text and a null."""
    texts, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        texts.append(prose() + " stupid worthless idiot" * (3 * bad))
        labels.append((i, int(bad), 1))
    base, private = texts[1], prose(60)
    long = prose(3000)
    texts += [base, base.replace(" ", "\n"), long, long + " end", private + " write to a.b@c.org or 10.1.2.3", "", None]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, texts


def test_stages_keep_the_columns_and_clean_documents(spark, corpus):
    folder, docs, texts = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    kept = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, folder).collect()}
    clean = {i for i in range(600) if i % 3}
    assert len(clean - kept) <= 0.02 * len(clean) and len({i for i in range(600) if i % 3 == 0} & kept) <= 6 and {600, 601, 604, 605, 606} <= kept


def test_run_packs_what_the_stages_leave(spark, corpus):
    folder, docs, texts = corpus
    pieces: dict = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    toxic_left = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, folder).collect()}
    seen, want = {}, {}
    for i, text in enumerate(texts):
        if i in toxic_left:
            seen.setdefault(" ".join((text or "").split()) if text else "", i)
    kept: dict = {}
    for i in seen.values():
        words = (texts[i] or "").lower().split()
        own = frozenset(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4)))
        if not any(len(own & other) / len(own | other) >= 0.8 for other in kept.values()):
            kept[i], want[i] = own, texts[i] or ""
    assert set(pieces) == set(want)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, text in want.items():
        spans = sorted(pii.base_spans(text) + pii.added_spans([text], [pii.base_spans(text)], *pii.model())[0])
        own = [x for r in sorted(pieces[i], key=lambda r: r.start) for x in r.ids]
        assert own == [*library.encode(pii.redact(text, spans), add_special_tokens=False).ids, 2]
    assert "<email> or <ip>" in pii.redact(texts[604], sorted(pii.base_spans(texts[604])))
    assert zlib.crc32(b"") == 0 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("unit", [500, 3])
def test_near_dedup_links_what_is_similar_by_five_words(spark, unit):
    """Copies with one to many changed words (similarities about the threshold), against all pairs compared."""
    rng, texts = random.Random(4), ["", " ", "a b", "A  b", "a b c"]
    for _ in range(12):
        words = rng.choices(WORDS, k=rng.randrange(60, 300))
        texts.append(" ".join(words))
        for changes in range(1, 9):
            copy = words[:]
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for i, j in linked:
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_groups(docs, unit).collect()} == dict(enumerate(root))
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == set(root)
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0
    assert 20 < len(linked) and len(set(root)) > 12


def test_near_dedup_misses_no_link(spark):
    """Pairs at 0.8 exactly that share none of 24 bands of five min-hashes (26 of 320,000 such pairs did not)."""
    missed = [15238, 23327, 43066, 78591, 87224, 108460, 127351, 131078, 156594, 173701, 193556, 199784, 206056, 217893]
    words = [[f"w{i}x{j}" for j in range(13)] for i in missed]
    texts = [" ".join(x) for x in words] + [" ".join(x[:-1] + ["end"]) for x in words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_groups(docs).collect()} == {i: i % len(missed) for i in range(len(texts))}


def test_rows_without_an_id_carry_links(spark):
    """Two texts that are similar only to one without an id are one component."""
    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(["x"] * 8 + words[8:])), (None, " ".join(words)), (2, " ".join(words[:-8] + ["y"] * 8)), (3, "else")]
    got = near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, None: 1, 2: 1, 3: 3}


def test_order_and_parities_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 60, 200, 3000):
        known = np.unique(rng.integers(0, 1 << 63, 40 + n, np.uint64))
        places = rng.permutation(len(known))
        for _ in range(60):
            own = np.unique(np.concatenate([rng.choice(known, n // 2), rng.integers(0, 1 << 63, n - n // 2, np.uint64)]))
            other = np.unique(np.concatenate([rng.permutation(own)[: len(own) - rng.integers(0, len(own) // 8 + 1)], rng.integers(0, 1 << 63, rng.integers(0, len(own) // 8 + 1), np.uint64)]))
            if near_copies.similar(own, other):
                assert np.intersect1d(near_copies.prefix(own, known, places), near_copies.prefix(other, known, places)).size
                differ = len(np.setxor1d(own, other))
                assert near_copies.apart(near_copies.parities(own), near_copies.parities(other)) <= differ
                sizes = [near_copies.short(b"\xff" * 16, len(x)) & 255 for x in (own, other)]
                assert abs(sizes[0] - sizes[1]) <= near_copies.APART


def test_rows_without_ids_clashing_names_and_empty_tables(spark, corpus):
    folder, docs, _ = corpus
    odd = docs.selectExpr("case when doc_id % 3 = 0 then null else doc_id end as doc_id", "text", "lang", "source", "n_chars", "'x' as node", "1 as digest", "2 as kept", "'y' as place")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns, name
        if name in ("exact_dedup", "near_dedup"):  # rows without an id are never dropped by id
            assert got.where("doc_id is null").count() == odd.where("doc_id is null").count(), name
        assert stage(spark, odd.limit(0), folder).count() == 0, name
    assert corpus_pipeline.packing_stage(spark, odd.limit(0), folder).count() == 0


def test_hot_groups_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BROADCAST_GROUPS", 1)
    test_near_dedup_links_what_is_similar_by_five_words(spark, 3)
