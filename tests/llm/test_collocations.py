"""Phrase collocations against a count from the definition."""

import collections
import re

import numpy as np

from weft.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, rank string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=10, top=2000, covered=50):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und" if lang is None else lang] += len(words)
            for n in (1, 2, 3):
                f.update(((lang if lang is not None else "und"), tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in candidates.items():
        if len(w) == 2 and any(100 * b >= covered * a for (m, x), b in candidates.items() if m == lang and len(x) == 3 and w in (x[:2], x[1:])):
            continue
        score, k, lo, r = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, lo, r, total[lang], score))
    found = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        found += [(lang, i, *x[1:]) for i, x in enumerate(best, 1)]
    return sorted(found)


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, t, m, 1, "x", "y") for i, t, m in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in co.phrases(table, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "city", "the", "the", "of", "É", "é", "a\x00b", "İ", "x.", "stop;", "go!", "\t", "\n", "  ", "\x0b", "日本", "-", "u\xa0v"]
    rows = [(i, "".join(w + " " * int(rng.integers(3)) for w in rng.choice(words, int(rng.integers(0, 40)))), [None, "en", "und", "", "de"][int(rng.integers(5))]) for i in range(n)]
    return rows + [(1, None, "en"), (None, "new york city the", "en"), (2, "", None), (3, "\n", "fr"), (4, "the the the the", "en"), (4, "the the the the", "en")] + [(9, "only here", "xx")] * 12


def test_odd_texts(spark, monkeypatch):
    rows = made()
    want = brute(rows)
    assert len(want) > 100 and {x[0] for x in want} > {"", "und", "en", "xx"}
    assert found(spark, rows) == want
    assert found(spark, rows, top=7, covered=80, least=25) == brute(rows, top=7, covered=80, least=25)
    monkeypatch.setattr(co, "STEP", 300)  # many steps
    monkeypatch.setattr(co, "MOST_BITS", 64)  # a bitmap that lets pairs pass by chance
    monkeypatch.setattr(co, "BROADCAST_PARTS", 3)  # parts beyond a broadcast
    assert found(spark, rows) == want


def test_empty_tables_and_long_texts(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, None), (2, ".", "en")]) == []
    rows = [(1, "one two three. " * 60_000, "en"), (2, "w" * 1_000_000 + " b", "en")]
    assert found(spark, rows) == brute(rows)


def test_one_table_gives_totals_extensions_and_ends(spark):
    rows = [(1, "a b. a b c. a", "en"), (2, "a c", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", "text")
    got = {(r.prefix, r.next): r.n for r in co.merged(co.word_stripes(table)).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("a", None): 1, ("b", "c"): 1, ("b", None): 1, ("c", None): 2}
