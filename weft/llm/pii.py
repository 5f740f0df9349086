"""Personal data: patterns, and boosted trees over the candidates of high-recall generators.

Four kinds are found by strict patterns ("base"). Generators then propose many more, overlapping spans: mail addresses
with the at and the dots spelled out, numbers in any grouping, addresses in hexadecimal groups. Boosted trees score each
proposal from its format and its context; thresholds for each kind, set on calibration examples so that hardly any decoy
passes, select what is added. Base spans always stay.

The trees are trained here, on examples made by rule with a fixed seed: spans of each kind in many formats, and decoys
(dates, prices, versions, order numbers, card numbers that fail the check sum, words around "at") in made-up contexts.
So the model is the same for any input, and no text is needed to train it.

Defined results: a null text is an empty text without spans; texts of any length are read whole, in linear time; spans
are in code points; equal rows, equal ids and null ids give rows of their own; an empty table gives no rows; other columns are
ignored (redacted keeps them as they are).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.boosting import Trees
from weft.llm.common import small_parts, spread, steps, text_rows

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that fails from the first digit of a run fails from the others too; so runs are entered at their start only.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check sum of the digits holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str, domain: re.Pattern = DOMAIN) -> Iterator[tuple[int, int]]:
    """Leftmost mail addresses: the longest run before each @ (after the match before it), and a domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = domain.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


#: Generators: spelled-out mail addresses, numbers in groups, hexadecimal addresses.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\s?[(\[{]\s?at\s?[)\]}]\s?|\s?[@＠]\s?| at |_at_)[A-Za-z0-9-]{1,63}(?:(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\.| dot )[A-Za-z0-9-]{1,63}){1,6}", re.I)
SIGN = re.compile(r"[@＠]|_at_|[(\[{]\s?at\s?[)\]}]| at (?=[A-Za-z0-9-]{1,63}(?:\.| dot |\s?[(\[{]))| dot |[(\[{]\s?dot\s?[)\]}]", re.I)
GROUPS = re.compile(r"(?<![0-9])[+(]?[0-9][0-9\x20().\-/_]{5,40}[0-9](?![0-9])")
HEXADECIMAL = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
#: Addresses with a run of zeros left out, and at most seven groups.
SHORTENED = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![0-9A-Fa-f:.]|\w)")
HINTS = [
    re.compile("mail|contact|write|reach", re.I),
    re.compile(r"\bip\b|host|server|address|addr", re.I),
    re.compile("card|visa|credit|payment|account|pay", re.I),
    re.compile("phone|tel|call|mobile|cell|fax|dial|whatsapp|number", re.I),
]
AGAINST = re.compile("order|invoice|isbn|version|date|total|price|page|item|sku|ref|ticket|on the|since|until", re.I)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the generators propose; a number is proposed as each kind it may be."""
    found = []
    for sign in SIGN.finditer(text):
        lo = max(0, sign.start() - 130)
        found += [(lo + m.start(), 0, lo + m.end()) for m in SPELLED.finditer(text[lo : sign.end() + 200])]
    if DIGIT.search(text):
        for m in GROUPS.finditer(text):
            n = len(NOT_DIGIT.sub("", m[0]))
            if 7 <= n <= 15:
                found.append((m.start(), 3, m.end()))
            if 13 <= n <= 19:
                found.append((m.start() + (m[0][0] in "+("), 2, m.end()))
        found += [(m.start(), 1, m.end()) for m in HEXADECIMAL.finditer(text)]
        if "::" in text:
            found += [(m.start(), 1, m.end()) for m in SHORTENED.finditer(text) if len(m[0]) > 3]
    return sorted(set(found))


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = NOT_DIGIT.sub("", span)
    groups = re.split("[^0-9A-Za-z]+", span.strip("+() "))
    return [
        *(float(kind == k) for k in range(4)),
        len(span),
        len(digits),
        sum(c.isalpha() for c in span),
        len(groups),
        max(map(len, groups)),
        min(map(len, groups)),
        len(groups[0]),
        len(groups[-1]),
        span.startswith("+"),
        "(" in span,
        "@" in span,
        len(re.findall(r"\bat\b", span, re.I)),
        len(re.findall(r"\bdot\b", span, re.I)),
        span.count("."),
        span.count("-"),
        span.count(" "),
        span.count("/"),
        span.count(":"),
        span.count("::"),
        span.count("_"),
        sum(c in "abcdefABCDEF" for c in span),
        float(bool(digits) and luhn(digits)),
        len(set(digits)),
        float(bool(re.match(r"(19|20)\d\d", digits))),
        *(float(bool(h.search(before))) for h in HINTS),
        float(bool(AGAINST.search(before))),
        float(before[-1:].isalnum() or before[-1:] in "$€£#"),
        float(after[:1].isalnum() or after[:1] in "%$€£"),
    ]


def made(rng: np.random.Generator, kind: int, real: bool) -> str:
    """A made-up span of a kind in one of many formats, or a decoy that a generator proposes as that kind."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(3, 9)))
    pick = lambda xs: xs[rng.integers(len(xs))]
    if kind == 0:
        if real:
            at, dot = pick([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" @ ", ".")])
            user = pick([word(), f"{word()}.{word()}", f"{word()}{n(2)}", f"{word()}_{word()}"])
            return user + at + dot.join([word(), *pick([["com"], ["org"], ["net"], ["example", "com"], ["co", "uk"], ["de"], ["edu"]])])
        return pick([f"{word()} at {word()} dot {word()} dot {word()}", f"{word()} @ {n(2)}.{n(2)}", f"{word()} at {n(1)} dot {n(2)}", f"the (at) {word()}.{n(3)}", f"{word()}@{word()}.{n(1)}", f"look at the dot {word()}"])
    if kind == 1:
        if real:
            groups = lambda k: ":".join("".join(rng.choice(list("0123456789abcdef"), rng.integers(1, 5))) for _ in range(k))
            return pick([groups(8), groups(8), f"{pick(['2001', 'fe80', 'fd00', '2a02'])}{pick(['', ':' + groups(1), ':' + groups(2), ':' + groups(3)])}::{groups(rng.integers(1, 4))}"])
        return pick([":".join(n(2) for _ in range(rng.integers(4, 6))), ":".join(n(1) for _ in range(5)), f"{n(2)}:{n(2)}:{n(2)}:{n(3)}", "de:ad:be:ef", f"{pick(['abc', 'add', 'bad', 'face', 'a', 'de'])}::{pick(['add', 'dead', 'bee', 'b', 'c0de'])}", f"{n(1)}::{n(2)}", f"{n(2)}::{n(1)}"])
    if kind == 2:
        digits = pick(["4", "5", "37"]) + n(13)
        digits = next(d for c in range(10) if luhn(d := digits + str(c)))
        if not real:
            digits = pick([digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10), n(rng.integers(13, 20))])
            digits = digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return pick([digits, ".".join(re.findall(".{1,4}", digits)), "/".join(re.findall(".{1,4}", digits)), "  ".join(re.findall(".{1,4}", digits)), "_".join(re.findall(".{1,4}", digits))])
    if real:
        a, b, c = f"{rng.integers(2, 10)}{n(2)}", f"{rng.integers(2, 10)}{n(2)}", n(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.integers(1, 99)} {a} {b} {c}", f"0{n(3)} {n(3)} {n(4)}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"00{rng.integers(10, 99)} {n(2)} {n(7)}", f"0{n(2)}/{n(7)}", f"{a}{b}{c}", f"0{a}{n(7)}"])
    y, m, d = 1900 + rng.integers(130), f"{rng.integers(1, 13):02}", f"{rng.integers(1, 29):02}"
    return pick([f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{y}-{y + 1}", n(rng.integers(7, 16)), f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(1)}.{n(3)}.{n(3)}", f"{n(2)} {n(2)} {n(2)} {n(2)}", f"{n(4)}.{n(4)}", f"{n(3)} - {n(4)}", f"{n(1)} / {n(6)}"])


#: Examples for the trees and for the thresholds; a threshold lets at most this share of a kind's decoys pass.
EXAMPLES, CALIBRATION, PASSING, SEED = 4000, 4000, 0.002, 5


@functools.cache
def model() -> tuple[Trees, np.ndarray]:
    """The trees, and for each kind the log-odds from which a proposal is taken."""
    rng = np.random.default_rng(SEED)
    helping = [["mail me:", "contact", "write to", "reach me"], ["from ip", "host", "server"], ["card", "pay with visa", "account"], ["call", "phone:", "tel.", "my number is", "fax"]]
    hindering = ["order", "invoice no", "isbn", "version", "on", "total", "page", "ref", "since"]
    filler = ["the", "and", "of", "le", "der", "que", "with", "in", "was", "", "was on", "for"]
    pick = lambda xs: xs[rng.integers(len(xs))]
    rows, labels, kinds = [], [], []
    while len(rows) < EXAMPLES + CALIBRATION:
        kind, real = int(rng.integers(4)), bool(rng.integers(2))
        lead = pick([pick(helping[kind]), pick(filler), pick(filler)]) if real else pick([pick(hindering), pick(filler), pick(filler)])
        span = made(rng, kind, real)
        if real and kind == 3 and span.isdigit():
            lead = pick(helping[kind])  # nothing but what stands before it tells such a number from others
        head = f"{pick(filler)} {lead}{pick([' ', ' ', ': '])}"
        text = f"{head}{span}{pick([' ', '. ', ', ', ''])}{pick(filler)}"
        for a, k, b in proposals(text):
            own = k == kind and real and a <= len(head) + 1 and b >= len(head) + len(span) - 1
            rows.append(features(text, a, k, b))
            labels.append(own)
            kinds.append(k)
    x, y, kind = np.array(rows, float), np.array(labels, float), np.array(kinds)
    trees = Trees().fit(x[:EXAMPLES], y[:EXAMPLES])
    odds = trees.odds(x[EXAMPLES:])
    limits = np.full(4, np.inf)
    for k in range(4):
        mine = kind[EXAMPLES:] == k
        decoys = np.sort(odds[mine & (y[EXAMPLES:] == 0)])
        if len(decoys):
            limits[k] = max(0.0, decoys[int((1 - PASSING) * (len(decoys) - 1))] + 1e-6)
    return trees, limits


class Spans:
    """Disjoint spans in order; whether another one touches any of them is found by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touch(self, a: int, b: int) -> bool:
        at = bisect.bisect_left(self.starts, b) - 1
        return at >= 0 and self.ends[at] > a

    def add(self, a: int, b: int) -> None:
        """A span that touches none."""
        at = bisect.bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], trees: Trees, limits: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """What the trees add: of overlapping proposals the one with the highest odds, none that touches a base span."""
    found, rows = [], []
    for i, text in enumerate(texts):
        if spans := proposals(text) if "@" in text or DIGIT.search(text) or SIGN.search(text) else []:
            taken = Spans([(a, b) for a, _, b in base[i]])
            for a, k, b in spans:
                if not taken.touch(a, b):
                    found.append((i, a, k, b))
                    rows.append(features(text, a, k, b))
    out: list[list] = [[] for _ in texts]
    if rows:
        odds = trees.odds(np.array(rows, float))
        taken_in: dict[int, Spans] = {}
        for at in np.argsort(-odds, kind="stable").tolist():
            i, a, k, b = found[at]
            if odds[at] > limits[k] and not taken_in.setdefault(i, Spans([])).touch(a, b):
                taken_in[i].add(a, b)
                out[i].append((a, k, b))
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans (arrays of kind, start, end) of every document."""
    trees = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            base = [base_spans(x) for x in texts]
            more = added_spans(texts, base, *trees.value)
            every = [sorted(b + m) for b, m in zip(base, more)]
            as_rows = lambda spans: [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array(as_rows(base), kind), pa.array(as_rows(every), kind)], ["doc_id", "text", "base", "spans"])

    span = "array<struct<kind: string, start: int, end: int>>"
    return spread(text_rows(docs)).mapInArrow(run, f"doc_id long, text string, base {span}, spans {span}")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans."""
    trees = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in steps(batches):
            base = [base_spans(x) for x in texts]
            more = added_spans(texts, base, *trees.value)
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in base], pa.int64()) for kind in range(4)]
            digests = [hashlib.sha256(told(s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, pa.array(digests), pa.array([told(sorted(b + m)) for b, m in zip(base, more)])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return spread(text_rows(docs)).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, free = [], 0
    for a, k, b in spans:
        if a >= free:
            out += [text[free:a], f"<{KINDS[k]}>"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, personal data in text replaced (n_chars follows); null texts stay null."""
    trees = docs.sparkSession.sparkContext.broadcast(model())
    names, at = docs.columns, docs.columns.index("text")
    rows = spread(docs.withColumn("text", docs["text"].cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_parts(batches, at):
            texts = [x or "" for x in part.column(at).to_pylist()]
            base = [base_spans(x) for x in texts]
            more = added_spans(texts, base, *trees.value)
            clean = [None if null else redact(x, sorted(s + m)) for x, s, m, null in zip(texts, base, more, part.column(at).is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if i == at else c for i, c in enumerate(part.columns)], names)

    out = rows.mapInArrow(run, rows.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in names else out
