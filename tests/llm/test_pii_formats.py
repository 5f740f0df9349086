"""Added spans on formats and contexts that the training examples do not make: recall, and the share of decoys taken."""

import numpy as np

from weft.llm import pii


def luhn_number(rng, prefix):
    digits = prefix + "".join(map(str, rng.integers(0, 10, 15 - len(prefix))))
    return next(d for c in range(10) if pii.luhn(d := digits + str(c)))


def held_out(rng):
    """(kind, span) in formats that `pii.made` lacks."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("aeioubdklmnrst"), rng.integers(3, 8)))
    card = luhn_number(rng, "4")
    hexes = lambda: "".join(rng.choice(list("0123456789ABCDEF"), 4))
    return [
        (0, f"{word()} {{at}} {word()}.org"),
        (0, f"{word()}_at_{word()}.{word()}.net"),
        (0, f"{word()}.{word()} AT {word()} DOT com"),
        (0, f"{word()}＠{word()}.de"),
        (1, f"FE80:0:0:0:{hexes()}:{hexes()}:{hexes()}:{hexes()}"),
        (1, f"2001:DB8:{hexes()}::{hexes()}"),
        (2, f"{card[:4]}. {card[4:8]}. {card[8:12]}. {card[12:]}"),
        (2, f"{card[:8]}/{card[8:]}"),
        (3, f"({n(1)}) {rng.integers(20, 99)} {rng.integers(2000, 9999)} {n(4)}"),
        (3, f"0{rng.integers(20, 99)}-{rng.integers(100, 999)}-{n(5)}"),
        (3, f"{rng.integers(200, 999)}/{rng.integers(200, 999)}-{n(4)}"),
    ]


def decoys(rng):
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    return [f"size {n(1)} x {n(2)} x {n(2)} cm", f"on {rng.integers(1990, 2030)}/{rng.integers(10, 13)}/{rng.integers(10, 29)} we met", f"version {n(2)}.{n(1)}.{n(2)}.{n(4)} out", f"std::{rng.choice(['abs', 'map', 'add'])} of x", f"price {n(4)}.{n(4)} euro", f"ratio {n(2)}/{n(2)}/{n(2)}/{n(2)} is", f"look at the dot of ink", f"pages {n(3)}-{n(3)} of {n(4)}", f"score {n(2)}:{n(2)}:{n(2)} in all", f"sum {n(3)} {n(3)} {n(3)} units"]  # noqa: F541


def taken(text):
    base = pii.base_spans(text)
    return sorted(base + pii.added_spans([text], [base], *pii.model())[0])


def test_recall_and_precision_on_held_out_formats():
    rng = np.random.default_rng(77)
    leads = ["You can use", "It says", "My own one is", "see", "Please try"]
    hit, all_of, wrong, tried = np.zeros(4), np.zeros(4), 0, 0
    for _ in range(60):
        for kind, span in held_out(rng):
            head = f"{leads[rng.integers(5)]} {span}"
            text = head + rng.choice([".", " today", ", thanks", ""])
            at = text.index(span)
            hit[kind] += any(k == kind and a <= at + 1 and b >= at + len(span) - 1 for a, k, b in taken(text))
            all_of[kind] += 1
        for text in decoys(rng):
            wrong += bool(set(taken(text)) - set(pii.base_spans(text)))
            tried += 1
    print("recall by kind", dict(zip(pii.KINDS, (hit / all_of).round(3))), "overall", round(hit.sum() / all_of.sum(), 3), "decoys taken", wrong, "of", tried)
    assert hit.sum() / all_of.sum() >= 0.9 and wrong / tried <= 0.05


def test_generators_propose_every_format():
    rng = np.random.default_rng(5)
    for _ in range(40):
        for kind, span in held_out(rng):
            text = f"use {span} now"
            proposed = [*pii.base_spans(text), *pii.proposals(text)]
            assert any(k == kind and a <= 5 and b >= 3 + len(span) for a, k, b in proposed), span
