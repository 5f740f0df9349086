"""Vectorised pre-tokenisation: where the matches of the byte-level pattern begin, found without a regular expression.

The pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Each code point is mapped to a symbol by an array of classes (letters, numbers, white space, other), refined by its
neighbours where the pattern looks ahead: an apostrophe before one of the endings, white space before the last of a run.
A symbol is then a transition function over eight states. Function composition is associative, so blocks of symbols are
composed side by side as columns of an array, the blocks are joined by a scan, and a second pass gives the state at
every code point; state and symbol tell whether a match begins there.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

L, N, O, A1, A2, SL, OL, WN, B = range(9)  #: symbols
FRESH, IN_L, IN_N, IN_O, IN_W, AFTER_SPACE, LEFT1, LEFT2 = range(8)  #: states
STATES, BLOCK = 8, 64

#: Code points of white space, and what may follow an apostrophe to make a match of its own.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ENDINGS, LONG_ENDINGS = ["s", "t", "m", "d"], ["re", "ve", "ll"]


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space (WN) or other."""
    found = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            found[c] = L
        elif kind == "N":
            found[c] = N
    found[WHITE] = WN
    return found


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol * 8 + state] and begins[symbol * 8 + state]."""
    after, begins = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), bool)
    after[L], after[N], after[O], after[A1], after[A2] = IN_L, IN_N, IN_O, LEFT1, LEFT2
    after[SL], after[OL], after[WN], after[B] = AFTER_SPACE, FRESH, IN_W, FRESH
    begins[L, [IN_L, AFTER_SPACE, LEFT1, LEFT2]] = False
    after[L, LEFT1], after[L, LEFT2] = FRESH, LEFT1
    begins[N, [IN_N, AFTER_SPACE]] = False
    for s in (O, A1, A2):
        begins[s, [IN_O, AFTER_SPACE]] = False
        after[s, [IN_O, AFTER_SPACE]] = IN_O
    begins[WN, IN_W] = False
    begins[B] = False
    return after.reshape(-1), begins.reshape(-1)


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point of several texts, one after the other with a separator (at `ends`) after each."""
    out = classes()[points]
    white = out == WN
    white[ends] = True  # the end of a text is no \S
    last = np.zeros(len(out), bool)
    last[:-1] = ~white[1:]
    last &= white
    out[last] = np.where(points[last] == 0x20, SL, OL)
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        one = points[np.minimum(quote + 1, len(points) - 1)]
        two = points[np.minimum(quote + 2, len(points) - 1)]
        sep = np.zeros(len(points), bool)
        sep[ends] = True
        near = ~sep[np.minimum(quote + 1, len(points) - 1)] & (quote + 1 < len(points))
        far = near & ~sep[np.minimum(quote + 2, len(points) - 1)] & (quote + 2 < len(points))
        out[quote[near & np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = A1
        pair = one.astype(np.uint64) << np.uint64(32) | two
        out[quote[far & np.isin(pair, np.array([ord(a) << 32 | ord(b) for a, b in LONG_ENDINGS], np.uint64))]] = A2
    out[ends] = B
    return out


def states_before(sym: np.ndarray) -> np.ndarray:
    """The state before each symbol, by composing transition functions in blocks and scanning over the blocks.

    White space before a word, and the end of a text, are constant functions: they absorb all before them. So a block
    that holds one is a constant itself, found from any state; only other blocks are composed for every state."""
    step = machine()[0]
    rows = -(-len(sym) // BLOCK)
    padded = np.full(rows * BLOCK, B, np.uint8)
    padded[: len(sym)] = sym
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    open_rows = np.flatnonzero(~((columns == SL) | (columns == OL) | (columns == B)).any(0))
    columns *= np.uint8(STATES)

    def run(state: np.ndarray, columns: np.ndarray, found: np.ndarray | None = None) -> np.ndarray:
        for k, c in enumerate(columns):
            if found is not None:
                found[k] = state
            state = step.take(state + c, mode="clip")
        return state

    whole = run(np.zeros(rows, np.uint8), columns)  # what a constant block gives
    if len(open_rows):
        functions = run(np.broadcast_to(np.arange(STATES, dtype=np.uint8), (len(open_rows), STATES)), columns[:, open_rows, None]).tolist()
        for r, f in zip(open_rows.tolist(), functions):
            whole[r] = f[whole[r - 1] if r else FRESH]
    first = np.zeros(rows, np.uint8)
    first[1:] = whole[:-1]
    found = np.empty((BLOCK, rows), np.uint8)
    run(first, columns, found)
    return found.T.reshape(-1)[: len(sym)]


def slices(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All matches of all texts in order, and how many each text has."""
    joined = "\0".join([*texts, ""])
    if not joined:
        return [], np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    sym = symbols(points, ends)
    begins = machine()[1].take(sym * np.uint8(STATES) + states_before(sym))
    begins[ends] = True
    at = np.flatnonzero(begins)
    real = sym[at] != B
    seen = np.concatenate([[0], np.cumsum(real)])
    counts = np.diff(seen[np.searchsorted(at, np.concatenate([[0], ends]))])
    real = real[:-1]
    return [joined[a:b] for a, b in zip(at[:-1][real].tolist(), at[1:][real].tolist())], counts
