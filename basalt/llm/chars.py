"""Classes of code points and the two splitting patterns of public tokenizers, as array operations.

A pattern is applied to many texts at once: classes of code points, then run boundaries. Code points
whose class differs between versions of Unicode are marked UNSTABLE; texts with any of them are left
to the tokenizer's own library, so the result is the library's for every text.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, UNSTABLE = 0, 1, 2, 3, 7

#: The code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def class_table() -> np.ndarray:
    """Class of each code point; stable ones have the same category in Unicode 3.2 and today."""
    table = np.full(0x110000, UNSTABLE, np.uint8)
    old, kinds = unicodedata.ucd_3_2_0.category, {"L": LETTER, "N": NUMBER}
    for i in range(0x110000):
        kind = unicodedata.category(c := chr(i))
        if kind == old(c) and kind not in ("Cn", "Cs"):
            table[i] = kinds.get(kind[0], OTHER)
    table[0x1C:0x20] = UNSTABLE  # spaces to some libraries only
    table[WHITE_SPACE] = SPACE
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the bounds of the texts in it."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def _runs(cls: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of one class inside a text, as a mask; mask of first characters of texts."""
    first = np.zeros(len(cls) + 1, bool)
    first[bounds[:-1]] = True
    first = first[:-1]
    start = first.copy()
    start[1:] |= cls[1:] != cls[:-1]
    return start, first


def _contractions(cp: np.ndarray, cls: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes that stand alone before s, t, m, d, re, ve or ll, and the length of the whole."""
    n = len(cp)
    at = np.nonzero((cp == 39) & start)[0]
    at = at[at + 1 < n]
    at = at[(cls[at + 1] == LETTER) & ~first[at + 1]]
    a = cp[at + 1]
    b = np.where((at + 2 < n), cp[np.minimum(at + 2, n - 1)], 0)
    b[(at + 2 < n) & first[np.minimum(at + 2, n - 1)]] = 0
    two = np.isin(a, [ord(c) for c in "stmd"])
    three = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
    size = np.where(two, 2, np.where(three, 3, 0))
    return at[size > 0], size[size > 0]


def split_spaced(cp: np.ndarray, cls: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run, first = _runs(cls, bounds)
    begin = run.copy()
    word = np.nonzero(run & (cls != SPACE) & ~first)[0]
    joined = word[cp[word - 1] == 32]
    begin[joined] = False
    after = word[cls[word - 1] == SPACE]
    begin[after - 1] = True  # the last space before a word is alone or the word's
    at, size = _contractions(cp, cls, run, first)
    alone = first[at] | (cp[at - 1] != 32)
    at, size = at[alone], size[alone]
    begin[at + 1] = False
    rest = (at + size)[at + size < n]
    inside = rest[~run[rest]]
    begin[inside] = True
    spans = np.nonzero(begin)[0]
    return spans, np.append(spans[1:], n)


def split_words(cp: np.ndarray, cls: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of `'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`; spaces are dropped."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run, first = _runs(cls, bounds)
    cut = run | (cls == NUMBER)
    at, size = _contractions(cp, cls, run, first)
    cut[at + 1] = False
    rest = (at + size)[at + size < n]
    cut[rest] = True
    edges = np.nonzero(cut)[0]
    ends = np.append(edges[1:], n)
    kept = cls[edges] != SPACE
    return edges[kept], ends[kept]


def letter_runs(cls: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of maximal runs of letters."""
    if not len(cls):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run, _ = _runs(cls, bounds)
    edges = np.nonzero(run)[0]
    ends = np.append(edges[1:], len(cls))
    kept = cls[edges] == LETTER
    return edges[kept], ends[kept]
