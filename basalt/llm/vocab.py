"""Token ids of many texts at once: every distinct word of a task is encoded once.

Texts are split by array operations (chars.py), the distinct words among the spans are encoded, and
the ids of a text are the ids of its words in order. Words are kept between tasks of one Python
worker up to a fixed number. Texts longer than a chunk are encoded in pieces, cut at spaces that no token
reaches over. Texts (of a long one, pieces) for which the array form might differ from the tokenizer's own
library (characters that newer Unicode versions classify anew, texts not in normal form) go to
that library whole.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cache

import numpy as np
import pandas as pd

from basalt.llm import chars
from basalt.llm.common import MIX_B, SpanHasher, chunks, gather, text_pieces

#: Distinct words that a worker keeps; beyond it starts anew.
KEPT_WORDS = 400_000
#: Bytes of text that are encoded at a time: more than other operators take, since a chunk's distinct words grow slower than it.
TOKEN_CHUNK = 1_000_000


class WordIds:
    """Ids of distinct words by the word's 64-bit name, in flat arrays.

    `encode` gives the ids of some words, end to end, and how many each has.
    """

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self):
        self.index: dict[int, int] = {}
        self.check = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, names: list[int], check: np.ndarray, words: list[str]):
        ids, size = self.encode(words)
        self.index.update(zip(names, range(len(self.size), len(self.size) + len(names)), strict=True))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size, self.check, self.ids = np.append(self.size, size), np.append(self.check, check), np.append(self.ids, ids)

    def find(self, cp, begin, end):
        """Where the ids of each span of code points are in `ids`, and their number."""
        name = SpanHasher(cp, MIX_B)(begin, end)
        check = (end - begin) << 42 ^ cp[begin].astype(np.int64) << 21 ^ cp[end - 1]  # besides the name
        inverse, unique = pd.factorize(name)  # by hash table: no sort
        first = np.empty(len(unique), np.int64)
        first[inverse[::-1]] = np.arange(len(name) - 1, -1, -1)
        names = unique.tolist()
        if len(self.index) + len(names) > KEPT_WORDS:
            self.clear()
        new = [k for k, u in enumerate(names) if u not in self.index]
        if new:
            at, text = first[new], cp.tobytes().decode("utf-32-le")
            self.add([names[k] for k in new], check[at], [text[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
        where = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))[inverse]
        start, size = self.start[where], self.size[where]
        for k in np.flatnonzero(self.check[where] != check).tolist():  # two words with one 64-bit name: this one is encoded apart
            ids, n = self.encode([cp[begin[k] : end[k]].tobytes().decode("utf-32-le", "surrogatepass")])
            start[k], size[k] = len(self.ids), n[0]
            self.ids = np.append(self.ids, ids)
        return start, size


def encode_texts(texts: list[str], split, words: WordIds, slow, fit) -> list[np.ndarray]:
    """Ids (uint32) of each text; those longer than a chunk go in pieces."""
    out: list[np.ndarray] = []
    for b, e in chunks(list(map(len, texts)), TOKEN_CHUNK):
        if e - b == 1 and len(texts[b]) > TOKEN_CHUNK:
            parts = [_encode_chunk([piece], split, words, slow, fit)[0] for piece in text_pieces(texts[b], TOKEN_CHUNK)]
            out.append(np.concatenate(parts))
        else:
            out += _encode_chunk(texts[b:e], split, words, slow, fit)
    return out


def _encode_chunk(texts: list[str], split, words: WordIds, slow, fit) -> list[np.ndarray]:
    """Ids of each text. `fit` gives the text to split or None, if it must take the slow way."""
    out: list[np.ndarray | None] = [None] * len(texts)
    fast = [(i, f) for i, t in enumerate(texts) if (f := fit(t)) is not None]
    cp, bounds = chars.code_points([f for _, f in fast])
    cls = chars.class_table()[cp]
    bad = np.add.reduceat(np.append(cls == chars.UNSTABLE, False), bounds[:-1]) * (np.diff(bounds) > 0) if len(fast) else []
    if np.any(bad):
        fast = [x for x, b in zip(fast, bad, strict=True) if not b]
        cp, bounds = chars.code_points([f for _, f in fast])
        cls = chars.class_table()[cp]
    begin, end = split(cp, cls, bounds)
    at, size = words.find(cp, begin, end)
    ids = gather(words.ids, at, size)
    before = np.append(0, np.cumsum(size))[np.searchsorted(begin, bounds)]
    for k, (i, _) in enumerate(fast):
        out[i] = ids[before[k] : before[k + 1]]
    for i, t in enumerate(texts):
        if out[i] is None:
            out[i] = np.array(slow(t), np.uint32)
    return out


@cache
def word_tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@cache
def word_encoder(path: str):
    """Encoder by a `tokenizers` file with the normal form NFC, lower case, and words split by class."""
    t = word_tokenizer(path)
    last = np.zeros(t.get_vocab_size(), bool)
    last[[i for piece, i in t.get_vocab().items() if piece.endswith("</w>")]] = True

    def encode(new: list[str]):
        """Words joined by spaces are encoded together; each word's last id has the mark of a word's end."""
        joined = t.encode_batch_fast([" ".join(new[i : i + 1000]) for i in range(0, len(new), 1000)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in joined])
        end = np.nonzero(last[ids])[0] + 1
        if len(end) != len(new) or end[-1] != len(ids):
            each = [e.ids for e in t.encode_batch_fast(new, add_special_tokens=False)]
            return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)
        return ids, np.diff(end, prepend=0)

    words = WordIds(encode)

    def fit(text: str):
        if text.isascii():
            return text.lower()
        if "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
            return None
        return text.lower()

    slow = lambda text: t.encode(text, add_special_tokens=False).ids
    return lambda texts: encode_texts(texts, chars.split_words, words, slow, fit)


class RankedMerges:
    """Byte-level BPE by a rank file: token bytes by id, and the id that a pair of ids merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            self.pieces[i] = piece
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.merges = {(self.ranks[p[:k]], self.ranks[p[k:]]): i for p, i in self.ranks.items() for k in range(1, len(p)) if p[:k] in self.ranks and p[k:] in self.ranks}
        key = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(key)
        self.keys, self.values = key[order], np.array(list(self.merges.values()), np.int64)[order]
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)

    NONE = 1 << 40

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.NONE)

    def fold(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: the pair of lowest rank, leftmost first, merges until none is left."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        known = [self.ranks.get(w, -1) for w in words]
        size = np.array([len(w) for w in words], np.int64)
        for i, k in enumerate(known):
            if k >= 0:
                out[i] = np.array([k], np.uint32)
        todo = np.nonzero((np.array(known) < 0) & (size > 0))[0]
        for i in todo[size[todo] > 64]:
            out[i] = self.fold_long(words[i])
        todo = todo[size[todo] <= 64]
        todo = todo[np.argsort(size[todo], kind="stable")]
        for group in np.array_split(todo, max(1, len(todo) // 8192)):
            if len(group):
                self._fold_group(words, group, size[group], out)
        return out

    def _fold_group(self, words, group, size, out):
        width = int(size.max())
        ids = np.full((len(group), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(words[i] for i in group), np.uint8)]
        live = np.arange(len(group))
        while len(live):
            a, b = ids[live, :-1], ids[live, 1:]
            rank = np.full(a.shape, self.NONE)
            both = b >= 0
            rank[both] = self.rank(a[both], b[both])
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), at]
            more = best < self.NONE
            live, at, best = live[more], at[more], best[more]
            if not len(live):
                break
            rows = ids[live]
            rows[np.arange(len(live)), at] = best
            place = np.arange(width - 1)
            shifted = np.where(place > at[:, None], rows[:, 1:], rows[:, :-1])
            ids[live] = np.concatenate([shifted, np.full((len(live), 1), -1)], axis=1)
        for k, i in enumerate(group):
            row = ids[k]
            out[i] = row[row >= 0].astype(np.uint32)

    def fold_long(self, word: bytes) -> np.ndarray:
        """The same for one long word, with a heap of (rank, place) and links between neighbours."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n, merges = len(ids), self.merges
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (q := merges.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids: their pieces, concatenated."""
        return gather(self.bytes, self.start[ids], self.size[ids])


@cache
def ranked_merges(path: str) -> RankedMerges:
    return RankedMerges(path)


@cache
def byte_encoder(path: str, pattern: str):
    """Encoder by a rank file; `pattern` is the splitting pattern that split_spaced stands for."""
    import regex

    merges, split = ranked_merges(path), regex.compile(pattern)
    def encode(new: list[str]):
        each = merges.fold([w.encode() for w in new])
        return np.concatenate(each), np.array([len(e) for e in each], np.int64)

    words = WordIds(encode)

    def slow(text: str):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=split.pattern, mergeable_ranks=merges.ranks, special_tokens={}).encode_ordinary(text)

    return lambda texts: encode_texts(texts, chars.split_spaced, words, slow, lambda t: t)
