"""Strings of a fixed length that occur again: the distributed part that substring dedups share.

A window is T consecutive symbols (bytes or words) of one text. Equal windows have the same anchor, the
k-gram of least hash inside them, so it is enough to hold windows of one anchor against each other:

1. `anchored` names, in one pass over the texts, maximal runs of window starts at one anchor: the
   anchor's name, the name of the run's content, place, length, and the anchor's place in the run.
   A run stands for about T - k symbols.
2. Anchors are counted; runs whose anchor occurs once hold no repeated window and go.
3. Runs of equal content are one content with a count and a smallest document. An anchor with one
   content is settled. For others, each distinct content's symbols are fetched once (`contents`).
4. `resolve`, from the caller, tells the repeated windows of the contents: suffix trees under prefixes
   of variable length, or prefix doubling by Spark's sorts. Both narrow groups by `clipped`: windows
   of one anchor are dealt out by where the anchor stands in them, and those of a range of such
   places share a longer string than the anchor, which is the new, longer prefix.
5. Windows go back to the runs they came from, and to the texts.

Counts and joins on hot keys are aggregated before the shuffle or are joins that Spark splits; no step
has all pairs of anything. A text is told apart by two 64-bit hashes, of its bytes and of its doc_id
with its bytes; rows that are equal in both have equal spans. Texts longer than a chunk are taken in
pieces that overlap by a window less one symbol, so memory doesn't grow with them beyond their symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import CHUNK_BYTES, MIX_A, MIX_B, MIX_C, SpanHasher, chunks, discard, gather, map_arrow, materialize, mix, pair

RUNS = "anchor long, content long, k long, d long, s0 int, n int, q int"
CONTENTS = "anchor long, content long, n int, q int, c long, least long, symbols binary"
MARKS = "anchor long, content long, runs array<struct<o:int,len:int,least:long>>"
#: Window starts of a long text that are taken at a time.
STEP = 100_000

_UPPER, _LOWER = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column without copying, and the bounds of its values."""
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) of words, runs of bytes other than space and 9 to 13, and the texts' bounds in words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    word = ~_BLANK[data]
    before = np.append(False, word[:-1]) & ~edge[:-1]
    after = np.append(word[1:], False) & ~edge[1:]
    begin, end = np.nonzero(word & ~before)[0], np.nonzero(word & ~after)[0] + 1
    return begin, end, np.searchsorted(begin, bounds)


def word_pieces(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, end, 64-bit names) of a long text's words, a chunk at a time; a word longer than a chunk is named by digest."""
    at, n = 0, len(data)
    while at < n:
        stop = min(at + CHUNK_BYTES, n)
        if stop < n:
            blank = np.flatnonzero(_BLANK[data[at:stop]])
            if len(blank):
                stop = at + int(blank[-1]) + 1
            else:
                while stop < n and not _BLANK[data[stop : stop + CHUNK_BYTES]].any():
                    stop += CHUNK_BYTES
                stop = min(n, stop + int(_BLANK[data[stop : stop + CHUNK_BYTES]].argmax())) if stop < n else n
                yield np.array([at]), np.array([stop]), np.frombuffer(hashlib.blake2b(data[at:stop], digest_size=8).digest(), np.uint64)
                at = stop
                continue
        begin, end, _ = word_spans(data[at:stop], np.array([0, stop - at]))
        if len(begin):
            yield begin + at, end + at, SpanHasher(data[at:stop], MIX_C)(begin, end)
        at = stop


def byte_symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, bounds


def word_symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of words."""
    if len(data) > CHUNK_BYTES:  # one text
        names = [x[2] for x in word_pieces(data)]
        return np.concatenate(names) if names else np.zeros(0, np.uint64), np.array([0, sum(map(len, names))])
    begin, end, own = word_spans(data, bounds)
    return SpanHasher(data, MIX_C)(begin, end) if len(begin) else np.zeros(0, np.uint64), own


@dataclass(frozen=True)
class Kind:
    """Symbols of a text, window length, anchor length."""

    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    dtype: type
    window: int
    anchor: int


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    size, m = 1, h
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - size :]) if size < w else m


def anchored(symbols: np.ndarray, bounds: np.ndarray, kind: Kind):
    """Runs of window starts with one anchor: (text, start in the text, number of starts, anchor, content, anchor's place from the start)."""
    t, k = kind.window, kind.anchor
    empty = tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    if len(symbols) < t:
        return empty
    named = SpanHasher(symbols, MIX_B)
    at = np.arange(len(symbols) - k + 1)
    name = named(at, at + k)
    # the anchor is the leftmost of least upper half: in equal windows it stands at the same place
    least = window_minima((name & _UPPER) | at.astype(np.uint64), t - k + 1) & _LOWER
    size = np.diff(bounds)
    counts = np.maximum(size - t + 1, 0)
    text = np.repeat(np.arange(len(size)), counts)
    if not len(text):
        return empty
    inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = bounds[text] + inside
    anchor = least[start]
    new = np.ones(len(text), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.nonzero(new)[0]
    run = np.diff(np.append(first, len(text)))
    s = start[first]
    content = SpanHasher(symbols, MIX_A)(s, s + run - 1 + t)
    at = anchor[first].astype(np.int64)
    return text[first], inside[first], run, name[at], content, at - s


def anchored_text(data: np.ndarray, bounds: np.ndarray, kind: Kind):
    """The runs of a chunk of texts; a text longer than a chunk goes in overlapping pieces."""
    symbols, own = kind.symbols(data, bounds)
    if len(own) > 2 or len(symbols) <= 2 * STEP:
        yield anchored(symbols, own, kind)
        return
    for b in range(0, len(symbols) - kind.window + 1, STEP):
        piece = symbols[b : b + STEP + kind.window - 1]
        text, s0, n, anchor, content, q = anchored(piece, np.array([0, len(piece)]), kind)
        yield text, s0 + b, n, anchor, content, q


def identified(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """The text, and two 64-bit hashes that tell a row's text and doc_id apart from others."""
    text = docs[text_col].cast("string")
    return text, F.xxhash64(text), F.xxhash64(F.lit(7), docs[id_col].cast("long"), text)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, k, d = identified(docs, id_col, text_col)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), k.alias("k"), d.alias("d"), text.alias("text"))


def _texts(batch, most: int = CHUNK_BYTES):
    """Chunks of a batch: (slice of the batch, bytes, bounds); a text of more than `most` bytes is alone."""
    column = batch.column("text")
    _, bounds = arrow_bytes(column)
    for b, e in chunks(np.diff(bounds).tolist(), most):
        part = batch.slice(b, e - b)
        yield part, *arrow_bytes(part.column("text"))


def run_table(keyed: DataFrame, kind: Kind, with_place: bool) -> DataFrame:
    carry = ["k", "d", "place"] if with_place else ["k", "d"]

    def run(batch):
        for part, data, bounds in _texts(batch):
            for text, s0, n, anchor, content, q in anchored_text(data, bounds, kind):
                if len(text):
                    index = pa.array(text)
                    cols = [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), *(part.column(c).take(index) for c in carry[:2]), *(pa.array(x.astype(np.int32)) for x in (s0, n, q)), *(part.column(c).take(index) for c in carry[2:])]
                    yield pa.RecordBatch.from_arrays(cols, ["anchor", "content", "k", "d", "s0", "n", "q", *carry[2:]])

    rows = keyed.where(F.octet_length("text") >= kind.window)
    rows = rows.select("text", "k", "d", *([F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("place")] if with_place else []))
    return map_arrow(rows, run, RUNS + ", place long" * with_place)


def _fetch(keyed: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """The symbols of each wanted content (anchor, content, k, d, s0, n, q, c, least)."""
    per_text = wanted.groupBy("k", "d").agg(F.collect_list(F.struct("anchor", "content", "s0", "n", "q", "c", "least")).alias("runs"))
    # rows of one key are equal; their contents come once for each, and have been counted for each
    joined = keyed.select("k", "d", "text").join(per_text.hint("shuffle_hash"), ["k", "d"]).select("text", "runs")

    def run(batch):
        lists = batch.column("runs")
        of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
        flat = lists.flatten()
        field = {c: flat.field(c) for c in ("anchor", "content", "s0", "n", "q", "c", "least")}
        s0, n = field["s0"].to_numpy().astype(np.int64), field["n"].to_numpy().astype(np.int64)
        at, width = 0, np.dtype(kind.dtype).itemsize
        for part, data, bounds in _texts(batch):
            symbols, own = kind.symbols(data, bounds)
            mine = np.flatnonzero((of >= at) & (of < at + part.num_rows))
            size = n[mine] - 1 + kind.window
            for b, e in chunks(size.tolist(), CHUNK_BYTES):
                here = mine[b:e]
                got = np.ascontiguousarray(gather(symbols, own[of[here] - at] + s0[here], size[b:e])).view(np.uint8)
                offsets = np.append(0, np.cumsum(size[b:e])) * width
                out = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(got)])
                index = pa.array(here)
                yield pa.RecordBatch.from_arrays([*(field[c].take(index) for c in ("anchor", "content", "n", "q", "c", "least")), out], ["anchor", "content", "n", "q", "c", "least", "symbols"])
            at += part.num_rows

    return map_arrow(joined, run, CONTENTS)


def clipped(symbols: np.ndarray, bounds: np.ndarray, n: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int, kind: Kind):
    """Contents whose windows have their anchor at places low to high, cut into `parts` ranges of such places.

    A window at j of a content has its anchor at q - j. All windows of a range share the string from the
    anchor's greatest place in them to its least: its name is the group's. Gives (content, first window,
    windows, least place, greatest place, name of the group, name of the clip) for ranges that a content has.
    """
    named, check = SpanHasher(symbols, MIX_B), SpanHasher(symbols, MIX_A)
    width = -(-(high - low + 1) // parts)
    anchor = bounds[:-1] + q
    out = []
    for p in range(parts):
        a, b = low + p * width, np.minimum(low + (p + 1) * width - 1, high)
        first, last = np.maximum(q - b, 0), np.minimum(q - a, n - 1)
        has = np.flatnonzero((a <= b) & (first <= last))
        if len(has):
            core = named(anchor[has] - a[has], anchor[has] - b[has] + kind.window)
            begin = bounds[:-1][has] + first[has]
            clip = check(begin, bounds[:-1][has] + last[has] + kind.window)
            out.append((has, first[has], last[has] - first[has] + 1, a[has], b[has], mix(pair(core, (a[has] << 16 | b[has]).astype(np.uint64))), clip))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint64)] * 2


def content_arrays(table, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a batch's contents end to end, and their bounds."""
    flat, bounds = arrow_bytes(table.column("symbols"))
    return np.frombuffer(flat.tobytes(), kind.dtype), bounds // np.dtype(kind.dtype).itemsize


def content_parts(batch, kind: Kind, most: int = CHUNK_BYTES):
    """Slices of a batch of contents with at most `most` symbols, their symbols and bounds: names take tens of bytes for each symbol."""
    symbols, bounds = content_arrays(batch, kind)
    for b, e in chunks(np.diff(bounds).tolist(), most):
        yield batch.slice(b, e - b), symbols[bounds[b] : bounds[e]], bounds[b : e + 1] - bounds[b]


def repeated_spans(docs: DataFrame, kind: Kind, resolve, earlier_only: bool, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id, k, d, text; spans: k, d, spans array<struct<start, stop>> in symbols, unmerged).

    `earlier_only`: a window counts as repeated in a document if it also starts in one with a
    smaller doc_id; else if it starts anywhere else. A null doc_id is larger than all others.
    `resolve(contents, kind)` gives MARKS of contents (CONTENTS) and the tables to delete afterwards.
    """
    keyed = _keyed(docs, id_col, text_col)
    runs = materialize(run_table(keyed, kind, earlier_only), "runs")
    tally = runs.groupBy("anchor").agg(F.count("*").alias("times"), *([F.min("place").alias("a"), F.max("place").alias("b")] if earlier_only else [])).where("times > 1 and a < b" if earlier_only else "times > 1").select("anchor")
    # written before the joins: Spark splits a hot anchor's join only if no aggregate stands between it and the shuffle
    tally = materialize(tally, "tally")
    alive = materialize(runs.join(tally, "anchor"), "alive")
    discard(runs, tally)
    least = F.min("place") if earlier_only else F.lit(0).cast("long")
    distinct = materialize(alive.groupBy("anchor", "content").agg(F.count("*").alias("c"), least.alias("least"), F.min(F.struct("k", "d", "s0", "n", "q")).alias("one")), "distinct")
    sharing = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("contents")), "sharing")
    placed = distinct.join(sharing, "anchor")
    settled = materialize(placed.where("contents = 1 and c > 1").select("anchor", "content", F.array(F.struct(F.lit(0).alias("o"), F.col("one.n").alias("len"), "least")).alias("runs")), "settled")
    wanted = placed.where("contents > 1").select("anchor", "content", "c", "least", "one.*")
    contents = materialize(_fetch(keyed, wanted, kind), "contents")
    discard(distinct, sharing)
    marks, used = resolve(contents, kind)
    hits = alive.join(settled.unionByName(marks), ["anchor", "content"]).select("k", "d", "s0", *(["place"] if earlier_only else []), F.explode("runs").alias("r"))
    if earlier_only:
        hits = hits.where("r.least < place")
    start = F.col("s0") + F.col("r.o")
    spans = hits.groupBy("k", "d").agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("r.len") - 1 + kind.window).alias("stop"))).alias("spans"))
    spans = materialize(spans, "spans")
    discard(alive, settled, contents, *used)
    return keyed, spans


def with_spans(keyed: DataFrame, spans: DataFrame, fn: Callable, schema, carry: str = "doc_id") -> DataFrame:
    """fn(column to carry, texts' bytes and bounds, span starts, span stops, spans of each) -> batch, over all texts."""
    right = spans.select(F.col("k").alias("_k"), F.col("d").alias("_d"), F.col("spans").alias("_spans"))
    joined = keyed.join(right.hint("shuffle_hash"), (keyed["k"] == F.col("_k")) & (keyed["d"] == F.col("_d")), "left").select(keyed[carry].alias("carried"), keyed["text"].alias("text"), F.col("_spans").alias("spans"))

    def run(batch):
        for part, data, bounds in _texts(batch):
            lists = part.column("spans")
            values = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            yield fn(part.column("carried"), data, bounds, values.field("start").to_numpy().astype(np.int64), values.field("stop").to_numpy().astype(np.int64), sizes)

    return map_arrow(joined, run, schema)


def covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of what any of the spans covers."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, begins, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0
