"""Substring dedup by prefix-partitioned suffix trees, over words.

Suffixes (places where a window of words begins) are dealt to groups by a prefix that equal windows
share: first the run of words at their anchor (repeats.py). A group of more bytes than `GROUP_BYTES`
gets longer prefixes: its windows are halved by the anchor's place in them, and those of a half share a
longer string, by which they are dealt out anew; and so on, up to the whole window, under which all is
equal. So prefixes have as many words as it takes for a group to fit in memory.

A task then builds the subtrees of its groups, as sorted suffixes with the longest common prefixes of
neighbours: an internal node is a run of suffixes with a common prefix of its depth. Nodes at the depth
of a window or below it, the deep ones, are the repeats; their leaves' windows join to maximal repeats
when they are removed.

Defined results: words are runs of bytes other than space and 9 to 13; null or empty texts and texts
shorter than a window lose nothing; repeated rows have the same doc_id and so don't count against each
other; a null doc_id is larger than all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import CHUNK_BYTES, bound_batches, map_arrow, materialize
from basalt.llm.repeats import Kind, clipped, content_arrays, covered, repeated_spans, with_spans, word_pieces, word_spans, word_symbols

WORDS = Kind(word_symbols, np.uint64, 50, 16)
#: Bytes of the contents of one group that a task may hold; a group of more gets longer prefixes.
GROUP_BYTES = 2 << 20
GROUPS = "key long, clip long, low int, high int, n int, q int, c long, least long, symbols binary"
RUNS = "key long, clip long, runs array<struct<o:int,len:int,least:long>>"


def sorted_suffixes(symbols: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at `place` by their first `depth` symbols, longest common prefix of each with the one before)."""
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    while 2 << (len(ranks) - 1) <= depth:
        r, h = ranks[-1], 1 << (len(ranks) - 1)
        ranks.append(np.unique(r[:-h] * (r.max() + 1) + r[h:], return_inverse=True)[1].astype(np.int64))
    top = len(ranks) - 1
    rest = ranks[top][place + depth - (1 << top)]
    order = np.lexsort((rest, ranks[top][place]))
    a, b = place[order[:-1]], place[order[1:]]
    common = np.zeros(len(order), np.int64)
    for k in range(top, -1, -1):
        at = common[1:]
        more = at + (1 << k) <= depth
        same = np.zeros(len(a), bool)
        same[more] = ranks[k][a[more] + at[more]] == ranks[k][b[more] + at[more]]
        common[1:] += same.astype(np.int64) << k
    return order, common


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, leaves) of the internal nodes that are the uppermost at `depth` or below it, among sorted suffixes."""
    inside = np.append(common >= depth, False)
    inside[0] = False
    first = np.flatnonzero(~inside[:-1] & inside[1:])
    last = np.flatnonzero(inside[:-1] & ~inside[1:])
    return first, last - first + 1


def window_starts(bounds: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(content, place) of each window start of contents laid end to end."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, bounds[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _repeats_of(table: pa.Table, kind: Kind) -> pa.RecordBatch | None:
    """Runs of repeated windows of each clip of some groups; neighbours with one smallest document are one run."""
    symbols, bounds = content_arrays(table, kind)
    n = table.column("n").to_numpy().astype(np.int64)
    owner, place = window_starts(bounds, n)
    weight, smallest = table.column("c").to_numpy()[owner], table.column("least").to_numpy()[owner].copy()
    order, common = sorted_suffixes(symbols, place, kind.window)
    first, leaves = deep_nodes(common, kind.window)
    hit = weight > 1  # a leaf of several equal suffixes
    members = np.repeat(first - (np.cumsum(leaves) - leaves), leaves) + np.arange(leaves.sum())
    if len(first):
        who = order[members]
        hit[who] = True
        smallest[who] = np.repeat(np.minimum.reduceat(smallest[who], np.cumsum(leaves) - leaves), leaves)
    hit = np.flatnonzero(hit)
    if not len(hit):
        return None
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (owner[hit][1:] != owner[hit][:-1]) | (smallest[hit][1:] != smallest[hit][:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(hit)))
    whose = owner[hit[begin]]
    clips, at = np.unique(whose, return_index=True)
    runs = pa.StructArray.from_arrays([pa.array((place[hit[begin]] - bounds[whose]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(smallest[hit[begin]].astype(np.int64))], ["o", "len", "least"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(whose)).astype(np.int32)), runs)
    index = pa.array(clips)
    return pa.RecordBatch.from_arrays([table.column("key").take(index), table.column("clip").take(index), lists], ["key", "clip", "runs"])


def _subtrees(groups: DataFrame, kind: Kind, group_bytes: int) -> DataFrame:
    """Repeated windows under each prefix; a task holds whole groups, up to `group_bytes` at a time."""

    def grown(held):
        return _repeats_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0], kind)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(a, b - a)
                if held and size > group_bytes and held[-1].column("key")[0] != piece.column("key")[0]:
                    if (out := grown(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(piece)
                size += piece.column("symbols").nbytes
        if held and (out := grown(held)) is not None:
            yield out

    bound_batches(groups.sparkSession)
    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(run, RUNS)


def _halved(groups: DataFrame, kind: Kind) -> DataFrame:
    """Clips of the contents of groups, under prefixes that are longer by half of what is missing."""

    def run(batch):
        symbols, bounds = content_arrays(batch, kind)
        n, q, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "q", "low", "high"))
        who, first, number, a, b, key, clip = clipped(symbols, bounds, n, q, low, high, 2, kind)
        if len(who):
            begin = bounds[who] + first
            parts = [symbols[x:y].tobytes() for x, y in zip(begin.tolist(), (begin + number - 1 + kind.window).tolist(), strict=True)]
            index = pa.array(who)
            cols = [batch.column("key").take(index), batch.column("clip").take(index), pa.array(first.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(clip.view(np.int64))]
            cols += [pa.array(x.astype(np.int32)) for x in (a, b, number, q[who] - first)] + [batch.column("c").take(index), batch.column("least").take(index), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["of_key", "of_clip", "shift", "key", "clip", "low", "high", "n", "q", "c", "least", "symbols"])

    return map_arrow(groups, run, "of_key long, of_clip long, shift int, " + GROUPS)


def resolve(contents: DataFrame, kind: Kind, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """Marks of repeated windows of contents, by subtrees under prefixes of variable length."""
    now = contents.select(F.col("anchor").alias("key"), F.col("content").alias("clip"), F.lit(0).alias("low"), F.lit(kind.window - kind.anchor).alias("high"), "n", "q", "c", "least", "symbols")
    marks, used, links = None, [], None
    while True:
        sizes = materialize(now.groupBy("key").agg(F.sum(F.octet_length("symbols")).alias("bytes"), F.max(F.col("high") - F.col("low")).alias("left")).where((F.col("bytes") > group_bytes) & (F.col("left") > 0)).select("key"), "large")
        used.append(sizes)
        more = sizes.head(1)
        found = _subtrees(now.join(sizes, "key", "left_anti") if more else now, kind, group_bytes)
        if links is None:
            found = found.select(F.col("key").alias("anchor"), F.col("clip").alias("content"), "runs")
        else:
            moved = F.transform("runs", lambda r: F.struct((r["o"] + F.col("shift")).alias("o"), r["len"].alias("len"), r["least"].alias("least")))
            found = found.join(links, ["key", "clip"]).select("anchor", "content", moved.alias("runs"))
        marks = found if marks is None else marks.unionByName(found)
        if not more:
            return marks, used
        split = materialize(_halved(now.join(sizes, "key", "left_semi"), kind), "halved")
        step = split.select("of_key", "of_clip", F.col("shift").alias("by"), "key", "clip").distinct()
        if links is None:
            links = step.select(F.col("of_key").alias("anchor"), F.col("of_clip").alias("content"), "key", "clip", F.col("by").alias("shift"))
        else:
            before = links.select("anchor", "content", F.col("key").alias("of_key"), F.col("clip").alias("of_clip"), "shift")
            links = before.join(step, ["of_key", "of_clip"]).select("anchor", "content", "key", "clip", (F.col("shift") + F.col("by")).alias("shift"))
        links = materialize(links, "links")
        # equal clips of several contents are one from here on
        one = F.min(F.struct("low", "high", "n", "q", "symbols")).alias("one")
        now = materialize(split.groupBy("key", "clip").agg(F.sum("c").alias("c"), F.min("least").alias("least"), one).select("key", "clip", "one.low", "one.high", "one.n", "one.q", "c", "least", "one.symbols"), "groups")
        used += [split, links, now]


def _kept(data: np.ndarray, gone: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    raw, left = data.tobytes(), ~gone
    return b" ".join([raw[x:y] for x, y in zip(begin[left].tolist(), end[left].tolist(), strict=True)])


def _apply(data, bounds, starts, stops, sizes):
    """(words, removed words, kept text) of each text."""
    if len(data) > CHUNK_BYTES:  # one text, in pieces
        gone, parts, at = None, [], 0
        pieces = list(word_pieces(data)) if not len(starts) else None
        total = sum(len(p[0]) for p in pieces or word_pieces(data))
        gone = covered(total, starts, stops)
        for begin, end, _ in pieces or word_pieces(data):
            part = gone[at : at + len(begin)]
            at += len(begin)
            if not part.all():
                base = int(begin[0])
                parts.append(_kept(data[base : int(end[-1])], part, begin - base, end - base))
        return [(total, int(gone.sum()), b" ".join(parts))]
    begin, end, own = word_spans(data, bounds)
    gone = np.zeros(len(begin), bool)
    if len(starts):
        base = np.repeat(own[:-1], sizes)
        gone = covered(len(begin), base + starts, base + stops)
    return [(int(own[k + 1] - own[k]), int(gone[own[k] : own[k + 1]].sum()), _kept(data[bounds[k] : bounds[k + 1]], gone[own[k] : own[k + 1]], begin[own[k] : own[k + 1]] - bounds[k], end[own[k] : own[k + 1]] - bounds[k])) for k in range(len(bounds) - 1)]


def _dedup(docs: DataFrame, kind: Kind, id_col: str, text_col: str, group_bytes: int, last: str, of) -> DataFrame:
    def fn(doc_ids, *args):
        rows = [(n, k, of(t)) for n, k, t in _apply(*args)]
        return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", last])

    found = repeated_spans(docs, kind, lambda contents, k: resolve(contents, k, group_bytes), True, id_col, text_col)
    return with_spans(*found, fn, f"doc_id long, n_words long, n_removed long, {last} string")


def dedup_words(docs: DataFrame, kind: Kind = WORDS, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by a space): windows also in an earlier document removed."""
    return _dedup(docs, kind, id_col, text_col, group_bytes, "kept", bytes.decode)


def dedup_digests(docs: DataFrame, kind: Kind = WORDS, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The same with the SHA-256 of the words left."""
    return _dedup(docs, kind, id_col, text_col, group_bytes, "kept_sha256", lambda t: hashlib.sha256(t).hexdigest())
