"""Suffix-array dedup by prefix doubling, over bytes.

Places are ranked by growing prefixes: ranks of h bytes at a place and of h bytes h further on are a
pair, Spark sorts the distinct pairs of all places and numbers them in order, and a pair's number is
the place's rank of 2h bytes. Places whose rank is unique drop out; the rounds end at the threshold
(50, 100, 200 bytes). First ranks are names of 50 bytes.

Doubling over every byte would sort and shuffle 16 bytes and more for each byte of text in each round,
so two exact filters come first (repeats.py): places whose anchor (a string of 64 bytes that equal
windows share) is unique go, and then, among contents of one anchor, places that share no string of
183 bytes or more (windows of an eighth of the anchor's places) with another content. Clips that are equal in
whole are settled there. What is left, windows next to a difference between texts, is doubled.

Defined results: null is empty; texts shorter than the threshold lose nothing; matches don't cross
texts; a repeated row is another document, so its copies are removed; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm.common import MIX_B, MIX_C, SpanHasher, discard, map_arrow, materialize
from basalt.llm.repeats import Kind, byte_symbols, clipped, content_parts, covered, identified, repeated_spans, with_spans

BYTES = Kind(byte_symbols, np.uint8, 200, 64)
#: Ranges of anchor places by which contents are clipped before the doubling.
PARTS = 8
#: Rounds of doubling; first ranks are of window / 2**ROUNDS bytes.
ROUNDS = 2


def _clips(contents: DataFrame, kind: Kind, parts: int) -> DataFrame:
    """Clips of contents by ranges of their anchor's place in a window."""

    def run(batch):
        for part, symbols, bounds in content_parts(batch, kind):
            n, q = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "q"))
            every = np.zeros(len(n), np.int64)
            who, first, number, _, _, key, clip = clipped(symbols, bounds, n, q, every, every + kind.window - kind.anchor, parts, kind)
            if len(who):
                index = pa.array(who)
                cols = [*(part.column(c).take(index) for c in ("anchor", "content", "c", "least")), pa.array(key.view(np.int64)), pa.array(clip.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "content", "c", "least", "key", "clip", "first", "n"])

    return map_arrow(contents, run, "anchor long, content long, c long, least long, key long, clip long, first int, n int")


def rank_columns(rounds: int) -> list[str]:
    return [f"r{i}" for i in range(1 << rounds)]


def offsets(window: int, rounds: int) -> list[int]:
    """Where the first ranks of a window begin: each half from both ends, halved again, so any length is covered."""
    out, size = [0], window
    for _ in range(rounds):
        half = -(-size // 2)
        out = [x for o in out for x in (o, o + size - half)]
        size = half
    return out


def _windows(contents: DataFrame, mixed: DataFrame, kind: Kind, rounds: int) -> DataFrame:
    """The first ranks (names of short strings) of each window of clips that others share a string with."""
    wanted = mixed.groupBy("anchor", "content").agg(F.collect_list(F.struct("key", "clip", "first", "n", "c", "least")).alias("clips"))
    joined = contents.select("anchor", "content", "symbols").join(wanted, ["anchor", "content"]).select("symbols", "clips")
    size = kind.window
    for _ in range(rounds):
        size = -(-size // 2)

    def run(batch):
        for part, symbols, bounds in content_parts(batch, kind):
            lists = part.column("clips")
            of = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
            clips = lists.flatten()
            n = clips.field("n").to_numpy().astype(np.int64)
            o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            clip = np.repeat(np.arange(len(n)), n)
            begin = bounds[of[clip]] + clips.field("first").to_numpy()[clip] + o
            named, index = SpanHasher(symbols, MIX_C), pa.array(clip)
            ranks = [pa.array(named(begin + x, begin + x + size).view(np.int64)) for x in offsets(kind.window, rounds)]
            yield pa.RecordBatch.from_arrays([*(clips.field(c).take(index) for c in ("key", "clip", "c", "least")), pa.array(o.astype(np.int32)), *ranks], ["key", "clip", "c", "least", "o", *rank_columns(rounds)])

    return map_arrow(joined, run, "key long, clip long, c long, least long, o int, " + ", ".join(f"{r} long" for r in rank_columns(rounds)))


def reranked(places: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y, rank): the pairs of ranks that more than one place has, numbered in the order of (x, y).

    Ranks keep the order and are not dense: they are a sorted partition's number and the row in it.
    """
    each = [places.select(F.col(x).alias("x"), F.col(y).alias("y"), "c") for x, y in pairs]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    often = every.groupBy("x", "y").agg(F.sum("c").alias("times")).where("times > 1").select("x", "y")
    return materialize(often.repartitionByRange("x", "y").sortWithinPartitions("x", "y").withColumn("rank", F.monotonically_increasing_id()), "ranks")


def doubled(windows: DataFrame, rounds: int) -> DataFrame:
    """Windows (key, clip, c, least, o) with the rank of all their bytes, `r0`; those with a unique rank dropped.

    `windows` is a written table, which is deleted, as are those of each round.
    """
    names = rank_columns(rounds)
    for _ in range(rounds):
        pairs = list(zip(names[::2], names[1::2], strict=True))
        ranks = reranked(windows, pairs)
        out = windows
        for k, (x, y) in enumerate(pairs):
            out = out.join(ranks.select(F.col("x").alias(x), F.col("y").alias(y), F.col("rank").alias(f"n{k}")), [x, y])
        names = rank_columns(len(pairs).bit_length() - 1)
        out = materialize(out.select("key", "clip", "c", "least", "o", *(F.col(f"n{k}").alias(r) for k, r in enumerate(names))), "places")
        discard(windows, ranks)
        windows = out
    return windows


def resolve(contents: DataFrame, kind: Kind, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, list[DataFrame]]:
    """Marks of repeated windows of contents, by prefix doubling."""
    clips = materialize(_clips(contents, kind, parts), "clips")
    distinct = materialize(clips.groupBy("key", "clip").agg(F.sum("c").alias("c"), F.min("least").alias("least"), F.min(F.struct("anchor", "content", "first", "n")).alias("one")), "distinct")
    sharing = materialize(distinct.groupBy("key").agg(F.count("*").alias("clips")), "sharing")
    placed = distinct.join(sharing, "key")
    settled = materialize(placed.where("clips = 1 and c > 1").select("key", "clip", F.lit(0).alias("o"), F.col("one.n").alias("len"), "least"), "settled")
    windows = materialize(_windows(contents, placed.where("clips > 1").select("key", "clip", "c", "least", "one.*"), kind, rounds), "windows")
    discard(distinct, sharing)
    ranked = doubled(windows, rounds)
    classes = materialize(ranked.groupBy("r0").agg(F.sum("c").alias("times"), F.min("least").alias("least")).where("times > 1"), "classes")
    hits = ranked.select("key", "clip", "o", "r0").join(classes.select("r0", "least"), "r0")
    # neighbouring windows of a clip are one run (a clip has at most as many windows as a range has places)
    order = Window.partitionBy("key", "clip", "least").orderBy("o")
    runs = hits.select("key", "clip", "o", "least").distinct().withColumn("island", F.col("o") - F.row_number().over(order)).groupBy("key", "clip", "least", "island").agg(F.min("o").alias("o"), F.count("*").cast("int").alias("len"))
    found = materialize(runs.select("key", "clip", "o", "len", "least"), "found")
    discard(ranked, classes)
    found_all = settled.unionByName(found)
    marks = clips.select("anchor", "content", "key", "clip", "first").join(found_all, ["key", "clip"]).select("anchor", "content", F.array(F.struct((F.col("first") + F.col("o")).alias("o"), "len", "least")).alias("runs"))
    return marks, [clips, settled, found]


def _apply(data, bounds, starts, stops, sizes):
    gone = np.zeros(len(data), bool)
    if len(starts):
        base = np.repeat(bounds[:-1], sizes)
        gone = covered(len(data), base + starts, base + stops)
    rows = []
    for k in range(len(bounds) - 1):
        out = gone[bounds[k] : bounds[k + 1]]
        rows.append((out, data[bounds[k] : bounds[k + 1]]))
    return rows


def whole_characters(data: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The mask without characters of which only some bytes are in it."""
    if not len(data):
        return out
    first = (data & 0xC0) != 0x80
    first[0] = True
    at = np.nonzero(first)[0]
    size = np.diff(np.append(at, len(data)))
    return np.repeat(np.add.reduceat(out.astype(np.int64), at) == size, size)


def dedup_bytes(docs: DataFrame, kind: Kind = BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, kept: the text without repeated strings; a character goes whole or stays."""

    def fn(doc_ids, *args):
        rows = [(whole_characters(x, out), x) for out, x in _apply(*args)]
        cols = [pa.array([len(x) for _, x in rows], pa.int64()), pa.array([int(o.sum()) for o, _ in rows], pa.int64()), pa.array([x[~o].tobytes().decode() for o, x in rows], pa.string())]
        return pa.RecordBatch.from_arrays([doc_ids, *cols], ["doc_id", "n_bytes", "n_removed", "kept"])

    return with_spans(*repeated_spans(docs, kind, resolve, False, id_col, text_col), fn, "doc_id long, n_bytes long, n_removed long, kept string")


def dedup_digests(docs: DataFrame, kind: Kind = BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, removed bytes, removed runs and the SHA-256 of the bytes left."""

    def fn(doc_ids, *args):
        out = [(len(x), int(o.sum()), int(np.count_nonzero(o[1:] & ~o[:-1]) + bool(len(o) and o[0])), hashlib.sha256(x[~o].tobytes()).hexdigest()) for o, x in _apply(*args)]
        return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(*repeated_spans(docs, kind, resolve, False, id_col, text_col), fn, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean_documents(docs: DataFrame, kind: Kind = BYTES, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows (all columns) without repeated strings in their text; the number of characters follows.

    A document of which nothing is left goes; one that was empty stays.
    """
    _, spans = repeated_spans(docs, kind, resolve, False, id_col, text_col)
    names = docs.columns
    text, k, d = identified(docs, id_col, text_col)
    rows = docs.select(F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names) if c != text_col), docs[text_col].isNull().alias("no_text")).alias("rest"), text.alias("text"), k.alias("k"), d.alias("d"))

    def fn(rest, *args):
        texts = []
        for out, x in _apply(*args):
            out = whole_characters(x, out)
            texts.append(None if len(x) and out.all() else x[~out].tobytes().decode())
        left = pa.array([x is not None for x in texts])
        return pa.RecordBatch.from_arrays([rest, pa.array(texts, pa.string()), left], ["rest", "text", "left"])

    kept = with_spans(rows, spans, fn, T.StructType([rows.schema["rest"], T.StructField("text", T.StringType()), T.StructField("left", T.BooleanType())]), carry="rest").where("left")

    def column(i: int, c: str):
        if c == text_col:
            return F.when(~F.col("rest.no_text"), F.col("text"))
        same = F.col(f"rest.c{i}")
        return F.when(same.isNotNull(), F.length("text").cast(docs.schema[c].dataType)).otherwise(same) if c == chars_col else same

    return kept.select(*(column(i, c).alias(c) for i, c in enumerate(names)))
