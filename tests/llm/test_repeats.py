"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import suffix_array, suffix_tree
from basalt.llm.common import materialize
from basalt.llm.repeats import Kind, anchored, byte_symbols, word_symbols

BIG = 1 << 62


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute_words(rows, t):
    first = {}
    for i, text in rows:
        w = words_of(text)
        for j in range(len(w) - t + 1):
            key = tuple(w[j : j + t])
            first[key] = min(first.get(key, BIG + 1), BIG if i is None else i)
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for j in range(len(w) - t + 1):
            if first[tuple(w[j : j + t])] < (BIG if i is None else i):
                gone[j : j + t] = [True] * t
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, t):
    count = Counter(b[j : j + t] for _, x in rows for b in [(x or "").encode()] for j in range(len(b) - t + 1))
    out = []
    for i, x in rows:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - t + 1):
            if count[b[j : j + t]] > 1:
                gone[j : j + t] = b"\1" * t
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_bytes", [suffix_tree.GROUP_BYTES, 1])
def test_words_equal_brute_force(spark, make_docs, odd_rows, group_bytes):
    kind = Kind(word_symbols, np.uint64, 20, 6)
    got = suffix_tree.dedup_digests(make_docs(spark, odd_rows), kind, group_bytes=group_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(odd_rows, 20)


@pytest.mark.parametrize(("window", "anchor"), [(80, 24), (77, 20)])
def test_bytes_equal_brute_force(spark, make_docs, odd_rows, window, anchor):
    kind = Kind(byte_symbols, np.uint8, window, anchor)
    got = suffix_array.dedup_digests(make_docs(spark, odd_rows), kind).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(odd_rows, window)


def test_texts_are_told_apart_by_more_than_32_bits(spark, make_docs):
    shared = " ".join(f"s{i}" for i in range(60))
    apart = " ".join(f"o{i}" for i in range(80))
    tails = spark.range(300_000).selectExpr("cast(id as string) as t")
    left = tails.selectExpr(f"concat('{shared} ', t) as a").selectExpr("a", "hash(a) as h")
    right = tails.selectExpr(f"concat('{apart} ', t) as b").selectExpr("b", "hash(b) as h")
    a, b = left.join(right, "h").select("a", "b").first()
    for ids in ((1, None, None), (1, 2, 2)):
        rows = [(ids[0], shared), (ids[1], a), (ids[2], b)]
        docs = make_docs(spark, rows)
        assert sorted((tuple(r) for r in suffix_tree.dedup_digests(docs).collect()), key=str) == brute_words(rows, 50)
        assert sorted((tuple(r) for r in suffix_array.dedup_digests(docs).collect()), key=str) == brute_bytes(rows, 200)
        kept = {r["text"] for r in suffix_array.clean_documents(docs).collect()}
        assert b in kept


def test_subtrees_equal_a_naive_tree():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 3, 400).astype(np.uint64)
    place = np.arange(0, 370)
    for depth in (1, 5, 6, 13, 30):
        order, common = suffix_tree.sorted_suffixes(symbols, place, depth)
        tail = [tuple(symbols[p : p + depth].tolist()) for p in place[order]]
        for k in range(1, len(tail)):
            same = next((i for i, (x, y) in enumerate(zip(tail[k - 1], tail[k], strict=True)) if x != y), depth)
            assert common[k] == same
        first, leaves = suffix_tree.deep_nodes(common, depth)
        groups = Counter(tail)
        assert sorted(leaves.tolist()) == sorted(v for v in groups.values() if v > 1)
        assert all(groups[tail[f]] == n and len(set(tail[f : f + n])) == 1 for f, n in zip(first.tolist(), leaves.tolist(), strict=True))


def test_ranks_keep_the_order_of_the_strings(spark):
    """Ranks after each round are those of sorted strings; places with a unique rank are gone."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 600)
    rows = [(0, 0, 1, 0, i, *(int("".join(map(str, data[i + o : i + o + 3])), 2) for o in (0, 3, 6, 9))) for i in range(580)]
    windows = materialize(spark.createDataFrame(rows, "key long, clip long, c long, least long, o int, r0 long, r1 long, r2 long, r3 long"), "windows")
    got = suffix_array.doubled(windows, 2).select("o", "r0").collect()
    strings = {i: tuple(data[i : i + 12].tolist()) for i in range(580)}
    often = Counter(strings.values())
    assert {r["o"] for r in got} == {i for i, x in strings.items() if often[x] > 1}
    assert [r["o"] for r in sorted(got, key=lambda r: (r["r0"], r["o"]))] == sorted((r["o"] for r in got), key=lambda i: (strings[i], i))


def test_long_texts(spark, make_docs):
    """A text of 50 MB, a word of half a megabyte, repeated across documents."""
    rng = random.Random(6)
    long = " ".join(f"{rng.getrandbits(40):x}" for _ in range(5_000_000))
    giant = "z" * 600_000
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, long[:20_000_000] + " " + passage + " " + giant + " " + long[20_000_000:]), (3, f"new {giant} {passage} end")]
    docs = make_docs(spark, rows).repartition(3)
    words = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in suffix_tree.dedup_digests(docs).collect()}
    for i, text in rows:
        left = text if i == 1 else text.replace(passage + " ", "", 1)
        assert words[i] == (len(text.split()), 0 if i == 1 else 60, hashlib.sha256(left.encode()).hexdigest())
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_array.dedup_digests(docs).collect()}
    both = len(passage) + len(giant) + 3  # with the spaces around and between
    assert cut[2] == (len(rows[1][1]), both) and cut[3] == (len(rows[2][1]), both)


def test_empty_tables(spark, make_docs):
    assert suffix_tree.dedup_words(make_docs(spark, [])).count() == 0
    assert suffix_array.dedup_bytes(make_docs(spark, [])).count() == 0


def test_rows_in_rows_out_keeps_characters_whole(spark, make_docs):
    text = "é" * 200
    got = suffix_array.clean_documents(make_docs(spark, [(1, text + "x"), (2, "y" + text), (3, "clean"), (4, None)]))
    assert got.columns == make_docs(spark, []).columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {1: ("x", 1), 2: ("y", 1), 3: ("clean", 5), 4: (None, None)}


@pytest.mark.parametrize("step", ["clips", "windows"])
def test_an_arrow_batch_of_contents_takes_bounded_memory(spark, monkeypatch, step):
    """Clips and windows of a batch of 4 MB: the rows that its contents have a few at a time, and no arrays over the whole batch."""
    rng = np.random.default_rng(9)
    kind = suffix_array.BYTES
    n = rng.integers(60, 138, 13_000)
    at = np.append(0, np.cumsum(n - 1 + kind.window)).astype(np.int32)
    ids = pa.array(np.arange(len(n)))
    cols = {"n": pa.array(n.astype(np.int32)), "c": pa.array(np.ones(len(n), np.int64)), "least": pa.array(np.zeros(len(n), np.int64))}
    symbols = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(rng.integers(97, 122, at[-1]).astype(np.uint8))])
    monkeypatch.setattr(suffix_array, "map_arrow", lambda df, fn, schema: fn)
    if step == "clips":
        fn = suffix_array._clips(None, kind, suffix_array.PARTS)
        batch = pa.RecordBatch.from_pydict({"anchor": ids, "content": ids, "q": pa.array((n + 9).astype(np.int32)), **cols, "symbols": symbols})
    else:
        fn = suffix_array._windows(MagicMock(), MagicMock(), kind, suffix_array.ROUNDS)
        clips = pa.StructArray.from_arrays([ids, ids, pa.array(np.zeros(len(n), np.int32)), *cols.values()], ["key", "clip", "first", *cols])
        batch = pa.RecordBatch.from_pydict({"symbols": symbols, "clips": pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32), clips)})
    tracemalloc.start()
    for part in fn(batch):
        del part
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20

    def rows(size):
        whole = pa.Table.from_batches([x for i in range(0, 3000, size) for x in fn(batch.slice(i, size))])
        return whole.sort_by([(c, "ascending") for c in whole.column_names])

    assert rows(3000).equals(rows(100))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    kind = Kind(byte_symbols, np.uint8, 30, 8)
    text, s0, n, anchor, _, q = anchored(data, np.array([0, 1500, 3000]), kind)
    assert n.sum() == 2 * (1500 - 29)
    of = {}
    for t, s, k, a in zip(text, s0, n, anchor, strict=True):
        for j in range(s, s + k):
            window = data[t * 1500 + j : t * 1500 + j + 30].tobytes()
            assert of.setdefault(window, a) == a
    assert all(0 <= v and v - k + 1 >= 0 and v <= 22 for v, k in zip(q.tolist(), n.tolist(), strict=True))
