"""Chat windows and sharding against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from basalt.llm import chat, sharding

ODD = ["", None, "\\### Assistant: </turn> ok", "a\\h<b>#c:\\c", "</turn>\n### user: x", "é漢🙂 " * 30, "x" * 500]


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(8)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", None, "to:ol"])
            rows.append((c, t, role, rng.choice(ODD)))
    return rows + [(None, 0, "user", "n"), (99, 1, "assistant", "b"), (99, 1, "assistant", "b"), (99, None, "user", "a")]


def turns_of(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v, key=lambda k: (k[0], k[1] or 0, k[2], k[3]))] for c, v in by.items()}


@pytest.mark.parametrize("budget, history", [(2048, 512), (90, 30), (20, 0), (300, 290)])
def test_windows_read_back(spark, conversations, budget, history):
    table = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("windows", F.lit("x"))
    formatted = chat.format_conversations(table, budget, history)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for c, turns in turns_of(conversations).items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert list(got[c]["loss"]) == [x for r, x in turns if r == "assistant"]
    for r in formatted.collect():
        turns = turns_of(conversations)[r["conv_id"]]
        cost = lambda x: -(-len(x.encode()) // 4) + chat.TURN_TOKENS
        at = 0
        for w in r["windows"]:
            shown = w["text"].count(chat.END)
            new = turns[at : at + shown - w["repeated"]]
            at += len(new)
            assert new
            total = sum(cost(x) for _, x in new)
            assert len(new) == 1 or total <= budget
            if w["repeated"] and turns[0][0] == "system":
                assert w["text"].startswith("### system: ")
        assert at == len(turns)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.read_back(chat.format_conversations(empty))).count() == 0


def smallest(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        cap = (low + high) // 2
        used, room = 1, cap
        for s in sizes:
            if s > room:
                used, room = used + 1, cap
            room -= s
        low, high = (low, cap) if used <= shards else (cap + 1, high)
    return low


@pytest.mark.parametrize("shards, docs", [(4, 300), (16, 2000), (5, 3)])
def test_shards_are_the_smallest_possible(spark, make_docs, shards, docs):
    rng = random.Random(docs)
    rows = [(k, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))) for k in range(docs)] + [(10**6, None), (10**6, None)]
    got = sharding.shard_documents(make_docs(spark, rows), shards).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes"
    where = {}
    for (i, t), _ in zip(rows, rows, strict=True):
        where.setdefault((t or ""), set()).update(r["shard"] for r in got if r["doc_id"] == i and r["text_crc32"] == zlib.crc32((t or "").encode()))
    assert all(len(v) == 1 for v in where.values())
    sizes = {t: (len(t.encode()) + 1) * len(v) for t, v in texts.items()}
    order = [sizes[t] for t in sorted(sizes, key=lambda t: hashlib.sha256(t.encode()).hexdigest())]
    if max(order) * shards <= sum(order):
        assert max(sum(r["size"] for r in v) for v in by.values()) == smallest(order, shards)


def test_a_giant_group_has_its_own_shard(spark, make_docs):
    rows = [(k, "same text") for k in range(300)] + [(1000 + k, f"text {k}") for k in range(100)]
    got = sharding.shard_documents(make_docs(spark, rows), 4).collect()
    giant = {r["shard"] for r in got if r["doc_id"] < 1000}
    assert len(giant) == 1 and not giant & {r["shard"] for r in got if r["doc_id"] >= 1000} and len({r["shard"] for r in got}) == 4
    assert sharding.shard_documents(make_docs(spark, []), 4).count() == 0


@pytest.mark.parametrize("large", [[], [0.05], [0.06, 0.05, 0.05, 0.03], [0.01] * 40])
def test_cells_give_the_smallest_capacity_and_few_are_fetched(large):
    """Against a greedy search over the groups themselves; cells fetched after the first don't grow with the groups."""
    rng, shards = random.Random(len(large)), 16
    sizes = [rng.choice([1, 40, 300, rng.randint(1, 5000)]) for _ in range(120_000)]
    sizes += [int(sum(sizes) * share) for share in large]
    groups = sorted((hashlib.sha256(str(k).encode()).hexdigest(), n) for k, n in enumerate(sizes))
    asked = []

    def histogram(prefixes, digits):
        wanted, cells = set(prefixes), {}
        for key, n in groups:
            if not wanted or key[: digits - sharding.MORE_DIGITS] in wanted:
                size, most, count = cells.get(key[:digits], (0, 0, 0))
                cells[key[:digits]] = (size + n, max(most, n), count + 1)
        asked.append(len(cells))
        return [(k, *v) for k, v in cells.items()]

    cells = sharding.refined(histogram, shards)

    def fits(capacity):
        used, filled = 1, 0
        for _, n in groups:
            if filled + n > capacity:
                used, filled = used + 1, 0
            filled += n
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    assert cells.smallest_capacity(shards, *cells.bounds(shards)) == low
    assert sum(asked[1:]) < 4 * shards * shards and len(asked) < 12
