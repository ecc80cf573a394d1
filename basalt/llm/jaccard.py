"""N-gram Jaccard join: size-aware, light sets by subsets, heavy sets by inverted lists.

A document is its set of word shingles; two link when their Jaccard similarity reaches the threshold.

* Equal sets are one node first, counted before the shuffle.
* Light sets enumerate subsets of a fixed size: for sizes s and t the overlap must reach a number c, so
  both share a subset of c shingles, and each emits its subsets of every c that a partner's size asks
  for. A set is light while that costs less than its inverted lists (`boundary`).
* Heavy sets are found through inverted lists. By default a list's key is a block of shingles: the sets
  of one band of sizes are split by hash into K = d + 1 + E blocks, where d bounds the symmetric
  difference of linked sets, so 1 + E blocks at least are equal; a block of few shingles, of which
  others hold the same by chance, is left out unless a set has more than E of them. With
  `scheme="prefix"` the keys are single shingles, the first of the set in a fixed order as far as linked
  sets must share one: fewer keys, for shingles so long that chance doesn't repeat them. The order is by
  hash, but shingles that many documents share come last (`common_shingles`), so a passage that stands
  in many documents is a key only of sets that have little else. Any order is exact.
* Lists with the same sets are one list. The sets of a list meet in one task (those of a very long list
  in tasks for each pair of its blocks), where parity bitmaps bound their differences from below; pairs
  that may still link join their sets to clusters. So sharing a passage doesn't make a cluster.
* A cluster's sets meet in one task, which counts all overlaps by a matrix product over the columns
  (shingles) that sets share, equal columns taken together; it gives back a spanning forest of the
  links. A cluster of more sets than a task may hold is dealt to tasks by pairs of blocks. Components
  of the links are found by star steps.

No link is lost: keys, clusters and counts are exact, and nothing is capped.

Defined results: letters A to Z count as small; words are runs of bytes other than space and 9 to 13; a
document with fewer words than a shingle has one shingle, all of them; one without words has none and
links with nothing; rows with the same doc_id are one document, linked by that; a row without
doc_id links with nothing and has no component; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import ceil, comb, exp, factorial, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import CHUNK_BYTES, MIX_A, MIX_B, MIX_C, SpanHasher, bound_batches, discard, map_arrow, materialize, mix, pair
from basalt.llm.components import components
from basalt.llm.repeats import _texts, word_pieces, word_spans

#: Sets of one cluster that a task holds; a larger cluster is dealt out by pairs of blocks of half of it.
CLUSTER = 3000
#: Sets of one list whose bitmaps (a kilobyte at most) a task holds; a longer list is dealt out by pairs of blocks of half of it.
BITMAPS = 8192
#: Bitmaps are compared in tiles of TILE x TILE; lists are held until they have so many rows.
TILE, HELD = 512, 8192
#: Shingles of so many documents are common; of hashes below SEEN / 2**64 the MOST_COMMON most common at most are put last.
COMMON, MOST_COMMON, SEEN = 16, 1 << 19, (1 << 64) // 3
#: Ratio of the largest to the smallest size of a band, and what one inverted-list key costs in subset keys.
BAND, LIST_COST = 1.4, 3.0
#: Place of a row without doc_id.
NO_ID = (1 << 63) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Join:
    """Words in a shingle, threshold `percent`, scheme of the lists, shingles of a block that isn't weak."""

    words: int = 3
    percent: int = 90
    scheme: str = "blocks"
    strong: int = 3

    def overlap(self, s: int, t: int) -> int:
        """Smallest overlap of linked sets of these sizes."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def largest(self, s: int) -> int:
        return 100 * s // self.percent

    def smallest(self, s: int) -> int:
        return -(-self.percent * s // 100)

    @cache
    def subset_sizes(self, s: int, upto: int) -> tuple[int, ...]:
        """Overlaps that a partner of at most `upto` shingles asks for, apart from an equal set."""
        pairs = range(self.smallest(s), min(self.largest(s), upto) + 1)
        return tuple(sorted({c for t in pairs if (c := self.overlap(s, t)) <= min(s, t) and not c == s == t}))

    @property
    @cache
    def boundary(self) -> int:
        """Largest size for which enumerating subsets costs less than the lists."""
        s = 1
        while sum(comb(s + 1, c) for c in self.subset_sizes(s + 1, s + 1 << 1)) <= LIST_COST * self.heavy_cost(s + 1):
            s += 1
        return s

    def heavy_cost(self, s: int) -> float:
        return s - self.smallest(s) + 1 if self.scheme == "prefix" else self.blocks(self.band(s))[0]

    @cache
    def band(self, s: int) -> int:
        return int(log(max(s, 1)) / log(BAND) + 1e-9)

    @cache
    def bands(self, s: int) -> tuple[int, ...]:
        """Own band, and the band below if linked sets may be there."""
        own = self.band(s)
        return (own, own - 1) if own and self.band(self.smallest(s)) < own else (own,)

    @cache
    def blocks(self, band: int) -> tuple[int, int]:
        """(K, E) for sets of a band and those of the next that link with them."""
        low, high = BAND**band, BAND ** (band + 1)
        most = int(min(high, 1e9)) + 1
        d = max((s + t - 2 * self.overlap(s, t) for s in (most, most - 1) for t in (self.largest(s), self.largest(s) - 1)), default=0)
        spare = 0
        while True:
            k = d + 1 + spare
            mean = max(low, 1) / k
            weak = k * sum(exp(-mean) * mean**i / factorial(i) for i in range(self.strong))
            if spare >= weak + 2 * sqrt(weak) or spare > d:
                return k, spare
            spare += 1


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of each text in hash order, end to end, and their bounds."""
    low = _LOWER[data]
    texts = len(bounds) - 1
    if len(data) > CHUNK_BYTES:  # one text, in pieces
        names = [x[2] for x in word_pieces(low)]
        name = np.concatenate(names) if names else np.zeros(0, np.uint64)
        own = np.array([0, len(name)])
    else:
        begin, end, own = word_spans(low, bounds)
        name = SpanHasher(low, MIX_C)(begin, end) if len(begin) else np.zeros(0, np.uint64)
    if not len(name):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    rolled = name
    for k in range(1, words):
        rolled = pair(rolled[: len(name) - k], name[k:])
    count = np.diff(own)
    number = np.maximum(count - words + 1, 0)
    text = np.repeat(np.arange(texts), number)
    at = np.repeat(own[:-1], number) + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    h = mix(rolled[at]) if len(at) else np.zeros(0, np.uint64)
    short = np.nonzero((count > 0) & (count < words))[0]
    if len(short):
        named = SpanHasher(name, MIX_B)
        text = np.append(text, short)
        h = np.append(h, mix(named(own[short], own[short + 1])))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    text, h = text[new], h[new]
    return h, np.searchsorted(text, np.arange(texts + 1))


def _block_keys(h: np.ndarray, bounds: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the equal-block scheme for heavy sets."""
    size = np.diff(bounds)
    texts, keys = [], []
    for which in (0, 1):
        chosen = [(i, bs[which]) for i, n in enumerate(size.tolist()) if n > join.boundary and len(bs := join.bands(n)) > which]
        if not chosen:
            continue
        who, band = np.array([i for i, _ in chosen]), np.array([b for _, b in chosen])
        k, spare = np.array([join.blocks(b) for b in band.tolist()]).T
        at = np.cumsum(k) - k
        n = size[who]
        owner = np.repeat(np.arange(len(who)), n)
        mine = h[np.repeat(bounds[who], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]
        block = at[owner] + ((mine >> np.uint64(20)) % k[owner].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(k.sum()), np.uint64)
        np.add.at(total, block, mix(mine + MIX_A))
        held = np.bincount(block, minlength=len(total))
        who_of = np.repeat(np.arange(len(who)), k)
        weak = held < join.strong
        few = np.bincount(who_of, weights=weak, minlength=len(who)) <= spare
        out = np.nonzero(~(weak & few[who_of]))[0]
        tag = (band[who_of[out]] << 32 | (out - at[who_of[out]])).astype(np.uint64)
        texts.append(who[who_of[out]])
        keys.append(mix(pair(total[out], tag) + held[out].astype(np.uint64)))
    return (np.concatenate(texts), np.concatenate(keys)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _prefix_keys(h: np.ndarray, bounds: np.ndarray, join: Join, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the first shingles of heavy sets; common ones (sorted names) are last in the order."""
    size = np.diff(bounds)
    if common is not None and len(common) and len(h):
        last = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = h[np.argsort(2 * np.repeat(np.arange(len(size)), size) + last, kind="stable")]
    n = np.where(size > join.boundary, size - -(-join.percent * size // 100) + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, h[np.repeat(bounds[:-1], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]


@cache
def _subset_rows(s: int, c: int) -> np.ndarray:
    """For each subset of c of s places, a row of the places left out."""
    return np.array(list(combinations(range(s), s - c)), np.int64).reshape(comb(s, c), s - c)


def _subset_keys(h: np.ndarray, bounds: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    size, x = np.diff(bounds), join.boundary
    texts, keys = [], []
    for s in np.unique(size[(size > 0) & (size <= join.largest(x))]).tolist():
        # a heavy set emits subsets only for light partners
        sizes = join.subset_sizes(s, join.largest(s) if s <= x else x)
        who = np.nonzero(size == s)[0]
        rows = mix(h[bounds[who][:, None] + np.arange(s)] + MIX_B)
        total = rows.sum(axis=1, dtype=np.uint64)
        for c in sizes:
            out = total[:, None] - rows[:, _subset_rows(s, c)].sum(axis=2, dtype=np.uint64)
            texts.append(np.repeat(who, out.shape[1]))
            keys.append(mix(pair(out.ravel(), np.full(out.size, c, np.uint64))))
    return (np.concatenate(texts), np.concatenate(keys)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


SETS = "doc_id long, th long, n int, h1 long, h2 long, keys array<long>, bits binary"
#: Largest bitmap of a set, in bits (a power of two).
MOST_BITS = 8192


def parity_bitmaps(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set one bit for each hash slot, whether an odd number of its shingles is there.

    Sets that differ in d shingles differ in at most d bits, whatever the number of slots.
    """
    size = np.diff(bounds)
    slots = np.where(size > 0, np.minimum(1 << np.ceil(np.log2(np.maximum(size, 64))).astype(np.int64), MOST_BITS), 0)
    base = np.cumsum(slots) - slots
    owner = np.repeat(np.arange(len(size)), size)
    at = base[owner] + ((h >> np.uint64(9)) & (slots[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(slots.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[b // 8 : (b + n) // 8] for b, n in zip(base.tolist(), slots.tolist(), strict=True)]


def folded(rows: np.ndarray, length: int) -> np.ndarray:
    """Bitmaps (a row each) of a smaller length: their parts are laid over each other."""
    return rows if rows.shape[1] == length else np.bitwise_xor.reduce(rows.reshape(len(rows), -1, length), axis=1)


def near_roots(n: np.ndarray, bitmaps: list[bytes], percent: int) -> np.ndarray:
    """For each of some sets the first one that it reaches through pairs whose bitmaps allow a link."""
    root = np.arange(len(n))
    order = np.argsort(n, kind="stable")
    sizes = np.array([len(bitmaps[i]) for i in order.tolist()])
    tiles = []  # in the order of size; bitmaps of a tile have one length
    for k in np.unique(sizes).tolist():
        same = order[sizes == k]
        for mine in (same[i : i + TILE] for i in range(0, len(same), TILE)):
            tiles.append((mine, np.frombuffer(b"".join(bitmaps[i] for i in mine.tolist()), np.uint8).reshape(len(mine), k)))
    signs = lambda rows: np.unpackbits(rows, axis=1).astype(np.float32) * 2 - 1
    for i, (mine, x) in enumerate(tiles):
        for theirs, y in tiles[i:]:
            if percent * n[theirs[0]] > 100 * n[mine[-1]]:
                break  # all further sets are too large to link with these
            if len(np.unique(root[np.concatenate([mine, theirs])])) == 1:
                continue
            length = min(x.shape[1], y.shape[1])
            differ = (8 * length - signs(folded(x, length)) @ signs(folded(y, length)).T) / 2
            both = n[mine][:, None] + n[theirs][None, :]
            least = -(-percent * both // (100 + percent))
            near = (differ <= both - 2 * least) & (least <= np.minimum(n[mine][:, None], n[theirs][None, :]))
            root = joined(root, mine, theirs, near)
    first = np.full(len(n), len(n))
    np.minimum.at(first, root, np.arange(len(n)))
    return first[root]


def near_pairs(n: np.ndarray, bitmaps: list[bytes], percent: int) -> np.ndarray:
    """Whether the bitmaps of rows 0 and 1, 2 and 3, and so on allow a link."""
    size = np.array([len(b) for b in bitmaps]).reshape(-1, 2)
    differ = np.zeros(len(size), np.int64)
    for small, large in np.unique(np.sort(size, axis=1), axis=0).tolist():
        who = np.flatnonzero((size.min(axis=1) == small) & (size.max(axis=1) == large))
        length = small
        total = np.zeros((len(who), length), np.uint8)
        for side in (0, 1):
            rows = [bitmaps[i] for i in (2 * who + side).tolist()]
            for k in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == k]
                total[at] ^= np.bitwise_xor.reduce(np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), -1, length), axis=1)
        differ[who] = np.bitwise_count(total).sum(axis=1)
    both = n[::2] + n[1::2]
    least = -(-percent * both // (100 + percent))
    return (differ <= both - 2 * least) & (least <= np.minimum(n[::2], n[1::2]))


def joined(root: np.ndarray, mine: np.ndarray, theirs: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Component labels after the links of a tile."""
    labels, index = np.unique(root, return_inverse=True)
    a, b = index[mine], index[theirs]
    rows, cols = np.unique(a), np.unique(b)
    some = np.zeros((len(rows), near.shape[1]), bool)
    np.logical_or.at(some, np.searchsorted(rows, a), near)
    link = np.zeros((len(rows), len(cols)), bool)
    np.logical_or.at(link.T, np.searchsorted(cols, b), some.T)
    parent = np.arange(len(labels))
    for i, r in enumerate(rows.tolist()):
        hit = cols[link[i]]
        if len(hit):
            olds = np.unique(parent[np.append(hit, r)])
            parent[np.isin(parent, olds)] = olds[0]
    return labels[parent[index]]


def common_shingles(keyed: DataFrame, join: Join, least: int, most: int) -> np.ndarray:
    """Sorted names of the shingles of at least `least` documents, of all texts, among hashes below SEEN.

    If there are more than `most`, the least is raised to the next power of two with no more; so what the
    driver and each task hold is bounded. Prefixes are about the lower fifth of a set's hashes.
    """

    def run(batch):
        seen = []
        for _, data, bounds in _texts(batch):
            h, _ = shingles(data, bounds, join.words)
            seen.append(h[h < np.uint64(SEEN)])
        name, count = np.unique(np.concatenate(seen), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(count.astype(np.int32))], ["h", "c"])

    counts = map_arrow(keyed.select("text"), run, "h long, c int").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    counts = materialize(counts.withColumn("power", F.floor(F.log2("c")).cast("int")), "common")
    total, power = 0, 64
    for r in sorted(counts.groupBy("power").count().collect(), reverse=True):  # a row for each power of two
        if total + r["count"] > most:
            break
        total, power = total + r["count"], r["power"]
    names = counts.where(F.col("power") >= power).select("h").toArrow().column("h").to_numpy()
    discard(counts)
    return np.sort(names.view(np.uint64))


def set_table(keyed: DataFrame, join: Join) -> DataFrame:
    """Size, 128-bit name and keys of each document's set."""
    common = common_shingles(keyed, join, COMMON, MOST_COMMON) if join.scheme == "prefix" else None

    def run(batch):
        for part, data, bounds in _texts(batch):
            h, own = shingles(data, bounds, join.words)
            size = np.diff(own)
            names = []
            for base in (MIX_A, MIX_C):
                sums = np.append(np.uint64(0), np.cumsum(mix(h + base), dtype=np.uint64))
                names.append((sums[own[1:]] - sums[own[:-1]]).view(np.int64))
            found = [_subset_keys(h, own, join), _block_keys(h, own, join) if common is None else _prefix_keys(h, own, join, common)]
            text, key = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(text, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[order], np.arange(len(size) + 1)).astype(np.int32)), pa.array(key[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(size.astype(np.int32)), pa.array(names[0]), pa.array(names[1]), lists, pa.array(parity_bitmaps(h, own), pa.binary())], ["doc_id", "th", "n", "h1", "h2", "keys", "bits"])

    return map_arrow(keyed, run, SETS)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _fetch(keyed: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """The shingles of each wanted (doc_id, th, node, tasks), a row for each task."""
    joined = keyed.join(wanted.hint("shuffle_hash"), ["doc_id", "th"]).select("node", "tasks", "text")

    def run(batch):
        for part, data, bounds in _texts(batch):
            h, own = shingles(data, bounds, join.words)
            sets = pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("tasks"), sets], ["node", "tasks", "shingles"])

    return map_arrow(joined, run, "node long, tasks array<long>, shingles array<long>").select("node", F.explode("tasks").alias("task"), "shingles")


def overlaps(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Overlap of every two of some sets; columns that only one set has are left out, equal ones are one."""
    g = len(bounds) - 1
    owner = np.repeat(np.arange(g), np.diff(bounds))
    unique, column = np.unique(h, return_inverse=True)
    tag = mix(np.arange(g, dtype=np.uint64) + MIX_A)
    pattern = np.zeros(len(unique), np.uint64)
    np.add.at(pattern, column, tag[owner])
    shared = np.bincount(column, minlength=len(unique)) > 1
    kind, first, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    of = np.full(len(unique), -1)
    of[np.nonzero(shared)[0][first]] = np.arange(len(kind))
    keep = of[column] >= 0
    row, col = owner[keep], of[column[keep]]
    out = np.zeros((g, g), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = max(256, (1 << 24) // max(g, 1))
    for c in range(0, len(kind), step):
        a, b = np.searchsorted(col, [c, c + step])
        x = np.zeros((g, min(step, len(kind) - c)), np.float32)
        x[row[a:b], col[a:b] - c] = 1
        out += (x * weight[c : c + step].astype(np.float32)) @ x.T
    return out


def linked(h: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """For each of some sets the first one of its component."""
    size = np.diff(bounds).astype(np.float64)
    both = overlaps(h, bounds)
    return reached(100 * both >= percent * (size[:, None] + size[None, :] - both))


def reached(link: np.ndarray) -> np.ndarray:
    """For each node of a matrix of links the first node of its component."""
    g = len(link)
    root = np.full(g, -1)
    for i in range(g):
        if root[i] < 0:
            root[i] = i
            front = [i]
            while front:
                near = np.nonzero(link[front].any(axis=0) & (root < 0))[0]
                root[near] = i
                front = near.tolist()
    return root


def _exact_roots(table: pa.Table, percent: int) -> np.ndarray:
    lists = table.column("shingles").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    h = lists.values.to_numpy()[bounds[0] : bounds[-1]].view(np.uint64)
    return linked(h, bounds - bounds[0], percent)


def _near_links(rows: DataFrame, percent: int) -> DataFrame:
    """Spanning forest (u, v) of the pairs whose bitmaps allow a link, inside each task's rows (task, node, n, bits)."""

    def links(table: pa.Table) -> pa.RecordBatch:
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        bits, task = table.column("bits").to_pylist(), table.column("task").to_numpy()
        begin = np.append(0, np.flatnonzero(task[1:] != task[:-1]) + 1)
        size = np.diff(np.append(begin, len(task)))
        two = (begin[size == 2][:, None] + np.arange(2)).ravel()
        u, v = [], []
        if len(two):
            hit = near_pairs(n[two], [bits[i] for i in two.tolist()], percent)
            u.append(node[two[1::2][hit]])
            v.append(node[two[::2][hit]])
        for b, k in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            root = near_roots(n[b : b + k], bits[b : b + k], percent)
            far = np.flatnonzero(root != np.arange(k))
            u.append(node[b + far])
            v.append(node[b + root[far]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (u, v)], ["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD:
                table = pa.Table.from_batches(held)
                task = table.column("task").to_numpy()
                cut = int(np.searchsorted(task, task[-1]))
                if cut:
                    yield links(table.slice(0, cut))
                    held, count = table.slice(cut).combine_chunks().to_batches(), len(task) - cut
        if count:
            yield links(pa.Table.from_batches(held))

    bound_batches(rows.sparkSession)
    return rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, "u long, v long")


def _task_forests(rows: DataFrame, roots, percent: int) -> DataFrame:
    """Spanning forest (u, v) inside each task's rows; roots(table, percent) has the first reached row of each."""

    def links(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks()
        node, root = table.column("node").to_numpy(), roots(table, percent)
        far = np.nonzero(root != np.arange(len(root)))[0]
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], ["u", "v"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            task = table.column("task").to_numpy()
            cuts = [0, *(np.nonzero(task[1:] != task[:-1])[0] + 1).tolist(), len(task)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = table.slice(a, b - a)
                if held and held[0].column("task")[0] != piece.column("task")[0]:
                    yield links(held)
                    held = []
                held.append(piece)
        if held:
            yield links(held)

    bound_batches(rows.sparkSession)
    return rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, "u long, v long")


def _pairs_of_blocks(group: str, size: str, most: int) -> Column:
    """Tasks of a row of a group: one if the group has at most `most` rows, else one for each pair of blocks of half of that."""
    blocks = F.when(F.col(size) <= most, 1).otherwise(F.ceil(F.col(size) / (most // 2))).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: (blocks == 1) | (x != block))
    return F.transform(others, lambda x: F.xxhash64(group, F.least(block, x), F.greatest(block, x)))


def _clusters(classes: DataFrame, places: DataFrame, join: Join) -> DataFrame:
    """(node, component) of the sets (node, keys) that may link with others, by lists and bitmaps."""
    postings = classes.select(F.explode("keys").alias("key"), "node")
    # written before the join: Spark splits a hot key's join only if no aggregate stands between it and the shuffle
    counted = postings.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("k > 1")
    lists = materialize(counted.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key", "k"), "lists")
    discard()
    members = materialize(postings.join(lists, "key"), "members")
    discard(lists)
    tasks = members.join(places.select("node", "n", "bits"), "node").select("node", "n", "bits", F.explode(_pairs_of_blocks("key", "k", BITMAPS)).alias("task"))
    links = materialize(_near_links(tasks, join.percent), "near")
    discard(members)
    found = components(links)
    discard(links)
    return found


def classes_and_links(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets: a row for each document; links (u, v) that span the components of doc_ids)."""
    keyed = _keyed(docs, id_col, text_col)
    keyed_sets = materialize(set_table(keyed, join), "sets")
    classes = materialize(keyed_sets.where(f"n > 0 and doc_id < {NO_ID}").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "n", "keys", "bits")).alias("one")).select("h1", "h2", F.col("one.doc_id").alias("node"), "one.th", "one.n", "one.keys", "one.bits"), "classes")
    sets = materialize(keyed_sets.drop("keys", "bits"), "sizes")
    discard(keyed_sets)
    equal = sets.where(f"n > 0 and doc_id < {NO_ID}").select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    equal = materialize(equal, "equal")
    places = materialize(classes.select("node", "th", "n", "bits"), "places")
    clusters = _clusters(classes, places, join)
    discard(classes)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    placed = clusters.join(sizes, "component").join(places.select("node", "th"), "node")
    wanted = placed.select(F.col("node").alias("doc_id"), "th", "node", _pairs_of_blocks("component", "size", CLUSTER).alias("tasks"))
    links = materialize(_task_forests(_fetch(keyed, wanted, join), _exact_roots, join.percent).unionByName(equal), "links")
    discard(clusters, places, equal)
    return sets, links


def near_duplicates(docs: DataFrame, join: Join | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    sets, links = classes_and_links(docs, join or Join(), id_col, text_col)
    found = components(links)
    rows = sets.select("doc_id", "n").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    out = materialize(rows.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real(F.coalesce("component", "doc_id")).alias("component_id")), "documents")
    discard(sets, links, found)
    return out
