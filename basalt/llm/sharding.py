"""Sharding by a minimax contiguous partition, in DataFrame operations only.

Atomic groups (rows of equal text) stand in the order of their text's SHA-256, and each shard is a
contiguous run of them. The smallest capacity that `shards` runs can hold is found by binary search;
a capacity is checked greedily: fill a run until the next group doesn't fit, cut there. The driver
holds only a histogram: sizes of cells of hash prefixes (65,536 at first). The cells in which a cut
may fall, which bounds on the capacity tell, are split into finer cells until each of them is a single
group; so the capacity and the cuts are exact for every number of groups. What a round sends to the
driver doesn't grow with the rows: at most 65,536 cells first, then 256 for each cell that is split. A group larger than an equal
share gets a shard of its own first, and the others are partitioned into the shards that are left.

Slots are counted within (shard, hash prefix, salt of the row) and moved on by the counts before, so
a group that holds a third of all rows is split.

Defined results: null text counts as empty; repeated rows get a slot each; with fewer groups than
shards the last shards are empty; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import materialize

#: Hexadecimal digits of the first cells, and digits added when a cell is split.
FIRST_DIGITS, MORE_DIGITS = 4, 2
#: A group is large if it has more than one part in so many of an equal share.
LARGE = 64
#: Salts of a row within its cell, for slots.
SALTS = 256


class Cells:
    """Sizes of contiguous cells of groups, by the hash prefix at which each begins."""

    def __init__(self, rows):
        self.rows = sorted(rows)  # (prefix, size, largest group, groups)
        self.before = [0]
        for _, size, _, _ in self.rows:
            self.before.append(self.before[-1] + size)
        self.total = self.before[-1]

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy: index of the first cell of each shard but the first; None if the shards don't suffice."""
        out, at = [], 0
        for _ in range(shards):
            nxt = bisect_right(self.before, self.before[at] + capacity) - 1
            if nxt == at and at < len(self.rows):
                return None
            at = nxt
            out.append(at)
        return out[:-1] if at == len(self.rows) else None

    def smallest_capacity(self, shards: int, low: int, high: int) -> int:
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, shards) is not None else (middle + 1, high)
        return low

    def could_hold(self, capacity: int, shards: int) -> bool:
        """Whether a capacity suffices if cells of several groups may be cut anywhere: if not, it doesn't for groups."""
        at = 0
        for _ in range(shards):
            at = min(at + capacity, self.total)
            i = bisect_right(self.before, at) - 1
            if i < len(self.rows) and self.rows[i][3] == 1:
                at = self.before[i]
        return at == self.total

    def bounds(self, shards: int) -> tuple[int, int]:
        """Bounds on the smallest capacity of the groups themselves, apart by a cell of several groups at most."""
        low, high = max([-(-self.total // shards), *(r[2] for r in self.rows)]), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.could_hold(middle, shards) else (middle + 1, high)
        return low, self.smallest_capacity(shards, low, max(self.total, low))

    def _large(self, shards: int) -> list[tuple[int, int]]:
        return [(at, at + r[1]) for at, r in zip(self.before, self.rows, strict=False) if r[3] == 1 and r[1] * LARGE * shards > self.total]

    def undecided(self, shards: int, low: int, high: int) -> list[str]:
        """Cells of several groups in which a cut may fall, for any capacity between the bounds.

        Only those of at least a quarter of the largest one's size: the others wait until the bounds are closer.
        The bounds differ by one such cell at most and each shard adds that to where its cut may fall, so these
        are of the order of shards x shards for each way around a large group, however many groups there are.
        """
        out, spans, large = {}, [(0, 0)], self._large(shards)
        for _ in range(shards - 1):
            reached = []
            for first, last in spans:
                floor = self.before[bisect_right(self.before, first + low) - 1]
                reached += _outside(large, floor, min(last + high, self.total))
            spans = []
            for first, last in sorted(reached):
                if spans and first <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
                else:
                    spans.append((first, last))
            for first, last in spans:
                i = bisect_right(self.before, first) - 1
                while i < len(self.rows) and self.before[i] < last:
                    if self.rows[i][3] > 1:
                        out[self.rows[i][0]] = self.rows[i][1]
                    i += 1
        most = max(out.values(), default=0)
        return sorted(k for k, size in out.items() if size * 4 >= most)


def _outside(large: list[tuple[int, int]], first: int, last: int) -> list[tuple[int, int]]:
    """The span of places without the insides of large groups: no cut falls there."""
    out = []
    for start, end in large:
        if first <= start < last:
            out.append((first, start))
            first = end
    return [*out, (first, last)] if first <= last else out


def refined(histogram: Callable[[list[str], int], list[tuple]], shards: int) -> Cells:
    """Cells that settle all cuts; `histogram` gives the cells of so many digits within the prefixes (all if none)."""
    cells = Cells(histogram([], FIRST_DIGITS))
    while split := cells.undecided(shards, *cells.bounds(shards)):
        gone = set(split)
        rows = [r for r in cells.rows if r[0] not in gone]
        for digits in sorted({len(p) for p in split}):
            rows += histogram([p for p in split if len(p) == digits], digits + MORE_DIGITS)
        cells = Cells(rows)
    return cells


def _histogram(groups: DataFrame, digits: int) -> list[tuple]:
    key = F.substring("key", 1, digits).alias("prefix")
    return [tuple(r) for r in groups.groupBy(key).agg(F.sum("size").cast("long"), F.max("size").cast("long"), F.count("*")).collect()]


def partition_groups(groups: DataFrame, shards: int) -> tuple[list[str], list[str], int]:
    """(keys of groups with a shard of their own, prefix at which each next shard begins, capacity)."""
    largest = groups.orderBy(F.desc("size"), "key").limit(shards).collect()
    total, left, own = groups.agg(F.sum("size")).first()[0] or 0, shards, []
    for r in largest:
        if left > 1 and r["size"] * left > total:
            own.append(r["key"])
            total, left = total - r["size"], left - 1
    rest = groups.where(~F.col("key").isin(own)) if own else groups
    within = lambda prefixes: rest.where(F.substring("key", 1, len(prefixes[0])).isin(prefixes)) if prefixes else rest
    cells = refined(lambda prefixes, digits: _histogram(within(prefixes), digits), left)
    capacity = cells.smallest_capacity(left, *cells.bounds(left))
    cuts = cells.cuts(capacity, left) or []
    return own, [cells.rows[i][0] if i < len(cells.rows) else "~" for i in cuts], capacity


def _shard(own: list[str], begins: list[str]) -> Column:
    """Shards of contiguous runs come first, then those of single groups."""
    run = reduce(lambda x, b: x + (F.col("key") >= b).cast("int"), begins, F.lit(0))
    return reduce(lambda x, kv: F.when(F.col("key") == kv[1], len(begins) + 1 + kv[0]).otherwise(x), enumerate(own), run)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of each row; sizes are bytes of the text plus 1, groups are rows of equal text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key"))
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    own, begins, _ = partition_groups(groups, shards)
    placed = rows.withColumn("shard", _shard(own, begins)).withColumns({"cell": F.substring("key", 1, 2), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))})
    part = ["shard", "cell", "salt"]
    # at most 256 x SALTS rows, and as many again where a cut divides a cell
    counts = placed.groupBy(*part).count()
    before = counts.select(*part, (F.sum("count").over(Window.partitionBy("shard").orderBy("cell", "salt")) - F.col("count")).alias("before"))
    within = Window.partitionBy(*part).orderBy("doc_id", "key")
    slots = placed.withColumn("at", F.row_number().over(within)).join(F.broadcast(before), part)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
