"""Best-fit packing of documents into sequences of a fixed number of tokens.

Method: pattern packing by non-negative least squares. Only the histogram of piece lengths (one row
for each length up to the capacity, so bounded) reaches the driver. There, patterns of up to three
lengths that fill a sequence are enumerated over coarse bins, repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left over is packed
best-fit-decreasing into the free space of the patterns and into new sequences. The result is a table
of intervals: the i-th piece of a length goes to this sequence at this place. Pieces get their i by
counting within (length, salt), so a length that holds a third of all pieces is split.

Defined results: a null or empty text is the end token alone; a text is cut only if it is longer than
a sequence; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm import vocab
from basalt.llm.common import map_arrow, materialize, text_chunks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task counts at a time.
COUNTED_PIECES = 200_000

Plan = list[tuple[tuple[int, ...], int]]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares with x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    slack = 1e-9 * max(1.0, np.abs(target).max(initial=0))
    for _ in range(rounds):
        w = target - gram @ x
        w[passive] = -np.inf
        j = int(w.argmax()) if n else 0
        if not n or w[j] <= slack:
            break
        passive[j] = True
        while True:
            on = np.nonzero(passive)[0]
            z = np.zeros(n)
            z[on] = np.linalg.lstsq(gram[np.ix_(on, on)], target[on], rcond=None)[0]
            if (z[on] > 0).all():
                x = z
                break
            low = on[z[on] <= 0]
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            passive[(x <= 1e-12) & passive] = False
            x[~passive] = 0
    return x


def patterns(bins: int) -> list[tuple[int, ...]]:
    """Bins (by upper edge, 1 to `bins`) of up to three documents that fill `bins` exactly."""
    two = [(a, bins - a) for a in range(1, bins // 2 + 1)]
    three = [(a, b, bins - a - b) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    return two + three


def pack_histogram(counts: dict[int, int], capacity: int, width: int = 32) -> Plan:
    """(lengths in a sequence, number of such sequences) for `counts` pieces of each length."""
    plan: Plan = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    left = {n: c for n, c in counts.items() if 0 < n < capacity and c > 0}
    bins = max(1, capacity // width)
    of_bin = defaultdict(list)
    for n in sorted(left):
        of_bin[-(-n // width)].append(n)  # the longest last, taken first
    full = np.zeros(bins + 1)
    for k, lengths in of_bin.items():
        full[min(k, bins)] += sum(left[n] for n in lengths)
    columns = [p for p in patterns(bins) if all(full[k] for k in p)]
    if columns:
        a = np.zeros((bins + 1, len(columns)))
        for j, p in enumerate(columns):
            for k in p:
                a[k, j] += 1
        for p, x in zip(columns, nnls(a, full), strict=True):
            plan += _take(p, int(x), of_bin, left)
    return plan[: bool(counts.get(capacity))] + _best_fit(plan[bool(counts.get(capacity)) :], left, capacity)


def _take(pattern: tuple[int, ...], repeats: int, of_bin: dict, left: dict[int, int]) -> Plan:
    """Up to `repeats` sequences of a pattern, in runs of equal lengths."""
    out: Plan = []
    while repeats:
        for k in set(pattern):
            while of_bin[k] and not left.get(of_bin[k][-1]):
                of_bin[k].pop()
        if not all(of_bin[k] for k in pattern):
            break
        lengths = [of_bin[k][-1] for k in pattern]
        times = min([repeats, *(left[n] // lengths.count(n) for n in lengths)])
        if not times:  # one piece left of a length that is needed twice: next longest instead
            need: dict[int, int] = defaultdict(int)
            lengths = []
            for k in pattern:
                n = next((n for n in reversed(of_bin[k]) if left[n] > need[n]), None)
                if n is None:
                    return out
                need[n] += 1
                lengths.append(n)
            times = 1
        for n in lengths:
            left[n] -= times
        out.append((tuple(lengths), times))
        repeats -= times
    return out


def _best_fit(open_: Plan, left: dict[int, int], capacity: int) -> Plan:
    """Put what is left, longest first, where least space stays free; else open sequences."""
    by_space: dict[int, list] = defaultdict(list)
    for lengths, times in open_:
        by_space[capacity - sum(lengths)].append((lengths, times))
    spaces = sorted(by_space)

    def add(lengths, times):
        space = capacity - sum(lengths)
        if not by_space[space]:
            i = bisect_left(spaces, space)
            if i == len(spaces) or spaces[i] != space:
                insort(spaces, space)
        by_space[space].append((lengths, times))

    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            i = bisect_left(spaces, n)
            if i < len(spaces):
                space = spaces[i]
                lengths, times = by_space[space].pop()
                if not by_space[space]:
                    spaces.pop(i)
                used = min(c, times)
                if times > used:
                    add(lengths, times - used)
                add((*lengths, n), used)
                c -= used
            else:
                fit = capacity // n
                if c >= fit:
                    add((n,) * fit, c // fit)
                if c % fit:
                    add((n,) * (c % fit), 1)
                c = 0
    return [x for same in by_space.values() for x in same]


def intervals(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first piece, last piece, sequence of the first, offset): piece i goes to sequence + (i - first)."""
    out, used, sequence = [], defaultdict(int), 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            out.append((n, used[n], used[n] + times - 1, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize each text, append the end token and cut what is longer than a sequence."""

    def run(batch):
        encode = vocab.word_encoder(path)
        doc_ids = batch.column("doc_id").to_pylist()
        for b, e, texts in text_chunks(batch.column("text"), vocab.TOKEN_CHUNK):
            rows = []
            for doc_id, ids in zip(doc_ids[b:e], encode(texts), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, PIECES)


def pack(pieces_: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (as `pieces` makes it; read several times)."""
    spark = pieces_.sparkSession
    counts = {r["length"]: r["count"] for r in pieces_.groupBy("length").count().collect()}  # a row for each length
    plan = intervals(pack_histogram(counts, capacity))
    salts = F.broadcast(spark.createDataFrame([(n, -(-c // COUNTED_PIECES)) for n, c in counts.items()], "length long, salts long"))
    plan_rows = F.broadcast(spark.createDataFrame(plan, "length long, first long, last long, sequence long, offset long"))
    salted = pieces_.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    # at most a row for each length and for each COUNTED_PIECES pieces
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("i", F.row_number().over(within)).join(F.broadcast(before), ["length", "salt"]).withColumn("i", F.col("i") + F.col("before") - 1)
    return (
        numbered.join(plan_rows, "length")
        .where("i between first and last")
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("i") - F.col("first")).alias("sequence_id"), "offset")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack documents. `path` is a `tokenizers` file."""
    return pack(materialize(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)
