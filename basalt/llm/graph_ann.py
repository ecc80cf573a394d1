"""Approximate nearest neighbours by inner product, with robust-pruned directed graphs.

Vectors are dealt to shards by hash. Each shard's graph is built in batches: greedy searches from entry
points propose neighbours of the new vectors, robust pruning keeps a proposed edge only if no kept one
is nearer to its end by the factor ALPHA (so edges stay diverse), and reverse edges are added and
pruned alike. A shard's index is one row of at most SHARD_BYTES of vectors. Queries are searched in every
shard by beam search, in blocks that stream past the index, so memory is bounded by one shard; the best
of all shards are merged.

Inner product becomes distance by one more component, sqrt(M^2 - |x|^2), which is zero for queries.
Equal vectors are one node with its smallest ids (as many as a query may return, and one more, since
a query leaves out its own row): no more of them can be in a result. Scores are inner products of the
original vectors in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors
meet only those of their own length; a row isn't its own neighbour; ties go to the smaller id; with fewer
candidates than k all are returned; a repeated row is a candidate for its other copy's query only if
its id differs; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import bound_batches, discard, materialize

DEGREE, SLACK, ALPHA = 32, 56, 1.2
FIRST_BEAM, BUILD_BEAM, SEARCH_BEAM, ENTRIES, BATCH = 32, 64, 140, 32, 512
#: Vectors in a shard: a 64th of all, at least LEAST_SHARD and at most SHARD_BYTES of them.
LEAST_SHARD, SHARD_BYTES = 8192, 64 << 20
#: Queries in a block.
BLOCK = 20_000

INDEX = "dim int, shard int, nodes long, scale double, ids array<array<long>>, vectors binary, edges binary, entries binary"


class Graph:
    """Vectors (one component longer than given), edges (padded with -1) and entry points."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.x, self.edges, self.entries = x, edges, entries

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of several queries at once: (nodes by distance, distances), -1 where there are fewer."""
        n, b = len(self.x), len(q)
        start = self.entries
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        first = ((q[:, None, :] - self.x[start][None]) ** 2).sum(axis=2)
        k = min(beam, len(start))
        order = np.argsort(first, axis=1)[:, :k]
        ids[:, :k], dist[:, :k] = start[order], np.take_along_axis(first, order, axis=1)
        done = ids < 0
        live = np.arange(b)
        norms = (self.x**2).sum(axis=1)
        for _ in range(4 * n):
            todo = ~done[live]
            more = todo.any(axis=1)
            live = live[more]
            if not len(live):
                break
            at = todo[more].argmax(axis=1)
            node = ids[live, at]
            done[live, at] = True
            near = np.sort(self.edges[node], axis=1)
            known = (near[:, :, None] == ids[live][:, None, :]).any(axis=2) | (near < 0)
            known[:, 1:] |= near[:, 1:] == near[:, :-1]
            safe = np.where(near < 0, 0, near)
            d = norms[safe] - 2 * np.einsum("brd,bd->br", self.x[safe], q[live]) + (q[live] ** 2).sum(axis=1)[:, None]
            d = np.where(known, np.inf, d).astype(np.float32)
            all_ids, all_d = np.concatenate([ids[live], near], axis=1), np.concatenate([dist[live], d], axis=1)
            all_done = np.concatenate([done[live], known], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_d, best, axis=1)
            gone = ~np.isfinite(dist[live])
            ids[live] = np.where(gone, -1, np.take_along_axis(all_ids, best, axis=1))
            done[live] = np.take_along_axis(all_done, best, axis=1) | gone
        return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to `degree` diverse neighbours of each point from its candidates (padded with -1)."""
    b, c = candidates.shape
    safe = np.where(candidates < 0, 0, candidates)
    v = x[safe]
    d = ((v - x[points][:, None, :]) ** 2).sum(axis=2)
    d[(candidates < 0) | (candidates == points[:, None])] = np.inf
    order = np.argsort(d, axis=1)
    candidates, v, d = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(v, order[:, :, None], axis=1), np.take_along_axis(d, order, axis=1)
    same = np.zeros_like(d, bool)
    same[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    d[same] = np.inf
    norm = (v**2).sum(axis=2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = np.isfinite(d)
    out = np.full((b, degree), -1, np.int64)
    rows = np.arange(b)
    for k in range(degree):
        at = alive.argmax(axis=1)
        has = alive[rows, at]
        if not has.any():
            break
        out[has, k] = candidates[rows, at][has]
        alive[rows, at] = False
        alive &= ~((alpha**2 * between[rows, at] <= d) & has[:, None])  # d and between are squares
    return out


def build(x: np.ndarray, seed: int = 7) -> Graph:
    """A graph over the rows of x; up to a few thousand start as a random graph, then all are inserted anew."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entries = np.unique(rng.choice(n, min(n, ENTRIES), replace=False))
    if n <= BATCH:
        return Graph(x, np.full((n, SLACK), -1, np.int64), np.arange(n))
    edges = np.full((n, SLACK), -1, np.int64)
    edges[:, : DEGREE // 2] = rng.integers(0, n, (n, DEGREE // 2))
    graph = Graph(x, edges, entries)
    for alpha, beam in ((1.0, FIRST_BEAM), (ALPHA, BUILD_BEAM)):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            points = order[i : i + BATCH]
            found, _ = graph.search(x[points], beam)
            kept = robust_prune(x, points, np.concatenate([found, edges[points]], axis=1), DEGREE, alpha)
            edges[points] = -1
            edges[points, :DEGREE] = kept
            _add_reverse(x, edges, points, kept, alpha)
    return graph


def _add_reverse(x, edges, points, kept, alpha):
    source = np.repeat(points, kept.shape[1])
    target = kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    fresh = ~(edges[target] == source[:, None]).any(axis=1)
    source, target = source[fresh], target[fresh]
    if not len(source):
        return
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    unique, first, count = np.unique(target, return_index=True, return_counts=True)
    most = int(count.max())
    new = np.full((len(unique), most), -1, np.int64)
    new[np.repeat(np.arange(len(unique)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    have = (edges[unique] >= 0).sum(axis=1)
    fits = have + count <= edges.shape[1]
    for j in range(most):
        rows = np.nonzero(fits & (count > j))[0]
        edges[unique[rows], have[rows] + j] = new[rows, j]
    full = np.nonzero(~fits)[0]
    for part in np.array_split(full, max(1, len(full) // 1024)):
        if len(part):
            pruned = robust_prune(x, unique[part], np.concatenate([edges[unique[part]], new[part]], axis=1), DEGREE, alpha)
            edges[unique[part]] = -1
            edges[unique[part], :DEGREE] = pruned


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components, not all zero."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda c: c != 0)


def lengthened(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors over the largest norm, in single precision, with the component that makes inner products distances."""
    unit = float(np.abs(vectors).max(initial=0)) or 1.0
    scaled = vectors / unit
    norm = (scaled**2).sum(axis=1)
    return np.concatenate([scaled, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], axis=1).astype(np.float32), unit


def shard_graph(vectors: np.ndarray) -> tuple[Graph, float]:
    x, unit = lengthened(vectors)
    return build(x), unit


def _build_shard(k: int):
    def run(table: pa.Table) -> pa.Table:
        vectors = np.array(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(table.num_rows, -1)
        order = np.argsort([x[0] for x in table.column("ids").to_pylist()], kind="stable")
        vectors, ids = vectors[order], table.column("ids").take(pa.array(order))
        graph, unit = shard_graph(vectors)
        return pa.table({
            "dim": pa.array([vectors.shape[1]], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "nodes": pa.array([len(vectors)], pa.int64()), "scale": pa.array([unit]),
            "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))), "vectors": pa.array([vectors.tobytes()], pa.binary()), "edges": pa.array([graph.edges.astype(np.int32).tobytes()], pa.binary()), "entries": pa.array([graph.entries.astype(np.int64).tobytes()], pa.binary()),
        })

    return run


def build_index(vectors: DataFrame, k: int, least_shard: int = LEAST_SHARD) -> DataFrame:
    """One row for each length and shard, from (vec_id, vector) of usable vectors."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    # no more than k + 1 of equal vectors can be in any result, counted before the shuffle
    classes = vectors.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes, "classes")
    counts = {r["dim"]: r["count"] for r in classes.groupBy(F.size("vector").alias("dim")).count().collect()}  # a row for each length
    shards = F.lit(1)
    for dim, n in counts.items():
        size = min(max(least_shard, n // 64), max(1, SHARD_BYTES // (8 * dim)))
        shards = F.when(F.size("vector") == dim, max(1, -(-n // size))).otherwise(shards)
    dealt = classes.withColumns({"dim": F.size("vector"), "shard": F.pmod(F.xxhash64(F.element_at("ids", 1)), shards).cast("int")})
    index = materialize(dealt.groupBy("dim", "shard").applyInArrow(_build_shard(k), INDEX), "index")
    discard(classes)
    return index


def _search_block(k: int):
    def run(batches):
        graph = vectors = None
        for batch in batches:
            out = []
            shard_rows = batch.column("edges").is_valid().to_numpy(zero_copy_only=False)
            i = 0
            while i < batch.num_rows:
                if shard_rows[i]:
                    r = batch.slice(i, 1)
                    n, unit = r.column("nodes")[0].as_py(), r.column("scale")[0].as_py()
                    vectors = np.frombuffer(r.column("vectors")[0].as_buffer(), np.float64).reshape(n, -1)
                    graph = Graph(lengthened(vectors)[0], np.frombuffer(r.column("edges")[0].as_buffer(), np.int32).astype(np.int64).reshape(n, -1), np.frombuffer(r.column("entries")[0].as_buffer(), np.int64))
                    ids = r.column("ids")[0].as_py()
                    i += 1
                    continue
                j = i
                while j < batch.num_rows and not shard_rows[j] and j - i < BATCH:
                    j += 1
                part = batch.slice(i, j - i)
                q = np.array(part.column("vector").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(j - i, -1)
                # a query's length doesn't change the order of its inner products
                near = (q / np.maximum(np.abs(q).max(axis=1, keepdims=True), 1e-300)).astype(np.float32)
                found, _ = graph.search(np.concatenate([near, np.zeros((len(q), 1), np.float32)], axis=1), min(SEARCH_BEAM, len(graph.x)))
                for query, row, nodes in zip(part.column("query").to_pylist(), q, found, strict=True):
                    nodes = nodes[nodes >= 0]
                    score = vectors[nodes] @ row
                    best = [(-s, v) for s, node in sorted(zip(-score, nodes.tolist(), strict=True))[: k + 1] for v in ids[node]]
                    best.sort(key=lambda t: (-t[0], t[1]))
                    out += [(query, v, s) for s, v in best[: k + 1]]
                i = j
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest rows found for each query (query, vector): query, vec_id, score, over all shards of its length."""
    blocks = max(1, -(-queries.count() // BLOCK))
    shards = index.select("dim", "shard")  # a row for each SHARD_BYTES of vectors, or fewer
    asked = queries.withColumns({"dim": F.size("vector"), "block": F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")})
    placed = asked.join(F.broadcast(shards), "dim") if _few(shards) else asked.join(shards, "dim")
    rows = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).unionByName(placed, allowMissingColumns=True)
    bound_batches(queries.sparkSession)
    found = rows.repartition(F.col("dim"), F.col("shard"), F.col("block")).sortWithinPartitions("dim", "shard", "block", F.col("edges").isNull()).mapInArrow(_search_block(k), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k + 1).drop("i")


def _few(shards: DataFrame) -> bool:
    """Whether the list of shards (12 bytes each) is small enough to broadcast."""
    return shards.count() <= 100_000


def nearest(rows: DataFrame, k: int = 20, query_modulus: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", least_shard: int = LEAST_SHARD) -> DataFrame:
    """query_id, rank, vec_id, score for rows whose id is divisible by `query_modulus`, among all other rows."""
    kept = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    kept = kept.dropDuplicates(["vec_id", "vector"])
    index = build_index(kept, k, least_shard)
    asked = kept.where(F.col("vec_id") % query_modulus == 0)
    distinct = materialize(asked.groupBy("vector").agg(F.min("vec_id").alias("query")), "queries")
    found = materialize(search(index, distinct, k), "found")
    discard(index)
    own = asked.join(distinct, "vector").select(F.col("vec_id").alias("query_id"), "query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = own.join(found, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return pairs.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
