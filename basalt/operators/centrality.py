"""Betweenness and communities.

Betweenness (exact) deals out source nodes; each task holds the adjacency, runs breadth-first searches
from its sources, and the partial sums are added. A node limit can be given. Communities are found by
Louvain moves until none gains, a task for each connected component, or by a fixed number of passes of
joins and aggregations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.plans.lineage import checkpointed

#: Nodes below which betweenness is computed, if no other limit is given.
NODE_LIMIT = 2000


def _undirected(edges: DataFrame) -> DataFrame:
    pairs = edges.where("from_id <> to_id").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def betweenness(nodes: DataFrame, edges: DataFrame, limit: int | None = NODE_LIMIT) -> DataFrame:
    """(id, score) normalized to 0 to 1; no rows below 3 nodes, or from `limit` nodes on if there is a limit."""
    ids = nodes.select("id").distinct()
    count = (ids.limit(limit) if limit else ids).count()
    if count < 3 or limit and count >= limit:
        return nodes.select("id", F.lit(0.0).alias("score")).where("false")
    names = np.sort(ids.toArrow().column("id").to_numpy(zero_copy_only=False))
    spark = nodes.sparkSession
    named = spark.createDataFrame(pd.DataFrame({"k": range(count), "id": names}), "k int, id string")
    key = lambda end: named.select(F.col("id").alias(end), F.col("k").alias(f"{end}_k"))
    # numbers, each pair once, are all that the driver gets of the edges
    ends = _undirected(edges).where("a < b").join(key("a"), "a").join(key("b"), "b").select("a_k", "b_k").toArrow()
    order, first, near, low = _by_component(*(ends.column(c).to_numpy() for c in ("a_k", "b_k")), count)
    high = np.append(low[1:], count)
    scale = (count - 1) * (count - 2)

    def run(batches):
        total = np.zeros(count)
        for batch in batches:
            for s in batch["k"]:
                part = np.searchsorted(low, s, "right") - 1
                at, end = low[part], high[part]
                if end - at > 2:
                    total[at:end] += _leans(first[at : end + 1] - first[at], near[first[at] : first[end]] - at, int(s - at))
        yield pd.DataFrame({"k": order, "part": total})

    parts = spark.range(count).select(F.col("id").alias("k")).repartition(max(8, spark.sparkContext.defaultParallelism)).mapInPandas(run, "k int, part double")
    return parts.groupBy("k").agg((F.sum("part") / scale).alias("score")).join(named, "k").select("id", F.round("score", 9).alias("score"))


def _adjacency(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each of `count` nodes: those of v are near[first[v] : first[v + 1]]."""
    tail, head = np.append(a, b), np.append(b, a).astype(np.int32)
    return np.append(0, np.cumsum(np.bincount(tail, minlength=count))), head[np.argsort(tail, kind="stable")]


def _by_component(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in an order in which connected components stand together, the neighbours by their places, and each component's first place."""
    label = np.arange(count)
    while True:
        # the roots of an edge's two ends become the lower of them, then all nodes take their root
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := label[label]) != label).any():
            label = up
    order = np.argsort(label, kind="stable")
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    first, near = _adjacency(place[a], place[b], count)
    return order, first, near, np.unique(label[order], return_index=True)[1]


def _leans(first: np.ndarray, near: np.ndarray, s: int) -> np.ndarray:
    """Share of the shortest paths from `s` through each node; the neighbours of v are near[first[v] : first[v + 1]].

    A level is found from the side that has fewer edges: from the last level's nodes or from those not reached yet.
    """
    count = len(first) - 1
    many = np.diff(first)
    far, paths, lean, level, steps = np.zeros(count, np.int32), np.zeros(count), np.zeros(count), np.array([s]), []
    far[s], paths[s], rest, depth = 1, 1, None, 1  # far: 1 + the steps from s
    left = int(many.sum()) - int(many[s])
    while len(level) and left:
        if rest is None and many[level].sum() > left:
            rest = np.flatnonzero((far == 0) & (many > 0))
        elif rest is not None:
            rest = rest[far[rest] == 0]
        back = rest is not None
        ends = rest if back else level
        k = many[ends]
        v = np.repeat(ends, k)
        w = near[np.arange(len(v)) + np.repeat(first[ends] - np.cumsum(k) + k, k)]
        kept = far[w] == (depth if back else 0)
        v, w = (w[kept], v[kept]) if back else (v[kept], w[kept])
        found = np.bincount(w, paths[v], count)
        level = np.flatnonzero(found)
        depth += 1
        far[level] = depth
        left -= int(many[level].sum())
        # a level's numbers of paths are kept relative to its largest, so they stay finite
        most = found[level].max(initial=1)
        paths[level] = found[level] / most
        steps.append((v, w, most))
    for v, w, most in reversed(steps):
        lean += np.bincount(v, paths[v] / (paths[w] * most) * (1 + lean[w]), count)
    lean[s] = 0
    return lean


def _local_moves(pairs: DataFrame, rounds: int) -> DataFrame:
    """(id, label) after rounds of moves to the neighbour label of largest modularity gain.

    pairs: (a, b, w), both directions, w > 0. Half of the nodes (by hash) move in each round, so two
    neighbours don't swap labels forever.
    """
    degree = pairs.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    labels = degree.select("id", F.col("id").alias("label"))
    all_ = degree.agg(F.sum("k").alias("m2"))
    best = Window.partitionBy("a").orderBy(F.desc("gain"), "label")
    for i in range(rounds):
        total = labels.join(degree, "id").groupBy("label").agg(F.sum("k").alias("tot"))
        links = pairs.join(labels.withColumnRenamed("id", "b"), "b").where("a <> b").groupBy("a", "label").agg(F.sum("w").alias("to_label"))
        stay = labels.select(F.col("id").alias("a"), "label", F.lit(0.0).alias("none"))
        votes = links.join(stay, ["a", "label"], "full_outer").select("a", "label", F.coalesce("to_label", F.lit(0.0)).alias("to_label"))
        own = labels.select(F.col("id").alias("a"), F.col("label").alias("own")).join(degree.select(F.col("id").alias("a"), "k"), "a")
        rest = F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0)  # without the node itself
        scored = votes.join(own, "a").join(total, "label").crossJoin(F.broadcast(all_)).withColumn("gain", F.round(F.col("to_label") - F.col("k") * rest / F.col("m2"), 9))
        top = scored.withColumn("i", F.row_number().over(best)).where("i = 1").select(F.col("a").alias("id"), F.col("label").alias("better"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        labels = labels.join(top, "id").select("id", F.when(turn, F.col("better")).otherwise(F.col("label")).alias("label"))
        labels = checkpointed(labels)
    return labels


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 6, passes: int = 2) -> DataFrame:
    """(id, community_id, size) by Louvain passes: local moves, then the same over the graph of communities."""
    pairs = checkpointed(_undirected(edges).select("a", "b", F.lit(1.0).alias("w")))
    member = nodes.select("id", F.col("id").alias("label")).distinct()
    for _ in range(passes):
        moved = _local_moves(pairs, rounds)
        member = member.join(moved.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left").select("id", F.coalesce("next", "label").alias("label"))
        side = lambda end: moved.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))  # noqa: B023, E731
        pairs = checkpointed(pairs.join(side("a"), "a").join(side("b"), "b").groupBy(F.col("a_label").alias("a"), F.col("b_label").alias("b")).agg(F.sum("w").alias("w")))
    size = member.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    return member.join(size, "label").select("id", F.concat(F.lit("community:"), "first").alias("community_id"), "size")


def _components(pairs: DataFrame) -> DataFrame:
    """(id, label) with the least id of each connected component; pairs in both directions."""
    labels = pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label"))
    while True:
        near = pairs.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("other"))
        low = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        up = low.select(F.col("id").alias("label"), F.col("label").alias("up"))
        labels = checkpointed(low.join(up, "label").select("id", "old", F.least("label", "up").alias("label")))
        if labels.where("old <> label").isEmpty():
            return labels.select("id", "label")
        labels = labels.select("id", "label")


def _settle(near: list[dict[int, float]], degree: list[float], label: list[int], m2: float) -> bool:
    """Moves nodes to the neighbour label (or a label of their own) of largest modularity gain until no move gains."""
    total, size, any_moved, moved = [0.0] * len(label), [0] * len(label), False, True
    for v, c in enumerate(label):
        total[c], size[c] = total[c] + degree[v], size[c] + 1
    free = [c for c, n in enumerate(size) if not n]
    while moved:
        moved = False
        for v, links in enumerate(near):
            own, k, to = label[v], degree[v], {}
            for u, w in links.items():
                to[label[u]] = to.get(label[u], 0.0) + w
            total[own] -= k
            best, most = own, to.pop(own, 0.0) - k * total[own] / m2 + 1e-9
            for c, w in to.items():
                gain = w - k * total[c] / m2
                if gain > most:
                    best, most = c, gain
            if most < 0 and size[own] > 1:
                best = free.pop()
            total[best] += k
            if best != own:
                label[v], moved, any_moved = best, True, True
                size[own], size[best] = size[own] - 1, size[best] + 1
                if not size[own]:
                    free.append(own)
    return any_moved


def _communities_of(near: list[dict[int, float]], m2: float) -> list[int]:
    """Labels by Louvain: nodes move, then whole communities, until neither a node's nor a community's move gains."""
    degree, label = [sum(links.values()) for links in near], list(range(len(near)))
    while True:
        _settle(near, degree, label, m2)
        group = {c: i for i, c in enumerate(dict.fromkeys(label))}
        label = [group[c] for c in label]
        wide: list[dict[int, float]] = [{} for _ in group]
        weight = [0.0] * len(group)
        for v, links in enumerate(near):
            weight[label[v]] += degree[v]
            for u, w in links.items():
                if label[u] != label[v]:
                    wide[label[v]][label[u]] = wide[label[v]].get(label[u], 0.0) + w
        joined = list(range(len(group)))
        if not _settle(wide, weight, joined, m2):
            return label
        label = [joined[c] for c in label]


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community_id, size) by Louvain until no move gains; a task holds a connected component."""
    pairs = checkpointed(_undirected(edges).select("a", "b"))
    m2 = float(pairs.count())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])
        codes, names = pd.factorize(rows["a"], sort=True)
        near: list[dict[int, float]] = [{} for _ in names]
        for a, b in zip(codes.tolist(), names.get_indexer(rows["b"]).tolist(), strict=True):
            near[a][b] = 1.0
        return pd.DataFrame({"id": names, "label": _communities_of(near, m2)}).assign(label=lambda d: d.groupby("label")["id"].transform("min"))

    parts = _components(pairs).select(F.col("id").alias("a"), F.col("label").alias("part"))
    tasks = max(8, nodes.sparkSession.sparkContext.defaultParallelism) * 8  # a number of their own, so components aren't put together
    moved = checkpointed(pairs.join(parts, "a").repartition(tasks, "part").groupBy("part").applyInPandas(lambda d: run(d[["a", "b"]]), "id string, label string"))
    member = nodes.select("id").distinct().join(moved, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    size = member.groupBy("label").agg(F.count("*").alias("size"))
    return member.join(size, "label").select("id", F.concat(F.lit("community:"), "label").alias("community_id"), "size")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row with the modularity of a partition."""
    pairs = _undirected(edges)
    m = membership.select("id", "community_id")
    inner = pairs.join(m.select(F.col("id").alias("a"), F.col("community_id").alias("ca")), "a").join(m.select(F.col("id").alias("b"), F.col("community_id").alias("cb")), "b")
    sides = inner.groupBy("ca").agg(F.count_if(F.col("ca") == F.col("cb")).alias("inside"), F.count("*").alias("degree"))
    total = sides.agg(F.sum("degree").alias("all"))
    return sides.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("inside") / F.col("all") - F.pow(F.col("degree") / F.col("all"), 2)), 6).alias("modularity"))
