"""Traversal and counting over directed edges: one join for each level, no recursion in SQL.

Each level's frontier is checkpointed, so a level is joined once, however deep a walk goes. A walk that
asks for least depths only leaves out what it has seen. Every level reads the edges again, so what is
costly to make should be written first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.plans.lineage import checkpointed

#: Levels that a request may ask for.
MOST_LEVELS = 10
#: Rows of a frontier up to which every task gets it whole, so that the edges stay where they are.
SENT_ROWS = 100_000


def _levels(n: int) -> int:
    return max(1, min(n, MOST_LEVELS))


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): a step from a to b in the direction asked; an edge of two kinds is two rows."""
    out = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    back = edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def _sent(frontier: DataFrame) -> DataFrame:
    """The frontier, broadcast if it is small; it must be cheap to read."""
    return F.broadcast(frontier) if frontier.limit(SENT_ROWS + 1).count() <= SENT_ROWS else frontier


def levels(edges: DataFrame, start: str, depth: int, direction: str) -> DataFrame:
    """(id, depth): every node and every depth up to `depth` at which a walk reaches it."""
    steps = _directed(edges, direction)
    frontier = checkpointed(steps.where(F.col("a") == start).select(F.col("b").alias("id")).distinct())
    out = [frontier.withColumn("depth", F.lit(1))]
    for d in range(2, _levels(depth) + 1):
        frontier = checkpointed(steps.join(_sent(frontier), F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct())
        out.append(frontier.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, out)


def distances(edges: DataFrame, start: str, depth: int, direction: str, goal: str | None = None) -> DataFrame:
    """(id, depth) of the nodes within `depth` steps, start at 0, by breadth-first search; it ends early at a goal."""
    steps = _directed(edges, direction)
    seen = steps.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    frontier = seen
    for d in range(1, _levels(depth) + 1):
        reached = steps.join(_sent(frontier.select("id")), F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = checkpointed(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if goal is not None and not frontier.where(F.col("id") == goal).isEmpty():
            break
    return seen


def neighbors(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, direction: str = "in", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Live nodes within `depth` steps over edges of some kinds (all by default), without the start; tombstoned nodes are walked through."""
    kept = edges.where(F.col("kind").isin(*kinds)) if kinds is not None else edges
    near = distances(kept, start, depth, direction).where("depth > 0")
    return nodes.where(F.col("deleted_at").isNull()).join(_sent(near), "id").select("id", "kind", "name", "path", "depth")


def blast_radius_paths(edges: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """(id, depth) of all transitive callers; a node at two depths is two rows."""
    return levels(edges, start, depth, "in").where(F.col("id") != start)


def blast_radius(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """Live transitive callers with their least depth."""
    return neighbors(nodes, edges, start, depth, "in")


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, limit))


def shortest_path_length(edges: DataFrame, start: str, goal: str, most: int = MOST_LEVELS) -> DataFrame:
    """One row with the number of steps from start to goal, none if it isn't reached within `most`."""
    return distances(edges, start, most, "out", goal).where((F.col("id") == goal) & (F.col("depth") > 0)).select(F.col("depth").alias("length"))


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = MOST_LEVELS) -> DataFrame:
    """(step, id) of a shortest path over calls, the least in the order of its ids; no rows if there is none."""
    calls = edges.where("kind = 'CALLS'")
    left = checkpointed(distances(calls, goal, most, "in", start))  # steps that are left to the goal
    steps, here, path = _directed(calls, "out"), start, [start]
    first = left.where(F.col("id") == start).first()
    for d in range(first["depth"] - 1, -1, -1) if first else ():
        here = steps.where(F.col("a") == here).join(left.where(F.col("depth") == d), F.col("b") == F.col("id")).agg(F.min("b")).first()[0]
        path.append(here)
    return edges.sparkSession.createDataFrame(list(enumerate(path)) if first else [], "step int, id string")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of calls, from one aggregation over both ends."""
    calls = edges.where(F.col("kind") == "CALLS")
    ends = calls.select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") == "CALLS").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("in_degree"))


def god_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Live nodes with the most callers."""
    alive = nodes.where(F.col("deleted_at").isNull())
    alive = alive.where(F.col("kind").isin(*kinds)) if kinds else alive
    return in_degree(edges).join(alive, "id").select("id", "kind", "name", "path", "in_degree").orderBy(F.desc("in_degree"), "id").limit(limit)


def callers(nodes: DataFrame, edges: DataFrame, node_id: str, path: str | None = None, limit: int = 10) -> DataFrame:
    """Callers of a node: those of its own file first, then by their own callers."""
    calls = edges.where((F.col("kind") == "CALLS") & (F.col("to_id") == node_id)).select(F.col("from_id").alias("id"))
    own = nodes.where(F.col("id") == node_id).select(F.col("path").alias("own_path"))
    theirs = edges.where("kind = 'CALLS'").join(calls.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
    rows = calls.join(nodes, "id").join(in_degree(theirs), "id", "left").crossJoin(F.broadcast(own))  # one row
    same = (F.col("path") == F.col("own_path")).cast("int")
    return rows.select("id", "name", "path", same.alias("same_file"), F.coalesce("in_degree", F.lit(0)).alias("in_degree")).orderBy(F.desc("same_file"), F.desc("in_degree"), "id").limit(limit)


def callees(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 10) -> DataFrame:
    """What a node calls: nodes of its own file first."""
    calls = edges.where((F.col("kind") == "CALLS") & (F.col("from_id") == node_id)).select(F.col("to_id").alias("id"))
    own = nodes.where(F.col("id") == node_id).select(F.col("path").alias("own_path"))
    same = (F.col("path") == F.col("own_path")).cast("int")
    return calls.join(nodes, "id").crossJoin(F.broadcast(own)).select("id", "name", "path", same.alias("same_file")).orderBy(F.desc("same_file"), "id").limit(limit)  # one row


def members(nodes: DataFrame, contains: DataFrame, node_id: str, limit: int = 20) -> DataFrame:
    held = contains.where((F.col("kind") == "CONTAINS") & (F.col("from_id") == node_id)).select(F.col("to_id").alias("id"))
    return held.join(nodes, "id").select("id", "kind", "name").orderBy("id").limit(limit)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n): live nodes and edges of each kind."""
    n = nodes.where(F.col("deleted_at").isNull()).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("part"), "kind", "n")
    return n.unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edges").alias("part"), "kind", "n"))
