"""Keyed writes of the graph's side tables: edges, columns, fingerprints, visits, savings, key-value facts.

Each takes the stored table and a change and gives the new table, so a caller writes a snapshot. A null
key never matches; of two rows with one key in a change, the greatest counts (ties by all columns).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the last in the order; all columns decide a tie."""
    ranked = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order), *(F.desc(F.to_json(F.struct(*rows.columns))) for _ in (0,)))
    return rows.withColumn("_i", F.row_number().over(ranked)).where("_i = 1").drop("_i")


def put(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the change take the place of stored rows with their key."""
    fresh = last_by(new, keys)
    return old.join(fresh, keys, "left_anti").unionByName(fresh)


def remove(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys.distinct(), keys.columns, "left_anti")


def delete_edges_by_path(edges: DataFrame, path: str) -> DataFrame:
    """Edges of which neither end's id holds the path, whatever the case; % and _ are wildcards."""
    hit = F.col("from_id").ilike(f"%{path}%") | F.col("to_id").ilike(f"%{path}%")
    return edges.where(~F.coalesce(hit, F.lit(False)))


def merge_file(nodes: DataFrame, edges: DataFrame, tags: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A file's nodes, outgoing edges and system tags are replaced; edges from other files stay.

    `seq` orders the new rows: the first node of an id counts, the last edge of (from_id, to_id, kind);
    a new node without a summary takes the stored one.
    """
    gone = nodes.where(F.col("path") == path).select("id", F.col("summary").alias("saved"))
    first = Window.partitionBy("id").orderBy("seq")
    fresh = new_nodes.withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i", "seq").join(gone, "id", "left")
    fresh = fresh.withColumn("summary", F.coalesce("summary", "saved")).drop("saved")
    last = Window.partitionBy("from_id", "to_id", "kind").orderBy(F.desc("seq"))
    calls = new_edges.withColumn("_i", F.row_number().over(last)).where("_i = 1").drop("_i", "seq")
    ids = gone.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(calls.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti")
    system = tags.where("source = 'system'").join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select("node_id", "tag", "source")
    return (
        nodes.join(ids, "id", "left_anti").join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True),
        kept.unionByName(calls, allowMissingColumns=True),
        tags.join(system, ["node_id", "tag", "source"], "left_anti"),
    )


def update_columns(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Columns of the updates (by id) replace those of stored nodes; other nodes and columns stay."""
    names = [c for c in updates.columns if c != "id"]
    change = last_by(updates, ["id"]).select("id", F.struct(*names).alias("_new"))
    out = nodes.join(change, "id", "left")
    return out.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in nodes.columns))


def touch_fingerprints(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Times of files whose content is the same move to what was seen; contents don't."""
    new = seen.select("file_path", F.col("content_sha").alias("_s"), F.col("mtime_ns").alias("_m"))
    return stored.join(new, "file_path", "left").select("file_path", "content_sha", F.when(F.col("_s") == F.col("content_sha"), F.col("_m")).otherwise(F.col("mtime_ns")).alias("mtime_ns"))


def log_visits(visits: DataFrame, new: DataFrame) -> DataFrame:
    return visits.unionByName(new)


def prune_orphan_visits(visits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Visits of nodes that are there."""
    return visits.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def savings_counters(savings: DataFrame) -> DataFrame:
    """(name, value): tokens saved in all, hits, and tokens by the kind of summary; entries of no tokens don't count."""
    saved = savings.where("tokens_saved > 0")
    each = saved.select(F.explode(F.array(
        F.struct(F.lit("total_tokens_saved").alias("name"), F.col("tokens_saved").cast("long").alias("v")), F.struct(F.lit("total_hits").alias("name"), F.lit(1).cast("long").alias("v")),
        F.struct(F.concat(F.lit("tokens_saved_"), "summary_type").alias("name"), F.col("tokens_saved").cast("long").alias("v")),
    )).alias("e"))
    return each.groupBy("e.name").agg(F.sum("e.v").alias("value"))


def log_savings(counters: DataFrame, new: DataFrame) -> DataFrame:
    """Counters moved on by new entries."""
    return counters.unionByName(savings_counters(new)).groupBy("name").agg(F.sum("value").alias("value"))


def meta_get(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") == key).select("key", "value")


def fill_summaries(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """Made summaries (id, text) where a node has none, files and communities apart; (id, summary, filled)."""
    rows = nodes.join(last_by(made, ["id"]), "id", "left")
    fill = F.col("summary").isNull() & F.col("text").isNotNull() & ~F.col("kind").isin("file", "community")
    return rows.select("id", F.when(fill, F.col("text")).otherwise(F.col("summary")).alias("summary"), fill.alias("filled"))


def changed_paths(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files (file_path, content_sha) whose content differs from what is stored, or is new."""
    old = stored.select("file_path", "content_sha")
    return listed.join(old, ["file_path", "content_sha"], "left_anti").select("file_path")


def coupling_due(meta: DataFrame, commits: DataFrame) -> DataFrame:
    """One row, whether a commit (commit, ts) is newer than the one that coupling was last made for."""
    newest = commits.agg(F.max(F.struct("ts", "commit")).alias("c"))
    stored = meta_get(meta, "last_coupling_commit").agg(F.max("value").alias("value"))
    return newest.crossJoin(stored).select((F.col("c").isNotNull() & ~F.col("c.commit").cast("string").eqNullSafe(F.col("value"))).alias("due"))  # one row each


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
