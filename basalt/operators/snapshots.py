"""Changes between snapshots: keyed merges, file replacement, tombstones, change classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify_changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(file_path, change) from two tables of (file_path, content_sha, mtime_ns)."""
    old = stored.select("file_path", F.col("content_sha").alias("s0"), F.col("mtime_ns").alias("m0"))
    new = found.select("file_path", F.col("content_sha").alias("s1"), F.col("mtime_ns").alias("m1"))
    change = F.when(F.col("m0").isNull(), "new").when(F.col("m1").isNull(), "deleted").when(F.col("m0") == F.col("m1"), "unchanged").when(F.col("s0") == F.col("s1"), "mtime_only").otherwise("changed")
    return old.join(new, "file_path", "full_outer").select("file_path", change.alias("change"))


def removed_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    return stored.join(found, "file_path", "left_anti").select("file_path")


def merge_nodes(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Upsert by id: a summary is kept unless there is none; updated_at moves only with the content's hash."""
    a, b = old.select("id", F.struct("name", "path", "summary", "content_hash", "token_count", "updated_at").alias("o")), new.select("id", F.struct("name", "path", "summary", "content_hash", "token_count", "updated_at").alias("n"))
    rows = a.join(b, "id", "full_outer")
    has = F.col("n").isNotNull()
    pick = lambda c: F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    moved = F.col("o").isNull() | (has & F.col("n.content_hash").isNotNull() & ~F.col("n.content_hash").eqNullSafe(F.col("o.content_hash")))
    return rows.select("id", pick("name").alias("name"), pick("path").alias("path"), F.coalesce("o.summary", "n.summary").alias("summary"), pick("content_hash").alias("content_hash"), F.coalesce("n.token_count", "o.token_count").alias("token_count"), F.when(moved, F.lit(now)).otherwise(F.col("o.updated_at")).alias("updated_at"))


def replace_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of the new rows' paths are replaced; saved summaries come back where the new row has none."""
    kept = old.join(new.select("path").distinct(), "path", "left_anti")
    saved = old.where("summary_hash is not null").select("id", F.col("summary").alias("saved"))
    filled = new.join(saved, "id", "left").withColumn("summary", F.coalesce("summary", "saved")).drop("saved")
    return kept.unionByName(filled, allowMissingColumns=True)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (from_id, to_id, kind), the last written; of two new rows the greatest by all columns."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("from_id", "to_id", "kind").orderBy(F.desc("_seq"), F.desc(F.to_json(F.struct(*(c for c in both.columns if c != "_seq")))))
    return both.withColumn("_i", F.row_number().over(last)).where("_i = 1").drop("_i", "_seq")


def mark_deleted(nodes: DataFrame, path: str, now: int) -> DataFrame:
    hit = (F.col("path") == path) & F.col("deleted_at").isNull()
    return nodes.withColumn("deleted_at", F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("deleted_at")))


def purge_tombstones(nodes: DataFrame, now: int, days: int = 30) -> DataFrame:
    return nodes.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= now - days * 86400))


def store_summaries(nodes: DataFrame, updates: DataFrame, force: bool = False) -> DataFrame:
    """(id, outcome, summary) of updates (id, text): not_found, skipped (fresh summary there) or updated."""
    rows = updates.join(nodes.select("id", "summary", "summary_hash", "content_hash", F.lit(True).alias("there")), "id", "left")
    fresh = F.col("summary").isNotNull() & F.col("summary_hash").eqNullSafe(F.col("content_hash")) & F.lit(not force)
    outcome = F.when(F.col("there").isNull(), "not_found").when(fresh, "skipped").otherwise("updated")
    return rows.select("id", outcome.alias("outcome"), F.when(outcome == "updated", F.col("text")).otherwise(F.col("summary")).alias("summary"))


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    return tags.unionByName(new).dropDuplicates(["node_id", "tag"])


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, ["node_id", "tag"], "left_anti")


def tags_normalized(tags: DataFrame) -> DataFrame:
    return tags.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags_normalized"))


def export_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, json) rows of nodes and edges, each once."""
    n = nodes.dropDuplicates(["id"]).select(F.lit("node").alias("item"), F.to_json(F.struct("id", "kind", "name", "path")).alias("json"))
    e = edges.dropDuplicates(["from_id", "to_id", "kind"]).select(F.lit("edge").alias("item"), F.to_json(F.struct("from_id", "to_id", "kind")).alias("json"))
    return n.unionByName(e)
