"""Point, batch and live scans of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node, tombstones included."""
    return nodes.where(F.col("id") == node_id)


def by_name(nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    return nodes.where(F.col("name") == name).orderBy("id").limit(limit)


def batch(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Nodes with the given ids; missing ids give nothing."""
    return nodes.where(F.col("id").isin(ids)) if ids else nodes.where("false")


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("deleted_at").isNull())


def file_hashes(nodes: DataFrame) -> DataFrame:
    return live(nodes).where((F.col("kind") == "file") & F.col("content_hash").isNotNull()).select("path", "content_hash")


def incident(edges: DataFrame, node_id: str, kind: str | None = None) -> DataFrame:
    touching = edges.where((F.col("from_id") == node_id) | (F.col("to_id") == node_id))
    return touching.where(F.col("kind") == kind) if kind else touching


def resolve_names(nodes: DataFrame) -> DataFrame:
    """name, id for names that exactly one node has."""
    return nodes.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")


def edge_exists(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """from_id, to_id, found for each asked pair."""
    have = edges.select("from_id", "to_id").distinct().withColumn("found", F.lit(True))
    return pairs.join(have, ["from_id", "to_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def project_catalogue(nodes: DataFrame) -> DataFrame:
    """Live nodes and last update of each project, the second part of ids."""
    return live(nodes).groupBy(F.split("id", ":")[1].alias("project")).agg(F.count("*").alias("n_nodes"), F.max("updated_at").alias("last_updated"))


def file_hash(nodes: DataFrame, path: str) -> DataFrame:
    """The hash of the first node of a path by id, tombstones included."""
    return nodes.where(F.col("path") == path).orderBy("id").limit(1).select("content_hash")


def has_key(metadata: Column, key: str) -> Column:
    """Whether JSON text holds a key, by its text as the store does."""
    return F.contains(metadata, F.lit(f'"{key}"'))


def json_int(metadata: Column, key: str) -> Column:
    return F.get_json_object(metadata, f"$.{key}").try_cast("int")
