"""From source files to a stored code graph, and from changed files to the next one.

Only new and changed files are parsed: their symbols and call sites replace those of the same paths in the
last store, and nodes, edges and tags follow from these two tables by joins. So a call into a file that did
not change is found as well as one within a changed file. Each phase is written before the next one reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.operators import enrich, structure, testlinks, writes
from basalt.sources import files as sources
from basalt.sources import parsers

TABLES = ("fingerprints", "heads", "symbols", "sites", "nodes", "edges", "tags")
CALLABLE = ("function", "method")


@dataclass
class Store:
    """The tables of an indexed project in a folder that driver and executors share."""

    spark: SparkSession
    root: str

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return getattr(self, name)


def texts(scanned: DataFrame) -> DataFrame:
    """path, language, text, content_sha, mtime_ns of scanned files; bytes that are no UTF-8 become marks."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return scanned.select("path", "language", text.alias("text"), F.sha2("content", 256).alias("content_sha"), (F.unix_micros("modified") * 1000).alias("mtime_ns"))


def symbol_id(project: str) -> Column:
    return F.when(F.col("kind") == "file", F.concat_ws(":", F.lit("file"), F.lit(project), "path")).otherwise(F.concat_ws(":", "kind", F.lit(project), "path", "symbol"))


def nodes_of(symbols: DataFrame, project: str, now: int) -> DataFrame:
    """Nodes of parsed symbols. Of symbols with one id (overloads) the first in the file is the node."""
    first = Window.partitionBy("id").orderBy("start_line", "end_line", "span_hash")
    one = symbols.withColumn("id", symbol_id(project)).withColumn("r", F.row_number().over(first)).where("r = 1")
    made = F.when(F.col("kind") != "file", enrich.auto_summary(F.col("kind"), F.col("name"), enrich.module_of(F.col("path")), F.col("doc")))
    level = F.when(F.col("kind").isin(*CALLABLE), enrich.complexity(F.coalesce("branches", F.lit(0)), F.coalesce("nesting", F.lit(0)), F.col("end_line") - F.col("start_line")))
    none = F.lit(None).cast("string")
    return one.select(
        "id", F.lit(project).alias("project"), "kind", "name", "path", "start_line", "end_line", "language", F.col("span_hash").alias("content_hash"), made.alias("summary"), none.alias("summary_hash"),
        F.when(made.isNotNull(), "auto").alias("summary_author"), none.alias("community_id"), level.alias("complexity"), F.col("notes").alias("language_notes"), F.get_json_object("metadata", "$.framework_hint").alias("framework_hint"),
        structure.layer(F.concat("path", F.lit("/"))).alias("layer"), "metadata", F.lit(now).cast("long").alias("updated_at"), F.lit(None).cast("long").alias("deleted_at"),
    )


def edges_of(symbols: DataFrame, sites: DataFrame, project: str) -> DataFrame:
    """CONTAINS edges from a file to the symbols that stand in nothing else, and CALLS edges of resolved calls."""
    named = symbols.withColumn("id", symbol_id(project))
    outer = named.where("kind <> 'file' and parent is null")
    contains = outer.select(F.concat_ws(":", F.lit("file"), F.lit(project), "path").alias("from_id"), F.col("id").alias("to_id"), F.lit("CONTAINS").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("context"), F.lit(False).alias("ambiguous")).distinct()
    ends = lambda role, *kinds: named.where(F.col("kind").isin(*kinds)).select(F.col("path").alias(f"{role}_path"), F.col("name").alias(role), F.col("start_line").alias(f"{role}_line"), F.col("id").alias(f"{role}_id")).distinct().hint("merge")
    calls = parsers.resolve_calls(sites, symbols).withColumnRenamed("path", "caller_path")
    calls = calls.join(ends("caller", *CALLABLE), ["caller_path", "caller", "caller_line"]).join(ends("callee", *CALLABLE, "class"), ["callee_path", "callee", "callee_line"])
    best = F.max_by(F.struct("context", "ambiguous"), F.struct("confidence", "context"))
    calls = calls.groupBy(F.col("caller_id").alias("from_id"), F.col("callee_id").alias("to_id")).agg(F.max("confidence").alias("confidence"), best.alias("best"))
    return contains.unionByName(calls.select("from_id", "to_id", F.lit("CALLS").alias("kind"), "confidence", "best.context", "best.ambiguous"))


def _tags(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, heads: DataFrame, project: str) -> DataFrame:
    """Tags by decorators, imports and folders, by links from tests, and by the graph."""
    rows = symbols.withColumn("id", symbol_id(project)).where("kind <> 'file'").select("id", "path", "decorators").join(heads.select("path", "imports"), "path", "left")
    system = lambda df: df.select(F.col("id").alias("node_id"), "tag", F.lit("system").alias("source"))
    tested = edges.where("kind = 'TESTED_BY'").select(F.col("to_id").alias("id"), F.when(F.col("confidence") >= enrich.TEST_HIGH, "tested").otherwise("partially-tested").alias("tag"))
    tags = system(enrich.auto_tags(rows)).unionByName(system(tested.distinct()))
    return structure.graph_tags(nodes, edges, tags).select("node_id", "tag", "source").distinct()


def _finish(store: Store, project: str, now: int, old: Store | None) -> Store:
    """Nodes, edges and tags of the store's symbols and call sites."""
    nodes = nodes_of(store.symbols, project, now)
    if old is not None:
        was = old.nodes
        kept = was.select("id", *(F.col(c).alias(f"was_{c}") for c in ("summary", "summary_hash", "summary_author", "content_hash", "updated_at", "deleted_at")))
        by_hand = F.col("was_summary").isNotNull() & ~F.col("was_summary_author").eqNullSafe(F.lit("auto"))
        same = F.col("was_content_hash").eqNullSafe(F.col("content_hash")) & F.col("was_deleted_at").isNull()
        pick = {c: F.when(by_hand, F.col(f"was_{c}")).otherwise(F.col(c)) for c in ("summary", "summary_hash", "summary_author")}
        joined = nodes.join(kept, "id", "left").withColumns(pick | {"updated_at": F.when(same, F.col("was_updated_at")).otherwise(F.col("updated_at"))})
        gone = was.join(nodes.select("id"), "id", "left_anti").withColumn("deleted_at", F.coalesce("deleted_at", F.lit(now).cast("long")))
        nodes = joined.select(*nodes.columns).unionByName(gone)
    nodes = store.put("nodes", nodes)
    live = nodes.where("deleted_at is null")
    edges = edges_of(store.symbols, store.sites, project)
    linked = testlinks.link_tests(live.join(store.heads.select("path", F.col("head").alias("text")), "path", "left"), edges)
    tests = linked.select(F.col("test_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("TESTED_BY").alias("kind"), F.col("score").alias("confidence"), F.lit(None).cast("string").alias("context"), F.lit(False).alias("ambiguous"))
    edges = store.put("edges", edges.unionByName(tests))
    store.put("tags", _tags(live, edges, store.symbols, store.heads, project))
    return store


def _heads(files: DataFrame) -> DataFrame:
    lines = F.slice(F.split("text", "\n"), 1, testlinks.HEAD_LINES)
    return files.select("path", F.array_join(lines, "\n").alias("head"), sources.import_lines(F.col("text")).alias("imports"))


def index(files: DataFrame, root: str, project: str, now: int, old: Store | None = None) -> Store:
    """Index files (path, language, text, content_sha, mtime_ns) into a folder; `old` is the store of the last time.

    With `old`, files of unchanged content are not parsed again, symbols of removed files become tombstones,
    summaries that an agent wrote stay. `root` must not be the folder of `old`. Null texts count as empty, an
    empty table gives empty tables; a path that comes twice is taken once.
    """
    if old is not None and old.root.rstrip("/") == root.rstrip("/"):
        raise ValueError("the new store needs a folder of its own")
    store = Store(files.sparkSession, root)
    files = files.withColumn("text", F.coalesce("text", F.lit(""))).dropDuplicates(["path"])
    seen = store.put("fingerprints", files.select(F.col("path").alias("file_path"), "content_sha", "mtime_ns"))
    fresh, stays = files, None
    if old is not None:
        changed = writes.changed_paths(old.fingerprints, seen).select(F.col("file_path").alias("path"))
        stays = seen.select(F.col("file_path").alias("path")).join(changed, "path", "left_anti")
        fresh = files.join(changed, "path", "left_semi")
    parts = {"heads": _heads(fresh), "symbols": parsers.parse_files(fresh), "sites": parsers.call_sites(fresh)}
    for name, rows in parts.items():
        store.put(name, rows if old is None else rows.unionByName(getattr(old, name).join(stays, "path", "left_semi")))
    return _finish(store, project, now, old)
