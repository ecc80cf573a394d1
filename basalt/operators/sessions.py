"""Sessions, visits, savings, changes since a time, context and primer facts, work plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators.traversal import in_degree

# Directories that are no module names.
PLAIN_DIRECTORIES = ("src", "lib", "app", "pkg")
#: Changed nodes up to which a delta lists them.
LISTED_CHANGES = 100


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """The newest session of each agent."""
    newest = Window.partitionBy("agent_id").orderBy(F.desc("started_at"), F.desc("id"))
    return sessions.withColumn("i", F.row_number().over(newest)).where("i = 1").drop("i")


def prune_sessions(sessions: DataFrame, visits: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The `keep` newest sessions of each agent, and their visits."""
    newest = Window.partitionBy("agent_id").orderBy(F.desc("started_at"), F.desc("id"))
    kept = sessions.withColumn("i", F.row_number().over(newest)).where(F.col("i") <= keep).drop("i")
    return kept, visits.join(kept.select(F.col("id").alias("session_id")), "session_id", "left_semi")


def is_gap() -> Column:
    """Whether a node's summary is missing or older than its source."""
    return F.col("summary_hash").isNull() | (F.col("content_hash").isNotNull() & (F.col("summary_hash") != F.col("content_hash")))


def unannotated_reads(visits: DataFrame, nodes: DataFrame, session_id: str) -> DataFrame:
    seen = visits.where(F.col("session_id") == session_id).groupBy(F.col("node_id").alias("id")).agg(F.max("visited_at").alias("last_visit"), F.max("tool").alias("tool"))
    return seen.join(nodes.where(F.col("deleted_at").isNull() & is_gap()), "id").select("id", "name", "last_visit", "tool")


def annotation_gaps(visits: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    seen = visits.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("visits"))
    return seen.join(nodes.where(F.col("deleted_at").isNull() & is_gap()), "id").select("id", "name", "visits").orderBy(F.desc("visits"), "id").limit(limit)


def savings_totals(savings: DataFrame) -> DataFrame:
    saved = savings.where("tokens_saved > 0")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("summary_type") == kind, F.col("tokens_saved"))), F.lit(0))
    return saved.agg(F.count("*").alias("hits"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens"), of("agent").alias("agent_tokens"), of("auto").alias("auto_tokens"))


def savings_recent(savings: DataFrame, limit: int = 10) -> DataFrame:
    return savings.where("tokens_saved > 0").orderBy(F.desc("ts"), "node_id").limit(limit)


def delta(nodes: DataFrame, since: int) -> DataFrame:
    """One row: changed, deleted and unchanged nodes since a time, and whether the changes are too many to list."""
    alive, plain = F.col("deleted_at").isNull(), ~F.col("kind").isin("file", "community")
    changed = F.count_if(alive & plain & (F.col("updated_at") > since))
    return nodes.agg(changed.alias("changed"), F.count_if(F.col("deleted_at") > since).alias("deleted"), F.count_if(alive & plain & (F.col("updated_at") <= since)).alias("unchanged"), (changed > LISTED_CHANGES).alias("too_many"))


def delta_top_paths(nodes: DataFrame, since: int, limit: int = 5) -> DataFrame:
    changed = nodes.where(F.col("deleted_at").isNull() & (F.col("updated_at") > since))
    return changed.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(limit)


def delta_rows(nodes: DataFrame, since: int) -> DataFrame:
    stale = F.coalesce(F.col("summary_hash") != F.col("content_hash"), F.lit(False))
    return nodes.where(F.col("deleted_at").isNull() & (F.col("updated_at") > since) & ~F.col("kind").isin("file", "community")).select("id", "name", stale.alias("stale"))


def age_text(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds)
    return F.when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60), F.lit("m"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h"))).otherwise(F.concat(F.floor(s / 86400), F.lit("d")))


def age_days(seconds: Column) -> Column:
    """Whole days, less than none for a time to come, null for no time."""
    return F.concat(F.floor(seconds / 86400), F.lit("d"))


def module_of(path: Column) -> Column:
    """First directory of a path that isn't a plain one, else its first part."""
    parts = F.split(path, "/")
    own = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.isin(*PLAIN_DIRECTORIES))
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.element_at(parts, 1))


def primer_counts(nodes: DataFrame) -> DataFrame:
    alive = nodes.where("deleted_at is null")
    return alive.agg(F.count("*").alias("n_nodes"), F.countDistinct("path").alias("n_paths"), F.countDistinct("language").alias("n_languages"), F.count("summary").alias("n_summaries"), F.max("updated_at").alias("last_updated"))


def primer_modules(nodes: DataFrame, limit: int = 8) -> DataFrame:
    alive = nodes.where(F.col("deleted_at").isNull() & F.col("kind").isin("function", "method", "class"))
    return alive.groupBy(module_of(F.col("path")).alias("module")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(limit)


def entry_points(nodes: DataFrame, patterns: tuple[str, ...], limit: int = 5) -> DataFrame:
    """Names of live functions that fit one of the LIKE patterns, whatever their case."""
    from functools import reduce

    hit = reduce(lambda a, b: a | b, (F.col("name").ilike(p) for p in patterns))
    return nodes.where(F.col("deleted_at").isNull() & F.col("kind").isin("function", "method") & hit).select("name").distinct().orderBy("name").limit(limit)


def module_detail(nodes: DataFrame, edges: DataFrame, module: str, limit: int = 10) -> DataFrame:
    inside = nodes.where(F.col("deleted_at").isNull() & F.col("path").like(f"%/{module}/%"))
    rows = inside.join(in_degree(edges), "id", "left").select("id", "name", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.substring("summary", 1, 60).alias("summary"))
    return rows.orderBy(F.desc("in_degree"), "id").limit(limit)


def work_plan(nodes: DataFrame, visits: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: what to do next, and the counts that tell."""
    functions = F.col("deleted_at").isNull() & F.col("kind").isin("function", "method", "class")
    facts = nodes.agg(F.count_if(functions).alias("n"), F.count_if(functions & F.col("summary").isNotNull()).alias("annotated"))
    gaps = annotation_gaps(visits, nodes, 1 << 30).agg(F.count("*").alias("gaps"))
    asked = questions.agg(F.count("*").alias("questions"))
    coverage = F.when(F.col("n") > 0, F.bround(F.col("annotated") / F.col("n"), 2)).otherwise(1.0)
    step = F.when(F.col("gaps") > 0, "document").when(F.col("questions") > 0, "investigate").when(coverage < 1.0, "explore").otherwise("nothing")
    return facts.crossJoin(gaps).crossJoin(asked).select(step.alias("step"), "gaps", "questions", coverage.alias("coverage"))


def context_packet(nodes: DataFrame, edges: DataFrame, tags: DataFrame, node_id: str, now: int) -> DataFrame:
    """One row of facts on a live node: degrees, tags, staleness, age and what to do about it."""
    own = nodes.where((F.col("id") == node_id) & F.col("deleted_at").isNull())
    calls = edges.where("kind = 'CALLS'")
    callers = calls.where(F.col("to_id") == node_id).agg(F.count("*").alias("n_callers"))
    callees = calls.where(F.col("from_id") == node_id).agg(F.count("*").alias("n_callees"))
    named = tags.where(F.col("node_id") == node_id).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    stale = F.coalesce(F.col("summary_hash") != F.col("content_hash"), F.lit(False))
    advice = F.when(stale, "read again").when(F.col("summary_author").isNull() & (F.col("n_callers") > 5), "write a summary").when(F.lit(now) - F.col("updated_at") > 48 * 3600, "index again").otherwise("none")
    return own.crossJoin(callers).crossJoin(callees).crossJoin(named).select("id", "name", "path", "n_callers", "n_callees", "tags", stale.alias("stale"), age_text(F.lit(now) - F.col("updated_at")).alias("age"), advice.alias("advice"))
