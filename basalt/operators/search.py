"""Full-text search: postings, BM25, tags, fallback search, ranking and confidence.

Postings are a table (term, id, positions) that a caller keeps; a query joins a few terms of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators.traversal import in_degree

#: Fixed values of the ranking: k1, b, and the idf of a term that half of the rows have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def parse(query: str) -> tuple[list[str], str]:
    """(tags in order, rest of the text) of a query such as `tag:auth login`."""
    tags = list(dict.fromkeys(re.findall(r"\btag:(\S+)", query)))
    return tags, " ".join(re.sub(r"\btag:\S+", " ", query).split())


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(rows: DataFrame, text: Column, stem=None) -> DataFrame:
    """(id, length, term, tf, positions); `stem` is a function of a column of words, if any."""
    words = rows.select("id", terms(text).alias("words"))
    words = words.withColumn("words", stem(F.col("words"))) if stem else words
    each = words.select("id", F.size("words").alias("length"), F.posexplode("words").alias("pos", "term"))
    return each.groupBy("id", "length", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(rows: DataFrame, text: Column) -> DataFrame:
    """One row: number of rows and mean length."""
    return rows.select(F.size(terms(text)).alias("length")).agg(F.count("*").alias("rows"), F.avg("length").alias("mean"))


def bm25(posted: DataFrame, corpus: DataFrame, words: list[str], mode: str = "and", without: list[str] | None = None) -> DataFrame:
    """(id, score) of rows with all ("and") or any ("or") of the words and none of `without`."""
    hits = posted.where(F.col("term").isin(words))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word
    idf = F.ln((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus)).withColumn("idf", F.when(idf <= 0, LEAST_IDF).otherwise(idf))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("found"))
    out = out.where(F.col("found") == len(set(words))) if mode == "and" else out
    if without:
        out = out.join(posted.where(F.col("term").isin(without)).select("id").distinct(), "id", "left_anti")
    return out.drop("found")


def phrase(posted: DataFrame, words: list[str]) -> DataFrame:
    """Ids of rows in which the words follow each other."""
    first = posted.where(F.col("term") == words[0]).select("id", F.col("positions").alias("starts"))
    for k, word in enumerate(words[1:], 1):
        other = posted.where(F.col("term") == word).select("id", F.transform("positions", lambda p: p - k).alias("shifted"))
        first = first.join(other, "id").select("id", F.array_intersect("starts", "shifted").alias("starts"))
    return first.where(F.size("starts") > 0).select("id", F.size("starts").alias("occurrences"))


def having_tags(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids that have all of the tags."""
    hits = tags.where(F.col("tag").isin(wanted))
    return hits.groupBy(F.col("node_id").alias("id")).agg(F.countDistinct("tag").alias("k")).where(F.col("k") == len(set(wanted))).select("id")


def tag_search(nodes: DataFrame, tags: DataFrame, wanted: list[str], limit: int = 10) -> DataFrame:
    alive = nodes.where(F.col("deleted_at").isNull())
    return alive.join(having_tags(tags, wanted), "id", "left_semi").select("id", "name", F.lit(1.0).alias("score")).orderBy("id").limit(limit)


def like_search(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Live nodes whose name or summary holds the text, whatever the case; ordered by id."""
    pattern = f"%{text}%"
    hit = F.col("name").ilike(pattern) | F.coalesce(F.col("summary").ilike(pattern), F.lit(False))
    return nodes.where(F.col("deleted_at").isNull() & hit).select("id", "name").orderBy("id").limit(limit)


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return F.contains(low, F.lit("/test")) | F.startswith(low, F.lit("test"))


def reranked(scored: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The best rows; after the cut, those of tests count three tenths."""
    top = scored.join(nodes.where(F.col("deleted_at").isNull()), "id").orderBy(F.desc("score"), "id").limit(limit)
    return top.select("id", "name", "path", F.round(F.when(is_test_path(F.col("path")), F.col("score") * 0.3).otherwise(F.col("score")), 6).alias("score")).orderBy(F.desc("score"), "id")


def confidence(scored: DataFrame, nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """Composite score, level and signals of each hit."""
    q = query.lower()
    best = scored.agg(F.max("score").alias("best"))
    rows = scored.join(nodes, "id").join(in_degree(edges), "id", "left").crossJoin(F.broadcast(best))
    norm = F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0)
    checks = {"exact_name_match": F.lower("name") == q, "high_bm25": norm >= 0.7, "has_agent_summary": F.coalesce(F.col("summary_author") == "agent", F.lit(False)), "hot_node": F.coalesce("in_degree", F.lit(0)) > 5, "path_match": F.contains(F.lower("path"), F.lit(q))}
    weight = {"exact_name_match": 0.40, "has_agent_summary": 0.15, "hot_node": 0.12, "path_match": 0.08}
    composite = F.round(sum((F.when(checks[k], w).otherwise(0.0) for k, w in weight.items()), 0.25 * norm), 6)
    signals = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items()))), ",")
    return rows.select("id", composite.alias("composite"), F.when(composite >= 0.65, "high").when(composite >= 0.35, "medium").otherwise("low").alias("confidence"), signals.alias("signals"))


def replacement_candidates(nodes: DataFrame, edges: DataFrame, node_ids: DataFrame, most: int = 3) -> DataFrame:
    """(dead_id, id, in_degree, rank): called live functions of the same file, most called first."""
    called = in_degree(edges).join(nodes.where(F.col("deleted_at").isNull() & F.col("kind").isin("function", "method")), "id").select("id", "path", "in_degree")
    best = Window.partitionBy("path").orderBy(F.desc("in_degree"), "id")
    # one more than asked for, since a node isn't its own replacement; so a file has few rows before the join
    few = called.withColumn("i", F.row_number().over(best)).where(F.col("i") <= most + 1).drop("i")
    rank = Window.partitionBy("dead_id").orderBy(F.desc("in_degree"), "id")
    pairs = node_ids.join(nodes, "id").select(F.col("id").alias("dead_id"), "path").join(few, "path").where("id <> dead_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most).select("dead_id", "id", "in_degree", "rank")


def searchable(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Nodes with `body`, the text of the four searched columns: name, summary, path, tags in order."""
    named = tags.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("named"))
    return nodes.join(named, "id", "left").withColumn("body", F.concat_ws(" ", "name", "summary", "path", "named")).drop("named")


def facade(nodes: DataFrame, tags: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, name, score, caller_count) of live nodes for a query of tags and words; words are all asked for.

    Tags alone score 1; a query that isn't only words (`a/b`, `x-y`) is looked up as it stands.
    """
    wanted, text = parse(query)
    if re.search(r"[^\w\s]", text):
        hits = like_search(nodes, query if not wanted else text, limit).select("id", F.lit(1.0).alias("score"))
    elif text:
        rows = searchable(nodes, tags)
        hits = bm25(postings(rows, F.col("body")), lengths(rows, F.col("body")), text.lower().split())
    else:
        hits = nodes.select("id", F.lit(1.0).alias("score"))
    if wanted:
        hits = hits.join(having_tags(tags, wanted), "id", "left_semi")
    top = hits.join(nodes.where(F.col("deleted_at").isNull()).select("id", "name"), "id").orderBy(F.desc("score"), "id").limit(limit)
    calls = edges.where("kind = 'CALLS'").join(top.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return top.join(in_degree(calls), "id", "left").select("id", "name", "score", F.coalesce("in_degree", F.lit(0)).alias("caller_count")).orderBy(F.desc("score"), "id")


def containing(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, id) of texts (id, text) that hold a passage (item_id, passage) as it stands.

    An equi-join on four words inside the passage, which a text that holds it has between spaces, then an
    exact test; a passage of fewer than six words is held against each text.
    """
    size, inner = 4, F.split("passage", " ")
    long = passages.where(F.size(inner) >= size + 2).select("item_id", "passage", F.array_join(F.slice(inner, 2, size), " ").alias("four"))
    short = passages.where(F.size(inner) < size + 2)
    words = F.split("text", " ")
    fours = texts.where(F.size(words) >= size).select("id", words.alias("w")).select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " ")))).alias("four"))
    found = fours.join(long.select("four").distinct(), "four", "left_semi").join(long, "four")
    pairs = found.join(texts, "id").where(F.contains("text", "passage")).select("item_id", "id")
    return pairs.unionByName(short.join(texts, F.contains("text", "passage")).select("item_id", "id")).distinct()


def tokens_saved(nodes: DataFrame) -> DataFrame:
    saved = F.greatest(F.lit(0), F.coalesce("token_count", F.lit(0)) - F.floor(F.length("summary") / 4).cast("int"))
    return nodes.where(F.col("summary").isNotNull()).select("id", saved.alias("tokens_saved"))
