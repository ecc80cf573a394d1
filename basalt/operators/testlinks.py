"""Tests and the code that they test: four equi-joins in place of every test against every function.

Signals: the path convention of the language, the file's name as a word of the test's first lines, the
name without its test affix, a call. A pair with any signal is scored; others have no score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.enrich import is_test_file, strip_test_name, test_score, test_tier

#: Lines of a test file that are searched for imports.
HEAD_LINES = 50
# Fixtures that are no tests.
NO_TESTS = ("setUp", "tearDown", "setUpClass", "tearDownClass")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def tested_stem(path: Column, language: Column) -> Column:
    """File name, without its ending, of what a test file tests by the convention of its language."""
    name = F.element_at(F.split(path, "/"), -1)
    first = lambda *patterns: F.coalesce(*(F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in patterns))
    python = first(r"test_(.+)\.py$", r"(.+)_test\.py$")
    return F.when(language == "python", python).when(language.isin("typescript", "javascript"), first(r"(.+)\.(?:test|spec)\.(?:ts|tsx|js|jsx)$")).when(language == "java", first(r"(.+?)(?:Tests|Test|IT|Spec)\.java$"))


def head_words(text: Column) -> Column:
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, HEAD_LINES)
    return F.array_distinct(F.split(F.array_join(lines, "\n"), r"[^A-Za-z0-9_]+"))


def link_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(test_id, id, score, tier) of functions and methods (id, kind, name, path, language, text of the file).

    A high tier is a TESTED_BY edge; a medium one marks the code as partly tested.
    """
    code = nodes.where(F.col("kind").isin("function", "method"))
    flagged = code.withColumn("is_test", is_test_file(F.col("path"), F.col("language")))
    tests = flagged.where(F.col("is_test") & ~F.col("name").isin(*NO_TESTS) & ~F.contains("path", F.lit("conftest")))
    tests = tests.select(F.col("id").alias("test_id"), "path", "language", F.lower(strip_test_name(F.col("name"), F.col("language"))).alias("tested"), tested_stem(F.col("path"), F.col("language")).alias("stem"), "text")
    made = flagged.where(~F.col("is_test")).select("id", F.lower("name").alias("tested"), stem(F.col("path")).alias("stem"), "language")
    flag = lambda df, signal: df.select("test_id", "id", F.lit(signal).alias("signal"))
    words = tests.select("test_id", F.explode(head_words(F.col("text"))).alias("stem")).where("stem <> ''")
    calls = edges.where("kind = 'CALLS'").select(F.col("from_id").alias("test_id"), F.col("to_id").alias("id"))
    pairs = flag(tests.where("stem is not null").join(made, ["stem", "language"]), "path")
    pairs = pairs.unionByName(flag(words.join(made.select("id", "stem"), "stem"), "import"))
    pairs = pairs.unionByName(flag(tests.join(made.select("id", "tested"), "tested"), "name"))
    pairs = pairs.unionByName(flag(calls.join(tests.select("test_id"), "test_id", "left_semi").join(made.select("id"), "id", "left_semi"), "calls"))
    signals = pairs.groupBy("test_id", "id").agg(F.collect_set("signal").alias("signals"))
    score = test_score({k: F.array_contains("signals", k) for k in ("path", "import", "name", "calls")})
    return signals.select("test_id", "id", score.alias("score")).withColumn("tier", test_tier(F.col("score"))).where("tier is not null")


def tested_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, test_id, name, path): tests that a TESTED_BY edge points from to a node."""
    links = edges.where("kind = 'TESTED_BY'").select(F.col("from_id").alias("test_id"), F.col("to_id").alias("node_id"))
    return links.join(nodes, F.col("id") == F.col("test_id")).select(F.col("node_id").alias("id"), "test_id", "name", "path")
