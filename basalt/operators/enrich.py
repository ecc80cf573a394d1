"""Enrichment: automatic tags, test links, call descriptions, complexity, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags by decorator prefix (tried in order), by import and by directory.
DECORATOR_TAGS = (
    ("app.route", "api-endpoint"), ("router.", "api-endpoint"), ("pytest.fixture", "test-fixture"), ("abstractmethod", "interface"), ("staticmethod", "static"), ("classmethod", "class-method"),
    ("property", "property"), ("contextmanager", "context-manager"), ("celery.task", "async-task"), ("Controller", "api-endpoint"), ("Injectable", "service"), ("Component", "framework-component"),
    ("RestController", "api-endpoint"), ("Service", "service"), ("Repository", "repository"), ("Test", "test"),
)
IMPORT_TAGS = (
    ("jwt", ("auth", "jwt")), ("oauth", ("auth", "oauth")), ("bcrypt", ("auth", "crypto")), ("passlib", ("auth", "crypto")), ("sqlalchemy", ("database", "orm")), ("psycopg", ("database",)), ("redis", ("cache",)),
    ("celery", ("async-task", "queue")), ("flask", ("web",)), ("fastapi", ("web", "api")), ("django", ("web",)), ("express", ("web",)), ("logging", ("observability",)), ("structlog", ("observability",)),
)
DIR_TAGS = (
    ("middleware", "middleware"), ("utils", "utility"), ("helpers", "utility"), ("migrations", "migration"), ("fixtures", "test-data"), ("scripts", "script"), ("proto", "grpc"), ("graphql", "graphql"),
    ("commands", "cli"), ("workers", "async-worker"), ("hooks", "hook"),
)
# Verbs of a callee's name, and names that say nothing.
VERBS = (
    ("get", "retrieval"), ("fetch", "retrieval"), ("set", "update"), ("update", "update"), ("create", "creation"), ("build", "building"), ("delete", "deletion"), ("remove", "removal"), ("validate", "validation"),
    ("check", "checking"), ("parse", "parsing"), ("serialize", "serialization"), ("send", "sending"), ("receive", "receiving"), ("save", "persistence"), ("load", "loading"), ("hash", "hashing"), ("encrypt", "encryption"),
    ("auth", "authentication"),
)
GENERIC_VERBS = ("run", "do", "process", "execute", "call", "invoke", "main", "init", "setup", "handle")
# Weights of the signals that a test covers a function, and the bounds of the tiers.
TEST_WEIGHTS = {"path": 0.30, "import": 0.30, "name": 0.25, "calls": 0.40}
TEST_HIGH, TEST_MEDIUM = 0.55, 0.30
# Branches, nesting and lines from which a function is complex, and up to which simple.
COMPLEX, SIMPLE = (8, 4, 60), (3, 2, 25)


def _pairs(rows: tuple) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("key"), F.lit(v).alias("tag")) for i, (k, v) in enumerate(rows)))


def decorator_tags(rows: DataFrame, decorators: str = "decorators") -> DataFrame:
    """(id, tag): the first rule whose prefix a decorator has, with or without its @."""
    each = rows.select("id", F.explode(decorators).alias("d")).select("id", F.ltrim(F.regexp_replace("d", "^@", "")).alias("d"))
    rules = F.filter(_pairs(DECORATOR_TAGS), lambda r: F.startswith(F.col("d"), r["key"]))
    return each.select("id", F.try_element_at(rules, F.lit(1))["tag"].alias("tag")).where("tag is not null").distinct()


def import_tags(rows: DataFrame, imports: str = "imports") -> DataFrame:
    """(id, tag) for each key that stands in a file's import lines."""
    low = F.lower(imports)
    found = F.flatten(F.array(*(F.when(F.contains(low, F.lit(k)), F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>")) for k, tags in IMPORT_TAGS)))
    return rows.select("id", F.explode(F.array_distinct(found)).alias("tag"))


def directory_tags(rows: DataFrame, path: str = "path") -> DataFrame:
    """(id, tag) for each directory of the path that has one, whatever its case."""
    parts = F.split(F.lower(path), r"[/\\]")
    found = F.array_compact(F.array(*(F.when(F.array_contains(parts, k), F.lit(t)) for k, t in DIR_TAGS)))
    return rows.select("id", F.explode(F.array_distinct(found)).alias("tag"))


def auto_tags(rows: DataFrame) -> DataFrame:
    return decorator_tags(rows).unionByName(import_tags(rows)).unionByName(directory_tags(rows)).distinct()


def name_parts(name: Column) -> Column:
    """Lower-case parts of a snake_case or camelCase name."""
    parts = F.when(F.contains(name, F.lit("_")), F.split(name, "_")).otherwise(F.split(name, "(?<!^)(?=[A-Z])"))
    return F.filter(F.transform(parts, F.lower), lambda p: p != "")


def verb_phrase(name: Column) -> Column:
    """What a name says it does; null for generic names."""
    parts = name_parts(name)
    verb, rest = F.try_element_at(parts, F.lit(1)), F.array_join(F.slice(parts, 2, 1 << 20), " ")
    noun = reduce(lambda a, kv: a.when(verb == kv[0], kv[1]), VERBS[1:], F.when(verb == VERBS[0][0], VERBS[0][1]))
    known = F.when(rest == "", verb).otherwise(F.concat_ws(" ", rest, noun))
    return F.when(verb.isNull() | verb.isin(*GENERIC_VERBS), F.lit(None).cast("string")).otherwise(F.when(noun.isNotNull(), known).otherwise(F.array_join(parts, " ")))


def module_of(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def describe_calls(edges: DataFrame, nodes: DataFrame, floor: float = 0.6) -> DataFrame:
    """(from_id, to_id, description) of calls sure enough and not generic."""
    side = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), verb_phrase(F.col("name")).alias(f"{end}_verb"), module_of(F.col("path")).alias(f"{end}_module"))
    rows = edges.where((F.col("kind") == "CALLS") & (F.col("confidence") >= floor)).join(side("from"), "from_id").join(side("to"), "to_id").where("to_verb is not null")
    far = F.col("to_module").isNotNull() & ~F.col("to_module").eqNullSafe(F.col("from_module"))
    reach = F.concat(F.when(F.col("from_verb").isNotNull(), F.concat("from_verb", F.lit(" "))).otherwise(""), F.lit("reaches into "), "to_module", F.lit(" for "), "to_verb")
    near = F.when(F.col("from_verb").isNotNull(), F.concat("from_verb", F.lit(" via "), "to_verb")).otherwise(F.col("to_verb"))
    return rows.select("from_id", "to_id", F.when(far, reach).otherwise(near).alias("description"))


def complexity(branches: Column, nesting: Column, lines: Column) -> Column:
    b, n, k = COMPLEX
    sb, sn, sk = SIMPLE
    return F.when((branches >= b) | (nesting >= n) | (lines >= k), "complex").when((branches <= sb) & (nesting <= sn) & (lines <= sk), "simple").otherwise("moderate")


def test_score(signals: dict[str, Column]) -> Column:
    """Sum of the weights of the signals that hold, 1 at most."""
    return F.round(F.least(F.lit(1.0), sum((F.when(c, TEST_WEIGHTS[k]).otherwise(0.0) for k, c in signals.items()), F.lit(0.0))), 6)


def test_tier(score: Column) -> Column:
    return F.when(score >= TEST_HIGH, "high").when(score >= TEST_MEDIUM, "medium")


def is_test_file(path: Column, language: Column) -> Column:
    python = path.rlike(r"test_(.+)\.py$") | path.rlike(r"(.+)_test\.py$") | path.rlike(r"tests?/")
    script = path.rlike(r"(.+)\.(test|spec)\.(ts|tsx|js|jsx)$") | path.rlike(r"__tests__/")
    java = F.contains(path, F.lit("src/test/java")) | path.rlike(r"(.+)(Test|Tests|IT|Spec)\.java$")
    return F.when(language == "python", python).when(language.isin("typescript", "javascript"), script).when(language == "java", java).otherwise(False)


def strip_test_name(name: Column, language: Column) -> Column:
    """Name of what a test tests, by the first rule that fits."""
    camel = F.when(F.startswith(F.lower(name), F.lit("test")), F.concat(F.upper(F.substring(name, 5, 1)), F.substring(name, 6, 1 << 20)))
    python = F.when(F.startswith(name, F.lit("test_")), F.substring(name, 6, 1 << 20)).when(F.endswith(name, F.lit("_test")), F.regexp_replace(name, "_test$", ""))
    java = F.coalesce(camel, F.when(name.rlike("(Test|Tests|IT|Spec)$"), F.regexp_replace(name, "(Test|Tests|IT|Spec)$", "")))
    return F.coalesce(F.when(language == "python", python).when(language.isin("typescript", "javascript"), camel).when(language == "java", java), name)


def auto_summary(kind: Column, name: Column, module: Column, doc: Column) -> Column:
    short = F.when(F.length(doc) > 200, F.concat(F.substring(doc, 1, 200), F.lit("..."))).otherwise(doc)
    return F.concat_ws("\n", F.concat(kind, F.lit(" "), name), F.when(module.isNotNull(), F.concat(F.lit("module: "), module)), short)
