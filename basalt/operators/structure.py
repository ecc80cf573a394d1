"""Structure of the graph: dead code, hubs, communities, coupling, layers, surprising connections."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators.search import replacement_candidates
from basalt.operators.traversal import degrees, in_degree
from basalt.plans.lineage import written

# Name endings and summary words that explain why nothing calls a node.
LEGACY_SUFFIXES = ("_old", "_legacy", "_deprecated", "_v1", "_v2_old", "_bak", "_backup")
DEPRECATION_KEYWORDS = ("deprecated", "use instead", "replaced by", "use ", "do not use", "obsolete")
ENTRY_TAGS = ("api-endpoint", "async-task", "cli", "hook")

# Path parts of each layer, in the order in which they are tried.
LAYERS = {
    "api": ("routes/", "api/", "endpoints/", "handlers/", "views/", "pages/", "controllers/"),
    "service": ("services/", "service/", "usecases/", "use_cases/", "interactors/", "domain/", "logic/", "managers/"),
    "data": ("models/", "entities/", "entity/", "schemas/", "repository/", "repositories/", "store/", "dal/", "persistence/", "db/"),
    "ui": ("components/", "widgets/", "ui/", "screens/", "templates/", "layouts/", "partials/"),
    "infra": ("infra/", "deploy/", "terraform/", "k8s/", "docker/", "helm/", "ansible/"),
    "config": ("config/", "settings/", "env/", "migrations/"),
    "test": ("tests/", "test/", "__tests__/", "spec/", "fixtures/"),
    "middleware": ("middleware/", "interceptors/", "pipes/", "guards/", "filters/"),
    "utils": ("utils/", "helpers/", "lib/", "common/", "shared/", "pkg/", "internal/"),
    "entry": ("cmd/", "bin/", "cli/", "scripts/", "src/bin/"),
}
# Layers that a layer may depend on.
ALLOWED = {"data": ("utils", "config"), "service": ("data", "utils", "config"), "utils": ("config",)}
#: Pairs that a task makes of two steps.
PAIR_ROWS = 2_000_000


def _live(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("deleted_at").isNull())


def uncalled(nodes: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    """Live functions and methods without callers: (id, name, summary, tag), tag entry-point or dead-code."""
    functions = _live(nodes).where(F.col("kind").isin("function", "method"))
    entry = tags.where(F.col("tag").isin(*ENTRY_TAGS)).select(F.col("node_id").alias("id")).distinct().withColumn("entry", F.lit(True))
    calls = edges.where(F.col("kind") == "CALLS").select(F.col("to_id").alias("id"))
    rows = functions.join(calls, "id", "left_anti").join(entry, "id", "left")
    return rows.select("id", "name", "path", "summary", F.when(F.col("entry"), "entry-point").otherwise("dead-code").alias("tag"))


def dead_reason(name: Column, summary: Column) -> Column:
    low, said = F.lower(name), F.lower(summary)
    legacy = reduce(lambda a, b: a | b, (F.endswith(low, F.lit(s)) for s in LEGACY_SUFFIXES))
    out = F.when(legacy, "name suggests legacy/superseded version")
    for word in DEPRECATION_KEYWORDS:
        out = out.when(F.contains(said, F.lit(word)), f"summary contains deprecation hint: '{word}'")
    return out.otherwise("no callers")


def dead_code(nodes: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    """Dead functions with the reason and up to three called functions of the same file."""
    dead = uncalled(nodes, edges, tags).where("tag = 'dead-code'")
    other = replacement_candidates(nodes, edges, dead.select("id")).groupBy(F.col("dead_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("c")))), lambda x: x["c"]).alias("candidates"))
    return dead.join(other, "id", "left").select("id", dead_reason(F.col("name"), F.col("summary")).alias("reason"), F.coalesce(F.array_join("candidates", ","), F.lit("")).alias("candidates"))


def hubs(edges: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Nodes whose calls in are above mean + `deviations` sample deviations."""
    d = degrees(edges)
    bound = d.agg((F.avg("in_degree") + deviations * F.stddev_samp("in_degree")).alias("bound"))
    return d.crossJoin(F.broadcast(bound)).where("in_degree > bound").select("id", "in_degree")


def busy_bridges(edges: DataFrame, least: int = 3) -> DataFrame:
    """Fallback bridge rule: many calls in and out."""
    return degrees(edges).where((F.col("in_degree") > least) & (F.col("out_degree") > least))


def _sides(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls with both ends' community."""
    side = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("community_id").alias(f"{end}_c"))
    return edges.where(F.col("kind") == "CALLS").join(side("from"), "from_id").join(side("to"), "to_id")


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of calls out of a community that stay inside, from distinct edges; largest first."""
    size = nodes.where(F.col("community_id").isNotNull()).groupBy("community_id").agg(F.count("*").alias("size"))
    pairs = _sides(nodes, edges).where("from_c is not null").select("from_c", "to_c", "from_id", "to_id").distinct()
    inside = F.coalesce(F.col("from_c") == F.col("to_c"), F.lit(False))
    counts = pairs.groupBy(F.col("from_c").alias("community_id")).agg(F.count_if(inside).alias("internal"), F.count_if(~inside).alias("external"))
    out = size.join(counts, "community_id", "left").fillna(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return out.withColumn("cohesion", F.when(total > 0, F.round(F.col("internal") / total, 3)))


def low_cohesion(nodes: DataFrame, edges: DataFrame, least_size: int = 5, bound: float = 0.2) -> DataFrame:
    """Communities of which few members' callers are inside: counts distinct callers."""
    size = nodes.where(F.col("community_id").isNotNull()).groupBy("community_id").agg(F.count("*").alias("size"))
    inside = F.col("from_c") == F.col("to_c")
    sides = _sides(nodes, edges).where("to_c is not null and from_c is not null")
    counts = sides.groupBy(F.col("to_c").alias("community_id")).agg(F.countDistinct(F.when(inside, F.col("from_id"))).alias("internal"), F.countDistinct(F.when(~inside, F.col("from_id"))).alias("external"))
    ratio = F.col("internal") / (F.col("internal") + F.col("external"))
    return size.join(counts, "community_id").where((F.col("size") >= least_size) & (ratio < bound)).select("community_id", "size", "internal", "external", F.round(ratio, 6).alias("ratio"))


def community_bridges(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Nodes called from many other communities."""
    sides = _sides(nodes, edges).where("from_c <> to_c")
    out = sides.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_c").alias("n_communities"), F.array_join(F.array_sort(F.collect_set("from_c")), ",").alias("communities"))
    return out.where(F.col("n_communities") >= least)


def suggest_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ordinal, kind, id, n): orphans, bridges, undocumented hot functions, communities of low cohesion."""
    alive = _live(nodes)
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    orphans = alive.where(F.col("kind").isin("function", "method", "class")).join(ends, "id", "left_anti").select("id", F.lit(0).cast("long").alias("n")).orderBy("id").limit(5)
    bridges = community_bridges(nodes, edges).select("id", F.col("n_communities").alias("n")).orderBy(F.desc("n"), "id").limit(3)
    hot = in_degree(edges).join(alive.where("summary is null"), "id").select("id", F.col("in_degree").alias("n")).orderBy(F.desc("n"), "id").limit(3)
    loose = low_cohesion(nodes, edges).select(F.col("community_id").alias("id"), F.col("size").alias("n")).orderBy(F.desc("n"), "id").limit(2)
    named = [df.select(F.lit(i).alias("ordinal"), F.lit(k).alias("kind"), "id", "n") for i, (k, df) in enumerate((("orphan", orphans), ("bridge", bridges), ("undocumented", hot), ("low_cohesion", loose)), 1)]
    return reduce(DataFrame.unionByName, named)


def _directory(path: Column, parts: int) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, parts), "/")


def surprising(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Calls across files scored by how unexpected they are; one row for two communities' pair of nodes."""
    d = degrees(edges)
    side = lambda end: _live(nodes).where(~F.col("kind").isin("file", "community")).select(F.col("id").alias(f"{end}_id"), F.col("path").alias(f"{end}_path"), F.col("community_id").alias(f"{end}_c"))
    total = lambda end: d.select(F.col("id").alias(f"{end}_id"), (F.col("in_degree") + F.col("out_degree")).alias(f"{end}_degree"))
    rows = edges.where("kind = 'CALLS'").join(side("from"), "from_id").join(side("to"), "to_id").where("from_path <> to_path").join(total("from"), "from_id").join(total("to"), "to_id")
    crossed = F.coalesce(F.col("from_c") != F.col("to_c"), F.lit(False))
    checks = ((crossed, 2), (_directory(F.col("from_path"), 1) != _directory(F.col("to_path"), 1), 2), ((F.col("from_degree") <= 2) & (F.col("to_degree") >= 10), 2), (F.col("confidence") < 0.7, 1), (_directory(F.col("from_path"), 2) != _directory(F.col("to_path"), 2), 1))
    score = sum((F.when(c, w).otherwise(0) for c, w in checks), F.lit(0))
    scored = rows.select("from_id", "to_id", score.alias("score"), crossed.alias("crossed")).where("score > 0")
    pair = F.when(F.col("crossed"), F.concat_ws("|", F.least("from_id", "to_id"), F.greatest("from_id", "to_id"))).otherwise(F.concat_ws("|", "from_id", "to_id"))
    first = Window.partitionBy(pair).orderBy(F.desc("score"), "from_id", "to_id")
    return scored.withColumn("i", F.row_number().over(first)).where("i = 1").select("from_id", "to_id", "score").orderBy(F.desc("score"), "from_id", "to_id").limit(limit)


def coupling(commits: DataFrame, threshold: float = 0.3, least: int = 2, most_files: int = 50, parts: int | None = None) -> DataFrame:
    """(a, b, together, frequency) of files (commit, file) changed together; commits of many files are left out.

    Pairs stay inside one commit of at most `most_files` files. They are counted over `parts` partitions, if given.
    """
    once = commits.select("commit", "file").distinct()
    small = once.join(once.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= most_files), "commit").select("commit", "file")
    seen = small.groupBy("file").agg(F.count("*").alias("seen"))
    # at most most_files x most_files / 2 pairs a commit, made inside its row
    sets = small.groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files"))
    each = sets.select(F.posexplode("files").alias("i", "a"), "files").select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    each = each.repartition(parts, "a") if parts else each
    pairs = each.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    rows = pairs.join(seen.select(F.col("file").alias("a"), F.col("seen").alias("sa")), "a").join(seen.select(F.col("file").alias("b"), F.col("seen").alias("sb")), "b")
    frequency = F.col("together") / F.greatest("sa", "sb")
    return rows.where(frequency >= threshold).select("a", "b", "together", F.round(frequency, 6).alias("frequency"))


def layer(path: Column) -> Column:
    """First layer of which a part stands anywhere in the path."""
    out = None
    for name, parts in LAYERS.items():
        hit = reduce(lambda a, b: a | b, (F.contains(path, F.lit(p)) for p in parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def with_layers(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("layer", layer(F.concat("path", F.lit("/"))))


def layer_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_layer, to_layer, n) of calls between layers."""
    layered = with_layers(_live(nodes)).where("layer is not null")
    side = lambda end: layered.select(F.col("id").alias(f"{end}_id"), F.col("layer").alias(f"{end}_layer"))
    return edges.join(side("from"), "from_id").join(side("to"), "to_id").where("from_layer <> to_layer").groupBy("from_layer", "to_layer").agg(F.count("*").alias("n"))


def _forbidden(pairs: DataFrame) -> DataFrame:
    allowed = reduce(lambda a, b: a | b, ((F.col("from_layer") == k) & F.col("to_layer").isin(*v) for k, v in ALLOWED.items()))
    return pairs.where(F.col("from_layer").isin(*ALLOWED) & ~allowed)


def layer_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _forbidden(layer_pairs(nodes, edges))


def _ends_met(batches):
    """Counts of distinct pairs from the rows (a, a_layer, b_layer, bs) of one task, which has all rows of its a."""
    held: dict[tuple[str, str], tuple[list[np.ndarray], int, int]] = {}

    def once(parts: list[np.ndarray]) -> np.ndarray:
        """Distinct rows (a, b), by numbers of their a and b."""
        a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        (ua, ia), (ub, ib) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        code = np.sort(ia * len(ub) + ib)
        code = code[np.append(True, code[1:] != code[:-1])]
        return np.stack([ua[code // len(ub)], ub[code % len(ub)]])

    for batch in batches:
        ends = pa.Table.from_batches([batch])
        for layers in {*zip(ends["a_layer"].to_pylist(), ends["b_layer"].to_pylist(), strict=True)}:
            own = ends.filter((pc.field("a_layer") == layers[0]) & (pc.field("b_layer") == layers[1])).combine_chunks()
            many = pc.list_value_length(own["bs"]).to_numpy()
            parts, n, bound = held.get(layers, ([], 0, PAIR_ROWS))
            parts.append(np.stack([np.repeat(own["a"].to_numpy(), many), pc.list_flatten(own["bs"]).to_numpy()]))
            if (n := n + int(many.sum())) > bound:
                parts = [once(parts)]
                n, bound = parts[0].shape[1], max(PAIR_ROWS, 2 * parts[0].shape[1])
            held[layers] = parts, n, bound
    for (a_layer, b_layer), (parts, n, _) in held.items():
        pairs = once(parts) if n else np.empty((2, 0), np.int64)
        for side, ends, layer, other in (("a", pairs[0], a_layer, b_layer), ("b", pairs[1], b_layer, a_layer)):
            key, count = np.unique(ends, return_counts=True)
            yield pa.RecordBatch.from_pydict({"side": [side] * len(key), "key": key, "layer": [layer] * len(key), "other_layer": [other] * len(key), "n": count.astype(np.int64)}, schema=_MET)


_MET = pa.schema([("side", pa.string()), ("key", pa.int64()), ("layer", pa.string()), ("other_layer", pa.string()), ("n", pa.int64())])


def two_steps(first: DataFrame, second: DataFrame, parts: int) -> DataFrame:
    """(side, key, layer, other_layer, n) of distinct pairs (a, b) that two steps lead from one layer to another, by the keys of both sides.

    first: (a, a_layer, mid), second: (mid, b, b_layer). All that is behind a middle node goes as one set to each
    node before it; the pairs are made and told apart in the task that has their a, so they are neither shuffled nor
    written. Their number sets how many tasks there are. A key of side b has a row for each task that met it.
    """
    first, sets = written(first), written(second.repartition(parts, "mid").groupBy("mid", "b_layer").agg(F.collect_set("b").alias("bs")))
    met = lambda held: first.repartition(parts, "mid").join(held.repartition(parts, "mid"), "mid").where("a_layer <> b_layer")
    pairs = met(sets.select("mid", "b_layer", F.size("bs").alias("n"))).agg(F.sum("n")).first()[0] or 0
    held = met(sets).select("a", "a_layer", "b_layer", "bs").repartition(max(parts, -(-pairs // PAIR_ROWS)), "a")
    return held.mapInArrow(_ends_met, "side string, key long, layer string, other_layer string, n long")


def layer_pairs_met(met: DataFrame, back: bool = False) -> DataFrame:
    """(from_layer, to_layer, n) of the pairs between layers, or of the same pairs from b to a."""
    ends = ("other_layer", "layer") if back else ("layer", "other_layer")
    return met.where("side = 'a'").groupBy(F.col(ends[0]).alias("from_layer"), F.col(ends[1]).alias("to_layer")).agg(F.sum("n").alias("n"))


def layer_violations_met(met: DataFrame, back: bool = False) -> DataFrame:
    return _forbidden(layer_pairs_met(met, back))


def gateways_met(met: DataFrame, a_ids: DataFrame, b_ids: DataFrame, most: int = 5) -> DataFrame:
    """Nodes of each layer with the most distinct pairs to other layers; a_ids, b_ids: (key, id)."""
    ids = a_ids.toDF("key", "id").withColumn("side", F.lit("a")).unionByName(b_ids.toDF("key", "id").withColumn("side", F.lit("b")))
    rank = Window.partitionBy("layer").orderBy(F.desc("n"), "id")
    counts = met.groupBy("side", "key", "layer").agg(F.sum("n").alias("n")).join(ids, ["side", "key"])
    return counts.select("layer", "id", "n", F.row_number().over(rank).alias("rank")).where(F.col("rank") <= most)


def gateways(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Nodes of each layer with the most edges to other layers."""
    layered = with_layers(_live(nodes)).where("layer is not null").select("id", "layer")
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("other")), F.struct(F.col("to_id").alias("id"), F.col("from_id").alias("other")))).alias("e")).select("e.*")
    crossed = ends.join(layered, "id").join(layered.select(F.col("id").alias("other"), F.col("layer").alias("other_layer")), "other").where("layer <> other_layer")
    rank = Window.partitionBy("layer").orderBy(F.desc("n"), "id")
    return crossed.groupBy("layer", "id").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)


# Files and words that tell a framework, in the order in which they are tried, and its own layers.
FRAMEWORK_FILES = (("next.config.js", "nextjs"), ("next.config.ts", "nextjs"), ("next.config.mjs", "nextjs"), ("manage.py", "django"), ("pom.xml", "spring"), ("build.gradle", "spring"), ("build.gradle.kts", "spring"), ("go.mod", "go"))
FRAMEWORK_CONFIGS, FRAMEWORK_WORDS = ("pyproject.toml", "requirements.txt", "composer.json"), ("fastapi", "django", "flask", "laravel")
FRAMEWORK_LAYERS = {
    "nextjs": (("app/", "api"), ("components/", "ui"), ("lib/", "service"), ("hooks/", "ui")),
    "django": (("views/", "api"), ("serializers/", "api"), ("managers/", "service"), ("signals/", "service")),
    "spring": (("controller/", "api"), ("service/", "service"), ("repository/", "data"), ("entity/", "data")),
    "go": (("cmd/", "entry"), ("internal/", "service"), ("pkg/", "utils")),
    "fastapi": (("routers/", "api"), ("schemas/", "data"), ("crud/", "data"), ("dependencies/", "middleware")),
}


def framework(files: DataFrame) -> DataFrame:
    """(project, framework) from the files (project, name, text) at the roots of projects: marker files first, then configurations."""
    marks = [n for n, _ in FRAMEWORK_FILES]
    low = F.lower(F.coalesce("text", F.lit("")))
    by_file = reduce(lambda a, i: a.when(F.col("name") == FRAMEWORK_FILES[i][0], F.struct(F.lit(i).alias("rank"), F.lit(FRAMEWORK_FILES[i][1]).alias("name"))), range(1, len(marks)), F.when(F.col("name") == marks[0], F.struct(F.lit(0).alias("rank"), F.lit(FRAMEWORK_FILES[0][1]).alias("name"))))
    word = reduce(lambda a, w: a.when(F.contains(low, F.lit(w)), w), FRAMEWORK_WORDS[1:], F.when(F.contains(low, F.lit(FRAMEWORK_WORDS[0])), FRAMEWORK_WORDS[0]))
    config = F.when(F.col("name").isin(*FRAMEWORK_CONFIGS) & word.isNotNull(), F.struct((F.array_position(F.array(*map(F.lit, FRAMEWORK_CONFIGS)), F.col("name")) + len(marks)).cast("int").alias("rank"), word.alias("name")))
    return files.select("project", F.coalesce(by_file, config).alias("f")).where("f is not null").groupBy("project").agg(F.min("f").alias("f")).select("project", F.col("f.name").alias("framework"))


def framework_layer(path: Column, name: str | None) -> Column:
    """Layer of a path where a framework has a say: its own directories first."""
    rules = FRAMEWORK_LAYERS.get(name or "", ())
    own = [F.when(F.contains(path, F.lit(p)), F.lit(layer_name)) for p, layer_name in rules]
    return F.coalesce(*own, layer(path)) if own else layer(path)


def bridges_by_score(scores: DataFrame) -> DataFrame:
    """Ids whose score (id, score) is above zero and above mean + 2 sample deviations of all; none of fewer than two rows."""
    bound = scores.agg((F.avg("score") + 2 * F.stddev_samp("score")).alias("bound"))
    return scores.crossJoin(F.broadcast(bound)).where("score > 0 and score > bound").select("id", "score")  # one row


def graph_tags(nodes: DataFrame, edges: DataFrame, tags: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(node_id, tag, source) after the graph's own tags are made anew: hub, bridge, entry-point, dead-code.

    Bridges are by betweenness `scores` (id, score) if they are given, else by more than three calls in and out.
    """
    made = uncalled(nodes, edges, tags).select(F.col("id").alias("node_id"), "tag")
    calls = _live(nodes).where(F.col("kind").isin("function", "method")).select("id").join(degrees(edges), "id", "left").fillna(0)
    bound = calls.agg((F.avg("in_degree") + 2 * F.stddev_samp("in_degree")).alias("bound"))
    hub = calls.crossJoin(F.broadcast(bound)).where("in_degree > bound")  # one row
    made = made.unionByName(hub.select(F.col("id").alias("node_id"), F.lit("hub").alias("tag")))
    bridge = calls.where("in_degree > 3 and out_degree > 3") if scores is None else bridges_by_score(scores)
    made = made.unionByName(bridge.select(F.col("id").alias("node_id"), F.lit("bridge").alias("tag")))
    kept = tags.where(~(F.col("tag").isin("hub", "bridge", "entry-point", "dead-code") & (F.col("source") == "system")))
    return kept.select("node_id", "tag", "source").unionByName(made.distinct().withColumn("source", F.lit("system"))).dropDuplicates(["node_id", "tag"])


def architecture(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, a, b, n): nodes of each layer, calls between layers, those that aren't allowed, gateways."""
    counts = with_layers(_live(nodes)).where("layer is not null").groupBy("layer").agg(F.count("*").alias("n"))
    rows = counts.select(F.lit("layer").alias("section"), F.col("layer").alias("a"), F.lit("").alias("b"), "n")
    for name, pairs in (("dependency", layer_pairs(nodes, edges)), ("violation", layer_violations(nodes, edges))):
        rows = rows.unionByName(pairs.select(F.lit(name).alias("section"), F.col("from_layer").alias("a"), F.col("to_layer").alias("b"), "n"))
    return rows.unionByName(gateways(nodes, edges).select(F.lit("gateway").alias("section"), F.col("layer").alias("a"), F.col("id").alias("b"), "n"))
