"""Registered queries over the whole input: whole texts, all edges, all calls."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.plans.catalog import CATALOG, queries
from basalt.plans.testview import View

from basalt.operators import centrality
from basalt.sources import files
from test_graph import brandes

SF = "/root/testdata/sf0.001"


def test_search_finds_words_after_the_first_200_characters(spark):
    docs = {r["doc_id"]: r["text"] for r in View(spark, SF).table("documents").collect()}
    has = lambda t: "die" in re.split(r"[\W_]+", t.lower())
    late = {i for i, t in docs.items() if has(t) and not has(t[:200])}
    got = {int(r["id"].rsplit("_", 1)[1]) for r in queries()["bm25_single"](spark, SF).collect()}
    assert late and got == {i for i, t in docs.items() if has(t)}


def test_import_lines_after_the_first_200_characters(spark):
    text = "x" * 250 + "\n  import os\nfrom a import b\nno import\n"
    got = spark.createDataFrame([(text,), ("none",)], "t string").select(files.import_lines(F.col("t"))).collect()
    assert [r[0] for r in got] == ["import os\nfrom a import b", ""]


def chain(spark):
    return {tuple(r) for r in View(spark, SF).chain.select("from_id", "to_id").where("from_id <> to_id").collect()}


def test_betweenness_of_all_edges(spark):
    pairs = chain(spark)
    want = brandes(sorted({n for p in pairs for n in p}), pairs)
    got = {r["id"]: r["score"] for r in queries()["betweenness"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_betweenness_of_2500_nodes(spark):
    e = spark.range(1, 2500).selectExpr("'n0' as from_id", "concat('n', id) as to_id", "'CALLS' as kind")
    n = spark.range(2500).selectExpr("concat('n', id) as id")
    got = {r["id"]: r["score"] for r in centrality.betweenness(n, e, None).collect()}
    assert len(got) == 2500 and got["n0"] == 1 and max(v for k, v in got.items() if k != "n0") == 0


def test_betweenness_of_more_paths_than_doubles_hold(spark):
    pairs = [(f"n{3 * i}", f"n{3 * i + k}") for i in range(1100) for k in (1, 2)] + [(f"n{3 * i + k}", f"n{3 * i + 3}") for i in range(1100) for k in (1, 2)]
    near = [[] for _ in range(3301)]
    for a, b in pairs:
        near[int(a[1:])].append(int(b[1:]))
        near[int(b[1:])].append(int(a[1:]))
    first = np.append(0, np.cumsum([len(x) for x in near]))
    got = centrality._leans(first, np.array([x for xs in near for x in xs]), 0)
    assert np.isfinite(got).all() and got[3] == pytest.approx(3297) and got[4] == pytest.approx((1 + 3294) / 2)


def gains(pairs, label):
    """Largest modularity gain of moving one node to another community or of joining two."""
    near, degree = {}, {}
    for a, b in {tuple(sorted(p)) for p in pairs if p[0] != p[1]}:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    degree = {v: len(x) for v, x in near.items()}
    m2, total, between = sum(degree.values()), {}, {}
    for v, c in label.items():
        total[c] = total.get(c, 0) + degree[v]
    best = 0.0
    for v in near:
        to = {}
        for u in near[v]:
            to[label[u]] = to.get(label[u], 0) + 1
            between[label[v], label[u]] = between.get((label[v], label[u]), 0) + 1
        stay = to.get(label[v], 0) - degree[v] * (total[label[v]] - degree[v]) / m2
        best = max(best, -stay, *(w - degree[v] * total[c] / m2 - stay for c, w in to.items() if c != label[v]), 0)
    return max([best, *(w - total[c] * total[d] / m2 for (c, d), w in between.items() if c != d)])


def test_louvain_of_all_edges_ends_when_no_move_gains(spark):
    pairs = chain(spark)
    label = {r["id"]: r["community_id"] for r in queries()["louvain_communities"](spark, SF).collect()}
    assert label.keys() == {n for p in pairs for n in p} and len(set(label.values())) > 1
    assert gains(pairs, label) < 1e-6


def test_louvain_of_several_components(spark):
    rng = random.Random(7)
    pairs = {(f"{g}{rng.randrange(30):02}", f"{g}{rng.randrange(30):02}") for g in "abc" for _ in range(60)}
    e = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "from_id string, to_id string, kind string")
    n = spark.createDataFrame([(f"{g}{i:02}",) for g in "abcd" for i in range(30)], "id string")
    rows = centrality.louvain(n, e).collect()
    label = {r["id"]: r["community_id"] for r in rows}
    assert len(rows) == 120 and all(r["size"] == 1 for r in rows if r["id"][0] == "d")
    ends = {n for p in pairs if p[0] != p[1] for n in p}
    assert gains(pairs, {v: c for v, c in label.items() if v in ends}) < 1e-6


def test_degrees_of_all_calls(spark):
    v = View(spark, SF)
    lines = v.lines.join(v.table("orders"), v.lines.l_orderkey == F.col("o_orderkey")).select("o_custkey", "l_partkey", "l_suppkey").collect()
    want = len({r[:2] for r in lines}) + len({r[1:] for r in lines})
    assert sum(r["out_degree"] for r in queries()["degree_in_out"](spark, SF).collect()) == want
