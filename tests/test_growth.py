"""What grows with the tables: partitions, pairs of two steps, tasks of parsers."""

import itertools

import numpy as np

from basalt.operators import centrality, packets, structure, traversal
from basalt.plans import index, testview
from basalt.plans.lineage import written
from basalt.plans.testview import View
from basalt.sources import parsers

DATA = "/root/testdata/sf0.001"


def test_partitions_of_order_lines_grow_with_their_rows(spark, monkeypatch):
    monkeypatch.setattr(testview, "PART_ROWS", 300)
    v = View(spark, DATA)
    assert v.n_parts == 20
    for name in ("lines", "chain", "calls"):
        plan = getattr(v, name)._jdf.queryExecution().executedPlan().toString()
        assert ", 20), REPARTITION_BY_NUM" in plan and ", 4), REPARTITION_BY_NUM" not in plan
        assert name == "calls" or "BroadcastExchange" not in plan


def test_a_walk_sends_its_frontier_and_not_the_edges(spark):
    v = View(spark, DATA)
    edges = v.stored("chain")
    assert edges.inputFiles() and v.stored("chain") is edges
    plan = traversal._directed(edges, "both")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_two_steps_counts_distinct_pairs_in_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(structure, "PAIR_ROWS", 50)
    first = [(a, "api", m) for a in range(12) for m in range(5) if (a + m) % 3] + [(99, "data", 0)]
    second = [(m, 1000 + b, "data" if b % 2 else "utils") for m in range(5) for b in range(20) if (b * m) % 4 != 1]
    met = structure.two_steps(spark.createDataFrame(first, "a long, a_layer string, mid long"), spark.createDataFrame(second, "mid long, b long, b_layer string"), 4)
    want = {(a, la, b, lb) for (a, la, m), (n, b, lb) in itertools.product(first, second) if m == n and la != lb}
    got = {(r["from_layer"], r["to_layer"]): r["n"] for r in structure.layer_pairs_met(met).collect()}
    assert got == {k: sum((p[1], p[3]) == k for p in want) for k in {(p[1], p[3]) for p in want}}
    back = {(r["from_layer"], r["to_layer"]): r["n"] for r in structure.layer_violations_met(met, back=True).collect()}
    assert back == {("data", "api"): got["api", "data"], ("utils", "api"): got["api", "utils"], **({("utils", "data"): got["data", "utils"]} if ("data", "utils") in got else {})}
    ids = lambda keys: spark.createDataFrame([(k, f"n{k}") for k in keys], "key long, id string")
    gates = structure.gateways_met(met, ids({p[0] for p in want}), ids({p[2] for p in want})).collect()
    for layer in ("api", "data", "utils"):
        ends = [(p[0], p[1]) for p in want] + [(p[2], p[3]) for p in want]
        counts = sorted(((-sum(e == (k, layer) for e in ends), f"n{k}") for k in {k for k, la in ends if la == layer}))[:5]
        assert sorted((-r["n"], r["id"]) for r in gates if r["layer"] == layer) == counts


def test_status_has_days_of_a_time_to_come_and_of_none(spark):
    row = lambda *times: packets.status(spark.createDataFrame([(t, None) for t in times], "updated_at long, deleted_at long"), 1_000_000).first()
    assert [row(t)["age"] for t in (1_000_100, 999_000, 800_000)] == ["-1d", "0d", "2d"]
    assert row()["age"] is None


def test_files_of_a_small_table_are_parsed_by_many_tasks_and_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(parsers, "TASK_FILES", 20)
    v = View(spark, DATA)
    assert parsers.parse_files(v.sources.coalesce(1)).rdd.getNumPartitions() == 10
    edges = index.edges_of(written(parsers.parse_files(v.sources)), written(parsers.call_sites(v.sources)), "p")
    assert "BroadcastExchange" not in edges._jdf.queryExecution().executedPlan().toString()


def test_betweenness_searches_inside_components():
    rng = np.random.default_rng(3)
    p = np.array([(i, j) for c in range(3) for i in range(c, 60, 3) for j in range(c, i, 3) if rng.random() < 0.4])
    order, first, near, low = centrality._by_component(p[:, 0], p[:, 1], 64)
    whole = centrality._adjacency(p[:, 0], p[:, 1], 64)
    assert len(low) == 7 and sorted(order.tolist()) == list(range(64))
    for at, end in zip(low, np.append(low[1:], 64), strict=True):
        assert near[first[at] : first[end]].size == 0 or (near[first[at] : first[end]].min() >= at and near[first[at] : first[end]].max() < end)
        for s in range(at, end):
            own = np.zeros(64)
            own[order[at:end]] = centrality._leans(first[at : end + 1] - first[at], near[first[at] : first[end]] - at, int(s - at))
            assert np.abs(own - centrality._leans(*whole, int(order[s]))).max() < 1e-9


def test_pairs_of_commits_are_counted_over_a_given_number_of_partitions(spark):
    commits = spark.createDataFrame([(c, f) for c in range(6) for f in range(4)], "commit long, file long")
    out = structure.coupling(commits, 0.05, parts=7)
    assert ", 7), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, structure.coupling(commits, 0.05).collect()))
