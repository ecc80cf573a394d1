"""Git lists, ignore rules, change feeds, and edge cases of writes, packets and test links, on small tables."""

import subprocess

import pytest
from pyspark.sql import functions as F

from basalt.operators import packets, search, structure, testlinks, traversal, writes
from basalt.sources import git
from basalt.streaming import activity

NODES = "id string, kind string, name string, path string, language string, text string, summary string, summary_author string, summary_hash string, content_hash string, community_id string, start_line int, end_line int, token_count int, updated_at long, deleted_at long"
EDGES = "from_id string, to_id string, kind string, confidence double"


def node(i, name=None, path="src/f.py", kind="function", **more):
    base = dict.fromkeys(["language", "text", "summary", "summary_author", "summary_hash", "content_hash", "community_id", "start_line", "end_line", "token_count", "deleted_at"])
    return base | {"id": i, "kind": kind, "name": name or i, "path": path, "updated_at": 1} | more


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in NODES.split(", ")) for r in rows], NODES)


def test_git_lists(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    for name, text in {"a.py": "x", "b.md": "x", "sub dir/ü.ts": "x", "gone.py": "x", ".gitignore": "gone.py\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("y")
    run("commit", "-qam", "two")
    root = str(tmp_path)
    assert sorted(r["path"] for r in git.listed_files(spark, root).collect()) == ["a.py", "sub dir/ü.ts"]
    assert [r["path"] for r in git.changed_files(spark, root, "HEAD~1", "HEAD").collect()] == ["a.py"]
    with pytest.raises(ValueError):
        git.changed_files(spark, root, "--output=x", "HEAD")
    got = git.commits(spark, root).groupBy("commit").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in got) == [1, 4]
    assert git.listed_files(spark, str(tmp_path.parent / "none")) is None


def test_ignore_rules(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".gitignore").write_text("# note\n*.log\n/build\ndocs/\n!keep.log\n")
    (tmp_path / "pkg" / ".gitignore").write_text("local.py\n**/tmp\n")
    names = ["a.py", "x.log", "keep.log", "build/a.py", "pkg/build/a.py", "docs/a.py", "pkg/docs/b.py", "docs.py", "pkg/local.py", "local.py", "pkg/q/tmp/a.py"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    left = {r["path"] for r in git.not_ignored(files, git.ignore_rules(str(tmp_path))).collect()}
    assert left == {"a.py", "keep.log", "pkg/build/a.py", "docs.py", "local.py"}


def test_feed_keeps_the_newest_row_of_a_key(spark, tmp_path):
    source, table_ = tmp_path / "in", f"file://{tmp_path}/out"
    for k, rows in enumerate([[(1, 5, "a"), (2, 1, "b")], [(1, 4, "late"), (2, 3, "c"), (3, None, "n")]]):
        spark.createDataFrame(rows, "k long, t long, v string").coalesce(1).write.parquet(f"file://{source}/part{k}")
        stream = spark.readStream.schema("k long, t long, v string").option("recursiveFileLookup", True).parquet(f"file://{source}")
        activity.run_feed(stream, table_, ["k"], "t")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(f"{table_}/1").collect()} == {(1, "a"), (2, "c"), (3, "n")}


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "x"), ("2024-01-05 10:00:00", "x")], [("2024-01-01 11:00:00", "x"), ("2024-01-09 10:00:00", "x")]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "ts string, event_type string").selectExpr("cast(ts as timestamp) as ts", "event_type").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema("ts timestamp, event_type string").option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
        counts = activity.late_counts(stream, "1 day", "1 day")
        counts.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["start"], r["n"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got[0] == (1704067200, 1)  # the row of January 1 in the second batch came too late


def test_packets(spark):
    nodes = table(spark, [node("t"), node("a"), node("b", path="src/g.py"), node("gone", deleted_at=5)])
    edges = spark.createDataFrame([("a", "t", "CALLS", 1.0), ("b", "t", "CALLS", 1.0), ("t", "a", "CALLS", 1.0), ("test", "t", "TESTED_BY", 1.0)], EDGES)
    tags = spark.createDataFrame([("t", "x", "system")], "node_id string, tag string, source string")
    (r,) = packets.packet(nodes, edges, tags, "t", 10, callers_limit=1, callees_limit=0).collect()
    assert (r["callers"], r["callers_total"], r["callees"], r["callees_total"], r["tested_by"]) == (["a"], 2, [], 0, ["test"])
    assert packets.packet(nodes, edges, tags, "gone", 10).count() == 0 == packets.packet(nodes, edges, tags, "none", 10).count()
    lines = [r["text"] for r in packets.primer(nodes, edges).collect()]
    assert lines[0].startswith("Nodes: 3, files: 2") and lines[2] == "Hot: t, a" and lines[4] == "Last analyzed: 1970-01-01 00:00"
    assert packets.primer(nodes.where("false"), edges.where("false")).count() == 3


def test_paths_and_kinds(spark):
    edges = spark.createDataFrame([("s", "b", "CALLS", 1.0), ("s", "a", "CALLS", 1.0), ("a", "g", "CALLS", 1.0), ("b", "g", "CALLS", 1.0), ("s", "g", "IMPORTS", 1.0)], EDGES)
    assert [r["id"] for r in traversal.shortest_path(edges, "s", "g").orderBy("step").collect()] == ["s", "a", "g"]
    assert traversal.shortest_path(edges, "g", "s").count() == 0
    assert [r["id"] for r in traversal.shortest_path(edges, "s", "s").collect()] == ["s"]
    nodes = table(spark, [node(i) for i in "sabg"])
    got = {r["id"]: r["depth"] for r in traversal.neighbors(nodes, edges, "s", 3, "out", ("CALLS",)).collect()}
    assert got == {"a": 1, "b": 1, "g": 2}
    assert {r["id"]: r["depth"] for r in traversal.neighbors(nodes, edges, "s", 3, "out").collect()}["g"] == 1


def test_links_of_other_languages(spark):
    rows = [node("p", "login", "src/auth.ts", language="typescript"), node("q", "testLogin", "src/auth.test.ts", language="typescript", text="import {x} from './auth'"), node("f", "setUp", "src/test/java/AuthTest.java", language="java"), node("n", None, None)]
    nodes = table(spark, rows)
    edges = spark.createDataFrame([("q", "p", "CALLS", 1.0)], EDGES)
    assert [tuple(r) for r in testlinks.link_tests(nodes, edges).collect()] == [("q", "p", 1.0, "high")]
    assert testlinks.link_tests(nodes.where("false"), edges).count() == 0


def test_writes_take_one_row_of_a_key(spark):
    old = spark.createDataFrame([("a", "CALLS", 1), ("b", "CALLS", 1)], "id string, kind string, v int")
    new = spark.createDataFrame([("a", "CALLS", 2), ("a", "CALLS", 3), ("c", "CALLS", 4), (None, "CALLS", 5)], old.schema)
    assert sorted((tuple(r) for r in writes.put(old, new, ["id"]).collect()), key=str) == [("a", "CALLS", 3), ("b", "CALLS", 1), ("c", "CALLS", 4), (None, "CALLS", 5)]
    meta = spark.createDataFrame([("last_coupling_commit", "c2")], "key string, value string")
    commits = spark.createDataFrame([("c1", 1), ("c2", 2)], "commit string, ts long")
    assert not writes.coupling_due(meta, commits).first()["due"] and writes.coupling_due(meta, commits.where("ts < 2")).first()["due"]
    assert writes.coupling_due(meta.where("false"), commits).first()["due"] and not writes.coupling_due(meta, commits.where("false")).first()["due"]


def test_bridges_frameworks_and_search(spark):
    scores = spark.createDataFrame([(f"n{i}", 0.0) for i in range(30)] + [("hub", 1.0)], "id string, score double")
    assert [r["id"] for r in structure.bridges_by_score(scores).collect()] == ["hub"]
    assert structure.bridges_by_score(scores.limit(1)).count() == 0
    files = spark.createDataFrame([("p", "requirements.txt", "Flask"), ("q", "pom.xml", None), ("q", "manage.py", None), ("r", "x.txt", "django")], "project string, name string, text string")
    assert {(r["project"], r["framework"]) for r in structure.framework(files).collect()} == {("p", "flask"), ("q", "django")}
    row = spark.createDataFrame([("x/hooks/a",), ("x/views/a",)], "p string").select(structure.framework_layer(F.col("p"), "nextjs"), structure.framework_layer(F.col("p"), None)).collect()
    assert [tuple(r) for r in row] == [("ui", None), ("api", "api")]
    nodes = table(spark, [node("a", "load_user", summary="reads a user"), node("b", "x/y thing"), node("c", "user", deleted_at=1)])
    tags = spark.createDataFrame([("a", "io", "system")], "node_id string, tag string, source string")
    edges = spark.createDataFrame([("b", "a", "CALLS", 1.0)], EDGES)
    assert [(r["id"], r["caller_count"]) for r in search.facade(nodes, tags, edges, "user").collect()] == [("a", 1)]
    assert [r["id"] for r in search.facade(nodes, tags, edges, "x/y").collect()] == ["b"]
    assert [(r["id"], r["score"]) for r in search.facade(nodes, tags, edges, "tag:io").collect()] == [("a", 1.0)]
    passages = spark.createDataFrame([(1, "one two three four five six seven"), (2, "two three")], "item_id long, passage string")
    texts = spark.createDataFrame([(10, "x one two three four five six seven y"), (11, "none"), (12, None)], "id long, text string")
    assert sorted(tuple(r) for r in search.containing(texts, passages).collect()) == [(1, 10), (2, 10)]
