"""Blocks of TypeScript and Java, calls and what is noted of them, registered languages, the index and its commands."""

import json

import pytest
from pyspark.sql import functions as F

from basalt.__main__ import run
from basalt.plans.index import Store, edges_of, index, texts
from basalt.sources import braces, files, notes, parsers

SCRIPT = """import {x} from "y"; /* class Not {} */
export class Box<T> extends Base {
  handler = async (e) => { this.go(e) }
  constructor(private a: string) { super(); helper(a) }
  async go({a, b}, c = {}): Promise<void> {
    if (a) { for (const q of b) { await this.load(q) } }
    return new Thing(a)
  }
}
export function helper<T>(v: T): T { console.log(v); return inner(v, () => { deep("a(b)") }) }
const inner = (v) => outer(v)
const outer: (x: number) => void = async (x) => { [1].map(y => helper(y)); }
type Alias = { a: number }
interface I { f(x: number): void }
app.get("/x", (req) => { helper(req) })
const o = { m(x) { return helper(x) } }
"""
JAVA = """package a.b;
@Service("x")
public class Box<T extends Foo> implements Runnable {
  Runnable r = new Runnable() { public void run() { go(); } };
  public Box(int a) { this(a, 1); init(a); }
  @GetMapping("/x")
  Map<String, List<T>> go(int x) throws IOException, Foo {
    if (x > 1) { while (true) { l.add("}"); } }
    return other.load(new Item<String>(x), helper());
  }
  abstract int helper();
  static class Item<Q> { Item(int x) { } }
  enum Color { RED(1) { }, BLUE(2); Color(int v) { } }
  record P(int a) { int twice() { return dbl(a); } }
}
@interface Mark { }
interface Shape { double area(); default double two() { return area(); } }
"""


def test_blocks_of_scripts():
    found = {(d.kind, d.name, d.parents) for d in braces.read(SCRIPT, "typescript").declared}
    assert found == {
        ("class", "Box", ()), ("function", "handler", ("Box",)), ("method", "constructor", ("Box",)), ("method", "go", ("Box",)),
        ("function", "helper", ()), ("function", "inner", ()), ("function", "outer", ()), ("type", "Alias", ()), ("interface", "I", ()),
    }
    calls = [c[:5] for c in braces.calls(braces.read(SCRIPT, "typescript")) if not notes.is_noise(c[2], "typescript")]
    assert calls == [
        ("handler", 3, "go", "method", 0.8), ("constructor", 4, "helper", "direct", 1.0), ("go", 5, "load", "method", 0.8), ("helper", 10, "inner", "direct", 1.0),
        ("helper", 10, "deep", "direct", 1.0), ("inner", 11, "outer", "direct", 1.0), ("outer", 12, "helper", "direct", 1.0),
    ]
    go = next(d for d in braces.read(SCRIPT, "typescript").declared if d.name == "go")
    assert go.nesting == 2


def test_blocks_of_java():
    found = [(d.kind, ".".join((*d.parents, d.name))) for d in braces.read(JAVA, "java").declared]
    assert found == [
        ("class", "Box"), ("method", "Box.Box"), ("method", "Box.go"), ("method", "Box.helper"), ("class", "Box.Item"), ("method", "Box.Item.Item"), ("enum", "Box.Color"),
        ("method", "Box.Color.Color"), ("class", "Box.P"), ("method", "Box.P.twice"), ("interface", "Mark"), ("interface", "Shape"), ("method", "Shape.area"), ("method", "Shape.two"),
    ]
    calls = [(c[0], c[2], c[3], c[4]) for c in braces.calls(braces.read(JAVA, "java")) if not notes.is_noise(c[2], "java")]
    assert calls == [("Box", "init", "direct", 1.0), ("go", "load", "method", 1.0), ("go", "Item", "new", 0.8), ("go", "helper", "direct", 1.0), ("twice", "dbl", "direct", 1.0), ("two", "area", "direct", 1.0)]


@pytest.mark.parametrize("text", ["", "}}}", "{{{", "class", "((((", "'", "function f(", "class A { m(", "/* x", "a\n" * 1000, "(" * 500 + ")" * 500])
@pytest.mark.parametrize("language", ["typescript", "java"])
def test_broken_sources_give_rows(language, text):
    braces.calls(braces.read(text, language))
    assert parsers.parse_text("f", language, text)[0][2] == "file"


def test_python_calls_without_noise():
    text = "def f(x):\n    y = [go(\n        a) for a in x]\n    x.append(len(y))\n    x.run()()\n\n\ngo(1)\n"
    assert [c[2:] for c in parsers.python_calls("a.py", text)] == [("f", 1, "go", "direct", 1.0, 2, "y = [go(\n        a) for a in x]"), ("f", 1, "run", "method", 0.8, 5, "x.run()()")]


def test_hints_and_notes():
    assert notes.framework_hint(["other", "api.app.route", "task"]) == "flask_route"
    assert notes.framework_hint(["x.task"]) is None and notes.framework_hint([]) is None
    text = "@app.get('/a')\nasync def f():\n    yield 1\n@dataclass\nclass A[T]:\n    def m(self):\n        with open('f') as g:\n            subprocess.run(g)\n"
    rows = {r[3]: (r[13], json.loads(r[11]).get("framework_hint")) for r in parsers.parse_text("a.py", "python", text)}
    assert rows["f"] == ("async generator, Flask/FastAPI route", "fastapi_route")
    assert rows["A"][0] == "generic type, dataclass, subprocess management, file I/O" and rows["m"][0] == "subprocess management, file I/O"
    assert notes.text_notes("go", "f", "func f(c chan int) (int, error) {\n  go run()\n  return 1, err\n}") == "goroutine, channel I/O, error-returning"
    assert notes.text_notes("rust", "f", "async fn f<T>(x: T) {}") == "async, generic" and notes.text_notes("kotlin", "A", "data class A(val x: Int)") == "data class"
    assert notes.text_notes("typescript", "useState", "function useState() {}") == "React hook" and notes.text_notes("typescript", "use", "function use() {}") is None


def test_calls_resolve_by_language(spark):
    table = spark.createDataFrame(
        [
            ("a.ts", "typescript", "function f() { g(); h(); both() }\nfunction g() {}\nfunction both() {}\nclass C { both() {} }"),
            ("b.ts", "typescript", "function h() {}"),
            ("a.py", "python", "def f():\n    g()\n    far()\n    many()\n"),
            ("b.py", "python", "def g():\n    pass\ndef far():\n    pass\ndef many():\n    pass\n"),
            ("c.py", "python", "class K:\n    def far(self):\n        pass\ndef many():\n    pass\n"),
            ("n.py", "python", None),
        ],
        "path string, language string, text string",
    )
    got = {(r["path"], r["callee"], r["callee_path"], r["ambiguous"]) for r in parsers.resolve_calls(parsers.call_sites(table), parsers.parse_files(table)).collect()}
    assert got == {("a.ts", "g", "a.ts", False), ("a.py", "g", "b.py", False), ("a.py", "far", "b.py", False), ("a.py", "many", "b.py", True), ("a.py", "many", "c.py", True)}
    edges = edges_of(parsers.parse_files(table.where("false")), parsers.call_sites(table.where("false")), "p")
    assert edges.count() == 0


def test_a_language_is_registered(spark):
    before = dict(files.LANGUAGES)
    try:
        parsers.register("lines", lambda path, text: [parsers.symbol(path, "lines", "function", t, i + 1, i + 1, length=len(t)) for i, t in enumerate(text.split("\n"))], (".lin",))
        table = spark.createDataFrame([("x.lin", "a\nbb")], "path string, text string").withColumn("language", files.language(F.col("path")))
        assert [(r["name"], r["symbol"], r["metadata"]) for r in parsers.parse_files(table).where("kind = 'function'").collect()] == [("a", "a", '{"length": 1}'), ("bb", "bb", '{"length": 2}')]
    finally:
        parsers.REGISTERED.clear()
        files.LANGUAGES.clear()
        files.LANGUAGES.update(before)


def test_index_sync_and_commands(spark, tmp_path):
    root, store = tmp_path / "src", f"file://{tmp_path}/store"
    for name, text in {"lib/auth.py": "def login(u):\n    return check(u)\n\n\ndef check(u):\n    return u\n", "tests/test_auth.py": "from lib import auth\n\n\ndef test_login():\n    assert login(1)\n", "old.py": "def gone():\n    pass\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    run(spark, ["index", str(root), "--store", f"{store}/1", "--project", "p"])
    one = Store(spark, f"{store}/1")
    assert {(r["from_id"], r["to_id"]) for r in one.edges.where("kind = 'CALLS'").collect()} == {("function:p:lib/auth.py:login", "function:p:lib/auth.py:check"), ("function:p:tests/test_auth.py:test_login", "function:p:lib/auth.py:login")}
    assert {r["to_id"]: r["confidence"] for r in one.edges.where("kind = 'TESTED_BY'").collect()} == {"function:p:lib/auth.py:login": 1.0, "function:p:lib/auth.py:check": 0.6}  # path and import; login's name and call too
    assert "tested" in {r["tag"] for r in one.tags.where("node_id = 'function:p:lib/auth.py:login'").collect()}
    (root / "old.py").unlink()
    (root / "lib" / "more.py").write_text("def audit():\n    return check(2)\n")
    run(spark, ["sync", str(root), "--store", f"{store}/2", "--from", f"{store}/1", "--project", "p"])
    two = Store(spark, f"{store}/2")
    assert {r["id"] for r in two.nodes.where("deleted_at is not null").collect()} == {"file:p:old.py", "function:p:old.py:gone"}
    assert {r["from_id"] for r in two.edges.where("kind = 'CALLS' and to_id = 'function:p:lib/auth.py:check'").collect()} == {"function:p:lib/auth.py:login", "function:p:lib/more.py:audit"}
    say = lambda *words: run(spark, [*words, "--store", f"{store}/2"])
    assert [r["id"] for r in say("callers", "function:p:lib/auth.py:login").collect()] == ["function:p:tests/test_auth.py:test_login"]
    assert [r["id"] for r in say("path", "function:p:tests/test_auth.py:test_login", "function:p:lib/auth.py:check").orderBy("step").collect()][1] == "function:p:lib/auth.py:login"
    assert "function:p:lib/auth.py:check" in {r["id"] for r in say("search", "check").collect()}
    for command in ("stats", "dead", "hubs", "primer", "architecture", "export"):
        assert say(command).count() >= 0
    with pytest.raises(SystemExit):
        say("callers")
    with pytest.raises(ValueError):
        index(texts(files.scan(spark, str(root))), two.root, "p", 1, two)


def test_an_agents_summary_stays_and_empty_tables_index(spark, tmp_path):
    table = spark.createDataFrame([("a.py", "python", "def f():\n    pass\n", "s1", 1), ("n.py", "python", None, "s2", 1)], "path string, language string, text string, content_sha string, mtime_ns long")
    one = index(table, f"file://{tmp_path}/1", "p", 10)
    written = one.nodes.withColumns({c: F.when(F.col("kind") == "function", F.lit(v)).otherwise(F.col(c)) for c, v in (("summary", "by hand"), ("summary_author", "agent"), ("summary_hash", "h"))})
    other = Store(spark, f"file://{tmp_path}/2")
    for name in ("fingerprints", "heads", "symbols", "sites", "edges", "tags"):
        other.put(name, getattr(one, name))
    other.put("nodes", written)
    three = index(table.withColumn("content_sha", F.lit("s3")).withColumn("text", F.lit("\ndef f():\n    return 1\n")), f"file://{tmp_path}/3", "p", 20, other)
    assert [(r["summary"], r["summary_author"], r["summary_hash"], r["updated_at"]) for r in three.nodes.where("kind = 'function' and path = 'a.py'").collect()] == [("by hand", "agent", "h", 20)]
    assert index(table.where("false"), f"file://{tmp_path}/4", "p", 1).nodes.count() == 0
