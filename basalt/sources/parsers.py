"""Parsers: rows (path, language, text) to symbols and calls, in Arrow batches.

Python is read with `ast`, HTML with `html.parser`, XML, JSON, TOML, INI, properties and YAML keys with the
standard library or line rules; TypeScript, JavaScript and Java by their blocks (`braces`), other languages
with patterns of declarations.
A file that can't be parsed gives a row with an error instead of symbols.
"""

from __future__ import annotations

import ast
import configparser
import hashlib
import json
import re
import tomllib
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources import braces, files, notes

SYMBOLS = "path string, language string, kind string, name string, parent string, start_line int, end_line int, decorators array<string>, branches int, nesting int, doc string, metadata string, error string, notes string, symbol string, span_hash string"
CALLS = "path string, language string, caller string, caller_line int, callee string, form string, confidence double, line int, context string"
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Match)


def _row(path, language, kind, name, parent=None, start=None, end=None, decorators=(), branches=None, nesting=None, doc=None, metadata=None, error=None, notes=None):
    return (path, language, kind, name, parent, start, end, list(decorators), branches, nesting, doc, json.dumps(metadata or {}, sort_keys=True), error, notes)


def _dotted(node) -> str:
    if isinstance(node, ast.Call):
        node = node.func
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id if isinstance(node, ast.Name) else ""])).strip(".")


def _depth(node, level=0) -> int:
    deeper = [_depth(c, level + isinstance(c, _BRANCH[:7])) for c in ast.iter_child_nodes(node)]
    return max([level, *deeper])


def python_symbols(path: str, text: str) -> list[tuple]:
    rows, lines = [], text.split("\n")

    def add(kind, node, parents, **more):
        decorators = [_dotted(d) for d in node.decorator_list]
        hint = notes.framework_hint(decorators)
        facts = more.pop("metadata") | ({"framework_hint": hint} if hint else {})
        own = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        rows.append(_row(path, "python", kind, node.name, ".".join(parents) or None, node.lineno, node.end_lineno, decorators, doc=ast.get_docstring(node), metadata=facts, notes=notes.python_notes(node, own), **more))

    def walk(node, parents, in_class):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                add("class", child, parents, metadata={"bases": [_dotted(b) for b in child.bases]})
                walk(child, [*parents, child.name], True)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                meta = {"params": [a.arg for a in child.args.args], "is_async": isinstance(child, ast.AsyncFunctionDef)}
                if child.returns is not None:
                    meta["return_type"] = ast.unparse(child.returns)
                add("method" if in_class else "function", child, parents, branches=sum(isinstance(x, _BRANCH) for x in ast.walk(child)), nesting=_depth(child), metadata=meta)
                walk(child, [*parents, child.name], in_class)
            else:
                walk(child, parents, in_class)

    walk(ast.parse(text), [], False)
    return rows


def python_calls(path: str, text: str) -> list[tuple]:
    """Calls in functions: f() is sure (1.0), o.f() less so (0.8); computed callees and noise are left out."""
    rows, lines = [], text.split("\n")

    def walk(node, owner, statement):
        for child in ast.iter_child_nodes(node):
            inner = child if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) else owner
            around = child if isinstance(child, ast.stmt) else statement
            if isinstance(child, ast.Call) and owner:
                form, name = ("direct", child.func.id) if isinstance(child.func, ast.Name) else ("method", child.func.attr) if isinstance(child.func, ast.Attribute) else (None, None)
                if form and not notes.is_noise(name, "python"):
                    context = "\n".join(lines[around.lineno - 1 : around.end_lineno]).strip()[:200]
                    rows.append((path, "python", owner.name, owner.lineno, name, form, 1.0 if form == "direct" else 0.8, child.lineno, context))
            walk(child, inner, around)

    walk(ast.parse(text), None, None)
    return rows


def block_symbols(path: str, language: str, text: str) -> list[tuple]:
    """Symbols of TypeScript, JavaScript and Java."""
    source, rows = braces.read(text, language), []
    for d in source.declared:
        callable_ = d.kind in ("function", "method")
        facts = {"params_text": _params(source.text, d)} if callable_ else {}
        rows.append(_row(path, language, d.kind, d.name, ".".join(d.parents) or None, source.line(d.start), source.line(max(d.start, d.end - 1)), branches=braces.branches(source, d) if callable_ else None, nesting=d.nesting if callable_ else None, metadata=facts, notes=notes.text_notes(language, d.name, text[d.start : d.end])))
    return rows


def _params(text: str, d: braces.Declared) -> str:
    """What stands in the first parentheses after a name."""
    m = re.compile(r"[^({]*\(([^()]*)\)").match(text, d.named)
    return " ".join(m[1].split()) if m else ""


# Declarations of other languages: (kind, pattern with a group `name`).
DECLARATIONS = {
    "go": (("method", r"^func\s+\([^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)"), ("class", r"^type\s+(?P<name>\w+)\s+struct"), ("interface", r"^type\s+(?P<name>\w+)\s+interface")),
    "rust": (("function", r"\bfn\s+(?P<name>\w+)"), ("class", r"\b(?:struct|enum)\s+(?P<name>\w+)"), ("interface", r"\btrait\s+(?P<name>\w+)")),
    "kotlin": (("function", r"\bfun\s+(?P<name>\w+)"), ("class", r"\b(?:class|object)\s+(?P<name>\w+)")),
    "ruby": (("class", r"^\s*(?:class|module)\s+(?P<name>\w+)"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)")),
    "csharp": (("class", r"\b(?:class|struct|record)\s+(?P<name>\w+)"), ("interface", r"\binterface\s+(?P<name>\w+)"), ("method", r"^\s+(?:(?:public|protected|private|internal|static|async|override|virtual)\s+)+[\w<>\[\], ?]+\s+(?P<name>\w+)\s*\(")),
    "php": (("class", r"\b(?:class|trait)\s+(?P<name>\w+)"), ("interface", r"\binterface\s+(?P<name>\w+)"), ("function", r"\bfunction\s+(?P<name>\w+)")),
    "cpp": (("class", r"\b(?:class|struct)\s+(?P<name>\w+)\s*[:{]"), ("function", r"^[\w:<>*&\s]+?\b(?P<name>[\w:~]+)\s*\([^;]*\)\s*(?:const\s*)?\{")),
}
BLOCKS = ("java", *braces.SCRIPTS)


def _closing(lines: list[str], at: int) -> int:
    """Line in which the braces opened from line `at` on are closed."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened = opened or "{" in lines[i]
        if opened and depth <= 0:
            return i + 1
        if not opened and i > at + 3:
            break
    return at + 1


def declared_symbols(path: str, language: str, text: str) -> list[tuple]:
    lines, rows = text.split("\n"), []
    patterns = [(k, re.compile(p)) for k, p in DECLARATIONS[language]]
    for i, line in enumerate(lines):
        for kind, p in patterns:
            if (m := p.search(line)) and not line.lstrip().startswith(("//", "*", "#")):
                end = _closing(lines, i)
                body = "\n".join(lines[i:end])
                rows.append(_row(path, language, kind, m["name"], None, i + 1, end, branches=len(re.findall(r"\b(?:if|for|while|case|catch)\b", body)), notes=notes.text_notes(language, m["name"], body)))
                break
    return rows


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.in_title = "", False
        self.scripts, self.styles, self.forms, self.ids, self.links, self.custom = [], [], 0, [], 0, set()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.in_title = tag == "title"
        if tag == "script" and a.get("src"):
            self.scripts.append(a["src"])
        if tag == "link" and "stylesheet" in (a.get("rel") or ""):
            self.styles.append(a.get("href") or "")
        self.forms += tag == "form"
        self.links += tag == "a"
        if a.get("id"):
            self.ids.append((tag, a["id"], self.getpos()[0]))
        if "-" in tag:
            self.custom.add(tag)

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title += data


def html_facts(text: str) -> dict:
    page = _Page()
    page.feed(text)
    return {"title": page.title.strip(), "scripts": page.scripts, "stylesheets": page.styles, "forms": page.forms, "links": page.links, "ids": [i for _, i, _ in page.ids], "custom_elements": sorted(page.custom)}


def config_facts(language: str, text: str) -> dict:
    """Facts of markup and configuration files: keys, sections, counts."""
    if language == "json":
        data = json.loads(text)
        return {"keys": list(data)[:20]} if isinstance(data, dict) else {"array_size": len(data)} if isinstance(data, list) else {}
    if language == "xml":
        root = ElementTree.fromstring(text)
        return {"root_tag": root.tag.rsplit("}", 1)[-1], "elements": sum(1 for _ in root.iter())}
    if language == "toml":
        data = tomllib.loads(text)
        project = data.get("project") or data.get("tool", {}).get("poetry", {})
        return {"sections": list(data), "name": project.get("name"), "version": project.get("version"), "dependencies": sorted(project.get("dependencies", [])) if project else []}
    if language == "ini":
        parser = configparser.ConfigParser(strict=False, interpolation=None)
        parser.read_string(text)
        return {"sections": parser.sections(), "keys": sum(len(parser[s]) for s in parser.sections())}
    if language in ("properties", "env"):
        keys = [m[1] for m in re.finditer(r"(?m)^\s*(?:export\s+)?([\w.\-]+)\s*[=:]", text)]
        return {"keys": len(keys), "sensitive": sorted({k for k in keys if re.search(r"(?i)password|secret|token|key", k)}), "database": any(re.search(r"(?i)datasource|database|db_", k) for k in keys)}
    if language == "yaml":
        return {"keys": re.findall(r"(?m)^([\w\-]+):", text)}
    if language == "css":
        return {"classes": len(set(re.findall(r"\.([A-Za-z_][\w\-]*)\s*[{,:.\s]", text))), "ids": len(set(re.findall(r"#([A-Za-z_][\w\-]*)\s*[{,:]", text))), "media": len(re.findall(r"@media\b", text)), "variables": len(set(re.findall(r"(--[\w\-]+)\s*:", text)))}
    return html_facts(text) if language == "html" else {}


#: Parsers that a user adds: language -> function (path, text) to rows made by `symbol`. Sent to workers with the job.
REGISTERED: dict[str, Callable[[str, str], list[tuple]]] = {}


def register(language: str, parser: Callable[[str, str], list[tuple]], extensions: tuple[str, ...] = ()) -> None:
    """Add a language, or another parser of a known one; files with these extensions count as of that language."""
    REGISTERED[language] = parser
    files.LANGUAGES.update(dict.fromkeys(extensions, language))


def symbol(path: str, language: str, kind: str, name: str, start: int, end: int, parent: str | None = None, **facts) -> tuple:
    """A row for a registered parser to return."""
    return _row(path, language, kind, name, parent, start, end, metadata=facts)


def _symbols(path: str, language: str, text: str, added: dict) -> list[tuple]:
    if language in added:
        return added[language](path, text)
    if language == "python":
        return python_symbols(path, text)
    return block_symbols(path, language, text) if language in BLOCKS else declared_symbols(path, language, text) if language in DECLARATIONS else []


def _finished(row: tuple, lines: list[str]) -> tuple:
    """The row with its name within the file (a class has its bare name) and the hash of its lines."""
    kind, name, parent, start, end = row[2:7]
    inner = f"{parent}.{name}" if parent and kind != "class" else name
    return (*row, "" if kind == "file" else inner, hashlib.sha256("\n".join(lines[start - 1 : end]).encode("utf-8", "surrogatepass")).hexdigest())


def parse_text(path: str, language: str, text: str, added: dict | None = None) -> list[tuple]:
    """Rows of a file: the file itself with its facts, then its symbols; `added` parsers come first."""
    lines = text.split("\n")
    file = (path, language, "file", path.rsplit("/", 1)[-1], None, 1, len(lines))
    try:
        rows = [_row(*file, metadata=config_facts(language, text)), *_symbols(path, language, text, added or {})]
    except (SyntaxError, ValueError, RecursionError, ElementTree.ParseError, configparser.Error) as e:
        rows = [_row(*file, error=f"{type(e).__name__}: {e}"[:200])]
    return [_finished(r, lines) for r in rows]


_COLUMNS = [c.split()[0] for c in SYMBOLS.split(", ")]


#: Files that a task parses.
TASK_FILES = 10_000


def dealt(files: DataFrame) -> DataFrame:
    """The files over as many tasks as they need: a small table of many files has few partitions of its own."""
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // TASK_FILES))
    return files.repartition(tasks, "path")


def parse_files(table: DataFrame) -> DataFrame:
    """Symbols of a table (path, language, text)."""
    added = dict(REGISTERED)

    def run(batches):
        for b in batches:
            rows = [r for p, lang, t in zip(b["path"], b["language"], b["text"], strict=True) for r in parse_text(p, lang, t or "", added)]
            frame = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("start_line", "end_line", "branches", "nesting"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return dealt(table.select("path", "language", "text")).mapInPandas(run, SYMBOLS)


def _call_rows(path: str, language: str, text: str) -> list[tuple]:
    if language == "python":
        return python_calls(path, text)
    return [(path, language, *c) for c in braces.calls(braces.read(text, language)) if not notes.is_noise(c[2], language)]


def call_sites(table: DataFrame) -> DataFrame:
    """Calls of the Python, TypeScript, JavaScript and Java files of a table (path, language, text)."""

    def run(batches):
        for b in batches:
            rows = []
            for p, lang, t in zip(b["path"], b["language"], b["text"], strict=True):
                try:
                    rows += _call_rows(p, lang, t or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue  # the file's row in parse_files has the error
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CALLS.split(", ")])

    return dealt(table.where(F.col("language").isin("python", *BLOCKS)).select("path", "language", "text")).mapInPandas(run, CALLS)


_SITE = ["path", "language", "caller", "caller_line", "callee", "form", "confidence"]


def resolve_calls(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row for each caller, callee and form, with the callee's path and line and the last call's statement.

    Other languages look in the same file and take a name that only one symbol has. Python looks in the same
    file first, then at all names of Python files; where several fit equally, each has a row that says `ambiguous`. Only calls
    that their own file can't settle are joined by name. Parsed rows are many more than their files' size says, so no
    side is broadcast by it.
    """
    calls = sites.groupBy(*_SITE).agg(F.max_by("context", "line").alias("context")).withColumn("site", F.struct(*_SITE))
    targets = symbols.where("kind in ('function', 'method', 'class')").select(F.col("name").alias("callee"), F.col("path").alias("callee_path"), F.col("start_line").alias("callee_line"), F.col("kind").alias("callee_kind"), F.col("language").alias("target_language")).distinct().hint("merge")
    near = calls.join(targets.withColumnRenamed("callee_path", "path"), ["path", "callee"]).withColumn("callee_path", F.col("path"))
    alone = F.count("*").over(Window.partitionBy("site"))
    blocks = near.where("language <> 'python' and (callee_kind <> 'class' or language = 'java')").withColumn("n", alone).where("n = 1").withColumn("ambiguous", F.lit(False))
    python = calls.where("language = 'python'").join(near.select("site").distinct().hint("merge"), "site", "left_anti").join(targets.where("target_language = 'python'"), "callee")
    python = python.unionByName(near.where("language = 'python'"), allowMissingColumns=True)
    fits = F.when(F.col("form") == "method", F.col("callee_kind") == "method").otherwise(F.col("callee_kind") != "method").cast("int")
    python = python.withColumn("r", F.rank().over(Window.partitionBy("site").orderBy(F.desc(fits)))).where("r = 1").withColumn("ambiguous", alone > 1)
    columns = [*_SITE, "context", "callee_path", "callee_line", "ambiguous"]
    return blocks.select(*columns).unionByName(python.select(*columns))
