"""TypeScript, JavaScript and Java by their blocks: one pass over brackets gives declarations, spans and calls.

Strings and comments are blanked first, so every bracket left is code. What stands between the last end of
a statement and an opening brace is that block's head; with the contents of its parentheses blanked too, the
head tells a class, a function, a named arrow function or a control block. Not seen: calls inside template
strings, and regular expression literals that hold quotes or brackets.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

SCRIPTS = ("typescript", "tsx", "javascript")

_QUIET = re.compile(r'"""(?s:.*?)"""|//[^\n]*|/\*(?s:.*?)\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\(?s:.)|[^`\\])*`')
_BRACKET = re.compile(r"[(){}\[\];]|\n(?=\s*[\w$@#'\"`}])")
_PARENS = re.compile(r"\([^()]*\)")
_CONTROL = re.compile(r"\b(?:if|else|for|while|switch|do|try|catch|finally)\s*§*\s*$")
_BRANCH = re.compile(r"\b(?:if|for|while|switch|case|try|catch)\b|\s\?\s")
_NAME = r"(?P<name>[\w$]+)"
_RESULT = r"\s*(?::[^;=]*)?"  # the result's type
_FUNCTION = r"function\b\s*\*?\s*[\w$]*\s*(?:<[^§]*>)?\s*§+" + _RESULT
_ARROW = r"(?:<[^§]*>\s*)?(?:§+|[\w$]+)" + _RESULT + r"=>\s*"
_SCRIPT_HEADS = [
    (None, re.compile(r"\b(?P<kind>class|interface|enum)\s+" + _NAME + r"[^;={}]*$")),
    ("function", re.compile(r"\b(?:const|let|var)\s+" + _NAME + r"\s*(?::[^;]*?)?=(?!>)\s*(?:async\s+)?(?:" + _FUNCTION + "|" + _ARROW + ")$")),
    ("function", re.compile(r"(?<![\w$.])" + _NAME + r"\s*=(?!>)\s*(?:async\s+)?(?:" + _FUNCTION + "|" + _ARROW + ")$")),
    ("function", re.compile(r"\bfunction\b\s*\*?\s*" + _NAME + r"\s*(?:<[^§]*>)?\s*§+" + _RESULT + "$")),
]
_SCRIPT_METHOD = re.compile(r"(?<![\w$.])" + _NAME + r"\s*(?:<[^§]*>)?\s*§+" + _RESULT + "$")
_SHORT_ARROW = re.compile(r"\b(?:const|let|var)\s+" + _NAME + r"\s*(?::[^=;\n]*)?=\s*(?:async\s+)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=;{}\n]*)?=>\s*(?=[^\s{])")
_ALIAS = re.compile(r"(?m)^[^\S\n]*(?:export\s+)?(?:declare\s+)?type\s+" + _NAME + r"\s*(?:<[^=\n]*>)?\s*=(?!=)")
_JAVA_TYPE = re.compile(r"(?:(?<![@\w.])(?P<kind>class|record|enum|interface)|@interface)\s+" + _NAME + r"[^;=]*$")
_JAVA_METHOD = re.compile(r"(?<![\w$.])" + _NAME + r"\s*§+\s*(?:throws\s+[\w.,\s]+)?$")
_CALL = re.compile(r"(?P<at>@\s*)?(?:(?<![\w$])new\s+(?P<made>[\w$.]+)\s*(?:<[^()]*?>)?|(?P<dot>\.\s*)?(?<![\w$#])(?P<name>[\w$]+)(?:<[\w$,.\[\]| ]+>)?)\s*\(")
# Words before a parenthesis that call nothing by name.
_NO_CALLS = frozenset("if for while switch catch function return typeof await super this import new do else try throw async synchronized assert case in of delete void yield instanceof".split())
_TYPES = ("class", "interface", "enum")
# Kinds of the types that Java declares.
_JAVA_KINDS = {"class": "class", "record": "class", "enum": "enum", "interface": "interface", None: "interface"}


@dataclass
class Declared:
    kind: str
    name: str
    start: int
    named: int
    end: int = 0
    parents: tuple[str, ...] = ()
    nesting: int = 0


@dataclass
class _Open:
    char: str
    head: int
    declared: Declared | None = None
    control: bool = False


@dataclass
class Source:
    text: str
    language: str
    code: str = ""
    declared: list[Declared] = field(default_factory=list)
    not_calls: set[int] = field(default_factory=set)
    #: Where statements begin or end.
    bounds: list[int] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _flat(head: str) -> str:
    """The head with each outermost pair of parentheses, and what it holds, as marks of the same length."""
    again = 1
    while again:
        head, again = _PARENS.subn(lambda m: "§" * len(m[0]), head)
    return head


def _java_method(head: str, owner: str) -> re.Match | None:
    """The name before the parameters: a result's type stands before it, or it is the type's own name."""
    m = _JAVA_METHOD.search(head) if "=" not in head else None
    if m is None:
        return None
    before = head[: m.start()].rstrip()
    typed = before[-1:].isalnum() or before[-1:] in ("_", ">", "]")
    return m if m["name"] == owner or (typed and not re.search(r"\bnew$", before)) else None


def _declared(source: Source, head: str, at: int, owner: Declared | None) -> Declared | None:
    """What a block's head, which begins at `at`, declares."""
    inside = owner is not None and owner.kind in _TYPES
    if source.language == "java":
        start = at + len(head) - len(head.lstrip())
        if m := _JAVA_TYPE.search(head):
            return Declared(_JAVA_KINDS[m["kind"]], m["name"], start, at + m.start("name"))
        m = _java_method(head, owner.name) if inside else None
        return Declared("method", m["name"], start, at + m.start("name")) if m else None
    for kind, pattern in _SCRIPT_HEADS:
        if m := pattern.search(head):
            return Declared(kind or m["kind"], m["name"], at + m.start(), at + m.start("name"))
    m = _SCRIPT_METHOD.search(head)
    if m is None or m["name"] in _NO_CALLS:
        return None
    source.not_calls.add(at + m.start("name"))
    return Declared("method", m["name"], at + m.start("name"), at + m.start("name")) if inside else None


def _expression_end(code: str, at: int) -> int:
    """Where the expression at `at` ends: a semicolon, a line's end or a bracket that it didn't open."""
    depth = 0
    for m in re.compile(r"[(){}\[\];\n]").finditer(code, at):
        c = m[0]
        if depth == 0 and c in ";\n)}]":
            return m.start()
        depth += (c in "([{") - (c in ")]}")
    return len(code)


def read(text: str, language: str) -> Source:
    """Declarations of a file in the order of their names, with their spans."""
    source = Source(text, language, _QUIET.sub(_blank, text))
    source.lines = [m.start() for m in re.finditer("\n", text)]
    code, stack, head = source.code, [], 0
    for m in _BRACKET.finditer(code):
        c, at = m[0], m.start()
        owner = stack[-1].declared if stack and stack[-1].char == "{" else None
        if c in "{};" or (c == "\n" and language != "java" and not (stack and stack[-1].char in "([")):
            source.bounds.append(at)
        if c == "\n":
            continue
        if c == "{":
            flat = _flat(code[head:at])
            new = _declared(source, flat, head, owner)
            block = _Open(c, head, new, new is None and bool(_CONTROL.search(flat)))
            if new:
                new.parents = tuple(o.declared.name for o in stack if o.declared)
                source.declared.append(new)
            stack.append(block)
            if block.control:
                depth = 0
                for o in reversed(stack):
                    depth += o.control
                    if o.declared:
                        o.declared.nesting = max(o.declared.nesting, depth)
            head = at + 1
        elif c in "([":
            stack.append(_Open(c, head))
            head = at + 1
        elif c in ")]":
            if stack and stack[-1].char in "([":
                head = stack.pop().head
        elif c == "}":
            while stack and stack[-1].char != "{":
                stack.pop()
            if stack and (done := stack.pop().declared):
                done.end = at + 1
            head = at + 1
        else:
            if language == "java" and owner is not None and owner.kind in _TYPES and (n := _java_method(flat := _flat(code[head:at]), owner.name)):
                start = head + len(flat) - len(flat.lstrip())
                source.declared.append(Declared("method", n["name"], start, head + n.start("name"), at + 1, tuple(o.declared.name for o in stack if o.declared)))
            if not stack or stack[-1].char == "{":
                head = at + 1
    for d in source.declared:
        d.end = d.end or len(text)
    if language in SCRIPTS:
        for m in _SHORT_ARROW.finditer(code):
            source.declared.append(Declared("function", m["name"], m.start(), m.start("name"), _expression_end(code, m.end())))
        if language != "javascript":
            for m in _ALIAS.finditer(code):
                source.declared.append(Declared("type", m["name"], m.start() + len(m[0]) - len(m[0].lstrip()), m.start("name"), _expression_end(code, m.end())))
    source.declared.sort(key=lambda d: (d.named, -d.end))
    return source


def branches(source: Source, d: Declared) -> int:
    return len(_BRANCH.findall(source.code[d.start : d.end]))


def _statement(source: Source, at: int) -> str:
    """The statement around a call, 200 characters at most."""
    k = bisect_right(source.bounds, at)
    start = source.bounds[k - 1] + 1 if k else 0
    end = source.bounds[k] if k < len(source.bounds) else len(source.text)
    return source.text[start:end].strip()[:200]


def calls(source: Source) -> list[tuple[str, int, str, str, float, int, str]]:
    """(caller, its line, callee, form, confidence, line, statement) of calls inside named functions.

    Scripts: f() is sure (1.0), o.f() less so (0.8), `new` is no call. Java: methods are sure, `new` has 0.8.
    """
    owners = [d for d in source.declared if d.kind in ("function", "method")]
    names = source.not_calls | {d.named for d in source.declared}
    out, inside, k = [], [], 0
    for m in _CALL.finditer(source.code):
        made = m["made"]
        at = m.start("made") if made else m.start("name")
        while k < len(owners) and owners[k].named <= at:
            inside.append(owners[k])
            k += 1
        while inside and inside[-1].end <= at:
            inside.pop()
        name = made.rsplit(".", 1)[-1] if made else m["name"]
        if m["at"] or at in names or not inside or not name or name[0].isdigit():
            continue
        if made:
            if source.language != "java":
                continue
            form, sure = "new", 0.8
        elif m["dot"]:
            form, sure = "method", 1.0 if source.language == "java" else 0.8
        elif name in _NO_CALLS:
            continue
        else:
            form, sure = "direct", 1.0
        owner = inside[-1]
        out.append((owner.name, source.line(owner.start), name, form, sure, source.line(at), _statement(source, at)))
    return out
