"""What is noted of symbols: names that are no calls worth an edge, framework hints, notes on language features."""

from __future__ import annotations

import ast
import re

# Methods of Python's own types whose calls are left out, with the built-in functions.
_PYTHON_METHODS = (
    "append extend insert remove pop clear index count sort reverse copy get keys values items update setdefault popitem add discard union intersection "
    "difference symmetric_difference issubset issuperset isdisjoint split join strip lstrip rstrip replace startswith endswith find rfind upper lower "
    "capitalize title swapcase encode decode format format_map ljust rjust center zfill expandtabs isalnum isalpha isascii isdecimal isdigit isidentifier "
    "islower isnumeric isprintable isspace istitle isupper read write close flush seek tell readline readlines writelines"
)
# Built-in functions and types whose calls are left out.
_PYTHON_BUILTINS = (
    "abs aiter all any anext ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate eval exec "
    "filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview min next "
    "object oct open ord pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip __import__"
)
# Common methods of Java.
_JAVA = "toString hashCode equals getClass notify notifyAll wait clone finalize size isEmpty contains add remove clear put get stream map filter forEach collect of valueOf println print format"
# Common methods of JavaScript and TypeScript.
_SCRIPT = "push pop shift unshift slice splice map filter reduce forEach find some every includes indexOf join then catch finally keys values entries assign parse stringify log warn error debug"

NOISE = {
    "python": frozenset(_PYTHON_BUILTINS.split()) | frozenset(_PYTHON_METHODS.split()),
    "java": frozenset(_JAVA.split()),
    "javascript": frozenset(_SCRIPT.split()),
    "typescript": frozenset(_SCRIPT.split()),
    "tsx": frozenset(_SCRIPT.split()),
}

# Decorators and the framework feature that they tell.
HINTS = {
    "app.route": "flask_route",
    "app.get": "fastapi_route",
    "app.post": "fastapi_route",
    "app.put": "fastapi_route",
    "app.delete": "fastapi_route",
    "app.patch": "fastapi_route",
    "router.get": "fastapi_route",
    "router.post": "fastapi_route",
    "router.put": "fastapi_route",
    "router.delete": "fastapi_route",
    "router.patch": "fastapi_route",
    "login_required": "django_auth",
    "permission_required": "django_auth",
    "require_http_methods": "django_view",
    "csrf_exempt": "django_view",
    "api_view": "drf_view",
    "action": "drf_action",
    "task": "celery_task",
    "shared_task": "celery_task",
}

# Beginnings of decorators, for notes.
_ROUTES = ("app.route", "router.", "app.get", "app.post", "app.put", "app.delete", "app.patch")
_COMMANDS = ("click.command", "app.command", "typer.command")
_TASKS = ("celery.task", "shared_task")


def is_noise(name: str, language: str) -> bool:
    return name in NOISE.get(language, ())


def framework_hint(decorators: list[str]) -> str | None:
    """Hint of the first decorator that has one, as written or by its last two parts."""
    found = (HINTS.get(d) or ("." in d and HINTS.get(".".join(d.split(".")[-2:]))) for d in decorators)
    return next((h for h in found if h), None)


def _listed(rules: list[tuple[bool, str]]) -> str | None:
    return ", ".join(note for holds, note in rules if holds) or None


def python_notes(node: ast.AST, source: str) -> str | None:
    """Notes on a function or class; `source` is its text without decorators, whose texts are read from the tree."""
    decorators = [ast.unparse(d) for d in node.decorator_list]
    within = list(ast.walk(node))
    says = lambda *words: any(w in d for w in words for d in decorators)
    begins = lambda words: any(d.startswith(words) for d in decorators)
    waits, yields = "async def" in source, "yield" in source
    return _listed(
        [
            (waits and yields, "async generator"),
            (waits and not yields, "async function"),
            (says("contextmanager"), "context manager"),
            (any(getattr(x, "type_params", None) for x in within), "generic type"),
            (says("dataclass"), "dataclass"),
            (says("attrs", "define"), "attrs class"),
            (begins(_ROUTES), "Flask/FastAPI route"),
            (begins(_COMMANDS), "CLI command"),
            (begins(_TASKS), "Celery task"),
            (sum(isinstance(x, ast.Try | ast.TryStar) for x in within) >= 3, "heavy error handling"),
            ("subprocess" in source, "subprocess management"),
            ("open(" in source and any(isinstance(x, ast.With | ast.AsyncWith) for x in within), "file I/O"),
        ]
    )


def text_notes(language: str, name: str, source: str) -> str | None:
    """Notes on a symbol of another language, by its text."""
    head = re.split(r"[({]", source, maxsplit=1)[0]
    generic = bool(re.search(r"<[^=]*>\s*$", head.rstrip()))
    if language in ("typescript", "tsx", "javascript"):
        return _listed([("async" in source, "async/await"), (bool(re.match(r"\s*(?:export\s+)?(?:async\s+)?function\s*\*", source)), "generator"), (generic, "generic function"), (name.startswith("use") and len(name) > 3, "React hook")])
    if language == "go":
        return _listed([(bool(re.search(r"(?m)(?:^|[;{])\s*go\s+[\w.]+", source)), "goroutine"), (bool(re.search(r"\bchan\b", source)), "channel I/O"), (any(w in source for w in (" err", "error)", ", error")), "error-returning")])
    if language == "rust":
        return _listed([(bool(re.search(r"\basync\s+fn\b", source)), "async"), (bool(re.search(r"\bunsafe\s+fn\b", source)), "unsafe"), (generic, "generic")])
    if language == "kotlin":
        return _listed([("suspend " in source[:64], "suspend function"), ("data class" in source[:80], "data class"), ("sealed class" in source[:80], "sealed class")])
    return None
