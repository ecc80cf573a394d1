"""Lists that git gives of a repository, as rows: files, changed files, commits. Git runs on the driver.

Lists of files and commits of one repository are small next to its contents, which Spark reads.
"""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources.files import is_skipped, language

#: Seconds that git may take.
TIMEOUT = 30
_REF = re.compile(r"[0-9A-Za-z._/~^@{}-]+")


def _git(root: str, *args: str) -> bytes | None:
    """What git prints, None if the folder is no repository or git isn't there."""
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, timeout=TIMEOUT, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def _checked(ref: str) -> str:
    if not _REF.fullmatch(ref) or ref.startswith("-"):
        raise ValueError(f"not a reference: {ref!r}")
    return ref


def _paths(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "path string")


def listed_files(spark: SparkSession, root: str) -> DataFrame | None:
    """path, language of tracked and untracked files that aren't ignored; None if it is no repository."""
    raw = _git(root, "ls-files", "-z", "-co", "--exclude-standard")
    if raw is None:
        return None
    rows = _paths(spark, [p.decode("utf-8", "replace") for p in raw.split(b"\0") if p]).distinct()
    return rows.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~is_skipped(F.col("path")))


def ignore_rules(root: str) -> list[tuple[str, bool, str]]:
    """(folder, whether the rule takes back, pattern) of all ignore files, those of outer folders first."""
    out = []
    for file in sorted(Path(root).rglob(".gitignore"), key=lambda f: len(f.parts)):
        folder = file.parent.relative_to(root).as_posix().removeprefix(".")
        for line in file.read_text(encoding="utf-8", errors="replace").splitlines():
            rule = line.strip()
            if rule and not rule.startswith("#"):
                out.append((folder, rule.startswith("!"), rule.removeprefix("!")))
    return out


def rule_pattern(folder: str, rule: str) -> str:
    """A regular expression over paths below the root for a rule of an ignore file."""
    anchored = "/" in rule.rstrip("/")
    body, only_folder = rule.strip("/"), rule.endswith("/")
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", body)
    regex = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
    base = re.escape(folder) + "/" if folder else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{regex}{'/.*' if only_folder else '(?:/.*)?'}$"


def not_ignored(files: DataFrame, rules: list[tuple[str, bool, str]]) -> DataFrame:
    """Files (path) that the rules leave: the last rule that fits decides."""
    ignored = F.lit(False)
    for folder, back, rule in rules:
        ignored = F.when(F.col("path").rlike(rule_pattern(folder, rule)), F.lit(not back)).otherwise(ignored)
    return files.where(~ignored)


def changed_files(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """path of files that differ between two commits."""
    raw = _git(root, "diff", "-z", "--name-only", _checked(old), _checked(new))
    if raw is None:
        raise ValueError("git cannot compare these commits")
    return _paths(spark, [p.decode("utf-8", "replace") for p in raw.split(b"\0") if p])


def commits(spark: SparkSession, root: str, months: int = 6) -> DataFrame:
    """(commit, ts, file) of the last months of 30 days."""
    raw = _git(root, "log", f"--since={months * 30}.days", "--name-only", "--no-renames", "--pretty=format:%x01%H %ct") or b""
    rows = []
    for block in raw.decode("utf-8", "replace").split("\x01")[1:]:
        head, *names = block.splitlines()
        commit, ts = head.split()
        rows += [(commit, int(ts), n) for n in names if n]
    return spark.createDataFrame(rows, "commit string, ts long, file string")
