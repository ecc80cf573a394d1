"""Source files as rows: a scan that keeps registered formats and leaves out skipped folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language of each registered extension.
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".html": "html", ".htm": "html", ".xml": "xml", ".cxml": "xml", ".json": "json", ".css": "css",
    ".yaml": "yaml", ".yml": "yaml", ".properties": "properties", ".toml": "toml", ".ini": "ini", ".env": "env", ".go": "go", ".rs": "rust", ".kt": "kotlin", ".kts": "kotlin", ".rb": "ruby", ".rake": "ruby", ".cs": "csharp",
    ".php": "php", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".h": "cpp", ".c": "cpp",
}
# Folders left out; those that begin with a dot are too.
SKIPPED = ("node_modules", "__pycache__", "venv", "dist", "build", "target", "vendor")


def language(path: Column) -> Column:
    """Language by extension; `.env*` files by name; minified files and others have none."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(name.rlike(r"\.min\.(js|css)$"), F.lit(None).cast("string")).when(F.startswith(name, F.lit(".env")), "env").otherwise(F.try_element_at(table, extension))


def is_skipped(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda p: p.isin(*SKIPPED) | (F.startswith(p, F.lit(".")) & (F.length(p) > 1)))


def scan(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path (below the root), language, content, modified and length of registered files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace("path", f"^.*?{base}/", "")
    out = files.select(path.alias("path"), language(path).alias("language"), "content", F.col("modificationTime").alias("modified"), "length")
    out = out.where(F.col("language").isNotNull() & ~is_skipped(F.col("path")))
    return out.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*skip))) if skip else out


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("content_sha"), (F.unix_micros("modified") * 1000).alias("mtime_ns"))


def import_lines(text: Column, most: int = 60) -> Column:
    """Lines among the first `most` that import something."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, most), lambda s: F.trim(s))  # a bare F.trim would take the index as its characters
    return F.array_join(F.filter(lines, lambda s: s.rlike(r"^(import |from |#include|using )") | F.contains(s, F.lit("require("))), "\n")
