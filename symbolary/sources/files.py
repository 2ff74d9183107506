"""Scans of source and prose files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIP_DIRS = ("__pycache__", "build", "dist", "node_modules", "venv", ".git", ".tox", ".venv")
DOC_SKIP_DIRS = ("_build", "site-packages", "node_modules", ".git")
#: Extensions and languages; .h is read as C++.
LANGUAGES = {
    ".bash": "bash", ".c": "c", ".c++": "cpp", ".cc": "cpp", ".cjs": "javascript", ".cpp": "cpp", ".cs": "csharp", ".cts": "typescript", ".cxx": "cpp", ".go": "go", ".h": "cpp", ".h++": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".java": "java", ".js": "javascript", ".jsx": "javascript", ".kt": "kotlin", ".kts": "kotlin", ".lua": "lua", ".mjs": "javascript", ".mts": "typescript", ".php": "php", ".py": "python", ".rake": "ruby", ".rb": "ruby", ".rs": "rust",
    ".sh": "bash", ".swift": "swift", ".ts": "typescript", ".tsx": "typescript",
}
DOC_EXTENSIONS = (".markdown", ".md", ".pdf", ".rst", ".txt")


def _folders_fine(path, skip):
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return ~F.exists(folders, lambda f: f.isin(*skip) | F.startswith(f, F.lit(".")))


def code_paths(files: DataFrame, extensions: dict[str, str] = LANGUAGES) -> DataFrame:
    """The rows whose path (relative) is code: a known extension, no type declaration, no skipped or hidden folder."""
    low = F.lower("path")
    extension = F.regexp_extract(low, r"[^/](\.[^./]+)$", 1)
    declares = low.rlike(r"\.d\.[mc]?ts$")
    return files.where(extension.isin(*extensions) & ~declares & _folders_fine(F.col("path"), SKIP_DIRS))


def doc_paths(files: DataFrame) -> DataFrame:
    """The rows whose path (relative) is prose."""
    return files.where(F.regexp_extract(F.lower("path"), r"[^/](\.[^./]+)$", 1).isin(*DOC_EXTENSIONS) & _folders_fine(F.col("path"), SKIP_DIRS + DOC_SKIP_DIRS))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), source of every file under a folder of any file system that Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://", 1)[-1]
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^.*?" + "\\Q" + "/" + base.lstrip("/") + "/" + "\\E", "")
    return raw.select(path.alias("path"), "content").select("path", F.expr("decode(content, 'UTF-8')").alias("source"))
