"""Source trees as tables of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..functions.paths import basename

#: Directories that hold no code of one's own.
EXCLUDED = [".git", ".venv", "venv", "__pycache__", "node_modules", "build", "dist", ".tox", ".nox", ".mypy_cache", ".pytest_cache", "site-packages"]


def read_tree(spark: SparkSession, root: str, exclude_dirs: list[str] | None = None, exclude_files: list[str] | None = None, scope: DataFrame | None = None, suffix: str = ".py", most_bytes: int | None = None) -> DataFrame:
    """(path relative to root, source, is_test): text files below root. Bytes that are no UTF-8 are replaced. Empty
    files, in which nothing can be found, have no row.

    scope (path): only these files, a semi-join. most_bytes drops larger files before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    full = F.regexp_replace("path", "^file:/+", "/")
    rel = F.regexp_replace(full, "^" + glob_regex(root.rstrip("/")).removeprefix("(?s)^").removesuffix(r"\z") + "/", "")
    out = files.select(rel.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"))
    parts = F.split(F.col("path"), "/")
    out = out.where(~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*(EXCLUDED if exclude_dirs is None else exclude_dirs))))
    for g in exclude_files or []:
        out = out.where(~basename(F.col("path")).rlike(glob_regex(g)))
    if scope is not None:
        out = out.join(scope.select("path").distinct(), "path", "left_semi")
    return out.withColumn("is_test", F.col("path").rlike(r"(?:^|/)tests?/") | basename(F.col("path")).rlike(r"^(?:test_.*|.*_test|conftest)\.py$"))
