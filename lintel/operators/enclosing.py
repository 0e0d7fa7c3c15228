"""Settings of the nearest enclosing folder: a longest-prefix join of paths.

A path has as many ancestors as it has parts, so a path meets its roots by equality, at any depth and without comparing
paths in pairs. Only distinct paths are expanded; events then meet their path's row, whose number does not follow theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import glob_regex


def folder(path: Column) -> Column:
    """A path without slashes at its end; the topmost folder is ''."""
    return F.regexp_replace(path, "/+$", "")


def ancestors(path: Column) -> Column:
    """array<string>: the folders that hold a path, from the topmost one to itself. A relative path is in no topmost folder."""
    parts = F.split(folder(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def nearest(rows: DataFrame, roots: DataFrame, path: str = "cwd", root: str = "root", priority: str | None = None) -> DataFrame:
    """rows plus `found`, a struct of the columns of the nearest root at or above `path`, NULL where there is none.

    Of rows of one root the one with the lowest priority counts, then the first as JSON text. Paths are compared as they are
    written, but for slashes at their end. Null paths and null roots meet nothing."""
    own = F.struct(*(F.col(f"`{c}`") for c in roots.columns))
    order = F.struct(F.col(priority) if priority else F.lit(0), F.to_json(own))
    one = roots.where(F.col(root).isNotNull()).groupBy(folder(F.col(root)).alias("at")).agg(F.min_by(own, order).alias("own"))
    paths = rows.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct()
    up = paths.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "at"))
    best = up.join(one, "at").groupBy("path").agg(F.max_by("own", "depth").alias("found"))
    kept = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(path).alias("of"))
    return kept.join(best, F.col("of") == F.col("path"), "left").select("row.*", "found")


def skipped(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs as a whole; case counts and `*` crosses slashes."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return F.coalesce(out, F.lit(False))


def enrolment(rows: DataFrame, repos: DataFrame, skip_paths: list[str], path: str = "cwd") -> DataFrame:
    """rows plus the facts `enrolled`, `repo_disabled` and `skipped` of evaluate_events. repos: (root, disabled)."""
    out = nearest(rows, repos.select("root", F.coalesce("disabled", F.lit(False)).alias("disabled")), path)
    at = F.col("found.root")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), at.isNotNull().alias("enrolled"), F.coalesce("found.disabled", F.lit(False)).alias("repo_disabled"), (at.isNotNull() & skipped(folder(at), skip_paths)).alias("skipped"))
