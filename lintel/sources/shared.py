"""Folders that driver and executors share, and moves in them, on any file system that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only for a local master that names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lintel-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def matched(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or a pattern of paths, names anything."""
    fs, p = _fs(spark, pattern)
    return bool(fs.globStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def moved(spark: SparkSession, old: str, new: str) -> bool:
    """Renames a folder, once the folders above are there. False, and nothing is changed, where the new name is taken."""
    fs, p = _fs(spark, new)
    if fs.exists(p):
        return False
    fs.mkdirs(p.getParent())
    return fs.rename(spark._jvm.org.apache.hadoop.fs.Path(old), p)
