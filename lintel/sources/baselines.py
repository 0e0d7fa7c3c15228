"""Baselines: files that people commit, {schema_version, generated_at, rules: {rule: sorted ids}}, and tables of any size.

A table is a folder of versions, each a folder of files of rows. A version is written aside and gets its number by a rename,
so readers see the one before until it is whole, and a writer that breaks off leaves that one in force."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SCHEMA = "schema_version int, generated_at string, rules map<string,array<string>>"
IDS, ROWS = "rule string, stable_id string", "schema_version int, generated_at string, rule string, stable_id string"
VERSION = 1


def parse_baseline(texts: DataFrame) -> DataFrame:
    """(value: JSON text) -> (rule, stable_id). Any version but 1 raises."""
    b = texts.select(F.from_json("value", SCHEMA).alias("b")).select("b.*")
    ok = F.when(F.col("schema_version") == VERSION, F.col("rules")).otherwise(F.raise_error(F.concat(F.lit("baseline version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing")), F.lit(f", expected {VERSION}"))))
    return b.select(F.explode(ok).alias("rule", "ids")).select("rule", F.explode("ids").alias("stable_id"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(rule, stable_id) of a file or of a pattern of files; a missing one is empty."""
    if not shared.matched(spark, path):
        return spark.createDataFrame([], IDS)
    return parse_baseline(spark.read.text(path, wholetext=True))


def baseline_json(violations: DataFrame, generated_at: str) -> DataFrame:
    """(rule, stable_id) -> one row of JSON text, rules and ids in order, ids once. A baseline is a file that people
    commit: the one place where all ids come together."""
    per = violations.groupBy("rule").agg(F.array_sort(F.collect_set("stable_id")).alias("ids"))
    rules = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "ids")))).alias("rules"))
    return rules.select(F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit(generated_at).alias("generated_at"), "rules")).alias("value"))


def write_baseline(violations: DataFrame, path: str, generated_at: str) -> None:
    baseline_json(violations, generated_at).coalesce(1).write.mode("overwrite").text(path)


# --- tables


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(x.removeprefix("version=")) for x in shared.children(spark, path) if x.startswith("version="))


def version_folder(path: str, version: int) -> str:
    return f"{path}/version={version:09d}"


def commit_baseline(violations: DataFrame, path: str, generated_at: str, after: int | None = None, keep: int = 2) -> int:
    """Writes (rule, stable_id) as the next version, ids once, and gives its number. Of more than `keep` versions the oldest go.

    after: the version that the violations were compared with; if another one is in force by now, this raises, so of two
    writers that began from one version only the first gets through. The rename must be atomic."""
    spark = violations.sparkSession
    now = versions(spark, path)
    last = now[-1] if now else 0
    if after is not None and after != last:
        raise ValueError(f"version {last} is in force, not {after}")
    aside = f"{path}/_aside/{uuid.uuid4().hex}"
    rows = violations.select("rule", "stable_id").distinct()
    rows.select(F.lit(VERSION).alias("schema_version"), F.lit(generated_at).alias("generated_at"), "rule", "stable_id").write.parquet(aside)
    if not shared.moved(spark, aside, version_folder(path, last + 1)):
        shared.delete(spark, aside)
        raise ValueError(f"version {last + 1} was taken meanwhile")
    for old in [*now, last + 1][:-keep]:
        shared.delete(spark, version_folder(path, old))
    return last + 1


def committed_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(rule, stable_id) of the version in force; empty where there is none. Rows of another layout than VERSION raise."""
    now = versions(spark, path)
    if not now:
        return spark.createDataFrame([], IDS)
    b = spark.read.schema(ROWS).parquet(version_folder(path, now[-1]))
    ok = F.when(F.col("schema_version") == VERSION, F.col("rule")).otherwise(F.raise_error(F.concat(F.lit("baseline version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing")), F.lit(f", expected {VERSION}"))))
    return b.select(ok.alias("rule"), "stable_id")
