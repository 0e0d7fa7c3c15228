"""Violations against a frozen baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(rule: Column, path: Column, identifier: Column, detail: Column) -> Column:
    return F.concat_ws("|", rule, path, identifier, F.nullif(detail, F.lit("")))


def new_violations(current: DataFrame, base: DataFrame) -> DataFrame:
    """Rows (not ids) of `current` whose id the baseline does not hold under the rule: repeats all appear."""
    return current.join(base, ["rule", "stable_id"], "left_anti")


def fixed_ids(current: DataFrame, base: DataFrame) -> DataFrame:
    """Ids of the baseline, each once, that no violation has any more."""
    return base.select("rule", "stable_id").distinct().join(current, ["rule", "stable_id"], "left_anti")


def tally(current: DataFrame, base: DataFrame, max_new: int = 0, generating: bool = False) -> DataFrame:
    """(rule, current_count, baseline_count, new_count, fixed_count, passed) for rules with a violation now. While a baseline
    is being generated nothing is compared: every rule passes with counts of zero but its own."""
    count = lambda df, name: df.groupBy("rule").agg(F.count(F.lit(1)).alias(name))
    if generating:
        zero = F.lit(0).cast("long")
        return count(current, "current_count").select("rule", "current_count", zero.alias("baseline_count"), zero.alias("new_count"), zero.alias("fixed_count"), F.lit(True).alias("passed"))
    out = count(current, "current_count").join(base.groupBy("rule").agg(F.count_distinct("stable_id").alias("baseline_count")), "rule", "left")
    out = out.join(count(new_violations(current, base), "new_count"), "rule", "left").join(count(fixed_ids(current, base), "fixed_count"), "rule", "left").na.fill(0)
    return out.withColumn("passed", F.col("new_count") <= max_new)


def increases(new: DataFrame, old: DataFrame) -> DataFrame:
    """(rule, old_count, new_count) for rules whose list of ids (repeats count) grew; a missing list has none."""
    count = lambda df, name: df.groupBy("rule").agg(F.count(F.lit(1)).alias(name))
    return count(new, "new_count").join(count(old, "old_count"), "rule", "left").na.fill(0).where("new_count > old_count").select("rule", "old_count", "new_count")


def passed(tallied: DataFrame) -> DataFrame:
    """One row: exit code 0 if no rule has new violations."""
    return tallied.agg(F.coalesce(F.max((F.col("new_count") > 0).cast("int")), F.lit(0)).alias("exit_code"))


def short_hash(c: Column, n: int = 8) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))
