"""Findings made more helpful by facts of the project: lookups only, each a left join or a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname

LEVELS, MOST_FIXTURES = 10, 10
#: Advice by checker code.
ADVICE = {
    "arg-type": "The argument has another type: narrow it or add an overload.",
    "return-value": "Narrow the returned type or check before returning.",
    "assignment": "Widen the annotation or restructure the assignment.",
    "union-attr": "Use isinstance() before reading the attribute.",
    "override": "Match the parent's signature.",
    "no-untyped-def": "Annotate the parameters and the result.",
}


def suppression_advice(text: Column) -> Column:
    """Advice for the first known code in a suppression, NULL without one."""
    return F.coalesce(*(F.when(text.contains(code), F.lit(f"{code}: {hint}")) for code, hint in ADVICE.items()))


def ancestors(path: Column, levels: int = LEVELS) -> Column:
    """Directories above a path, nearest first, at most `levels`, '' for the root."""
    parts = F.filter(F.split(dirname(path), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(levels - 1))), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))


def visible_fixtures(tests: DataFrame, facts: DataFrame) -> DataFrame:
    """tests (path) -> (path, fixtures): names from conftest.py of the directories above, nearest first, each once, at most ten."""
    own = facts.where("kind = 'fixture' AND (path = 'conftest.py' OR endswith(path, '/conftest.py'))").select(dirname(F.col("path")).alias("dir"), F.col("name").alias("fixture"), "line")
    asked = tests.select("path", F.posexplode(ancestors(F.col("path"))).alias("level", "dir")).join(own, "dir")
    nearest = asked.groupBy("path", "fixture").agg(F.min(F.struct("level", "line")).alias("at"))
    ranked = nearest.selectExpr("*", "row_number() OVER (PARTITION BY path ORDER BY at, fixture) AS nth").where(F.col("nth") <= MOST_FIXTURES)
    return ranked.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "fixture"))), lambda x: x.fixture).alias("fixtures"))


def with_function_facts(findings: DataFrame, facts: DataFrame, kinds: tuple[str, ...] = ("complexity", "span", "params", "nesting")) -> DataFrame:
    """findings (path, name, …) with a map of the function's measures; of equal names the first in the file."""
    f = facts.where(F.col("kind").isin(*kinds)).groupBy("path", "name", "kind").agg(F.min_by("value", "line").alias("value"))
    m = f.groupBy("path", "name").agg(F.map_from_entries(F.collect_list(F.struct("kind", "value"))).alias("measures"))
    return findings.join(m, ["path", "name"], "left")


def metrics(before: DataFrame, after: DataFrame, key: str = "ord") -> DataFrame:
    """How many findings enrichment saw and changed, from message columns before and after."""
    both = before.select(key, F.col("message").alias("old")).join(after.select(key, F.col("message").alias("new")), key)
    return both.agg(F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("changed"))
