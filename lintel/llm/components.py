"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations over edges; a hot vertex's edges are grouped by a minimum first (pre-aggregated on the
map side) and only then joined. Loops and repeated edges change nothing; an empty table has no components. Rounds are cut by tables in the shared folder, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's neighbours (large: only those above it; small: only those below) to its smallest one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(low, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (v, root): root is the smallest vertex reachable from v, for every v of an edge but roots."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        nxt = written(_star(_star(now, True), False), "edges")
        dropped(now)
        now = nxt
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        mark = tuple(seen)
