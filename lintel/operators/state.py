"""Per-session state in batch: look-back over spans of time instead of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TTL_SECONDS = 3600


def known_full_reads(reads: DataFrame, keys: tuple[str, ...] = ("session", "path"), ttl: int = TTL_SECONDS) -> DataFrame:
    """reads (keys, ord, at: epoch seconds, full) plus `known`: a full read of the keys came before, at most ttl seconds ago.

    Time is cut in spans of ttl seconds. A full read before a row in its own span is young enough, so the span's first one
    tells; of the span before only the last one can be; older ones cannot. Two values of each key and span are what rows
    meet, so a key of many rows is met in as many places as it has spans, and rows and full reads are never paired off.
    Rows of the same second count by `ord`. Null keys are equal."""
    width = max(ttl, 1)
    of = lambda c: (c - F.pmod(c, F.lit(width))).alias("span")
    names = {k: f"key_{i}" for i, k in enumerate(keys)}
    renamed = [F.col(k).alias(n) for k, n in names.items()]
    full = reads.where("full").select(*renamed, of(F.col("at").cast("long")), "at", "ord")
    none = F.lit(None)
    own = full.select(*names.values(), "span", F.struct("at", "ord").alias("first"), none.cast("long").alias("last"))
    after = full.select(*names.values(), (F.col("span") + width).alias("span"), none.cast(own.schema["first"].dataType).alias("first"), F.col("at").cast("long").alias("last"))
    known = own.unionByName(after).groupBy(*names.values(), "span").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    rows = reads.select(F.struct(*reads.columns).alias("own"), *renamed, of(F.col("at").cast("long")))
    known = known.select(*(F.col(n).alias(f"k_{n}") for n in names.values()), F.col("span").alias("k_span"), "first", "last")
    same = F.col("span") == F.col("k_span")
    for n in names.values():
        same = same & F.col(n).eqNullSafe(F.col(f"k_{n}"))
    met = rows.join(known, same, "left")
    before = F.col("first") < F.struct(F.col("own.at").alias("at"), F.col("own.ord").alias("ord"))
    recent = F.col("last") >= F.col("own.at") - ttl
    return met.select("own.*", (F.coalesce(before, F.lit(False)) | F.coalesce(recent, F.lit(False))).alias("known"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: a reminder given once a session."""
    return rows.selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) AS nth").where("nth = 1").drop("nth")


def repeat_counts(rows: DataFrame, keys: list[str], order: str, reset: str) -> DataFrame:
    """Rows that are no reset with `n`: how often the key came up since its last reset. The third escalates."""
    w = W.partitionBy(*keys).orderBy(order)
    island = F.sum(F.col(reset).cast("int")).over(w)
    out = rows.withColumn("island", island).where(~F.col(reset))
    return out.withColumn("n", F.row_number().over(W.partitionBy(*keys, "island").orderBy(order))).withColumn("escalates", F.col("n") >= 3).drop("island")
