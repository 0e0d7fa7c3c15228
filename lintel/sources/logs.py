"""JSON-lines logs: scan with dense row numbers, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import scratch

MOST_SPLITS = 1 << 21  # of which a row of 40 bytes each goes to every worker
PLACE = (1 << 33) - 1  # the bits of a generated id that count the rows of a partition


def split_counts(lines: DataFrame) -> DataFrame:
    """(split, part, first, n, before) of each split of a scan: its rows are the n from place `first` of partition `part`, and
    `before` are in the splits that stand before it in order of file and place."""
    found = lines.groupBy("file", "block").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a split
    return found.select(F.xxhash64("file", "block").alias("split"), F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND(PLACE).alias("first"), "n", before.alias("before"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): one row per line; ord counts all lines from 0, file after file in order of their names.

    One pass counts the lines of each split, and their sums are added to the places that lines have in theirs, so nothing is
    sorted or moved. The scan is the same both times while the session's settings for splits are; a row that stands elsewhere
    the second time raises."""
    pinned = "spark.sql.files.minPartitionNum"  # else the number of cores, which may change in between
    if not spark.conf.get(pinned, None):
        spark.conf.set(pinned, str(spark.sparkContext.defaultParallelism))
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    kept = scratch(spark, "splits")
    split_counts(t).write.parquet(kept)
    splits = spark.read.parquet(kept)
    n, distinct = splits.agg(F.count(F.lit(1)), F.count_distinct("split")).first()
    if n != distinct:
        raise ValueError("two splits have one hash")
    rows = t.withColumn("split", F.xxhash64("file", "block"))
    rows = rows.join(F.broadcast(splits) if n <= MOST_SPLITS else splits, "split", "left")
    place = F.col("row").bitwiseAND(PLACE) - F.col("first")
    as_counted = (F.shiftright("row", 33) == F.col("part")) & (place >= 0) & (place < F.col("n"))
    return rows.select(F.when(F.coalesce(as_counted, F.lit(False)), F.col("before") + place).otherwise(F.raise_error(F.lit("the log is split otherwise than when it was counted")).cast("long")).alias("ord"), "value")


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def sorted_json(df: DataFrame):
    """One JSON object a row, keys in order."""
    return F.to_json(F.struct(*sorted(df.columns)))


def append_log(df: DataFrame, path: str) -> None:
    df.select(sorted_json(df).alias("value")).write.mode("append").text(path)


def read_events(spark: SparkSession, path: str, platform: str = "claude") -> DataFrame:
    """(ord, platform, raw): one event a file."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.monotonically_increasing_id().alias("ord"), F.lit(platform).alias("platform"), F.col("value").alias("raw"))


def replayed(log: DataFrame, platform: str = "claude") -> DataFrame:
    """(ord, platform, raw) of a log of payloads: one event a line."""
    return log.select("ord", F.lit(platform).alias("platform"), F.col("value").alias("raw"))
