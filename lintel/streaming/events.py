"""Events as a stream: decided without a join, their traces added once for each batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.engine import trace_results
from ..sources import shared
from ..sources.logs import sorted_json


def stream_events(spark: SparkSession, path: str, platform: str = "claude") -> DataFrame:
    """(ord, platform, raw) of a folder to which files of payloads are added, one payload a line. ord: a hash of the
    file's name and the payload, since a stream has no places; equal payloads of a file share it."""
    return spark.readStream.text(path).select(F.xxhash64("_metadata.file_path", "value").alias("ord"), F.lit(platform).alias("platform"), F.col("value").alias("raw"))


def batch_folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch:012d}"


def commit_batch(lines: DataFrame, batch: int, path: str) -> bool:
    """Adds a batch's lines to a trace, once: they are written aside and the folder is then given the batch's name. A name
    that is there already says that the batch is in, so one that is run again adds nothing, and one that broke off while it
    was written left nothing that a reader sees. False where the batch was in.

    The rename must be atomic, as it is on HDFS and on local disks."""
    spark = lines.sparkSession
    if shared.exists(spark, batch_folder(path, batch)):
        return False
    aside = f"{path}/_aside/{batch}-{uuid.uuid4().hex}"
    lines.write.text(aside)
    if shared.moved(spark, aside, batch_folder(path, batch)):
        return True
    shared.delete(spark, aside)
    return False


def trace_stream(decided: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A query that adds the activity-log rows of a stream of decided events to a trace. A trace is one query's own: batches are
    numbered by its checkpoint."""

    def add(batch: DataFrame, number: int) -> None:
        commit_batch(batch.select(sorted_json(batch).alias("value")), number, path)

    return trace_results(decided).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value) of all batches that are in."""
    return spark.read.schema("value string, batch long").text(path) if shared.children(spark, path) else spark.createDataFrame([], "value string, batch long")
