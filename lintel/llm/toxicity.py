"""Toxicity scores of whole texts by a bidirectional gated recurrent network (gru.py), over all overlapping windows.

The network is fitted by one task on a bounded sample of labelled documents: of each label at most `fit_docs`
documents, those of at most `fit_chars` characters first, in the order of a hash of doc_id, and at most fit_docs x fit_chars
characters in all (one document at least), never from the held-out fifth. Every document is then scored whole, whatever its
length; only its text is an input of the score.

Null counts as empty; a text without words scores as one without evidence. Repeated rows get equal scores. Labels
that are null are not learned from. Where either label is missing, all texts score the smoothed share of label 1 (0.25
without labels). Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import gru
from .common import slices, table, trimmed


def held_out(c: Column, fold: int = 5, at: int = 0) -> Column:
    return F.coalesce(F.crc32(c.cast("string")) % fold == at, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = 1200, fit_chars: int = 6000, seed: int = 11) -> gru.Model:
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~held_out(F.col("id")))
    own = own.withColumn("order", F.xxhash64("id", F.lit(seed)))
    have = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # of each label the ids with the lowest hashes, about twice fit_docs of them: a share that shrinks as labels grow
    share = {y: int(((min(1.0, 2 * fit_docs / n) * 2) - 1) * (2**63 - 1)) for y, n in have.items()}
    ids = own.where(" OR ".join(f"(y = {y} AND order <= {s})" for y, s in share.items()) or "false")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.length(text_col).alias("chars")).where("chars > 0").join(F.broadcast(ids.dropDuplicates(["id", "y"])), "id")
    # shorter texts first; longer ones are learned from whole, as many as there is room for
    by = W.partitionBy("y").orderBy(F.col("chars") > fit_chars, "order", "id", F.xxhash64("text"))
    first = rows.select("id", "y", "order", "chars", "text").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= fit_docs)
    room = F.sum("chars").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    got = first.withColumn("used", room).where((F.col("used") <= fit_docs * fit_chars) | (F.col("nth") == 1)).select("y", "nth", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        model = gru.fit(pc.utf8_lower(pa.array([t for *_, t in rows], pa.string())), np.array([y for y, *_ in rows], np.int64), seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        del rows, model
        trimmed()

    made = got.repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(made[0].model) if made else gru.fit(pa.array([], pa.string()), np.zeros(0, np.int64), seed=seed)


def score(docs: DataFrame, model: gru.Model, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 1_000_000) -> DataFrame:
    """(doc_id, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: at most 2^15 words, 2^12 n-gram vectors, 2^17 odds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                text = gru.read(pc.utf8_lower(part.column("text").fill_null("")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(gru.scores(sent.value, text), pa.float64())], names=["doc_id", "score"])
        trimmed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5, text_col: str = "text", slice_bytes: int = 1_000_000) -> DataFrame:
    """The documents that are not rejected, with their own columns; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, slice_bytes):
                text = gru.read(pc.utf8_lower(part.column(text_col).fill_null("")))
                yield part.filter(pa.array(gru.scores(sent.value, text) < limit))
        trimmed()

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
