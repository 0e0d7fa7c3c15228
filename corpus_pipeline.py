"""A training corpus from the documents table: toxic documents go, then exact and near copies, sources are mixed to
target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. A document that the mixing stage repeats stands there once for
each copy; one whose count is 0 is out of this epoch of the mixture. Once a stage is written, all that it and those before
it left in the shared folder is deleted.

Null and empty texts score as ones without evidence and are one group of exact copies. Rows that repeat an id are documents
of their own until a copy of their text or a near copy stays in their place; of equal rows one stays. Documents with
null ids lose to any other of their group and share one draw of the mixture. Texts of any length are read whole. Whatever
other columns the table has come back as they were. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintel.llm import bpe, exact_dedup, mixing, simhash, toxicity
from lintel.llm.common import made, released, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.vocabulary_path(), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]

#: SQL expresses neither the network's scores nor fingerprints and encoding; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), made()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
            released(spark, since, docs)
    return docs
