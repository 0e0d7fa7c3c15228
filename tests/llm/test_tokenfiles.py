"""op12: the encoder against the library, and the files against the documents they were made of."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintel.llm import tokenfiles as tf
from lintel.llm.bpe import vocabulary_path
from lintel.llm.common import scratch

ODD = ["", " ", "  ", "a", " a", "a  b", "a \n b", "\n", "a  b", "a   b", "  lead", "trail  ", "don't 's", "x<|endoftext|>y z", "<|endoftext|>", "é à", "\x1c \x1d a", "日本 語", "🙂 🙂", "1 2  3\t4", "\r\n \r\n", "a\x85 b", "　 a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def same(library, texts):
    ids, n = tf.encoder(vocabulary_path())(pa.array(texts, pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder(library, spark):
    same(library, ODD)
    same(library, [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()])
    rng = random.Random(5)
    same(library, ["".join(rng.choice([" ", " ", "\n", " ", "a", "B", "é", "'s", "1", "-", "<|endoftext|>"]) for _ in range(rng.randrange(30))) for _ in range(400)])
    ids, n = tf.encoder(vocabulary_path())(pa.array([], pa.string()))
    assert len(ids) == 0 and len(n) == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_encoder_on_any_text(library, texts):
    same(library, [t.encode("utf-8", "replace").decode() for t in texts])


def test_shifted():
    rng = random.Random(3)
    for n in (0, 1, 7, 300, 70_000):
        a, b = rng.randbytes(20), rng.randbytes(n)
        assert tf.shifted(zlib.crc32(a), n) ^ zlib.crc32(b) == zlib.crc32(a + b)


def plain(library, rows):
    out, at = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table(library, spark):
    from lintel.llm.tokenfiles import op12_token_files

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in op12_token_files(spark, "/root/testdata/sf0.001").collect())
    assert got == plain(library, sorted((r.doc_id, r.text) for r in docs.collect()))


def test_odd_rows(library, spark):
    rows = [(None, "none"), (3, "same"), (3, "same"), (2, None), (1, ""), (9, "long word " * 30_000)] + [(10 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(t, i, 1, 2) for i, t in rows], "text string, doc_id long, part int, `at` int")
    path = scratch(spark, "ids")
    tf.write_ids(df, path, vocabulary_path(), piece=1000)
    got = sorted((tuple(r) for r in tf.documents(spark, path).collect()), key=lambda r: r[1])
    assert got == plain(library, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert tf.read_ids(spark, path).agg(F.max(F.size("ids"))).first()[0] <= 1000
    empty = scratch(spark, "ids")
    tf.write_ids(df.limit(0), empty, vocabulary_path())
    assert tf.documents(spark, empty).count() == 0


def test_rows_of_one_id_are_dealt_to_several_files(library, spark):
    rows = [(7, f"text {i % 50}") for i in range(400)]
    path = scratch(spark, "ids")
    tf.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, vocabulary_path())
    got = sorted((tuple(r) for r in tf.documents(spark, path).collect()), key=lambda r: r[1])
    assert tf.read_ids(spark, path).select("part").distinct().count() > 1 and len(got) == 400
    assert sorted((n, c) for _, _, n, c in got) == sorted((n, c) for _, _, n, c in plain(library, rows))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))


def test_filters_are_answered_by_the_index(spark):
    docs = spark.range(20_000).select((F.col("id") * 3).alias("doc_id"), F.lit("one two").alias("text"))
    path = scratch(spark, "ids")
    tf.write_ids(docs, path, vocabulary_path())

    def scanned(ids):
        df = tf.read_ids(spark, path, ids)
        assert len(df.collect()) == sum(i % 3 == 0 for i in ids)
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    assert 0 < scanned([3000]) <= 1000  # one group of rows
    assert scanned([3001, 30_001]) <= 100  # inside the statistics' ranges, but not in the Bloom filters
