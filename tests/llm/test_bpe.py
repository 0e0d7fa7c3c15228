"""op1 against the tokenizers library, and the transducer against a dict."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lintel.llm import bpe
from lintel.llm.transducer import compile_words, mapped

TEXTS = [
    None, "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "'s's 'S don't we'll I'VE", "  \n\n x  y \t z   ", "a" * 3000, "=" * 5000, "é" * 3000, " \x1c\x1d\x85\xa0  x x", "١٢٣ ⅷ ²",
    "日本語テキスト", "🙂🙂👩‍👩‍👧", "a\r\nb\rc", "\x01x", "﻿x", "".join(map(chr, range(1, 3000))), "word " * 20000,
]


def test_transducer(tmp_path):
    rng = random.Random(5)
    entries = {"".join(rng.choices("abc", k=rng.randrange(1, 9))).encode(): [rng.randrange(99) for _ in range(rng.randrange(4))] for _ in range(600)}
    (tmp_path / "x").write_bytes(compile_words(entries))
    t = mapped(str(tmp_path / "x"))
    asked = [*entries, b"", b"abcabcabcabc", b"d", b"aaaaaaaaaa"]
    data, ends = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([len(a) for a in asked])
    got = t.lookup(data, ends - [len(a) for a in asked], ends)
    for a, n in zip(asked, got.tolist(), strict=True):
        assert (n >= 0) == (a in entries)
        if n >= 0:
            assert t.ids[t.id_offsets[n] : t.id_offsets[n + 1]].tolist() == entries[a]
    assert len(t.finals) < 600 * 3  # suffixes are shared
    (tmp_path / "y").write_bytes(compile_words({}))
    assert mapped(str(tmp_path / "y")).lookup(data, ends - 1, ends).max() == -1


def test_like_the_library(spark):
    path = bpe.vocabulary_path()
    tk = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    docs = docs.withColumn("ids", F.lit("clash"))
    for lexicon in (0, 500):
        got = {r.doc_id: r for r in bpe.encode(docs, path, lexicon_words=lexicon, digests=True).collect()}
        for r in docs.collect():
            ids = tk.encode(r.text or "", add_special_tokens=False).ids
            g = got[r.doc_id]
            assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (r.text or "")[:60]
            assert g.decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    path = bpe.vocabulary_path()
    encoded = bpe.encode(docs, path)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(docs.limit(0), path, digests=True).count() == 0


def test_a_worker_holds_one_slice(spark, monkeypatch):
    """The arrays of a slice are gone before the next one's, and the next task finds none of them."""
    kept = {}
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, *_: kept.update(run=f) or df)
    bpe.encode(docs, bpe.vocabulary_path(), digests=True)
    words = [f"{a}{b}" for a in "some short words that stand here again and again".split() for b in "abcdefgh"]
    texts = [" ".join(random.Random(i).choices(words, k=1000)) for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    assert batch.nbytes > 7e6
    bpe.merges(bpe.vocabulary_path())
    pa.default_memory_pool().release_unused()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    rows, arrow = 0, 0
    for out in kept["run"](iter([batch])):
        rows, arrow = rows + out.num_rows, max(arrow, pa.total_allocated_bytes() - before)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts)
    assert most < 40e6 and arrow < 10e6, (most, arrow)
