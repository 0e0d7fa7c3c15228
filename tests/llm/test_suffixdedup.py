"""op10 against brute force over all windows."""

import hashlib
import random
import string
from collections import Counter

import numpy as np
import pytest

from lintel.llm import suffixdedup as sd
from lintel.llm import windows


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), n_spans, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def same(got, texts, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.begins), bytes(r.kept)) for r in got.collect()}
    for i, want in enumerate(brute(texts, length)):
        assert got[i] == want, (i, got[i][:3], want[:3])


@pytest.mark.parametrize("seed", range(3))
def test_pieces(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abcdeé ", k=n))
    shared = [word(rng.randrange(380, 1200)) for _ in range(6)]
    texts = [None, "", "short", "a" * 3000, "ab" * 1500, "ab" * 300, "x" * 400, "y" * 399]
    for _ in range(30):
        texts.append("".join(rng.choice(shared)[rng.randrange(50) : rng.randrange(300, 1300)] if rng.random() < 0.6 else word(rng.randrange(1, 900)) for _ in range(rng.randrange(1, 6))))
    texts += [shared[0] * 3, "".join(shared), texts[20], word(40000) + shared[1]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, dk int")
    same(sd.suffix_dedup(docs), texts, 400)
    same(sd.suffix_dedup(docs, crowd=(1, 2, 5)[seed]), texts, 400)


def test_a_text_that_is_read_in_parts(monkeypatch):
    rng = random.Random(5)
    passage = rng.randbytes(900)
    whole = rng.randbytes(3000) + passage + rng.randbytes(5000) + passage + rng.randbytes(100) + passage[:399]
    data = np.frombuffer(whole, np.uint8)
    for most in (1 << 21, 1000, 401, 64):
        got = {}
        for text, start, n, m, place in zip(*windows.runs(data, np.array([0, 0, len(data)]), 400, 24, most), strict=True):
            assert text == 1
            got |= {int(start) + k: (int(m), int(place) - int(start) - k) for k in range(int(n))}
        assert sorted(got) == list(range(len(data) - 399))
        assert all(got[3000 + k] == got[8900 + k] for k in range(501))


def test_a_very_long_text(spark):
    """A passage beyond 16 MiB of a text is found again in another."""
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=1500))
    long = "".join(rng.choices(string.printable[:64], k=17_000_000)) + passage + "end"
    docs = spark.createDataFrame([(1, long), (2, "zz" + passage)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.begins, r.ends) for r in sd.suffix_dedup(docs).drop("kept").collect()}
    assert got == {1: (17_001_503, 1500, [17_000_000], [17_001_500]), 2: (1502, 1500, [2], [1502])}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = {r.doc_id: w for r, w in zip(docs, brute([r.text for r in docs], 400), strict=True)}
    for r in sd.op10_suffix_dedup(spark, "/root/testdata/sf0.001").collect():
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "q" * 200 + "r" * 300), (1, "q" * 200 + "r" * 300), (None, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in sd.suffix_dedup(docs).collect()) == [(0, 0), (500, 500), (500, 500)]
    assert sd.suffix_dedup(docs.limit(0)).count() == 0
