"""op3: exact parts against a plain count, the filter against a dict, scores against the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import bloomlm as lm


def plain(rows):
    toks = {}
    for i, (d, t) in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        toks[i] = [*re.findall(r"[^\x20\x09-\x0D]+", low), None]
    train = [i for i, (d, _) in enumerate(rows) if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    return [(d, i not in set(train), len(toks[i]), sum(c[w] > 0 for w in toks[i]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks[i])) for i, (d, _) in enumerate(rows)]


def check(got, want):
    key = lambda r: (r[0], r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])), (g, w)
        assert math.isfinite(g[6]) and g[6] < 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.op3_lm(spark, "/root/testdata/sf0.01").collect()
    check(got, plain([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_few_frequent_words_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = lm.training(F.col("doc_id"))
    model, counts = lm.fit(docs.where(learned), n_segments=5, dictionary=10)
    out = lm.score(docs, model, counts, learned, most_tokens=2000).select("doc_id", ~F.col("trained"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    check(out.collect(), plain([(r.doc_id, r.text) for r in docs.collect()]))


def test_filter_levels():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    lv = rng.integers(1, 12, 20000).astype(np.uint8)
    bits, size = lm.segment_bits(keys[:0], lv[:0], keys, lv)
    f = lm.Filter(np.frombuffer(bits, np.uint8), np.array([size]))
    got = f.level(keys, keys)
    assert (got >= lv).all() and (got == lv).mean() > 0.95
    assert (f.level(rng.integers(0, 1 << 63, 5000).astype(np.uint64), keys[:5000]) > 0).mean() < 0.04


def test_sums_of_blobs():
    rng = np.random.default_rng(3)
    f, want = lm.Folded(most=50), Counter()
    for _ in range(40):
        k, c = rng.integers(0, 90, 30).astype(np.uint64), rng.integers(1, 9, 30).astype(np.uint32)
        f.add(k.tobytes(), c.tobytes())
        want.update(dict.fromkeys(k.tolist(), 0))
        for x, n in zip(k.tolist(), c.tolist(), strict=True):
            want[x] += n
    assert dict(zip(*(x.tolist() for x in f.sums()), strict=True)) == dict(want)


def test_equal_texts_score_equal(spark):
    rows = [(i, "the cat sat on the mat" if i % 3 == 0 else f"a dog {i % 5} ran off") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = lm.training(F.col("doc_id"))
    for most_bytes in (1 << 20, 0):
        out = lm.score(docs, *lm.fit(docs.where(learned), n_segments=3, most_bytes=most_bytes), learned).collect()
        by = {}
        for r in out:
            by.setdefault(rows[r.doc_id][1], set()).add((r.score, r.base_score))
        assert {r.trained for r in out} == {True, False} and all(len(v) == 1 for v in by.values())


def test_probabilities_add_up_to_one_at_most(spark):
    rng = np.random.default_rng(7)
    words = "abcdef"
    docs = spark.createDataFrame([(i, " ".join(rng.choice(list(words), rng.integers(0, 9), p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]))) for i in range(200)], "doc_id long, text string")
    texts = ["", *words, *(f"{x} {y}" for x in words for y in words), *(f"{x} {y} {z}" for x in words for y in words for z in words)]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = lm.score(asked, *lm.fit(docs, n_segments=3), F.lit(False)).collect()
    assert 0.2 < sum(10**r.score for r in out) <= 1
    best = max(out, key=lambda r: r.score / r.n_tokens)
    assert len(out) == len(texts) and all(math.isfinite(r.score) and r.score < 0 for r in out) and best.score > best.base_score - 1


def test_a_filter_of_any_size_scores_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = lm.training(F.col("doc_id"))
    scores = []
    for most_bytes in (64 << 20, 1000):
        out = lm.score(docs, *lm.fit(docs.where(learned), n_segments=5, most_bytes=most_bytes, dictionary=50), learned, most_tokens=2000)
        scores.append({r.doc_id: (r.score, r.base_score, r.n_known) for r in out.collect()})
    assert scores[0] == scores[1] and len(scores[0]) > 50
    rows = spark.createDataFrame([(1, None), (2, "a a b"), (3, "a a b"), (4, "")], "doc_id long, text string")
    few = lm.training(F.col("doc_id"))
    a, b = (sorted((r.doc_id, r.score) for r in lm.score(rows, *lm.fit(rows.where(few), n_segments=3, most_bytes=m), few).collect()) for m in (1 << 20, 0))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a a a"), (3, "a a a"), (4, "x" * 30000), (5, "b " * 9000), (6, " \n"), (9, "Ünï A\x0bb")]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, row string")
    learned = lm.training(F.col("doc_id"))
    out = lm.score(docs, *lm.fit(docs.where(learned), n_segments=3), learned).select("doc_id", ~F.col("trained"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    check(out.collect(), plain(rows))
    none = docs.limit(0)
    assert lm.score(none, *lm.fit(none), learned).count() == 0
    assert lm.score(docs, *lm.fit(none), learned).where("n_known = 0 AND train_tokens = 0").count() == len(rows)


def test_a_text_scores_the_same_alone(spark):
    """The mixture weight is the training texts' choice, whatever else is scored."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    learned = lm.training(F.col("doc_id"))
    scores = lambda df, *fitted: {r.doc_id: r.score for r in lm.score(df, *fitted, learned).collect()}
    for most_bytes in (1 << 30, 0):
        fitted = lm.fit(docs.where(learned), n_segments=3, most_bytes=most_bytes)
        whole = scores(docs, *fitted)
        alone = scores(docs.where(~learned), *fitted)
        assert alone and all(whole[i] == pytest.approx(x, abs=1e-9) for i, x in alone.items())
    late = scores(docs, *lm.fit(docs.where(learned), n_segments=3, choose=False))
    assert late == pytest.approx(whole)
