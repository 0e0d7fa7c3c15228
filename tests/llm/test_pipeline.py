"""The pipeline, stage by stage, against plain Python on the kept rows."""

import hashlib
import math
import random
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline as cp
from lintel.llm import bpe, toxicity
from lintel.llm.common import ascii_lower, table

from .test_simhash import brute, linked, plain, shingles

SF = "/root/testdata/sf0.001"


def copies(doc_id, rate, seed=7):
    parts = max(1, math.ceil(rate / 16))
    mean, out = rate / parts, 0
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = total = math.exp(-mean)
        k = 0
        while u >= total and k < 80:
            k += 1
            p *= mean / k
            total += p
            out += 1
    return out


def test_stages(spark):
    docs = table(spark, SF, "documents")
    scores = {r.doc_id: r.score for r in toxicity.op2_toxicity(spark, SF).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    keep = {i for i in rows if scores[i] < 0.5}
    got = cp.drop_toxic(spark, docs, SF)
    assert got.schema == docs.schema and {r.doc_id for r in got.collect()} == keep

    last = {}
    for i in sorted(keep):
        last["".join(c.lower() if c.isascii() else c for c in rows[i].text or "")] = i
    keep = set(last.values())
    got = cp.drop_copies(spark, got, SF)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == keep

    ids = sorted(keep)
    fps = {i: (plain(rows[i].text), shingles(rows[i].text)) for i in ids}
    jaccard = lambda a, b: len(a[1] & b[1]) / len(a[1] | b[1])
    bits = lambda a, b: (a[0] ^ b[0]).bit_count()
    most = set(linked(fps, lambda a, b: bits(a, b) <= 4 or jaccard(a, b) >= 0.8).values())
    got = cp.drop_near_copies(spark, got, SF)
    keep = {r.doc_id for r in got.collect()}
    assert got.columns == docs.columns and most <= keep <= set(brute([plain(rows[i].text) for i in ids], ids))

    n = Counter(rows[i].source for i in keep)
    want = Counter({i: k for i in keep if (k := copies(i, len(keep) / len(n) / n[rows[i].source]))})
    got = cp.mix_sources(spark, got, SF)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want

    tk = Tokenizer.from_file(bpe.vocabulary_path())
    final = cp.run(spark, SF).collect()
    assert Counter(r.doc_id for r in final) == want
    for r in final:
        assert r.n_tokens == len(tk.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids)


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated ids and rows, very long texts, and columns named as ours are."""
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    same, long = words(40), words(60_000)
    rows = [(1, same), (1, same), (2, words(40)), (2, same), (3, same.upper()), (4, None), (5, ""), (None, words(30)), (None, None), (6, long), (7, long + " end"), (8, words(50))]
    names = "doc_id long, text string, lang string, source string, n_chars long, h string, own_h int, keep_id string, mix_copy2 int, `group` int, label int"
    docs = spark.createDataFrame([(i, t, None, None if i == 8 else "s", None, "h", 1, "k", 2, 3, 4) for i, t in rows], names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(100, 120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    got = cp.drop_toxic(spark, docs, str(tmp_path))
    assert got.schema == docs.schema and got.count() == len(rows)
    got = cp.drop_copies(spark, got, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), len(r.text or "")) for r in got.collect()) == sorted((str(i), len(t or "")) for i, t in [(2, rows[2][1]), (3, same), (5, ""), (None, rows[7][1]), (6, long), (7, long + " end"), (8, rows[11][1])])
    got = cp.drop_near_copies(spark, got, str(tmp_path))
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["2", "3", "5", "6", "8", "None"]
    assert cp.mix_sources(spark, got, str(tmp_path)).columns == docs.columns
    assert cp.run(spark, str(tmp_path)).where("n_tokens >= 0").count() > 0


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_ascii_lower(spark):
    assert spark.createDataFrame([("AZÉ",)], "x string").select(ascii_lower("x")).first()[0] == "azÉ"
