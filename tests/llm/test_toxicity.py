"""op2: the gradient, odd inputs, and held-out accuracy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lintel.llm import gru, toxicity


def tiny():
    texts = pa.array([f"good words here number {i}" for i in range(20)] + [f"bad idiot words number {i}" for i in range(20)])
    return gru.fit(texts, np.array([0] * 20 + [1] * 20)), texts


def test_gradient():
    rng = np.random.default_rng(0)
    m, _ = tiny()
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = rng.standard_normal((7, gru.FIXED + 2 * gru.DIM))
    idx, mask = rng.integers(0, 7, (5, 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    up = rng.standard_normal(3)
    loss = lambda: float(gru.forward(p, x, idx, mask, False)[0] @ up)
    g, dx = gru.backward(p, x, idx, mask, gru.forward(p, x, idx, mask, True)[1], up)
    for name, arr, got in [("x", x, dx), *((k, p[k], g[k]) for k in ("Wf", "Ub", "cf", "v", "o"))]:
        at = tuple(rng.integers(0, s) for s in arr.shape)
        kept = arr[at]
        arr[at] = kept + 1e-2
        hi = loss()
        arr[at] = kept - 1e-2
        lo = loss()
        arr[at] = kept
        assert abs((hi - lo) / 2e-2 - got[at]) < 2e-2 * max(1, abs(got[at])), name


def test_windows_cover_every_word():
    per = np.array([0, 1, 47, 48, 49, 80, 81, 1000])
    text, start, length = gru.windows(per)
    base = np.cumsum(per) - per
    for i, n in enumerate(per):
        seen = np.zeros(n, bool)
        for s, k in zip(start[text == i], length[text == i], strict=True):
            seen[s - base[i] : s - base[i] + k] = True
        assert seen.all()


def test_slices_do_not_change_scores():
    m, texts = tiny()
    odd = pa.array(["", "  ", "idiot", "x" * 5000, "idiot " * 3000 + "good", *texts.to_pylist()])
    whole = gru.scores(m, gru.read(odd))
    one = np.concatenate([gru.scores(m, gru.read(odd.slice(i, 1))) for i in range(len(odd))])
    assert np.allclose(whole, one, atol=1e-5) and ((whole >= 0) & (whole <= 1)).all()


def test_held_out(spark):
    out = toxicity.op2_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    rows = out.select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in rows) / len(rows) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x", None), (3, "x", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).where(F.col("score").between(0, 1)).count() == 4
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.clean(docs.limit(0), labels).count() == 0


def test_long_and_missing_labels(spark):
    """Labelled texts that are all long are learned from; where a label is missing nothing is called toxic."""
    docs = spark.createDataFrame([(i, ("calm words only here " if i % 2 else "you idiot fool moron ") * 400, i) for i in range(60)] + [(3, None, 0), (100, "", 0)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(5, 0), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fit_docs=20)
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("text is not null"), model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 0) for i in range(60)) and got[100] < 0.5
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        assert {r.score < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).count() == 0
