"""op13: runs, and the contract's columns, against a search of every period at every place."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from lintel.llm import periodic


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(6, 4 * q) and not any(s == a and m == length and q % p == 0 for s, m, p in out):
                out.append((a, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(150):
        kind, n = rng.randrange(4), rng.randrange(90)
        if kind == 0:
            words = [rng.randrange(2) for _ in range(n)]
        elif kind == 1:
            words = [0] * n
        else:
            words = []
            while len(words) < n:
                piece = [rng.randrange(rng.choice([2, 5, 1000])) for _ in range(rng.randrange(1, 13))]
                words += (piece * rng.randrange(1, 8))[: rng.randrange(1, 60)]
        assert periodic.runs_of(np.array(words, np.int64)) == plain_runs(words)


def test_long_periods():
    rng = random.Random(9)
    for p in (63, 64, 65, 170, 171, 341, 342, 700):
        piece = [rng.randrange(10**6) for _ in range(p)]
        for extra in (-1, 0, 5):
            words = [rng.randrange(10**6) for _ in range(rng.randrange(40))] + (piece * 5)[: 4 * p + extra] + [-1, -2]
            assert periodic.runs_of(np.array(words, np.int64)) == plain_runs(words)


def test_cuts_keep_every_run():
    rng = random.Random(4)
    words = []
    for _ in range(60):
        words += [rng.randrange(300) for _ in range(rng.randrange(80))] + [rng.randrange(3) for _ in range(rng.randrange(1, 4))] * rng.randrange(3, 9)
    ids = np.array(words, np.int64)
    assert periodic.runs_of(ids) == plain_runs(words)
    assert sum(b - a for a, b in periodic.recurring(ids)) < len(ids) / 2
    assert periodic.recurring(np.arange(1000)) == []


def test_very_long_texts():
    rng = random.Random(6)
    begin = time.time()
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    piece = [rng.randrange(1000) for _ in range(40_000)]
    assert periodic.runs_of(np.array(piece * 5, np.int64)) == [(0, 200_000, 40_000)]
    many = [w for k in range(20_000) for w in [k] * 6 + [-1, -2]]
    assert len(periodic.runs_of(np.array(many, np.int64))) == 20_000
    assert time.time() - begin < 60


def plain(i, text):
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if x]
    n = len(w)
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a, old = g % n, list(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [old[a + (k - a) % p] if k >= a else old[k] for k in range(n)]
    runs = plain_runs(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_whole_table(spark):
    got = periodic.op13_periodic_runs(spark, "/root/testdata/sf0.001")
    assert got.columns == [x.split()[0] for x in periodic.SHAPE.split(", ")]
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len((r.text or "").split()) < 2500]
    got = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(docs) > 150 and sum(r[1] for r in got.values()) > 3
    assert all(got[r.doc_id] == plain(r.doc_id, r.text) for r in docs)


def test_odd_rows(spark):
    rows = [(None, "a a a a a a a"), (1, None), (1, ""), (1, " \n"), (2, "x\x0by\x0cx y x y x y x y"), (2, "x y x y x y x y"), (-5, "é é é é é é"), (3, "a a a a a a b b b b b b")]
    df = spark.createDataFrame([(t, i, 0, "r") for i, t in rows], "text string, doc_id long, start int, runs string")
    got = periodic.periodic_runs(df, texts=True).collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert [r.collapsed for r in got] == ["a", "", "", "", "x y", "x y", "é", "a b"]
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 7, 1)], [], [], [], [(0, 10, 2)], [(0, 8, 2)], [(0, 6, 1)], [(0, 6, 1), (6, 6, 1)]]
    tails = {r.doc_id: tuple(r) for r in periodic.periodic_runs(df.where("doc_id = 3"), repeat_tails=True).collect()}
    assert tails[3] == plain(3, "a a a a a a b b b b b b")
    assert periodic.periodic_runs(df.limit(0)).count() == 0
