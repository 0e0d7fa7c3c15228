"""op7: recall, exactness of what it returns, and odd vectors."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from lintel.llm import ann


def brute(ids, x, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    want = brute(np.array(t["vec_id"]), np.array(t["embedding"].to_pylist(), np.float64))
    got = {}
    for r in sorted(ann.op7_ann(spark, f"/root/testdata/{sf}").collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 10 and sorted(v, key=lambda p: (p[1], p[0])) == v for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
    for q in want:
        exact = dict(want[q])
        assert all(abs(exact[a] - s) < 1e-12 for a, s in got[q] if a in exact)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, [1.0])]
    rows += [(1000 + i, [3.0, 4.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in sorted(ann.ann_search(df).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 100, 300, 1000} and got[0] == [100, 1, *range(1000, 1008)] and got[300] == [7]
    assert got[1000] == [*range(1001, 1011)]
    assert ann.ann_search(df.limit(0)).count() == 0
    split = ann.ann_search(df, shard_rows=7)
    assert {(r.query_id, r.vec_id) for r in split.collect()} == {(q, v) for q, vs in got.items() for v in vs}


def test_probe_order():
    sets = ann.perturbations(4, 30)
    assert sets[0] == () and sets[1] == (1,) and len(set(sets)) == 30
    assert all(9 - j not in s for s in sets for j in s)
