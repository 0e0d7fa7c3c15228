"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of `tables` tables hashes a vector by `width` Gaussian projections, floored in cells of `cell` times a distance
scale that is fitted on a bounded sample. A query visits its own bucket and then those of perturbed projections, in the
order of their estimated success: the sets of small perturbations come from the expected squared distances of sorted
cell borders, and each query fills in its own borders. Candidates of all tables are merged and ranked by exact distance.

Rows are dealt once, in shards of bounded size; a task indexes its shard once and the queries come past it in batches, so
its memory follows neither the table nor the query set, and neither all candidates nor a bucket's pairs leave a task: only
each query's nearest of the shard do. A vector that many rows repeat stands for its smallest ids only, as many as can be
among the nearest. A query that found too few is answered by comparing it with every row, past the same shards.

Vectors that are null, zero, or hold null, NaN or infinite parts take no part, nor do null ids; vectors of another
length are no candidates. A row that repeats id and vector counts once. Ties go to the smaller id. Vectors of any
length are read whole. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, table, written


def perturbations(width: int, most: int) -> list[tuple[int, ...]]:
    """Sets of sorted-border ranks (1 to 2 x width) in order of their expected squared distance, the empty set first."""
    m = width
    z = [0.0] + [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out, heap = [()], [(z[1], (1,))]
    while heap and len(out) < most:
        cost, s = heappop(heap)
        if all(2 * m + 1 - j not in s for j in s):  # both borders of one projection cannot be crossed
            out.append(s)
        last = s[-1]
        if last < 2 * m:
            heappush(heap, (cost - z[last] + z[last + 1], (*s[:-1], last + 1)))
            heappush(heap, (cost + z[last + 1], (*s, last + 1)))
    return out


class Hash:
    """The projections of all tables. scale: the distance that `cell` is measured in."""

    def __init__(self, dim: int, scale: float, tables: int, width: int, cell: float, probes: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.w = scale * cell
        self.a = rng.standard_normal((tables, dim, width))
        self.b = rng.random((tables, width)) * self.w
        self.mul = rng.integers(1, 1 << 62, width) | 1
        self.sets = perturbations(width, probes)
        self.tables, self.width = tables, width

    def cells(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t] + self.b[t]) / self.w

    def keys(self, x: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (np.floor(self.cells(x, t)).astype(np.int64) * self.mul).sum(1)

    def probe_keys(self, q: np.ndarray, t: int) -> np.ndarray:
        """(queries x probes) bucket keys, most promising first."""
        c = self.cells(q, t)
        home = np.floor(c)
        border = np.concatenate([c - home, 1 - (c - home)], 1)
        order = np.argsort(border, axis=1)
        with np.errstate(over="ignore"):
            step = np.where(order < self.width, -1, 1) * self.mul[order % self.width]
            base = (home.astype(np.int64) * self.mul).sum(1)
            return np.stack([base + sum((step[:, j - 1] for j in s), np.zeros(len(q), np.int64)) for s in self.sets], 1)


class Index:
    """The buckets of all tables over the rows of a shard, built once: rows in the order of their keys."""

    def __init__(self, h: Hash, x: np.ndarray) -> None:
        self.h, self.n, self.keys, self.order = h, len(x), [], []
        for t in range(h.tables):
            keys = h.keys(x, t)
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.order.append(order.astype(np.int32))

    def candidates(self, q: np.ndarray) -> list[np.ndarray]:
        """Rows that each query's probes meet in any table."""
        cut = max(1, (1 << 25) // max(1, self.n))
        if len(q) > cut:
            return [c for i in range(0, len(q), cut) for c in self.candidates(q[i : i + cut])]
        hit = np.zeros((len(q), self.n), bool)
        for t in range(self.h.tables):
            probe = self.h.probe_keys(q, t)
            lo, hi = np.searchsorted(self.keys[t], probe, "left"), np.searchsorted(self.keys[t], probe, "right")
            row, _ = ragged((hi - lo).sum(1))
            span, inner = ragged((hi - lo).ravel())
            hit[row, self.order[t][lo.ravel()[span] + inner]] = True
        return [np.flatnonzero(r) for r in hit]


def candidates(h: Hash, x: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    return Index(h, x).candidates(q)


def by_length(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch's rows (id, v) by the length of their vectors."""
    ids, v = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
    off = np.asarray(v.offsets)
    values = v.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    return {int(d): (ids[size == d], values[off[:-1][size == d][:, None] + np.arange(d)]) for d in np.unique(size)}


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qid: np.ndarray, found: list[np.ndarray] | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's k nearest among its candidates (all rows where found is None), itself left out."""
    out = []
    for i in range(len(q)):
        at = np.arange(len(x)) if found is None else found[i]
        at = at[ids[at] != qid[i]]
        d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
        top = np.lexsort((ids[at], d))[:k] if len(d) <= 4 * k else (lambda near: near[np.lexsort((ids[at][near], d[near]))[:k]])(np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]))
        out.append((np.full(len(top), qid[i]), ids[at][top], d[top]))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0, (np.int64, np.int64, np.float64)[j]) for j in range(3))


def fitted_scale(rows: DataFrame, n: int, k: int, sample: int, dim: int, seed: int) -> float:
    """About the mean distance to the k-th nearest of n, from a sample of bounded size in the order of a hash of the id."""
    got = rows.where(F.size("v") == dim).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").collect()
    x = np.array([r.v for r in got], np.float64)
    if len(x) < 2:
        return 1.0
    d = ((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T).clip(0)
    np.fill_diagonal(d, np.inf)
    d = np.sqrt(np.sort(d, 1)[:, min(len(x) - 2, max(0, round(k * len(x) / n) - 1))])
    return float(d[d > 1e-9].mean()) if (d > 1e-9).any() else 1.0


def ann_search(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 56, width: int = 10, cell: float = 1.65, probes: int = 80, sample: int = 1000, shard_rows: int = 10000, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by `every`, against all rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)).distinct()
    rows = written(rows, "vectors")
    # of equal vectors only the k + 1 smallest ids can be among a query's k nearest
    stand = written(rows.selectExpr("*", "row_number() OVER (PARTITION BY v ORDER BY id) AS nth").where(F.col("nth") <= k + 1).drop("nth"), "stand-ins")
    asks = rows.where(F.col("id") % every == 0)
    n = stand.count()
    shards = max(1, -(-n // shard_rows))
    dims = {r.d: fitted_scale(stand, n, k, sample, r.d, seed) for r in stand.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").limit(64).collect()}

    def search(every_row: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, ready = None, {}, {}
            for batch in batches:  # by shard; in each its rows, then the queries
                shard, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "ask"))
                cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                    if lo == hi:
                        continue
                    if shard[lo] != at:
                        at, held, ready = shard[lo], {}, {}
                    for dim, (ids, v) in by_length(batch.slice(lo, hi - lo)).items():
                        if not asks[lo]:
                            held.setdefault(dim, []).append((ids, v))
                            continue
                        if dim not in held:
                            continue
                        if dim not in ready:
                            own, x = (np.concatenate(p) for p in zip(*held[dim], strict=True))
                            ready[dim] = own, x, None if every_row or dim not in dims else Index(Hash(dim, dims[dim], tables, width, cell, probes, seed), x)
                        own, x, index = ready[dim]
                        got = nearest(x, own, v, ids, index.candidates(v) if index else None, k)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

        return run

    def answers(queries: DataFrame, every_row: bool) -> DataFrame:
        rows = stand.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(False).alias("ask"), "id", "v")
        rows = rows.unionByName(queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("ask"), "id", "v"))
        got = rows.repartition(shards, "shard").sortWithinPartitions("shard", "ask").mapInArrow(search(every_row), "query_id long, vec_id long, score double")
        return got.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank").where(F.col("rank") <= k)

    first = written(answers(asks, False), "neighbours")
    few = first.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = asks.join(few, "id", "left_anti")
    if short.limit(1).count():  # queries whose buckets held fewer than k
        first = first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(answers(short, True))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_ann(spark, sf_dir):
    return ann_search(table(spark, sf_dir, "embeddings"))
