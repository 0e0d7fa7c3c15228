"""op8: counts against the inverted distribution, rates, odd sources."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintel.llm import mixing


def count(ident, rate, seed=7):
    parts = max(1, math.ceil(rate / 16))
    total = 0
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{ident}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = cdf = math.exp(-rate / parts)
        k = 0
        while u >= cdf and k < mixing.TERMS:
            k += 1
            p *= rate / parts / k
            cdf += p
        total += k
    return total


def test_counts(spark):
    rows = [(i, "big") for i in range(300)] + [(1000 + i, "small") for i in range(3)] + [(2000, None)]
    df = spark.createDataFrame([(i, s, "t", 5) for i, s in rows], "doc_id long, source string, text string, copies int")
    out = mixing.poisson_mix(df)
    got = Counter(r.doc_id for r in out.collect())
    n = Counter(s for _, s in rows)
    assert got == {i: c for i, s in rows if (c := count(i, len(rows) / 3 / n[s]))}
    assert out.columns[:4] == df.columns and abs(got.total() - len(rows)) < 6 * math.sqrt(len(rows))
    many = Counter(r.doc_id for r in mixing.poisson_mix(df, {"small": 3.0, "big": 1.0}, size=10).collect())
    assert set(many) & {2000} == set() and abs(sum(many[1000 + i] for i in range(3)) - 2280) < 300  # rates of 760 are cut in parts
    seen = out.select("doc_id", "mix_copy").collect()
    assert len(set(seen)) == len(seen) and mixing.poisson_mix(df).select("doc_id", "mix_copy").collect() == seen


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "s", None), (None, "s", ""), (1, "s", "x" * 50000), (1, "s", "x" * 50000)], "doc_id long, source string, text string")
    out = mixing.poisson_mix(df, size=5)
    assert {r[0] for r in out.groupBy("doc_id").agg(F.count_distinct("mix_copies")).select("count(DISTINCT mix_copies)").collect()} <= {1}
    assert mixing.poisson_mix(df.limit(0)).count() == 0


def test_no_source_with_a_weight(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "doc_id long, source string, mix_copy int")
    assert mixing.poisson_mix(df, {"absent": 1.0}, prefix="own_").count() == 0 and mixing.poisson_mix(df, {"a": 0.0}, prefix="own_").count() == 0
    with pytest.raises(ValueError):
        mixing.poisson_mix(df, {"a": -1.0})


def test_columns_named_like_ours_come_back(spark):
    names = ["copy", "copies", "rate", "key", "src", "parts", "cdf"]
    plain = [(i, f"text {i}", "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(plain, "doc_id long, text string, source string")
    odd = df.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(f"mix_{n}") for n in names), F.lit(1).alias("MIX_KEY_"), F.lit(2).alias("a.b"))
    out = mixing.poisson_mix(odd)
    back = out.select(*(F.col(f"`{c}`") for c in odd.columns)).distinct().collect()
    want = {tuple(r) for r in odd.collect()}
    assert {tuple(r) for r in back} <= want and len(out.columns) == len(odd.columns) + 4 and len({c.lower() for c in out.columns}) == len(out.columns)
    count = lambda rows: sorted(r.doc_id for r in rows.select("doc_id").collect())
    assert count(out) == count(mixing.poisson_mix(df))
