"""op9: the directory, the index files, and groups against a dict."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lintel.llm import exact_dedup as ed


def test_directory():
    rng = random.Random(1)
    for _ in range(50):
        bits = rng.randrange(1, 8)
        counts = {rng.randrange(1 << bits): rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))}
        room = rng.randrange(1, 120)
        slots = ed.directory(counts, bits, room)
        depth = len(slots).bit_length() - 1
        assert len(slots) == 1 << depth and slots[0] == 0 and all(b - a in (0, 1) for a, b in zip(slots, slots[1:], strict=False))
        held = Counter()
        for p, n in counts.items():
            held[slots[p >> (bits - depth)]] += n
        width = Counter(slots)
        assert all(n <= room or (width[b] == 1 and depth == bits) for b, n in held.items())
        assert all(w & (w - 1) == 0 for w in width.values())
    assert ed.directory({}, 4, 10) == [0]


def folded(rows):
    return ["".join(c.lower() if c.isascii() else c for c in t or "") for _, t in rows]


def plain(rows):
    return sorted(plain_in_order(rows), key=repr)


def plain_in_order(rows):
    low = folded(rows)
    n, keep = Counter(low), {}
    for (i, _), t in zip(rows, low, strict=True):
        keep[t] = i if keep.get(t) is None else max(keep[t], i) if i is not None else keep[t]
    return [(i, keep[t], n[t], i == keep[t]) for (i, _), t in zip(rows, low, strict=True)]


def test_groups(spark):
    rng = random.Random(2)
    texts = ["", None, "A", "a", "É", "é", "x" * 100000, "X" * 100000, " a"] + [rng.choice("abcDEF") * rng.randrange(1, 4) for _ in range(200)]
    rows = list(enumerate(texts)) + [(3, "a"), (None, "a"), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, keep_id int")
    for room in (1 << 14, 3):
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_groups(df, bucket_rows=room).collect()), key=repr)
        assert got == plain(rows)
    few = lambda c: F.xxhash64(F.length(c) % 3)
    for room in (1 << 14, 1):  # three hashes for all texts
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_groups(df, bucket_rows=room, hash_of=few).collect()), key=repr)
        assert got == plain(rows)
    kept = ed.exact_dedup(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({t: i for (i, _, _, k), t in zip(plain_in_order(rows), folded(rows), strict=True) if k}.values(), key=repr)
    twice = spark.createDataFrame([(1, "same", 5), (1, "same", 5), (2, "u", 6), (2, "v", 6), (3, "V", 7)], "doc_id long, text string, __keep long")
    assert sorted(map(tuple, ed.exact_dedup(twice).collect())) == [(1, "same", 5), (2, "u", 6), (3, "V", 7)]
    assert ed.exact_groups(df.limit(0)).count() == 0


def test_buckets_hold_key_ranges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for bits in (16, 2, 1):
        check_buckets(ed.build_index(docs, bucket_rows=20, bits=bits).collect(), 20 if bits == 16 else 40)


def check_buckets(rows, room):
    by = {}
    for r in rows:
        by.setdefault(r.bucket, []).append(r.h % (1 << 64))
    spans = sorted((min(v), max(v), len(v)) for v in by.values())
    assert len(by) > 5 and all(n <= room for *_, n in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
