"""op6 against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lintel.llm import linededup as ld


def edit(rng, s, n):
    s = bytearray(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice(b"abcd"))
        elif s and kind == 1:
            del s[min(i, len(s) - 1)]
        elif s:
            s[min(i, len(s) - 1)] = rng.choice(b"abcd")
    return bytes(s)


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_distance(most):
    rng = random.Random(most)
    for _ in range(3000):
        a = bytes(rng.choices(b"abcd"[: rng.randrange(1, 5)], k=rng.randrange(0, 90)))
        b = edit(rng, a, rng.randrange(0, 2 * most + 2)) if rng.random() < 0.9 else bytes(rng.choices(b"abcd", k=rng.randrange(0, 90)))
        assert ld.distance(a, b, most) == min(ld.small_distance(a, b), most + 1), (a, b)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_within_the_threshold_meet(edits):
    rng = random.Random(9)
    for _ in range(300):
        a = bytes(rng.choices(b"abcdefgh", k=rng.randrange(edits + 1, 60)))
        b = edit(rng, a, rng.randrange(0, edits + 1))
        if len(b) <= edits:
            continue
        data, n = np.frombuffer(a + b, np.uint8), np.array([len(a), len(b)])
        keys, rows, kinds = ld.join_keys(data, np.array([0, len(a)]), n, edits)
        side = [{(int(k), int(t)) for k, r, t in zip(keys, rows, kinds, strict=True) if r == x} for x in (0, 1)]
        assert any((k, 1 - t) in side[1] for k, t in side[0])


def test_lines_of():
    texts = ["", "a", "a\n", "\n\nb", None, "é\nx"]
    data, text, pos, start, n = ld.lines_of(pa.array(texts))
    got = [(int(t), int(p), bytes(data[s : s + k]).decode()) for t, p, s, k in zip(text, pos, start, n, strict=True)]
    assert got == [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n"))]


def brute(rows, edits=2, least=24):
    occ = [(d, p, x) for d, t in rows for p, x in enumerate((t or "").split("\n")) if x]
    lines = sorted({x for _, _, x in occ})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a.encode()), len(b.encode())) < least:
                continue
            if ld.small_distance(a.encode(), b.encode()) <= edits if abs(len(a.encode()) - len(b.encode())) <= edits else False:
                root[find(a)] = find(b)
    first = {}
    for d, p, x in sorted(occ, key=lambda o: o[:2]):
        first.setdefault(find(x), (d, p))
    return {d: sorted(p for e, p, x in occ if e == d and first[find(x)] != (d, p)) for d, _ in rows}


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = [bytes(rng.choices(b"abcdefghij ", k=rng.randrange(10, 50))) for _ in range(12)]
    rows = [(i, "\n".join(edit(rng, rng.choice(base), rng.randrange(0, 4)).decode() for _ in range(rng.randrange(1, 8)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 30000), (104, "x" * 30000 + "\n" + "x" * 29999 + "y"), (105, "é" * 20 + "\n" + "é" * 19 + "e")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, dropped string")
    want = {k: v for k, v in brute([r for r in rows if r[0] < 103]).items() if v} | {104: [0, 1], 105: [1]}
    assert {r.doc_id: r.dropped for r in ld.dropped_lines(docs).collect()} == want
    assert {r.doc_id: r.dropped for r in ld.dropped_lines(docs, heavy=3).collect()} == want
    out = {r.doc_id: r.text for r in ld.line_dedup(docs).collect()}
    assert out[100] is None and out[102] == "\n\n" and out[104] == "" and ld.line_dedup(docs).columns == docs.columns
    assert ld.line_dedup(docs.limit(0)).count() == 0


def test_lines_that_collide_under_a_polynomial(spark):
    """Thue-Morse words of 1,024 bytes and their complements have equal polynomial hashes modulo 2^64 in any base."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    docs = spark.createDataFrame([(1, word), (2, word.translate({97: "b", 98: "a"})), (3, word), (4, "short"), (5, "short\nshorn")], "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in ld.dropped_lines(docs).collect()} == {3: [0], 5: [0]}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a line of some bytes, long enough", 7, 8, 9), (2, "a line of some bytes, long enough", 7, 8, 9)], "doc_id long, text string, __dropped int, own_id int, lost_lines int")
    assert sorted(map(tuple, ld.line_dedup(docs).collect())) == [(1, "a line of some bytes, long enough", 7, 8, 9), (2, "", 7, 8, 9)]


def test_long_distance():
    rng = random.Random(2)
    a = bytes(rng.choices(b"abcd", k=100_000))
    assert ld.distance(a, edit(rng, edit(rng, a, 1), 1), 2) <= 2 and ld.distance(a, a[::-1], 2) == 3
