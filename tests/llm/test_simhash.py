"""op4 against a brute-force reading of the contract."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lintel.llm import golay, simhash


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, most=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    low = {}
    for i in range(len(fps)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(fps))]


TEXTS = [None, "", " \n\t", "One", "ONE", "one two", "a b c d", "a b c d e", "Ünï cödé W\x0bx É", "x" * 50000, "w " * 9000, "nb\xa0sp a b", "a  b\nc   d"]


def test_fingerprints(spark):
    got = simhash.fingerprints(pa.array(TEXTS))
    assert [int(x) for x in got] == [plain(t) for t in TEXTS]
    long = pa.array([" ".join(random.Random(i).choices("abcdefg", k=70000)) for i in range(3)])
    assert [int(x) for x in simhash.fingerprints(long)] == [plain(t.as_py()) for t in long]


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 2000)
    k, n = golay.keys(w)
    for _ in range(40):
        flips = sum(1 << int(i) for i in rng.choice(23, rng.integers(0, 3), replace=False))
        k2, n2 = golay.keys(w ^ flips)
        assert all(set(a[:x]) & set(b[:y]) for a, x, b, y in zip(k, n, k2, n2, strict=True))


@pytest.mark.parametrize("heavy", [1 << 18, 3])
def test_links_lose_nothing(spark, heavy):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = lambda label: df.selectExpr("fp AS bits", "false AS second", f"{label} AS label")
    found = simhash.search(nodes("fp"), 4, nearest=True, heavy=heavy).collect()
    for r in found + simhash.search(nodes("fp"), 4, heavy=heavy).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert a in root and b in root
        root[find(a)] = find(b)
    want = brute(fps, fps)
    assert len({find(x) for x in fps}) == len(set(want))


def test_components(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, plain(r.text)) for r in docs.collect())
    want = brute([f for _, f in rows], [i for i, _ in rows])
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, "/root/testdata/sf0.001").collect())
    assert got == [(i, f"{f:016x}", c) for (i, f), c in zip(rows, want, strict=True)]
    kept = simhash.near_dedup(docs, far=0)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def linked(rows, link):
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if link(rows[i], rows[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_near_copies(spark):
    rng = random.Random(8)
    docs = []
    for i in range(30):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400))]
        docs.append(" ".join(w))
        for changes in (1, 2, 12):
            x = list(w)
            for _ in range(changes):
                x[rng.randrange(len(x))] = f"y{rng.randrange(10**6)}"
            docs.append(" ".join(x))
    rows = {i: (plain(t), shingles(t)) for i, t in enumerate(docs)}
    jaccard = lambda a, b: len(a[1] & b[1]) / len(a[1] | b[1])
    bits = lambda a, b: (a[0] ^ b[0]).bit_count()
    least = linked(rows, lambda a, b: bits(a, b) <= 4 or bits(a, b) == 5 and jaccard(a, b) >= 0.8)
    most = linked(rows, lambda a, b: bits(a, b) <= 4 or jaccard(a, b) >= 0.8)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(df, far=10).collect()}
    for i in rows:
        for j in rows:
            assert least[i] != least[j] or got[i] == got[j]
            assert got[i] != got[j] or most[i] == most[j]
    caught = sum(got[4 * i] == got[4 * i + k] for i in range(30) for k in (1, 2))
    assert caught >= 50, caught


def test_hub_of_a_crowded_bucket(spark, monkeypatch):
    """Ten fingerprints around a hub that is near all of them in bits and like none: pairs of the ten are alike."""
    rng = random.Random(3)
    around = []
    while len(around) < 10:
        x = sum(1 << 43 + b for b in rng.sample(range(21), 5))
        if all(6 <= (x ^ y).bit_count() <= 10 for y in around):
            around.append(x)
    fps = [0, *around]
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = [" ".join(text())]
    for _ in range(5):
        w = text()
        docs += [" ".join(w), " ".join([*w, "end"])]
    keys, at = simhash.key_pairs(np.array(fps, np.uint64))
    assert any(len(set(at[keys == k])) == 11 for k in set(keys))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    own = spark.createDataFrame([(i, i, f - (1 << 64) if f >> 63 else f, rng.getrandbits(62), 196) for i, f in enumerate(fps)], "doc_id long, h long, fp long, other long, n long")
    monkeypatch.setattr(simhash, "fingerprint_table", lambda *_: own)
    want = {0: 0} | {i: i - (i + 1) % 2 for i in range(1, 11)}
    for heavy in (1 << 18, 4):
        assert {r.doc_id: r.component_id for r in simhash.simhash_components(df, far=10, heavy=heavy).collect()} == want


def test_recall_of_near_copies(spark):
    """Pairs of documents whose five-word shingles are 0.8 to 0.85 alike: nine of ten meet at least."""
    rng = random.Random(21)
    docs, pairs = [], []
    while len(pairs) < 300:
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 500))]
        x = list(w)
        for _ in range(round(len(w) / 47)):
            x[rng.randrange(len(x))] = f"y{rng.randrange(10**6)}"
        a, b = shingles(" ".join(w)), shingles(" ".join(x))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            pairs.append((len(docs), len(docs) + 1))
            docs += [" ".join(w), " ".join(x)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(df, far=11).collect()}
    assert len(set(got.values())) >= 300 and sum(got[a] == got[b] for a, b in pairs) >= 270


def test_links_of_a_large_group_follow_its_size(spark):
    """2,000 fingerprints around one another: no stretch of buckets gives more links than it has labels."""
    rng = random.Random(4)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(2000)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "bits long").selectExpr("bits", "false AS second", "bits AS label")
    first = simhash.search(df, 4, nearest=True).where("kind = 0").collect()
    assert len(first) <= 4 * 4 * len(fps)
    roots = simhash.components(spark.createDataFrame([(r.a, r.b) for r in first], "a long, b long"))
    known = df.join(roots, df.bits == roots.v, "left").selectExpr("bits", "second", "coalesce(root, bits) AS label")
    assert simhash.search(known, 4).where("kind = 0").count() <= 4 * 4 * known.select("label").distinct().count()


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "same", "a"), (1, "same", "a"), (2, "u", "b"), (2, "v", "b"), (3, "v", "b"), (None, "none", "c"), (None, "other", "c"), (None, "none", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted(map(tuple, simhash.near_dedup(df).collect()), key=str)
    assert got == sorted({(1, "same", "a"), (2, "u", "b"), (2, "v", "b"), (None, "none", "c"), (None, "other", "c")}, key=str)


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "One", "x"), (None, "One", "x")], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()]
    assert len(got) == len(TEXTS) + 2 and {c for i, _, c in got if i in (3, 4, None)} == {3}
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_near_copies_among_rows_that_repeat_an_id(spark):
    """A near copy five to eight bits off is compared with the text it is like, whichever row of an id comes first."""
    rng = random.Random(12)
    while True:
        w = [f"w{rng.randrange(10**6)}" for _ in range(220)]
        x = [*w[:100], f"y{rng.randrange(10**6)}", *w[101:]]
        a, b = " ".join(w), " ".join(x)
        if 5 <= (plain(a) ^ plain(b)).bit_count() <= 8:
            break
    other = lambda: " ".join(f"z{rng.randrange(10**6)}" for _ in range(200))
    rows = [(1, other()), (1, a), (2, b), (3, other())]
    for given in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        kept = simhash.near_dedup(spark.createDataFrame(given, "doc_id long, text string"))
        assert sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[1], rows[3]])


def test_sketches_never_reject_what_is_alike(spark):
    """Odd sketches of sets of 0 to 900 members: no pair at the similarity is refused; of sets that do not fill 256 bits,
    nearly all others are."""
    rng = random.Random(31)
    sets = [[], [7], [9]]
    for _ in range(150):
        base = [rng.getrandbits(64) - (1 << 63) for _ in range(rng.choice([1, 4, 12, 40, 150, 900]))]
        cut = max(1, round(len(base) * rng.choice([0.5, 0.8, 0.85, 0.9, 1.0])))
        sets += [base, base[:cut], [*base[:cut], *(rng.getrandbits(64) - (1 << 63) for _ in range(len(base) // 12))]]
    df = spark.createDataFrame(list(enumerate(sets)), "i int, s array<long>")
    rows = df.select("i", *simhash.odd_sketch("s")).orderBy("i").collect()
    columns = [np.array([r[c] for r in rows], np.int64) for c in simhash.SKETCHED]
    assert columns[0].tolist() == [len(x) for x in sets]
    i, j = np.triu_indices(len(sets), 1)
    may = simhash.may_be_alike(columns, i, j, 0.8)
    alike = np.array([len(set(sets[x]) & set(sets[y])) >= 0.8 * len(set(sets[x]) | set(sets[y])) for x, y in zip(i.tolist(), j.tolist())])
    small = columns[0][i] + columns[0][j] <= 400
    assert may[alike].all() and alike.sum() > 100 and may[small & ~alike].mean() < 0.02


def test_a_crowd_of_unlike_texts_gives_few_candidates(spark, monkeypatch):
    """Short texts within 11 bits of one another but under 0.8 alike are not taken to be compared; near ones among them link."""
    rng = random.Random(8)
    fps = list(dict.fromkeys(sum(1 << b for b in rng.sample(range(62), 4)) for _ in range(200)))
    docs = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in fps]
    many = len(fps)
    fps += [f ^ 3 << 20 + i for i, f in enumerate(fps[:20])]  # two bits off, more than are linked unseen
    docs += [x + " end" for x in docs[:20]]
    assert len(set(fps)) == len(fps)
    own = spark.createDataFrame([(i, i, f, rng.getrandbits(62), 36) for i, f in enumerate(fps)], "doc_id long, h long, fp long, other long, n long")
    monkeypatch.setattr(simhash, "fingerprint_table", lambda *_: own)
    sizes, real = [], simhash.written

    def counting(df, name):
        out = real(df, name)
        if name == "candidates":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counting)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(df, most=1, far=8).collect()}
    assert got == {i: i - many if i >= many else i for i in range(len(fps))}
    assert len(sizes) == 2 and sizes[1] <= 40


def test_sketches_of_texts_never_reject_what_is_alike():
    """Texts of no word, of one shingle and of hundreds, with the sketches that are dealt along with their fingerprints."""
    rng = random.Random(5)
    texts = [None, "", "One", "one", "a b c d", "A b c d", "a b c d e", "a b c d e f"]
    for _ in range(150):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 5, 6, 20, 60, 400]))]
        x = list(w)
        x[rng.randrange(len(x))] = "y"
        texts += [" ".join(w), " ".join(x), " ".join([*w, *w[: rng.choice([0, 1, 9])]]), " ".join(w[: max(1, len(w) - 2)])]
    *_, n, sketch = simhash.both_fingerprints(pa.array(texts))
    sets = [shingles(t) if (t or "").strip() else set() for t in texts]
    assert n.tolist() == [len(x) for x in sets] and len(sketch) == len(texts)
    i, j = np.triu_indices(len(texts), 1)
    may = simhash.may_be_alike([n, *sketch.T.copy().view(np.int64)], i, j, 0.8)
    alike = np.array([len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) > 0 for x, y in zip(i.tolist(), j.tolist())])
    small = n[i] + n[j] <= 200
    assert may[alike].all() and alike.sum() > 100 and may[small & ~alike].mean() < 0.02


def test_a_crowd_of_unlike_texts_holds_nothing(spark, monkeypatch):
    """Short texts within 8 bits of one another that cannot be alike are neither candidates nor held for another search; of
    copies that are alike one tree is given, and once it is verified none of them is searched for again."""
    rng = random.Random(8)
    around = lambda seed: list(dict.fromkeys(sum(1 << b for b in random.Random(seed + i).sample(range(62), 4)) for i in range(200)))
    fps = around(0)
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    unlike = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in fps]
    copies = [" ".join([*text, f"end{i}"]) for i in range(len(fps))]
    real = simhash.written
    for docs in (unlike, copies):
        *_, n, sketch = simhash.both_fingerprints(pa.array(docs))
        rows = [(i, i, f, rng.getrandbits(62), *map(int, (n[i], *sketch[i].view(np.int64)))) for i, f in enumerate(fps)]
        own = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("doc_id", "h", "fp", "other", "n", "sketch0", "sketch1")))
        monkeypatch.setattr(simhash, "fingerprint_table", lambda *_: own)  # noqa: B023
        sizes = {}

        def counting(df, name):
            out = real(df, name)
            sizes.setdefault(name, []).append(out.count())  # noqa: B023
            return out

        monkeypatch.setattr(simhash, "written", counting)
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in simhash.simhash_components(df, most=1, far=8).collect()}
        assert got == {i: i if docs is unlike else 0 for i in range(len(fps))}
        assert sizes.get("held", [0]) == [0]
        assert docs is copies or sizes["found"] == [0]


def test_keys_of_groups():
    """A fingerprint dealt once a group, once a share of it, or once a key has the same keys where it arrives, in one turn or more."""
    rng = np.random.default_rng(7)
    fps, second = rng.integers(0, 1 << 64, 500, np.uint64), rng.random(500) < 0.4
    for nearest in (False, True):
        keys, at = simhash.key_pairs(fps, nearest)
        want = sorted(zip((keys | np.where(second[at], simhash.OTHER, 0)).tolist(), at.tolist(), strict=True))
        assert len(set(want)) == len(want) and (len(want) > 70 * len(fps)) != nearest
        for cut in (np.ones(simhash.GROUPS, np.int64), rng.choice([0, 1, 2, 5, 4096], simhash.GROUPS)):
            key, row = simhash.packed(fps, second, cut, nearest)
            assert len(set(zip(key.tolist(), row.tolist(), strict=True))) == len(key) and (len(key) <= 12 * len(fps) or cut.min() == 0)
            for turns in (1, 3):
                got = [simhash.unpacked(key, fps[row], cut, nearest, t, turns) for t in range(turns)]
                assert sorted((k, int(row[r])) for own, of in got for k, r in zip(own.tolist(), of.tolist(), strict=True)) == want
                assert turns == 1 or all(len(own) < 0.6 * len(want) for own, _ in got)


def shuffled_rows(spark):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_fingerprint_travels_once_a_group(spark):
    """4,000 fingerprints, more than `heavy`, so that crowded buckets are looked for: some ten rows of each are shuffled, not one
    for each of its 85 keys and another to count the key."""
    rng = random.Random(14)
    df = spark.createDataFrame([(rng.getrandbits(64) - (1 << 63),) for _ in range(4000)], "bits long").selectExpr("bits", "false AS second", "bits AS label")
    before = shuffled_rows(spark)
    assert simhash.search(df, 4, heavy=2000).where("kind > 0").count() == 0
    assert shuffled_rows(spark) - before <= 20 * 4000
