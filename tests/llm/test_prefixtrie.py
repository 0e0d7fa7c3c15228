"""op11: against a trie of Python dicts, with long shared conversations, hot ones and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lintel.llm import prefixtrie

SHAPE = "conv_id long, turn long, role string, text string"


def plain(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    conv = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}
    if not conv:
        return []
    root = {"kids": {}, "members": [], "ends": [], "chars": 0, "depth": 0, "up": None}
    for c in sorted(conv):
        h = zlib.crc32(str(c).encode()) % 6
        n = root
        n["members"].append(c)
        for r, x in conv.get(c - c % 100, [])[:h] + conv[c][h:]:
            n = n["kids"].setdefault((r, x), {"kids": {}, "members": [], "ends": [], "chars": len(x), "depth": n["depth"] + 1, "up": n})
            n["members"].append(c)
        n["ends"].append(c)
    order = [root]
    for n in order:
        order += n["kids"].values()
    for n in reversed(order):
        n["leaves"] = sum(k["leaves"] for k in n["kids"].values()) or 1
        n["saved"] = (len(n["members"]) - 1) * n["chars"] + sum(k["saved"] for k in n["kids"].values())
    sha = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    return sorted((n["members"][0], n["depth"], n["up"] and n["up"]["members"][0], len(n["members"]), len(n["kids"]), n["leaves"], n["saved"], sha(n["ends"])) for n in order)


def got(spark, rows):
    return sorted(map(tuple, prefixtrie.prefix_trie(spark.createDataFrame(rows, SHAPE)).collect()))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, prefixtrie.op11_prefix_trie(spark, "/root/testdata/sf0.01").collect())) == plain(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None, "bot"]), rng.choice(["", None, "x", "é", "yy"])) for c in rng.sample(range(700), 120) for t in rng.sample([None, *range(9)], rng.randrange(1, 9))]
    assert got(spark, rows) == plain(rows)


def test_long_shared_conversations(spark):
    """Copies, each cut at another turn, some with a tail of their own: a run of hundreds of nodes, and a comb."""
    rows = [(c, t, "user", f"turn {t}") for c in range(7, 47) for t in range(150 - 3 * c)]
    rows += [(c, 1000, "bot", f"own {c % 4}") for c in range(7, 47)]
    assert got(spark, rows) == plain(rows)


def test_one_conversation_holds_most_rows(spark):
    """It spans several ranges, and half of its rows are equal."""
    rows = [(500, t, "user", f"text {t}") for t in range(600)] + [(500, None, "user", "same")] * 600 + [(c, t, "user", f"text {t}") for c in (3, 501, 502, 550, 601) for t in range(8)]
    want = plain(rows)
    assert got(spark, rows) == want and max(r[1] for r in want) == 1200


def test_many_conversations_end_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 50)
    rows = [(c, t, "user", f"text {t}") for c in range(1, 900) for t in range(7)]
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "nobody"), (-7, 1, "user", "a"), (-100, 1, "user", "b"), (0, 1, "ab", "c"), (1, 1, "a", "bc"), (2, None, None, None), (2, None, None, None), (2, 1, "", "z" * 100_000), (2, 1, "a", "z"), (99, 3, "user", "z")]
    assert got(spark, rows) == plain(rows)
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], SHAPE + ", part int, node string")
    assert sorted(map(tuple, prefixtrie.prefix_trie(df).collect())) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "nobody")]) == []
    assert got(spark, [(8, 1, "user", "one")]) == plain([(8, 1, "user", "one")])
