"""Nearest enclosing settings against a search of all roots."""

import random

from pyspark.sql import functions as F

from lintel.operators import enclosing


def test_nearest(spark):
    rng = random.Random(7)
    make = lambda: rng.choice(["", "/"]) + "/".join(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "/", "//"])
    paths = [make() for _ in range(150)] + [None, "", "/", "a"] + ["/a/b/hot"] * 50
    roots = [make() for _ in range(25)] + [None, "/"]
    want = {}
    for i, p in enumerate(paths):
        cut = lambda x: x.rstrip("/")
        own = [(len(cut(r)), k) for k, r in enumerate(roots) if p is not None and r is not None and (cut(p) == cut(r) or cut(p).startswith(cut(r) + "/"))]
        longest = max((n for n, _ in own), default=None)
        want[i] = min((k for n, k in own if n == longest), default=None)
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(paths)], "id int, cwd string, path string")
    table = spark.createDataFrame([(r, k, "s") for k, r in enumerate(roots)], "root string, k int, `a.b` string")
    out = enclosing.nearest(df, table, priority="k")
    assert out.columns == [*df.columns, "found"] and {r.id: r.found and r.found.k for r in out.collect()} == want and any(want.values())
    assert enclosing.nearest(df, table.limit(0)).where("found IS NOT NULL").count() == 0 and enclosing.nearest(df.limit(0), table).count() == 0


def test_enrolment(spark):
    df = spark.createDataFrame([(1, "/r/a/b"), (2, "/r/off/x"), (3, "/elsewhere"), (4, "/r/skip/me"), (5, "/r")], "id int, cwd string")
    repos = spark.createDataFrame([("/r/a", None), ("/r/off/", True), ("/r/skip", False), ("/r", False)], "root string, disabled boolean")
    out = enclosing.enrolment(df, repos, ["/r/sk?p", "/R/*"])
    assert sorted(map(tuple, out.drop("cwd").collect())) == [(1, True, False, False), (2, True, True, False), (3, False, False, False), (4, True, False, True), (5, True, False, False)]
    assert out.where(F.col("enrolled").isNull()).count() == 0
