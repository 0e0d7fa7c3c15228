"""Syntax facts and violations on small sources."""

import pytest
from pyspark.sql import functions as F

from lintel.functions.pyfacts import facts, shape
from lintel.operators import enrich as E
from lintel.operators import lint as L


def fact(source, kind):
    return [(n, v, t) for k, n, _, _, v, t in facts(source) if k == kind]


def test_measures():
    src = "def f(self, a, b=1, *c, d, **e):\n    '''doc'''\n    if a and b or d:\n        for x in [y for y in a if y]:\n            with x:\n                try:\n                    pass\n                except E:\n                    assert a if b else d\n"
    assert fact(src, "complexity") == [("f", 10 - 1, "")] and fact(src, "complexity_rule") == [("f", 10, "")]
    assert fact(src, "nesting") == [("f", 5, "")] and fact(src, "params") == [("f", 3, "")] and fact(src, "body_lines") == [("f", 7, "")] and fact(src, "span") == [("f", 9, "")]
    wide = "async def g(a):\n    async for x in a:\n        async with x:\n            pass\n"
    assert fact(wide, "nesting") == [("g", 0, "")] and fact(wide, "nesting_rule") == [("g", 2, "")]


def test_bad_sources():
    for src in ("def f(:", "x = 1" * 100_000, "\x00", "(" * 5000):
        assert [k for k, *_ in facts(src)] == ["module"]
    assert fact("", "module") == [("", 0, "")] and fact("a = 1\r\nb = 2\x0c", "module")[0][1] == 2
    assert facts("x" + " + 1" * 3000)  # deep, but no failure


def test_shapes():
    import ast

    s = lambda x: shape(ast.parse(x).body[0])
    assert s("a = f(b, 1)") == s("x = f(y, 2)") != s("x = g(y, 2)") and s("a = b + b") != s("a = b + c") and s("a = 1") != s("a = '1'") and s("a = True") != s("a = 1")


def test_small_checks():
    src = (
        "from typing import Any\nimport datetime\ndef w(a, *b):\n    return x.y(a, *b)\ndef d():\n    return 1\n    print()\ndef e():\n    try:\n        pass\n    except Exception:\n        log.info(1)\n        return None\n"
        "    try:\n        pass\n    except:\n        pass\n    try:\n        pass\n    except ValueError:\n        return datetime.datetime.now()\ndef t(a: list[Any]) -> Any: ...\nv: Any = 1\n_log = getLogger()\nx = 1  # type: ignore\ny = '# noqa'\n"
        "if TYPE_CHECKING:\n    from typing import Any\n"
    )
    assert fact(src, "wrapper") == [] or fact(src, "wrapper") == [("w", 1, "x.y")]
    assert fact(src, "dead") == [("d", 1, "return")] and fact(src, "swallow") == [("e", 1, "")] and fact(src, "silent") == [("e", 1, "pass")] and fact(src, "datetime") == [("e", 1, "")]
    assert [t for *_, t in fact(src, "any")] == ["line 1", "return annotation, line 22", "param a, line 22", "line 23"]
    assert fact(src, "logger_name") == [("_log", 1, "")] and [t for *_, t in fact(src, "suppression")] == ["x = 1  # type: ignore"]


def test_tests():
    src = "import pytest\n@pytest.fixture()\ndef fx(): ...\ndef test_a():\n    assert 1\n    assert 2\n    with c:\n        assert 1\n        assert 2\n        assert 3\n        assert 4\n    run(); go(); len(x)\ndef test_b():\n    for x in y:\n        self.assertEqual(x)\ndef test_c():\n    with pytest.raises(E):\n        go()\ndef test_d():\n    go()\n"
    assert fact(src, "bare_asserts") == [("test_a", 4, ""), ("test_b", 0, ""), ("test_c", 0, ""), ("test_d", 0, "")]
    assert fact(src, "fixture") == [("fx", 1, "")] and [n for n, *_ in fact(src, "conditional")] == ["test_b"] and fact(src, "test_calls")[0][1] == 2


@pytest.fixture(scope="module")
def files(spark):
    body = "    a = one(x)\n    b = two(a, 7.5)\n    c = three(b)\n    d = 'shared text'\n    return four(d)\n"
    many = [(f"src/m{i}.py", f"import os\nimport sys\ndef f{i}(x):\n{body}", False) for i in range(12)]
    long = "def f():\n" + "    x = 1\n" * 60
    return spark.createDataFrame(
        [*many, ("src/constants.py", "SHARED = 'shared text'\n", False), ("src/long.py", long, False), ("src/big.py", "x = 1\n" * 700, False), ("src/mid.py", "x = 1\n" * 400, False), ("bad.py", "def (", False), ("n.py", None, False)]
        + [("src/god.py", "class C:\n" + "".join(f"    def m{i}(self): ...\n" for i in range(11)), False), ("tests/test_x.py", "def test_n():\n    go()\ndef test_r():\n    with pytest.raises(E):\n        go()\n", True)],
        "path string, source string, is_test boolean",
    )


def test_violations(spark, files):
    got = {}
    for r in L.lint(files).collect():
        got.setdefault(r.rule, []).append((r.path, r.identifier, r.detail))
    assert [x[1] for x in got["long-method"]] == ["f"] and got["god-class"] == [("src/god.py", "C", "methods=11")] and got["oversized-module"][0][0] == "src/big.py" and got["oversized-module-soft"][0][2] == "lines=400 (soft limit=350)"
    assert len(got["semantic-clone"]) == 12 and len(got["duplicate-call-sequence"]) == 12 and got["assertion-free-test"] == [("tests/test_x.py", "test_n", "")]
    first = next(d for p, _, d in got["semantic-clone"] if p == "src/m0.py")
    assert first.endswith("clones: src/m1.py:f1, src/m10.py:f10, src/m11.py:f11")
    assert got["repeated-magic-number"] == [("<project>", "7.5", "appears in 12 files (max: 5)")]
    assert got["repeated-string-literal"] == [("<project>", "'shared text'", "appears in 13 files (max: 10); already defined as SHARED in src/constants.py:1")]
    assert {p for p, *_ in got["repeated-code-block"]} >= {f"src/m{i}.py" for i in range(12)}


def test_runtime_and_draft(spark):
    src = "from m import get_a, get_b, get_c, x, y, z\ndef f(a, b, c, d, e):\n    q.a; q.b; q.c; q.d; q.e; r.f\n    return 42, 42, 42, 42\n"
    f = L.ast_facts(spark.createDataFrame([("a.py", src, False), ("x/.venv/a.py", src, False), ("a.txt", src, False)], "path string, source string, is_test boolean"))
    got = {(r.rule_id, r.path, r["name"], r["value"]) for r in L.runtime_findings(f).collect()}
    assert got == {("PY-CODE-009", "a.py", "f", 5), ("PY-CODE-012", "a.py", "f", 5), ("PY-IMPORT-001", "a.py", "m", 6)}
    assert ("PY-DUP-004", "a.py", "42", 4) in {tuple(r) for r in L.draft_findings(f).collect()}
    names = spark.createDataFrame([(f"d/_run_{x}.py",) for x in "abc"] + [("d/_go_a.py",)], "path string")
    assert [tuple(r) for r in L.flat_siblings(names).collect()] == [("d", "run", 3)]


def test_enrichment(spark):
    conf = "import pytest\n" + "".join(f"@pytest.fixture\ndef {n}(): ...\n" for n in ("near", "both"))
    top = "import pytest\n" + "".join(f"@pytest.fixture\ndef {n}(): ...\n" for n in ["both", *(f"far{i}" for i in range(12))])
    f = L.ast_facts(spark.createDataFrame([("t/u/conftest.py", conf, True), ("conftest.py", top, True), ("o/conftest.py", conf, True)], "path string, source string, is_test boolean"))
    got = E.visible_fixtures(spark.createDataFrame([("t/u/test_a.py",)], "path string"), f).first().fixtures
    assert got[:2] == ["near", "both"] and len(got) == 10 and got.count("both") == 1
    assert spark.range(1).select(E.suppression_advice(F.lit("# type: ignore[union-attr]")).alias("x")).first().x.startswith("union-attr")
