"""Rules over what events write to Python files, from payloads to findings."""

import json

from pyspark.sql import functions as F

from lintel.operators.builtin_rules import Policy
from lintel.operators.engine import evaluate_events, full_reads
from lintel.operators.rules import RegexRule

LONG = "def f(a, b):\n" + "    work(a)\n" * 60
DEEP = "def f(a):\n" + "".join("    " * i + "if a:\n" for i in range(1, 7)) + "    " * 7 + "return work(1)\n"
BRANCHY = "def f(a):\n" + "    if a:\n        go(1)\n" * 13 + "    return 1\n"
BEFORE = {
    "PY-CODE-008": (LONG, LONG[:400]),
    "PY-CODE-009": ("def f(a, b, c, d, e):\n    return [a, b]\n", "def f(self, a, b, c, d):\n    return [a, b]\n"),
    "PY-CODE-010": ("def f(a):\n    return [" + "1, " * 60 + "]\n", "x = 1  # " + "y" * 200 + " https://a.b\n"),
    "PY-CODE-011": (DEEP, "def f(a):\n    if a:\n        return work(1)\n"),
    "PY-CODE-012": ("def f(a):\n    q.a; q.b; q.c; q.d; q.e; r.f\n    return 1\n", "def f(a):\n    q.a; q.b; q.c; r.d; r.e; r.f\n    return 1\n"),
    "PY-CODE-013": ("def f(a):\n    return g(a)\n", "def f(a):\n    b = a\n    return g(b)\n"),
    "PY-CODE-014": ("class C:\n" + "".join(f"    def m{i}(self): ...\n" for i in range(11)), "class C:\n" + "".join(f"    def __m{i}__(self): ...\n" for i in range(11))),
    "PY-CODE-015": (BRANCHY, BRANCHY[:100]),
    "PY-CODE-016": ("def f(a):\n    return 1\n    go()\n", "def f(a):\n    go()\n    return 1\n"),
    "PY-IMPORT-001": ("from m import a, b, c, d, e, f\n", "from m import a, b\n"),
}
GRAPH = "from langgraph.graph import StateGraph\n"
AFTER = {
    "LG-STATE-001": (GRAPH + "class S(TypedDict):\n    items: list[str]\n    other: list\n    name: str\n", GRAPH + "class S(TypedDict):\n    items: Annotated[list, add]\n"),
    "LG-NODE-001": (GRAPH + "def n(state):\n    state['x'].append(1)\n    return state\n", "def n(state):\n    state['x'] = 1\n"),
    "LG-API-001": (GRAPH + "g.set_finish_point('a')\n", GRAPH + "g.add_edge(START, 'a')\n"),
}


def body(event, tool="Write", **given):
    return json.dumps({"hook_event_name": event, "tool_name": tool, "tool_input": given})


def test_before(spark):
    rows = [(2 * i + k, "claude", body("PreToolUse", file_path="a.py", content=c)) for i, pair in enumerate(BEFORE.values()) for k, c in enumerate(pair)]
    rows += [(100, "claude", body("PreToolUse", file_path="x/.venv/a.py", content=LONG)), (101, "claude", body("PreToolUse", file_path="a.md", content=LONG)), (102, "claude", body("PreToolUse", file_path="a.py", content="def ("))]
    got = {r.ord: r for r in evaluate_events(spark.createDataFrame(rows, "ord long, platform string, raw string")).collect()}
    for i, rule in enumerate(BEFORE):
        assert rule in [f.rule_id for f in got[2 * i].findings] and rule not in [f.rule_id for f in got[2 * i + 1].findings], rule
    assert got[0].decision == "deny" and "`f` in `a.py` is 61 lines long" in got[0].reason and got[8].decision == "context"
    assert [got[n].findings for n in (100, 101, 102)] == [[], [], []]
    off = evaluate_events(spark.createDataFrame(rows[:1], "ord long, platform string, raw string"), Policy(disabled=("PY-CODE-008",))).first()
    assert off.findings == []


def test_after(spark):
    rows = [(2 * i + k, "claude", body("PostToolUse", file_path="g.py"), [("g.py", c)], ["pkg/_run_a.py"], None) for i, pair in enumerate(AFTER.values()) for k, c in enumerate(pair)]
    siblings = [f"pkg/_run_{x}.py" for x in "abc"] + ["pkg/_go_a.py", "other/_run_d.py"]
    rows += [(50, "claude", body("PostToolUse", file_path="pkg/new.py"), [("pkg/new.py", LONG)], siblings, None), (51, "claude", body("PostToolUse", "Read", file_path="pkg/new.py"), [("pkg/new.py", LONG)], siblings, None), (52, "claude", body("PostToolUse", file_path="n.py"), [("n.py", AFTER["LG-NODE-001"][1])], None, True)]
    df = spark.createDataFrame(rows, "ord long, platform string, raw string, files array<struct<path:string,source:string>>, siblings array<string>, graph_project boolean")
    got = {r.ord: r for r in evaluate_events(df).collect()}
    ids = {n: [f.rule_id for f in r.findings] for n, r in got.items()}
    for i, rule in enumerate(AFTER):
        assert ids[2 * i] == [rule] and rule not in ids[2 * i + 1], (rule, ids)
    assert ids[50] == ["PY-CODE-008", "PY-CODE-017"] and got[50].decision == "block" and ids[51] == [] and ids[52] == ["LG-NODE-001"]
    assert "`items`, `other`" in got[0].context


def test_a_bad_rule_stops_no_other(spark):
    df = spark.createDataFrame([(0, "claude", body("PreToolUse", file_path="a.py", content="TODO"))], "ord long, platform string, raw string")
    out = evaluate_events(df, regex_rules=[RegexRule("BAD", ["PreToolUse"], "content", ["(open"]), RegexRule("GOOD", ["PreToolUse"], "content", ["TODO"])]).first()
    assert [f.rule_id for f in out.findings] == ["GOOD"] and len(out.errors) == 1 and out.errors[0].startswith("BAD: ")


def test_full_reads_end_to_end(spark):
    read = lambda **kw: json.dumps({"hook_event_name": "PreToolUse", "tool_name": "Read", "session_id": "s", "tool_input": {"file_path": "a.py"} | kw})
    rows = [(0, "claude", read(offset=1), 10), (1, "claude", read(), 20), (2, "claude", read(offset=1), 30), (3, "claude", read(limit=5), 20 + 3601)]
    df = spark.createDataFrame(rows, "ord long, platform string, raw string, at long")
    out = evaluate_events(full_reads(df, F.col("at")).drop("at")).orderBy("ord").collect()
    assert [[f.rule_id for f in r.findings] for r in out] == [["BUILTIN-ENFORCE-FULL-READ"], [], [], ["BUILTIN-ENFORCE-FULL-READ"]]


def test_findings_are_matched_once(spark):
    """However many columns a decision and its rendering read them for."""
    from lintel.plans import catalog

    plan = lambda q: catalog.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan("render_permission").count("moron") <= plan("rule_content").count("moron")
