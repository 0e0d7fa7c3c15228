"""Rules as rows: literals, and findings against those of rules that are compiled into the plan."""

import json
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lintel.operators import rule_table as R
from lintel.operators.decide import decide, render
from lintel.operators.events import canonical
from lintel.operators.rules import RegexRule, evaluate, regex_rule

RULES = [
    RegexRule("TODO", ["PreToolUse"], "content", [r"\bTODO\b"], message="{rule_id} in {path}: {matched_paths}", path_globs=["*.py"], exclude_path_globs=["tests/**", "Lib/"]),
    RegexRule("STASH", ["PreToolUse"], "command", [r"git\s+stash"], action="context", context="no stash", tool_matchers=["Bash|Shell"]),
    RegexRule("NAME", ["PreToolUse", "PostToolUse"], "path", ["_helper"], case_sensitive=False, severity="CRITICAL", action="block", message="bad name"),
    RegexRule("ASK", ["UserPromptSubmit"], "prompt", ["delete|remove"], action="ask", message="sure?"),
    RegexRule("BAD", ["PreToolUse"], "content", ["ok", "("]),
    RegexRule("BADTOOL", ["UserPromptSubmit"], "prompt", ["ok"], tool_matchers=["["]),
    RegexRule("ANY", ["PreToolUse"], "content", [r"^\d+$", r"\p{Lu}{4}"], title="Digits", multiline=True),
    RegexRule("ONE", ["PreToolUse"], "content", [r"^x.y$"], multiline=False),
    RegexRule("NONE", ["PreToolUse"], "content", []),
    RegexRule("ODD", ["PreToolUse"], "elsewhere", ["TODO"]),
    RegexRule("DOT", ["PreToolUse"], "content", ["straße|KELVIN|ſet"], case_sensitive=False),
]


def events(spark):
    write = lambda path, content, **kw: {"hook_event_name": "PreToolUse", "tool_name": "Write", "tool_input": {"file_path": path, "content": content}, **kw}
    bash = lambda command, **kw: {"hook_event_name": "PreToolUse", "tool_name": "Bash", "tool_input": {"command": command}, **kw}
    edits = {"hook_event_name": "PreToolUse", "tool_name": "MultiEdit", "tool_input": {"file_path": "m.py", "edits": [{"new_string": "TODO"}, {"filePath": "n.py", "newText": "TODO"}, {"filePath": "n.js", "newText": "12\n13"}]}}
    payloads = [
        write("a.py", "# TODO x"), write("tests/a.py", "TODO"), write("lib/a.py", "TODO"), write("a.js", "TODO"), write("my_HELPER.py", "# TODO"), write("a.py", "x\ny"), write("a.py", "xzy"), write("a.py", "STRASSE Straße kelvin SET"), write("q", "İKELVİN kelvın"),
        bash("git stash"), bash("git  stash", tool_name="Zsh"), edits, {"hook_event_name": "UserPromptSubmit", "prompt": "delete all, ok"}, {"hook_event_name": "Stop"}, {}, write("", "TODO"), write("a.py", ""), bash("cat x_helper"),
    ]
    raw = spark.createDataFrame([(i, "claude", json.dumps(p)) for i, p in enumerate(payloads)], "ord long, platform string, raw string")
    return canonical(raw).withColumn("mode", F.when(F.col("ord") == 3, "outside_repo").otherwise("repo_strict")).withColumn("skipped", F.lit(False))


def test_findings_equal_those_of_compiled_rules(spark):
    e = events(spark)
    both = lambda df: {r.ord: ([tuple(f) for f in r.findings], r.errors) for r in df.select("ord", "findings", "errors").collect() if r.findings or r.errors}
    want = both(evaluate(e, [regex_rule(r) for r in RULES]))
    assert {f[0] for v in want.values() for f in v[0]} == {"TODO", "STASH", "NAME", "ASK", "ANY", "ONE", "DOT"} and any("BADTOOL" in x for v in want.values() for x in v[1])
    rows = R.rule_rows(spark, RULES)
    for most in (1 << 20, 600):
        got = R.evaluate_rules(e, rows, most_chars=most)
        assert both(got) == want
    out = {r.ord: r for r in render(decide(got)).collect()}
    assert out[0].decision == "deny" and json.loads(out[12].output)["decision"] == "block"
    assert R.evaluate_rules(e, rows.limit(0)).count() == 0 and R.evaluate_rules(e.limit(0), rows).count() == 0


def test_plan_does_not_follow_the_number_of_rules(spark):
    e = events(spark)
    size = lambda n: len(R.evaluate_rules(e, R.rule_rows(spark, [RegexRule(f"R{i}", ["PreToolUse"], "content", [f"word{i}"]) for i in range(n)]))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(3) - size(1500)) < 200


def test_literals():
    want = {r"\bTODO\b": ["todo"], r"git\s+stash": ["stash"], "a(?:bc|de)f": ["bc", "de"], "(foo|bar)+x": ["foo", "bar"], "(abc)?": None, "ab*": None, "(?i)Hello": ["hello"], r"\d+": None, "x{2}": ["xx"], r"a\*{3}$": ["a***"], "ax+b": ["ax"], "(?:abc){2,}": ["abcabc"], "(?=zz)ab(?!q)cd": ["abcd"], r"[a[bc]]de": None, "a|bc": None, r"\Qab\E": None, "[a&&b]cde": None, "ab.cde": ["cde"], "(?x)a b c": ["abc"], "(": None, "": None}
    assert {p: R.literals(p) for p in want} == want


def test_a_match_holds_a_literal():
    rng = random.Random(8)
    atoms = ["ab", "b", "c+", "(?:ab|cd)", "(b|ca)*", "[abc]", "d?", r"\bcd", "(?:ac){2}", ".", "(?=b)", "(?:a|(?:bd|dc)d)"]
    met = 0
    for _ in range(600):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 5)))
        found = R.literals(pattern)
        for _ in range(40):
            text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(12)))
            if found and re.search(pattern, text):
                met += 1
                assert any(x in R.fold(text) for x in found), (pattern, text)
    assert met > 300


def test_fold_keeps_what_the_engine_takes_as_equal():
    classes = defaultdict(set)
    for i in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(i)
        up = c.upper() if len(c.upper()) == 1 else c
        classes["i" if i == 0x130 else up.lower() if len(up.lower()) == 1 else up].add(R.fold(c))
    assert all(len(v) == 1 for v in classes.values())
