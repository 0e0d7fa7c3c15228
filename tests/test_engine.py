"""Events to decisions on hand-written payloads."""

import json

import pytest
from pyspark.sql import functions as F

from lintel.operators.builtin_rules import Policy
from lintel.operators.engine import evaluate_events
from lintel.operators.rules import RegexRule

POLICY = Policy(protected_globs=["locked/", "*.lock", "**/secret/*"], sensitive_patterns=[".env", r"id_rsa\b"], system_prefixes=["/etc/", "c:/windows"], search_reminder="search first")
RULES = [
    RegexRule("TODO", ["PreToolUse"], "content", [r"\bTODO\b"], message="{rule_id} in {path}: {matched_paths}", path_globs=["*.py"], exclude_path_globs=["tests/**"]),
    RegexRule("STASH", ["PreToolUse"], "command", [r"git\s+stash"], action="context", context="no stash", tool_matchers=["Bash|Shell"]),
    RegexRule("NAME", ["PreToolUse", "PostToolUse"], "path", ["_helper"], case_sensitive=False, severity="CRITICAL", action="block", message="bad name"),
    RegexRule("ASK", ["UserPromptSubmit"], "prompt", ["delete"], action="ask", message="sure?"),
]


@pytest.fixture(scope="module")
def run(spark):
    def go(*payloads, platform="claude", **kw):
        raw = spark.createDataFrame([(i, platform, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "ord long, platform string, raw string")
        return evaluate_events(raw, POLICY, RULES, **kw).orderBy("ord").collect()

    return go


def write(path, content, tool="Write", **kw):
    return {"hook_event_name": "PreToolUse", "tool_name": tool, "tool_input": {"file_path": path, "content": content}, **kw}


def bash(command, event="PreToolUse", **kw):
    return {"hook_event_name": event, "tool_name": "Bash", "tool_input": {"command": command}, **kw}


def ids(row):
    return [f.rule_id for f in row.findings]


def test_rules(run):
    rows = run(
        write("a.py", "# TODO x"), write("tests/a.py", "TODO"), write("a.js", "TODO"), bash("git stash"), write("my_Helper.py", "# TODO"), bash("git commit --no-verify -m x"), bash("cat .env"), bash("cat .env.example"),
        write("deep/secret/x", "y"), bash("cat x.lock"), bash("rm x.lock"), write("/etc/passwd", "x"), bash("grep a b"), {"hook_event_name": "Nope"}, "", "[1]", "{bad", bash("git stash") | {"tool_name": "Zsh"}, {"hook_event_name": "UserPromptSubmit", "prompt": "delete all"},
    )
    assert [ids(r) for r in rows] == [
        ["TODO"], [], [], ["STASH"], ["TODO", "NAME"], ["GIT-001"], ["GLOBAL-BUILTIN-SENSITIVE-DATA"], [], ["BUILTIN-PROTECTED-PATHS"], [], ["BUILTIN-PROTECTED-PATHS"], ["GLOBAL-BUILTIN-SYSTEM-PROTECTION"], ["REMIND-SEARCH-001"], [], [], [], [], [], ["ASK"],
    ]
    assert rows[0].decision == "deny" and rows[0].reason == "[TODO | HIGH] TODO in a.py: a.py"
    assert rows[4].decision == "block" and rows[4].reason == "[NAME | CRITICAL] bad name"
    assert rows[3].decision is None and json.loads(rows[3].output) == {"hookSpecificOutput": {"hookEventName": "PreToolUse", "additionalContext": "no stash"}}
    assert rows[13].output is None and json.loads(rows[18].output)["decision"] == "block"


def test_targets(run):
    edits = {"hook_event_name": "PreToolUse", "tool_name": "MultiEdit", "tool_input": {"file_path": "m.py", "edits": [{"new_string": "ok"}, {"filePath": "n.py", "newText": "TODO"}, {"oldText": "gone"}, {"oldText": "gone"}, 3, {}]}}
    patch = {"hook_event_name": "PreToolUse", "tool_name": "apply_patch", "tool_input": {"patchText": "*** Update File: p.py\r\n+# TODO\n-x\n+++ b/q.py\n--- /dev/null\n*** End"}}
    rows = run(edits, patch, {"hook_event_name": 5, "tool_name": " ", "tool": " Read ", "session_id": None, "tool_input": {"path": 3, "file_path": " b.rs "}, "tool_response": "text"})
    assert [tuple(t) for t in rows[0].targets] == [("m.py", "ok", "multi_edit"), ("n.py", "TODO", "multi_edit"), ("m.py", "gone", "multi_edit_old")]
    assert rows[0].paths == ["m.py", "n.py"] and ids(rows[0]) == ["TODO"]
    assert [tuple(t) for t in rows[1].targets] == [("p.py", "# TODO", "patch"), ("q.py", "# TODO", "patch")] and rows[1].languages == ["python"]
    assert rows[2].tool == "Read" and rows[2].paths == ["b.rs"] and rows[2].languages == ["rust"] and rows[2].session == "" and rows[2].event == "5"


def test_platforms(run, spark):
    block = bash("x", "PostToolUse") | {"tool_input": {"path": "a_helper"}}
    assert json.loads(run(block, platform="codex")[0].output) == {"continue": False, "stopReason": "[NAME | CRITICAL] bad name"}
    assert json.loads(run(block)[0].output) == {"decision": "block", "reason": "[NAME | CRITICAL] bad name"}
    opened = run({"hook_event_name": "tool.execute.before", "tool_name": "bash", "tool_input": {"command": "git push --no-verify"}}, {"hook_event_name": "session.idle", "stop_response": "That was already broken"}, platform="opencode")
    assert opened[0].tool == "Bash" and json.loads(opened[0].output)["action"] == "block"
    assert ids(opened[1]) == ["STOP-001", "STOP-002"] and json.loads(opened[1].output)["action"] == "continue"
    stop = run({"hook_event_name": "Stop", "stop_response": "out of scope"})[0]
    assert json.loads(stop.output)["reason"].startswith("[STOP-001 | HIGH]") and json.loads(stop.output)["reason"].endswith("clean.")
    assert run({"hook_event_name": "SubagentStop"}, platform="codex")[0].output is None
    with pytest.raises(Exception, match="unknown platform"):
        run("{}", platform="other")


def test_errors_and_config(run):
    out = lambda text, cmd="make": bash(cmd, "PostToolUse") | {"tool_response": {"stdout": text, "stderr": ""}}
    rows = run(
        out("Traceback (most recent call last)\nValueError: x"), out("4 passed in 0.1s\nBuild FAILED"), out("KeyError"), out("Found 3 errors in x", "cat log | sort"), out("Found 3 errors in x"),
        bash("make", "PostToolUseFailure"), bash("grep x", "PostToolUseFailure"), bash("make", "PostToolUseFailure") | {"is_interrupt": True},
        {"hook_event_name": "ConfigChange", "source": "user_settings", "changes": {"disableAllHooks": True}}, {"hook_event_name": "ConfigChange", "source": "user_settings", "changes": {"hooks": {}}}, {"hook_event_name": "ConfigChange", "source": "x", "changes": {"hooks": {}}},
    )
    assert [ids(r) for r in rows] == [["ERRORS-BASH-001"], [], [], [], ["ERRORS-BASH-001"], ["ERRORS-FAIL-001"], [], [], ["CONFIG-001"], ["CONFIG-001"], []]
    assert [f.severity for f in rows[8].findings] == [40] and [f.severity for f in rows[9].findings] == [30]


def test_large_and_guard(run):
    rows = run(write("a.txt", "x" * 50001), write("a.txt", "x" * 50000), write("cfg.json", "disable the guard"), write("test_cfg.json", "disable the guard"))
    assert [ids(r) for r in rows] == [["WARN-LARGE-001"], [], ["BUILTIN-RULEBOOK-SECURITY"], []]
    assert "50,001" in rows[0].context


def test_overrides_and_modes(run, spark):
    rows = run(write("a.py", "TODO"), overrides={"TODO": "WARN"})
    assert rows[0].decision is None and rows[0].findings[0].severity == 10
    assert run(write("a.py", "TODO"), overrides={"TODO": "odd"})[0].findings[0].severity == 20
    raw = spark.createDataFrame([(0, "claude", json.dumps(write("a.py", "TODO")), False, False, False), (1, "claude", json.dumps(write("/etc/x.py", "TODO")), False, False, False), (2, "claude", json.dumps(write("a.py", "TODO")), True, True, False), (3, "claude", json.dumps(write("a.py", "TODO")), True, False, True)], "ord long, platform string, raw string, enrolled boolean, repo_disabled boolean, skipped boolean")
    got = evaluate_events(raw, POLICY, RULES).orderBy("ord").collect()
    assert [ids(r) for r in got] == [[], ["GLOBAL-BUILTIN-SYSTEM-PROTECTION"], [], []] and [r.mode for r in got] == ["outside_repo", "outside_repo", "repo_relaxed", "repo_strict"]


def test_full_read(spark):
    read = {"hook_event_name": "PreToolUse", "tool_name": "Read", "tool_input": {"file_path": "/a.py", "offset": 1}}
    exempt = {"hook_event_name": "PreToolUse", "tool_name": "Read", "tool_input": {"file_path": "/a.md", "limit": 1}}
    raw = spark.createDataFrame([(0, json.dumps(read), False, 1), (1, json.dumps(read), True, 1), (2, json.dumps(read), False, 40001), (3, json.dumps(exempt), False, 1)], "ord long, raw string, full_read_known boolean, file_bytes long").withColumn("platform", F.lit("claude"))
    assert [ids(r) for r in evaluate_events(raw).orderBy("ord").collect()] == [["BUILTIN-ENFORCE-FULL-READ"], [], [], []]


def test_baseline(spark):
    new = lambda n: json.dumps({"rules": {"r": [str(i) for i in range(n)]}})
    raw = spark.createDataFrame([(i, "claude", json.dumps(write("x/baselines.json", new(n))), new(2)) for i, n in enumerate((3, 2, 1))], "ord long, platform string, raw string, old_baseline string")
    assert [ids(r) for r in evaluate_events(raw).orderBy("ord").collect()] == [["BASELINE-001"], [], []]
