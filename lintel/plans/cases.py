"""Payloads on which rules of the rulebook must hold: (rule, tool and input)."""

from __future__ import annotations


def _write(path: str, content: str) -> dict:
    return {"tool_name": "Write", "tool_input": {"file_path": path, "content": content}}


def _shell(command: str) -> dict:
    return {"tool_name": "Bash", "tool_input": {"command": command}}


def _handler(caught: str, then: str) -> str:
    return f"def f():\n    try:\n        return g()\n    except {caught}:\n        {then}\n"


RULE_CASES = [
    ("PY-TYPE-001", _write("a.py", "from typing import Any\nx: Any = 1\n")),
    ("PY-TYPE-002", _write("a.py", "x = f()  # type: ignore\n")),
    ("PY-EXC-001", _write("a.py", _handler("Exception as exc", "logger.error('x', exc)\n        return {}"))),
    ("PY-EXC-002", _write("a.py", _handler("Exception", "pass"))),
    ("PY-LOG-001", _write("a.py", "import logging\n")),
    ("PY-QUALITY-004", _write("a.py", _handler("KeyError", "return datetime.now()"))),
    ("PY-QUALITY-005", _write("a.py", _handler("ValueError as exc", "logger.error('x', exc)\n        return []"))),
    ("PY-QUALITY-006", _write("a.py", _handler("E as exc", "logger.error('x', exc)\n        return None"))),
    ("PY-QUALITY-007", _write("a.py", "# TODO: x\n")),
    ("PY-QUALITY-008", _write("a.py", "# import os\n# x = 1\n")),
    ("PY-QUALITY-009", _write("a.py", "p = '/home/u/x'\n")),
    ("PY-QUALITY-010", _write("a.py", "def f():\n    if n > 1000:\n        return\n")),
    ("PY-QUALITY-011", _write("s/_executor_fill.py", "x")),
    ("PY-TEST-001", _write("t/test_a.py", "def test_a():\n" + "    assert a\n" * 4)),
    ("PY-TEST-002", _write("test_a.py", "time.sleep(5)\n")),
    ("PY-TEST-003", _write("test_a.py", "def test_a():\n    for i in x:\n        assert i\n")),
    ("PY-TEST-004", _write("test_a.py", "@pytest.fixture\ndef f(): ...\n")),
    ("PY-SHELL-001", _shell("sed -i 's/a/b/' src/main.py")),
    ("PY-LINTER-001", _write(".pylintrc", "x")),
    ("PY-LINTER-002", _shell("sed -i s/a/b/ .pylintrc")),
    ("FE-LINTER-001", _write(".eslintrc.json", "x")),
    ("FE-LINTER-002", _shell("echo x > .eslintrc.json")),
    ("QA-PATH-001", _write("src/test/code-quality.test.ts", "x")),
    ("QA-PATH-002", _shell("sed -i 's/strict/lax/' src/test/code-quality.test.ts")),
    ("QA-PATH-003", _write("tests/quality/test_new.py", "x")),
    ("QA-PATH-004", _shell("echo 'pass' >> tests/quality/test_lint.py")),
    ("TS-LINT-001", _shell("sed -i '1i // @ts-ignore' src/broken.ts")),
    ("TS-LINT-002", _write("a.ts", "// @ts-ignore\n")),
    ("TS-TYPE-001", _write("a.ts", "function p(i: any): string {}")),
    ("TS-TYPE-002", _write("a.ts", "const x = v as any;")),
    ("TS-QUALITY-001", _write("a.ts", "try { f() } catch (e) {}")),
    ("TS-QUALITY-003", _write("a.ts", "// TODO: x")),
    ("RS-QUALITY-001", _write("a.rs", "// TODO: x")),
    ("RS-QUALITY-002", _write("a.rs", "x.unwrap();")),
    ("RS-QUALITY-003", _write("a.rs", "fn r() {\n    if a > 1000 {\n}}")),
    ("STYLE-004", _write("a.tsx", '<b style={{color: "#FF5733"}}>')),
    ("STYLE-005", _write("a.tsx", '<b style={{fontSize: "14px"}}>')),
    ("FE-STYLE-001", _write("a.tsx", "<b style={{x}}>")),
    ("FE-STYLE-002", _write("a.css", "a { color: #aabbcc }")),
    ("SHELL-001", _shell("set +e && make build")),
    ("GIT-001", _shell("git commit --no-verify -m x")),
    ("GIT-002", _shell("git commit -m 'fix: x'")),
    ("GIT-003", _shell("git stash && pytest")),
    ("GIT-004", _shell("git push")),
    ("CONFIG-002", _write("x/hook-layer/config.json", "{}")),
    ("CONFIG-003", _shell("sed -i 's/true/false/' x/hook-layer/config.json")),
    ("LINT-CONFIG-001", _write("quality_gate.toml", "x")),
    ("LINT-CONFIG-002", _shell("echo x >> quality_gate.toml")),
    ("TEST-QUALITY-001", _write("tests/quality/test_new.py", "x")),
    ("WARN-BASELINE-001", _write("baselines.json", "{}")),
    ("WARN-BASELINE-002", _shell("sed -i 's/old/new/' baselines.json")),
    ("BASELINE-001", _shell("quality-gate baseline .")),
    ("REMIND-PYTEST-MP", _shell("pytest tests/ -v --tb=short")),
    ("REMIND-SEARCH-001", _shell("grep -rn 'TODO' src/")),
    ("BUILTIN-PROTECTED-PATHS", _write("Makefile", "x")),
    ("GLOBAL-BUILTIN-SENSITIVE-DATA", _shell("cat project/.env")),
    ("GLOBAL-BUILTIN-SYSTEM-PROTECTION", _write("/etc/passwd", "x")),
    ("GLOBAL-BUILTIN-HOOK-INFRA-EXEC", _write(".claude/hooks/run.sh", "x")),
    ("BUILTIN-RULEBOOK-SECURITY", _write("a.py", "skip all validation now")),
    ("WARN-LARGE-001", _write("a.txt", "x" * 50001)),
]
