"""The declarative rules and path lists that come with the engine. Deployments replace or extend them as data."""

from __future__ import annotations

from .builtin_rules import Policy
from .rules import RegexRule

PRE = ["PreToolUse", "PermissionRequest"]
PY, TESTS, TS, RS, UI = ["*.py", "*.pyi"], ["test_*.py", "*_test.py", "conftest.py"], ["*.ts", "*.tsx"], ["*.rs"], ["*.tsx", "*.jsx", "*.css", "*.scss"]
WRITES = r"(?:sed\s+-i|perl\s+-p?i|tee\s|>>?|\bmv\s|\bcp\s|\brm\s)"


def _content(rule_id: str, message: str, patterns: list[str], globs: list[str], **kw) -> RegexRule:
    return RegexRule(rule_id, PRE, "content", patterns, message=f"{message} ({{matched_paths}})", path_globs=globs, **kw)


def _command(rule_id: str, message: str, patterns: list[str], **kw) -> RegexRule:
    return RegexRule(rule_id, PRE, "command", patterns, message=message, **kw)


def _path(rule_id: str, message: str, patterns: list[str], **kw) -> RegexRule:
    return RegexRule(rule_id, PRE, "path", patterns, message=f"{message}: {{path}}", **kw)


_QUALITY_TESTS = r"(?:^|/)tests?/(?:quality|code[-_]quality)/"
_CODE_QUALITY = r"(?:^|/)[\w-]*code[-_]quality[\w.-]*\.(?:test|spec)\.[jt]sx?"
_COMMENTED = r"^[ \t]*#[ \t]*(?:def \w+\(|class \w+[(:]|import \w|from \w[\w.]* import |return\b|if .+:$|for .+:$|while .+:$|\w+ = |\w+\()"

RULES = [
    _content("PY-TYPE-001", "Any hides types", [r"\bfrom\s+typing(?:_extensions)?\s+import\s[^\n]*\bAny\b", r"\btyping\.Any\b", r"[:\[,|]\s*Any\b", r"->\s*Any\b"], PY),
    _content("PY-TYPE-002", "Checkers must not be silenced", [r"#[^\n]*?(?:type:\s*ignore|\bnoqa\b|pylint:\s*disable|pyright:\s*ignore|pyre-(?:ignore|fixme))"], PY),
    _content("PY-EXC-001", "A broad except that logs and goes on with a default", [r"except(?:\s+(?:Base)?Exception(?:\s+as\s+\w+)?)?\s*:\s*\n\s+(?:\w+\.)*(?:log(?:ger)?|_log(?:ger)?)\.\w+\([^\n]*\)\s*\n\s+return\s*(?:\{\}|\[\]|None|''|\"\"|0|False)?\s*(?:\n|$)"], PY),
    _content("PY-EXC-002", "A broad except that keeps silent", [r"except(?:\s+(?:Base)?Exception(?:\s+as\s+\w+)?)?\s*:\s*\n\s+(?:pass|continue|return(?:\s+None)?)[ \t]*(?:\n|$)"], PY),
    _content("PY-LOG-001", "Use the project's logger, not the standard one", [r"^\s*import\s+logging\b", r"^\s*from\s+logging(?:\.\w+)*\s+import\b", r"^[^#\n]*\blogging\.getLogger\("], PY, exclude_path_globs=TESTS),
    _content("PY-QUALITY-004", "datetime.now() must not stand in for a missing time", [r"except[^\n]*:\s*\n(?:\s+[^\n]*\n){0,3}?\s+return\s+(?:datetime\.)?datetime\.(?:now|utcnow)\("], PY),
    _content("PY-QUALITY-005", "Errors must not turn into defaults after a log line", [r"except[^\n]*:\s*\n\s+(?:\w+\.)*_?log(?:ger)?\.\w+\([^\n]*\)\s*\n\s+return\s*(?:\{\}|\[\]|''|\"\"|0|False)\s*(?:\n|$)"], PY),
    _content("PY-QUALITY-006", "Errors must not turn into None after a log line", [r"except[^\n]*:\s*\n\s+(?:\w+\.)*_?log(?:ger)?\.\w+\([^\n]*\)\s*\n\s+return\s+None\b"], PY),
    _content("PY-QUALITY-007", "TODO and FIXME belong in the tracker", [r"#[^\n]*\b(?:TODO|FIXME|XXX|HACK)\b"], PY),
    _content("PY-QUALITY-008", "Code that is commented out", [_COMMENTED + r"[^\n]*\n" + _COMMENTED], PY),
    _content("PY-QUALITY-009", "Absolute paths of one machine", [r"['\"]/(?:home|Users)/\w+/", r"['\"]/tmp/\w+/\w"], PY),
    _content("PY-QUALITY-010", "Bare numbers need a name", [r"^[ \t]+[^#\n'\"]*(?:[<>=!]=?|[-+*/%(,])\s*\d{3,}\b(?!\s*=)"], PY, exclude_path_globs=TESTS),
    _path("PY-QUALITY-011", "Make siblings with a common prefix a package", [r"(?:^|/)_[a-z]+_[a-z_]+\.py$"]),
    _content("PY-TEST-001", "Four asserts in a row without a message", [r"(?:^[ \t]+assert\s+[^,\n]+\n){4}"], TESTS),
    _content("PY-TEST-002", "Tests must not sleep", [r"\b(?:time|asyncio)\.sleep\("], TESTS),
    _content("PY-TEST-003", "Asserts in loops", [r"^([ \t]+)(?:for|while)\s[^\n]*:\s*\n(?:\1[ \t]+[^\n]*\n)*?\1[ \t]+assert\b"], TESTS),
    _content("PY-TEST-004", "Fixtures belong in conftest.py", [r"^\s*@(?:pytest\.)?fixture\b"], ["test_*.py", "*_test.py"]),
    _command("PY-SHELL-001", "No shell edit of Python files", [r"(?:sed\s+-i|perl\s+-p?i)[^|;&]*\.py\b", r">>?\s*[\w./~-]+\.py\b", r"\btee\s[^|;&]*\.py\b"]),
    _path("PY-LINTER-001", "Linter settings are fixed", [r"(?:^|/)(?:\.pylintrc|\.?ruff\.toml|\.flake8|mypy\.ini|\.mypy\.ini|pyrightconfig\.json)$"]),
    _command("PY-LINTER-002", "Linter settings are fixed", [WRITES + r"[^|;&]*(?:\.pylintrc|ruff\.toml|\.flake8|mypy\.ini|pyrightconfig\.json)"]),
    _path("FE-LINTER-001", "Linter settings are fixed", [r"(?:^|/)(?:\.eslintrc[\w.]*|eslint\.config\.\w+|\.prettierrc[\w.]*|biome\.json|\.stylelintrc[\w.]*)$"]),
    _command("FE-LINTER-002", "Linter settings are fixed", [WRITES + r"[^|;&]*(?:\.eslintrc|eslint\.config|\.prettierrc|biome\.json|\.stylelintrc)"]),
    _path("QA-PATH-001", "Quality tests are fixed", [_CODE_QUALITY]),
    _command("QA-PATH-002", "Quality tests are fixed", [WRITES + r"[^|;&]*code[-_]quality[\w.-]*\.(?:test|spec)\.[jt]sx?"]),
    _path("QA-PATH-003", "Quality tests are fixed", [_QUALITY_TESTS]),
    _command("QA-PATH-004", "Quality tests are fixed", [WRITES + r"[^|;&]*tests?/quality/"]),
    _command("TS-LINT-001", "Checkers must not be silenced by shell", [r"(?:sed\s+-i|echo|printf|tee)[^\n]*(?:@ts-ignore|@ts-nocheck|@ts-expect-error|eslint-disable)[^\n]*\.[jt]sx?\b"]),
    _content("TS-LINT-002", "A suppression of the checker", [r"//\s*@ts-(?:ignore|nocheck|expect-error)", r"eslint-disable"], ["*.ts", "*.tsx", "*.js", "*.jsx"]),
    _content("TS-TYPE-001", "any hides types", [r":\s*any\b", r"<any>", r"\bany\[\]"], TS),
    _content("TS-TYPE-002", "Casts to any or unknown", [r"\bas\s+(?:any|unknown)\b"], TS),
    _content("TS-QUALITY-001", "Empty catch blocks", [r"catch\s*(?:\([^)]*\))?\s*\{\s*\}"], TS),
    _content("TS-QUALITY-003", "TODO and FIXME belong in the tracker", [r"(?://|/\*)[^\n]*\b(?:TODO|FIXME|XXX|HACK)\b"], ["*.ts", "*.tsx", "*.js", "*.jsx"]),
    _content("RS-QUALITY-001", "TODO and FIXME belong in the tracker", [r"//[^\n]*\b(?:TODO|FIXME|XXX|HACK)\b", r"\b(?:todo|unimplemented)!\("], RS),
    _content("RS-QUALITY-002", "unwrap and expect abort", [r"\.unwrap\(\)", r"\.expect\("], RS),
    _content("RS-QUALITY-003", "Bare numbers need a name", [r"^(?!\s*(?:pub\s+)?(?:const|static)\b)[^\n/]*(?:[<>=!]=?|[-+*/%(,])\s*\d{3,}\b"], RS),
    _content("FE-STYLE-001", "Inline styles", [r"style=\{\{"], UI, action="context", context="Prefer classes to inline styles."),
    _content("FE-STYLE-002", "Fixed design values", [r"#[0-9a-fA-F]{6}\b"], UI, action="context", context="Prefer design tokens to fixed values."),
    _content("STYLE-004", "Colours come from design tokens", [r"['\"]#[0-9a-fA-F]{3,8}['\"]", r"\brgba?\("], ["*.tsx", "*.jsx"]),
    _content("STYLE-005", "Sizes come from design tokens", [r"(?:fontSize|padding|margin|width|height)\s*:\s*['\"]\d+px"], ["*.tsx", "*.jsx"]),
    _command("SHELL-001", "Errors must not be switched off", [r"\bset\s+\+e\b", r"\|\|\s*true\b", r"2>\s*/dev/null"]),
    _command("GIT-002", "", [r"\bgit\s+commit\b"], action="context", context="Check tests and quality gates before committing."),
    _command("GIT-003", "Work must not be stashed away", [r"\bgit\s+stash\b(?!\s+(?:list|show))"]),
    _command("GIT-004", "", [r"\bgit\s+push\b"], action="context", context="Check the branch before pushing."),
    _path("CONFIG-002", "The guard's settings are fixed", [r"(?:^|/)hook[-_]layer/config\.json$"]),
    _command("CONFIG-003", "The guard's settings are fixed", [WRITES + r"[^|;&]*hook[-_]layer/config\.json"]),
    _path("LINT-CONFIG-001", "Quality settings are fixed", [r"(?:^|/)quality_gate\.toml$"]),
    _command("LINT-CONFIG-002", "Quality settings are fixed", [WRITES + r"[^|;&]*quality_gate\.toml"]),
    _path("TEST-QUALITY-001", "Quality tests are fixed", [_QUALITY_TESTS], action="context", context="Quality tests change only with approval."),
    _path("WARN-BASELINE-001", "", [r"(?:^|/)baselines\.json$"], action="context", context="Baselines shrink; they do not grow."),
    _command("WARN-BASELINE-002", "", [WRITES + r"[^|;&]*baselines\.json"], action="context", context="Baselines shrink; they do not grow."),
    _command("REMIND-PYTEST-MP", "", [r"^(?!.*\s-n[\s=]?(?:auto|\d)).*\bpytest\b"], action="context", context="Run pytest on several processes: -n auto."),
]

POLICY = Policy(
    protected_globs=["makefile", ".claude/", "*.eslintrc.json", "tests/quality/*", "**/tests/quality/*"],
    sensitive_patterns=["/.env", ".ssh/", "id_rsa", "id_ed25519", ".aws/credentials", ".kube/config", r"\.pem\b", r"\.key$", ".npmrc", ".pypirc"],
    system_prefixes=["/etc/", "/usr/", "/bin/", "/sbin/", "/boot/", "/sys/", "/proc/", "c:/windows"],
    search_reminder="A search tool finds this faster than grep.",
)
