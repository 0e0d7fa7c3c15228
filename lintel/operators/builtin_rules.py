"""The built-in rules that need no syntax tree, as expressions over canonical events.

Facts from outside the events (file sizes, exit codes, git output, earlier full reads) are columns of the input where
a rule needs them: full_read_known, file_bytes, exit_codes, git_context, prompt_context, transcript.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.globs import any_matches
from ..functions.paths import lower_path
from .events import is_edit_tool
from .rules import Rule, finding

#: Lists the rules go by.
READ_TOOLS = ["read", "grep", "glob", "webfetch", "websearch"]
SAFE_READ_VERBS = ["cat", "less", "more", "head", "tail", "grep", "egrep", "fgrep", "zgrep", "wc", "file", "stat", "ls", "find", "awk", "sort", "uniq", "diff", "cmp", "md5sum", "sha256sum", "hexdump", "strings", "od"]
SAFE_SUFFIXES = [".example", ".sample", ".template", ".defaults", ".dist", ".test", ".bak"]
READ_EXEMPT = [".md", ".json", ".jsonl", ".yaml", ".yml", ".txt", ".log", ".csv"]
DISMISSALS = ["pre-existing", "preexisting", "already existed", "was already", "existed before", "not introduced by", "outside the scope", "out of scope", "not my change"]
GUARD_PATTERNS = ["bypass_permissions", "allowManagedHooksOnly", "disable.*guard", "disable.*rule", "skip.*validation"]
READ_ONLY_PREFIXES = ["grep ", "grep\t", "egrep ", "fgrep ", "rg ", "ag ", "ack ", "cat ", "head ", "tail ", "less ", "more ", "bat ", "ls ", "ls\t", "ll ", "dir ", "tree ", "du ", "df ", "wc ", "find ", "locate ", "fd ", "git log", "git show", "git diff", "git status", "git blame", "git branch", "git tag", "git remote", "git stash list", "which ", "whereis ", "type ", "file ", "stat ", "echo ", "printf ", "env", "printenv", "man ", "help ", "pwd"]
READ_ONLY_START = r"(?i)^(?:command\s+-v|type\s+|hash\s+|readlink\s+|realpath\s+|basename\s+|dirname\s+)"
BENIGN_FAILURES = [r"(?i)^(grep|egrep|fgrep|rg|ag|ack)\b", r"(?i)^diff\b", r"(?i)^(test\s|\[\s)", r"(?i)^(which|command\s+-v|type\s+|hash\s+)\b", r"(?i)^git\s+diff\b.*--exit-code", r"(?i)^curl\b.*--fail"]
ERROR_SIGNALS = [
    r"(?i)\bFAILED\b.*test", r"(?i)\bFAIL\s+(?:src/|tests/)", r"(?i)Tests?:\s+\d+\s+failed", r"(?i)test result: FAILED", r"(?i)\d+\s+failed,\s+\d+\s+passed", r"(?m)^.*:\d+:\d+:\s+error:",
    r"(?i)make:\s+\*\*\*.*Error\s+\d+", r"(?i)Build FAILED", r"(?i)compilation\s+error", r"Traceback \(most recent call last\)",
    r"(?:SyntaxError|TypeError|NameError|ValueError|AttributeError|ImportError|KeyError|IndexError|RuntimeError|AssertionError|FileNotFoundError|ModuleNotFoundError|OSError|PermissionError):",
    r"(?i)Found\s+\d+\s+error", r"(?i)error\[E\d+\]", "✗|✘",
]
SUCCESS_SIGNALS = [r"(?m)^\s*\d+\s+passed(?:\s+in\s+[\d.]+s)?\s*$", "(?i)DEPRECATION:|DeprecationWarning|PendingDeprecationWarning", r"(?i)\d+\s+warnings?\s+found\s+\(use\s+docker", r"(?i)Successfully\s+(built|installed|tagged|created)"]
BASELINE_COMMANDS = ["quality-gate baseline", "lint baseline"]
LARGE_CHARS, LARGE_FILE_BYTES = 50_000, 40_000
PRE = ("PreToolUse", "PermissionRequest")


@dataclass(frozen=True)
class Policy:
    """What a deployment sets. Empty lists switch their rule off."""

    protected_globs: list[str] = field(default_factory=list)
    sensitive_patterns: list[str] = field(default_factory=list)
    system_prefixes: list[str] = field(default_factory=list)
    infra_fragments: list[str] = field(default_factory=lambda: ["hook-layer/config.json", "hook_layer/", ".claude/hooks/"])
    config_fragments: list[str] = field(default_factory=list)
    guard_excluded: list[str] = field(default_factory=lambda: ["hook_layer/", "hook-layer/", ".claude/hooks/", "test_", "fixture"])
    search_reminder: str = ""
    disabled: tuple[str, ...] = ()
    read_exempt: list[str] = field(default_factory=lambda: READ_EXEMPT)


def any_of(c: Column, items: list[str], test) -> Column:
    out = F.lit(False)
    for x in items:
        out = out | test(c, x)
    return out


def contains_any(c: Column, items: list[str]) -> Column:
    return any_of(c, items, lambda a, x: a.contains(x))


def quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in word)


def has_word(command: Column, word: str) -> Column:
    return command.rlike(rf"(?i)(^|\s){quoted(word)}(\s|$)")


def safe_read(command: Column) -> Column:
    """A shell command that only reads: a reading verb stands alone in it and nothing is written."""
    low = F.lower(command)
    verbs = "|".join(quoted(v) for v in SAFE_READ_VERBS)
    return ~contains_any(low, ["sed -i", "tee ", ">>", " > "]) & low.rlike(rf"(^|\s)(?:{verbs})(\s|$)")


def read_only_command(command: Column) -> Column:
    low = F.lower(F.trim(command))
    first = F.trim(F.substring_index(low, "|", 1))
    starts = lambda c: any_of(c, READ_ONLY_PREFIXES, lambda a, p: a.startswith(p) | (a == p.strip()))
    return starts(low) | low.rlike(READ_ONLY_START) | starts(first)


def benign_failure(command: Column) -> Column:
    return any_of(F.trim(command), BENIGN_FAILURES, lambda c, p: c.rlike(p))


def signal_count(text: Column) -> Column:
    out = F.lit(0)
    for p in ERROR_SIGNALS:
        out = out + text.rlike(p).cast("int")
    return out


def error_signals(text: Column) -> Column:
    """Two signals, or one without a sign of success; never in fewer than 10 characters."""
    good = any_of(text, SUCCESS_SIGNALS, lambda c, p: c.rlike(p))
    n = signal_count(text)
    return (F.length(F.trim(text)) >= 10) & (n > 0) & ~(good & (n <= 1))


def git_bypass(command: Column) -> Column:
    low = F.lower(command)
    return (
        F.when(low.contains("--no-verify") & contains_any(low, ["git commit", "git push", "git merge"]), "--no-verify")
        .when(low.contains("git commit") & contains_any(low, [" -n ", "\t-n ", " -an ", " -nm "]), "-n (shorthand for --no-verify)")
        .when(low.contains("core.hookspath") & low.contains("/dev/null"), "core.hookspath=/dev/null")
    )


def sensitive_regex(patterns: list[str]) -> list[str]:
    """Patterns without metacharacters are plain text."""
    out = []
    for p in (x.strip() for x in patterns):
        if p:
            out.append("(?iu)" + (p if any(c in "[](){}*+?|^$\\" for c in p) else quoted(p)))
    return out


def sensitive_path(path: Column, patterns: list[str]) -> Column:
    low = lower_path(path)
    return ~any_of(low, SAFE_SUFFIXES, lambda c, x: c.endswith(x)) & any_of(low, sensitive_regex(patterns), lambda c, p: c.rlike(p))


def sensitive_command(command: Column, patterns: list[str]) -> Column:
    """A match whose tail, up to the next break, does not start with a safe suffix."""
    low, out = F.lower(command), F.lit(False)
    safe = "|".join(quoted(s) for s in SAFE_SUFFIXES)
    bare = "|".join(quoted(s[1:]) for s in SAFE_SUFFIXES)
    for p in sensitive_regex(patterns):
        tail = re.compile(p).groups + 1
        out = out | F.exists(F.regexp_extract_all(low, F.lit(f"{p}(?=([^ \\t\\n;|&><]*))"), F.lit(tail)), lambda t: ~t.rlike(rf"^(?:{safe})|^(?:{bare})\z"))
    return out


def system_path(path: Column, prefixes: list[str]) -> Column:
    return any_of(lower_path(path), [p.lower() for p in prefixes], lambda c, p: c.startswith(p))


def system_command(command: Column, prefixes: list[str]) -> Column:
    low = F.lower(command)
    return any_of(low, [p.lower() for p in prefixes], lambda c, p: c.rlike(rf"(?:^|[\s;|&(]){quoted(p)}") if p.startswith("/") else c.contains(p))


def first_path(test) -> Column:
    return F.try_element_at(F.filter("paths", test), F.lit(1))


def _protected(p: Policy) -> Column:
    hit = first_path(lambda x: any_matches(x, p.protected_globs)) if p.protected_globs else F.lit(None).cast("string")
    reads = F.lower("tool").isin(*READ_TOOLS) | ((F.lower("tool") == "bash") & safe_read(F.col("command")))
    return F.when(hit.isNotNull() & ~reads, finding("BUILTIN-PROTECTED-PATHS", "HIGH", "deny", F.concat(F.lit("This path is protected: "), hit), None, F.struct(hit.alias("path"))))


def _sensitive(p: Policy) -> Column:
    hit = F.coalesce(first_path(lambda x: sensitive_path(x, p.sensitive_patterns)), F.when((F.col("command") != "") & sensitive_command(F.col("command"), p.sensitive_patterns), "[command]"))
    return F.when(hit.isNotNull(), finding("GLOBAL-BUILTIN-SENSITIVE-DATA", "HIGH", "deny", F.concat(F.lit("Access to sensitive data is blocked: "), hit), None, F.struct(hit.alias("target"))))


def _system(p: Policy) -> Column:
    hit = F.coalesce(first_path(lambda x: system_path(x, p.system_prefixes)), F.when((F.col("command") != "") & system_command(F.col("command"), p.system_prefixes), "[command]"))
    return F.when(hit.isNotNull(), finding("GLOBAL-BUILTIN-SYSTEM-PROTECTION", "CRITICAL", "deny", F.concat(F.lit("Access to system paths is blocked: "), hit), None, F.struct(hit.alias("target"))))


def _infra(p: Policy) -> Column:
    """The first path that names a protected fragment decides: silent for reading commands, else denied for tools that write."""
    low = lambda x: F.lower(x)
    writes = (F.lower("tool") == "bash") | is_edit_tool(F.col("tool"))
    passes = ((F.lower("tool") == "bash") & safe_read(F.col("command"))) | F.lower("tool").isin("read", "grep", "glob")
    hit = first_path(lambda x: contains_any(low(x), p.config_fragments + p.infra_fragments))
    kind = F.when(contains_any(low(hit), p.config_fragments), "config").otherwise("infra")
    return F.when(hit.isNotNull() & ~passes & writes, finding("GLOBAL-BUILTIN-HOOK-INFRA-EXEC", "CRITICAL", "deny", F.concat(F.lit("The guard's own files are protected: "), hit), None, F.struct(hit.alias("path"), kind.alias("kind"))))


def _guard(p: Policy) -> Column:
    pattern = "(?i)(?:" + "|".join(GUARD_PATTERNS) + ")"
    hit = F.try_element_at(F.transform(F.filter("targets", lambda t: ~contains_any(F.lower(t.path), p.guard_excluded) & t.content.rlike(pattern)), lambda t: t.path), F.lit(1))
    return F.when(hit.isNotNull(), finding("BUILTIN-RULEBOOK-SECURITY", "HIGH", "deny", F.concat(F.lit("Guardrail settings must not be weakened: "), hit), None, F.struct(hit.alias("path"))))


def _git() -> Column:
    kind = F.when(F.col("command") != "", git_bypass(F.col("command")))
    return F.when(kind.isNotNull(), finding("GIT-001", "HIGH", "deny", F.concat(F.lit("Git hooks must not be bypassed: "), kind), None, F.struct(kind.alias("bypass_type"), F.left("command", F.lit(200)).alias("command"))))


def _search(p: Policy) -> Column:
    asks = F.col("tool").isin("Grep", "WebSearch") | ((F.col("command") != "") & has_word(F.lower("command"), "grep"))
    return F.when(F.lit(bool(p.search_reminder)) & asks, finding("REMIND-SEARCH-001", "LOW", None, None, p.search_reminder))


def _full_read(p: Policy) -> Column:
    """A partial read of a file never read in full: its last path counts, unless any path is exempt or the file is large."""
    target = F.try_element_at("paths", F.lit(-1))
    exempt = F.exists("paths", lambda x: any_of(F.lower(x), p.read_exempt, lambda c, s: c.endswith(s)))
    part = V.has(F.col("i"), "offset") | V.has(F.col("i"), "limit")
    denied = (F.col("tool") == "Read") & target.isNotNull() & ~exempt & part & ~F.coalesce("full_read_known", F.lit(False)) & (F.coalesce("file_bytes", F.lit(0)) <= LARGE_FILE_BYTES)
    return F.when(denied, finding("BUILTIN-ENFORCE-FULL-READ", "MEDIUM", "deny", F.concat(F.lit("Read the whole file first: "), target), None, F.struct(target.alias("path"))))


def _prompt() -> Column:
    got = F.filter(F.transform(F.coalesce("prompt_context", F.array().cast("array<struct<name:string,text:string>>")), lambda x: F.when(F.length(F.trim(x.text)) > 0, F.concat(F.lit("## "), x["name"], F.lit("\n"), F.trim(x.text)))), lambda x: x.isNotNull())
    return F.when(F.size(got) > 0, finding("BUILTIN-INJECT-PROMPT", "LOW", None, None, F.array_join(got, "\n\n")))


def _quality() -> Column:
    """exit_codes: array<struct<command, code, output, block>> of quality commands that ran elsewhere."""
    bad = F.filter(F.coalesce("exit_codes", F.array().cast("array<struct<command:string,code:int,output:string,block:boolean>>")), lambda x: x.code != 0)
    text = F.array_join(F.transform(bad, lambda x: F.concat(x.command, F.lit(": "), F.coalesce(x.output, F.lit("")))), "\n")
    blocks = F.exists(bad, lambda x: F.coalesce(x.block, F.lit(False)))
    return F.when(F.size(bad) > 0, F.when(blocks, finding("QUALITY-POST-001", "HIGH", "block", text)).otherwise(finding("QUALITY-POST-001", "HIGH", None, None, text)))


def last_assistant(transcript: Column) -> Column:
    """Text of the newest assistant turn of array<struct<turn, role, text>>."""
    own = F.filter(transcript, lambda t: t.role == "assistant")
    return F.try_element_at(F.array_sort(F.transform(own, lambda t: F.struct((-t.turn).alias("k"), t.text.alias("text")))), F.lit(1))["text"]


def dismissal(text: Column) -> Column:
    low, out = F.lower(text), F.lit(None).cast("string")
    for p in reversed(DISMISSALS):
        out = F.when(low.contains(p), p).otherwise(out)
    return out


def _stop() -> Column:
    said = F.coalesce(F.nullif(last_assistant(F.col("transcript")), F.lit("")), V.text(F.col("v"), "stop_response"))
    phrase = dismissal(said)
    return F.when(phrase.isNotNull(), finding("STOP-001", "HIGH", "block", "Problems that were found must be fixed or flagged, not dismissed.", None, F.struct(phrase.alias("matched_phrase"))))


def large_targets(targets: Column, most: int = LARGE_CHARS) -> Column:
    return F.filter(targets, lambda t: F.length(t.content) > most)


def _large() -> Column:
    big = large_targets(F.col("targets"))
    return F.transform(big, lambda t: finding("WARN-LARGE-001", "MEDIUM", None, None, F.concat(F.lit("WARNING: "), t.path, F.lit(" has "), F.format_number(F.length(t.content), 0), F.lit(" characters. Consider splitting it.")), F.struct(t.path.alias("path"), F.length(t.content).alias("chars"))))


def _session() -> Column:
    got = F.filter(F.coalesce("git_context", F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    return F.when(F.size(got) > 0, finding("SESSION-001", "LOW", None, None, F.concat(F.lit("# Project context\n\n"), F.array_join(got, "\n\n"))))


def _config() -> Column:
    source, changes = V.text(F.col("v"), "source"), V.member(F.col("v"), "changes")
    guarded = F.coalesce(source.isin("project_settings", "local_settings", "user_settings"), F.lit(False)) & V.is_object(changes)
    off = (V.kind(V.member(changes, "disableAllHooks")) == "BOOLEAN") & F.try_variant_get(changes, "$.disableAllHooks", "boolean")
    meta = F.struct(source.alias("source"))
    return F.when(guarded & F.coalesce(off, F.lit(False)), finding("CONFIG-001", "CRITICAL", "block", "All hooks must not be disabled.", None, meta)).when(guarded & V.has(changes, "hooks"), finding("CONFIG-001", "HIGH", "block", "The hook configuration must not be changed.", None, meta))


def _bash_errors() -> Column:
    get = lambda k: F.coalesce(F.when(V.is_object(F.col("response")), V.text(F.col("response"), k)), F.lit(""))
    output = V.trimmed(F.concat(get("stdout"), F.lit("\n"), get("stderr")))
    bad = (F.col("tool") == "Bash") & (F.col("command") != "") & ~read_only_command(F.col("command")) & error_signals(output)
    return F.when(bad, finding("ERRORS-BASH-001", "HIGH", None, None, "The output holds errors. Fix them before going on.", F.struct(F.left("command", F.lit(200)).alias("command"))))


def _bash_failure() -> Column:
    stopped = V.member(F.col("v"), "is_interrupt")
    truthy = F.coalesce(F.when(V.kind(stopped) == "BOOLEAN", F.try_variant_get(stopped, "$", "boolean")).when(V.kind(stopped) == "VOID", False).otherwise(stopped.isNotNull()), F.lit(False))
    bad = (F.col("tool") == "Bash") & (F.col("command") != "") & ~benign_failure(F.col("command")) & ~read_only_command(F.col("command")) & ~truthy
    return F.when(bad, finding("ERRORS-FAIL-001", "HIGH", None, None, "The command failed. Resolve the failure before going on.", F.struct(F.left("command", F.lit(200)).alias("command"))))


def _baseline() -> Column:
    """A write to baselines.json that raises a rule's count over that of `old_baseline` (JSON text), or one by shell."""
    mine = F.filter("targets", lambda t: any_matches(t.path, ["baselines.json", "**/baselines.json"]))
    ids = lambda text: F.from_json(text, "struct<rules:map<string,array<string>>>")["rules"]
    more = lambda new, old: F.map_filter(new, lambda k, v: F.size(v) > F.coalesce(F.size(F.try_element_at(old, k)), F.lit(0)))
    raised = F.exists(mine, lambda t: F.coalesce(F.size(more(ids(t.content), F.coalesce(ids(F.col("old_baseline")), F.create_map().cast("map<string,array<string>>")))), F.lit(0)) > 0)
    regenerates = contains_any(F.lower("command"), BASELINE_COMMANDS)
    return F.when(raised | regenerates, finding("BASELINE-001", "HIGH", "deny", F.when(raised, "The baseline may shrink, not grow.").otherwise("Baselines of a whole repository are not to be generated.")))


def builtin_rules(policy: Policy) -> list[Rule]:
    """In registration order; it decides ties. The first three hold outside enrolled repositories too."""
    p, post, stop = policy, ("PostToolUse",), ("Stop", "SubagentStop")
    return [
        Rule("GLOBAL-BUILTIN-SENSITIVE-DATA", PRE, lambda: _sensitive(p), always=True),
        Rule("GLOBAL-BUILTIN-SYSTEM-PROTECTION", PRE, lambda: _system(p), always=True),
        Rule("GLOBAL-BUILTIN-HOOK-INFRA-EXEC", PRE, lambda: _infra(p), always=True),
        Rule("BUILTIN-INJECT-PROMPT", ("UserPromptSubmit",), _prompt),
        Rule("BUILTIN-ENFORCE-FULL-READ", PRE, lambda: _full_read(p)),
        Rule("BUILTIN-PROTECTED-PATHS", PRE, lambda: _protected(p)),
        Rule("GIT-001", PRE, _git),
        Rule("REMIND-SEARCH-001", ("PreToolUse",), lambda: _search(p)),
        Rule("QUALITY-POST-001", post, _quality),
        Rule("BASELINE-001", ("PreToolUse",), _baseline),
        Rule("STOP-001", stop, _stop),
        Rule("STOP-002", stop, lambda: finding("STOP-002", "LOW", None, None, "Before stopping, check that tests pass and quality gates are clean.")),
        Rule("WARN-LARGE-001", PRE, _large, many=True),
        Rule("BUILTIN-RULEBOOK-SECURITY", PRE, lambda: _guard(p)),
        Rule("SESSION-001", ("SessionStart",), _session),
        Rule("CONFIG-001", ("ConfigChange",), _config),
        Rule("ERRORS-BASH-001", post, _bash_errors),
        Rule("ERRORS-FAIL-001", ("PostToolUseFailure",), _bash_failure),
    ]


#: Columns of outside facts and the types they have where an input lacks them.
FACTS = {
    "full_read_known": "boolean", "file_bytes": "bigint", "old_baseline": "string", "enrolled": "boolean", "repo_disabled": "boolean", "skipped": "boolean", "git_context": "array<string>",
    "files": "array<struct<path:string,source:string>>", "siblings": "array<string>", "graph_project": "boolean",
    "prompt_context": "array<struct<name:string,text:string>>", "exit_codes": "array<struct<command:string,code:int,output:string,block:boolean>>", "transcript": "array<struct<turn:bigint,role:string,text:string>>",
}


