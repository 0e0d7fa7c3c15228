"""Rules that read the Python files an event writes: syntax-tree rules, rules for graph frameworks, sibling files.

Before a tool runs, its content targets are read; after it, the files on disk that the event names, which come as a column
of outside facts (`files`). One Arrow function turns the sources of the events that write Python into hits, and expressions
turn hits into findings. A source on which the walk fails gives an error, not a failed job. Sources above MOST_CHARS
characters are not parsed here; lint() has no such limit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, splitlines
from ..functions.pyfacts import MOST_CHARS, Fact, facts
from .events import is_edit_tool
from .lint import VENDORED, Limits
from .rules import FINDING, SEVERITIES, Rule, finding, settled

BEFORE, AFTER = ("PreToolUse", "PermissionRequest"), ("PostToolUse",)
#: What marks a source of the graph framework, and the patterns of its rules.
GRAPH_MARKS = ["from langgraph", "import langgraph", "StateGraph"]
MUTATIONS = [
    r"\bstate\s*\[.+\]\s*=", r"\bstate\s*\[.+\]\.append\b", r"\bstate\s*\[.+\]\.extend\b", r"\bstate\s*\[.+\]\.update\b", r"\bstate\.update\s*\(",
    r"\bstate\s*\[.+\]\.pop\b", r"\bstate\s*\[.+\]\.clear\b", r"\bstate\s*\[.+\]\s*\+=",
]
OLD_CALLS = [(r"\.set_entry_point\s*\(", "set_entry_point()", 'add_edge(START, "node")'), (r"\.set_finish_point\s*\(", "set_finish_point()", 'add_edge("node", END)')]
#: Severity and message of each rule; {name}, {path}, {value}, {total}, {text} and {limit} stand for parts of a hit.
TREE_RULES = {
    "PY-CODE-008": ("HIGH", "`{name}` in `{path}` is {value} lines long, {limit} being the most. Move parts of it out."),
    "PY-CODE-009": ("MEDIUM", "Python function `{name}` in `{path}` has {value} parameters. Group inputs; at most {limit} are allowed."),
    "PY-CODE-010": ("MEDIUM", "Line {line} in `{path}` has {value} characters. At most {limit} are allowed."),
    "PY-CODE-011": ("HIGH", "Function `{name}` in `{path}` is nested {value} deep. At most {limit} levels are allowed."),
    "PY-CODE-012": ("LOW", "`{path}`: {value} of the {total} attributes that `{name}` reads belong to `{text}`; it may be better placed there."),
    "PY-CODE-013": ("MEDIUM", "Function `{name}` in `{path}` only wraps `{text}`. Call that directly."),
    "PY-CODE-014": ("HIGH", "Class `{name}` in `{path}` has {value} non-dunder methods. At most {limit} are allowed."),
    "PY-CODE-015": ("HIGH", "`{path}`: `{name}` has {value} independent ways through it, the limit being {limit}. Make it simpler."),
    "PY-CODE-016": ("HIGH", "Function `{name}` in `{path}` has unreachable code after `{text}` at line {line}."),
    "PY-IMPORT-001": ("LOW", "`{path}` imports {value} names from `{name}`. Import the module itself."),
    "LG-STATE-001": ("LOW", "`{path}`: lists in the state `{name}` are overwritten by each node, since no reducer joins them: {text}."),
}
QUIET = ("PY-CODE-012", "PY-IMPORT-001")  # their decision ranks below all others, so no answer shows them
HIT = pa.struct([("rule_id", pa.string()), ("path", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("value", pa.int64()), ("total", pa.int64()), ("text", pa.string())])
HITS = "array<struct<rule_id:string,path:string,name:string,line:int,value:bigint,total:bigint,text:string>>"


def limits_by_rule(m: Limits) -> dict[str, int]:
    return {"PY-CODE-008": m.method_lines, "PY-CODE-009": m.params, "PY-CODE-010": m.line_length, "PY-CODE-011": m.nesting, "PY-CODE-014": m.class_methods, "PY-CODE-015": m.complexity, "PY-IMPORT-001": m.import_names}


#: Fact kinds of rules that report a file's highest value, and of those that report every fact.
WORST = {"PY-CODE-008": "span", "PY-CODE-009": "params_rule", "PY-CODE-010": "worst_line", "PY-CODE-011": "nesting_rule", "PY-CODE-015": "complexity_rule"}
EVERY = {"PY-CODE-012": "access", "PY-CODE-013": "wrapper_rule", "PY-CODE-014": "class_public", "PY-CODE-016": "dead", "PY-IMPORT-001": "imports", "LG-STATE-001": "state_lists"}


def hits_of(path: str, found: list[Fact], m: Limits, graph: bool) -> list[dict]:
    """The hits of one file's facts, in the order of the rules."""
    limit, out = limits_by_rule(m), []
    for rule in TREE_RULES:
        own = [f for f in found if f[0] == WORST.get(rule, EVERY.get(rule)) and f[4] > limit.get(rule, 0)]
        if rule in WORST:
            own = [max(own, key=lambda f: (f[4], -f[2]))] if own else []
        if rule == "PY-CODE-012":
            own = [f for f in own if f[3] >= m.envy_least and f[4] / f[3] > m.envy_share]
        if rule == "LG-STATE-001" and not graph:
            own = []
        for _, name, line, end, value, text in own:
            shown = ", ".join(f"`{x}`" for x in text.split("\x1f")[:5]) if rule == "LG-STATE-001" else text
            out.append({"rule_id": rule, "path": path, "name": name, "line": line, "value": value, "total": end, "text": shown})
    return out


def with_hits(events: DataFrame, limits: Limits) -> DataFrame:
    """events plus `hits` (HITS), NULL where an event writes no Python. What fails on a source is a hit of rule '' with the
    error as its text. Only the sources go to a Python worker, and only those of events that write Python files."""

    def found(files: list[dict], known: bool | None) -> list[dict]:
        row: list[dict] = []
        for f in files:
            path, source = f["path"] or "", f["source"] or ""
            try:
                row += hits_of(path, facts(source, MOST_CHARS), limits, bool(known) or any(x in source for x in GRAPH_MARKS))
            except Exception as e:  # noqa: BLE001
                row.append({"rule_id": "", "path": path, "name": type(e).__name__, "line": 0, "value": 0, "total": 0, "text": str(e)[:200]})
        return row

    @F.arrow_udf(HITS)
    def walk(sources: pa.Array, project: pa.Array) -> pa.Array:
        asked = zip(sources.to_pylist(), project.to_pylist(), strict=True)
        return pa.array([None if files is None else found(files, known) for files, known in asked], pa.list_(HIT))

    own = settled(events.withColumn("sources", sources_of()))  # Spark does not take a UDF out of a plan by itself where its argument is this long
    return own.withColumn("hits", walk("sources", F.coalesce("graph_project", F.lit(False)))).drop("sources")


def own_python(files: Column) -> Column:
    """Python files that are one's own."""
    theirs = lambda p: F.exists(F.array(*(F.lit(v) for v in VENDORED)), lambda v: F.contains(F.replace(p, F.lit("\\"), F.lit("/")), v))
    return F.filter(files, lambda f: F.lower(f.path).rlike(r"\.pyi?$") & ~theirs(f.path))


def writes() -> Column:
    return is_edit_tool(F.col("tool")) | (F.lower("tool") == "bash")


def sources_of() -> Column:
    """array<struct<path, source>> of what an event writes: its targets before, the files it names after."""
    before = F.transform("targets", lambda t: F.struct(t.path.alias("path"), t.content.alias("source")))
    after = F.when(writes(), F.col("files"))
    found = own_python(F.when(F.col("event").isin(*BEFORE), before).when(F.col("event").isin(*AFTER), after))
    return F.when((F.col("mode") == "repo_strict") & ~F.col("skipped") & (F.size(found) > 0), found)


def message_of(h: Column, limits: Limits) -> Column:
    limit, out = limits_by_rule(limits), F.lit(None).cast("string")
    for rule, (_, text) in TREE_RULES.items():
        shown: Column = F.lit(text.replace("{limit}", str(limit.get(rule, ""))))
        for part in ("name", "path", "line", "value", "total", "text"):
            if "{" + part + "}" in text:
                shown = F.replace(shown, F.lit("{" + part + "}"), F.coalesce(h[part].cast("string"), F.lit("")))
        out = F.when(h.rule_id == rule, shown).otherwise(out)
    return out


def tree_findings(limits: Limits, disabled: tuple[str, ...] = ()) -> Column:
    """FINDINGs of column `hits`, in its order."""
    def one(h: Column) -> Column:
        level = F.lit(20)
        for rule, (name, _) in TREE_RULES.items():
            level = F.when(h.rule_id == rule, SEVERITIES[name]).otherwise(level)
        level = F.when((h.rule_id == "PY-IMPORT-001") & (F.length(h.text) > 0), 20).otherwise(level)  # names of one family
        graph, text = h.rule_id.startswith("LG-"), message_of(h, limits)
        decision = F.when(h.rule_id.isin(*QUIET), "context").when(~graph, F.when(F.col("event").isin(*BEFORE), "deny").otherwise("block"))
        meta = F.to_json(F.struct(h.path.alias("path"), h["name"].alias("name"), h.line.alias("line"), h.value.alias("value")))
        return F.struct(
            h.rule_id.alias("rule_id"), h.rule_id.alias("title"), level.alias("severity"), decision.alias("decision"), F.when(~graph, text).alias("message"), F.when(graph, text).alias("context"),
            F.create_map().cast("map<string,string>").alias("updated_input"), meta.alias("metadata"),
        ).cast(FINDING)

    kept = F.filter("hits", lambda h: (h.rule_id != "") & ~h.rule_id.isin(*(disabled or ("",))))
    return F.coalesce(F.transform(kept, one), F.array().cast(f"array<{FINDING}>"))


def tree_errors() -> Column:
    """Texts of what failed, by file."""
    bad = F.filter("hits", lambda h: h.rule_id == "")
    return F.coalesce(F.transform(bad, lambda h: F.concat(h.path, F.lit(": "), h["name"], F.lit(": "), h.text)), F.array().cast("array<string>"))


def _graph_files() -> Column:
    named = lambda f: F.coalesce("graph_project", F.lit(False)) | F.exists(F.array(*(F.lit(m) for m in GRAPH_MARKS)), lambda m: F.contains(f.source, m))
    return F.filter(F.when(writes(), F.col("files")), lambda f: F.lower(f.path).rlike(r"\.pyi?$") & (F.length(f.source) <= MOST_CHARS) & named(f))


def _mutations() -> Column:
    """One finding a file that writes to the state it is given: its first three such lines."""
    pattern = "|".join(f"(?:{p})" for p in MUTATIONS)

    def one(f: Column) -> Column:
        lines = F.transform(splitlines(f.source), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
        bad = F.filter(lines, lambda x: ~F.ltrim(x.line).startswith("#") & x.line.rlike(pattern))
        shown = F.array_join(F.transform(F.slice(bad, 1, 3), lambda x: F.concat(F.lit("L"), x.no.cast("string"), F.lit(": "), F.left(F.trim(x.line), F.lit(80)))), "; ")
        text = F.concat(F.lit("State seems to be changed in place in `"), f.path, F.lit("`: "), shown, F.lit(". Return an update instead."))
        return F.when(F.size(bad) > 0, finding("LG-NODE-001", "MEDIUM", None, None, text, F.struct(f.path.alias("path"), F.size(bad).alias("mutation_count"))))

    return F.transform(_graph_files(), one)


def _old_calls() -> Column:
    def one(f: Column) -> Column:
        each = [F.when(f.source.rlike(p), finding("LG-API-001", "LOW", None, None, F.concat(F.lit(f"`{old}` in `"), f.path, F.lit(f"` is the older call. Use `{new}`.")), F.struct(f.path.alias("path"), F.lit(old).alias("old_api")))) for p, old, new in OLD_CALLS]
        return F.array(*each)

    return F.flatten(F.transform(_graph_files(), one))


def _siblings() -> Column:
    """One finding for a directory of a named file and a prefix that three of its files `_prefix_rest.py` share. `siblings`
    holds the paths of the files that stand there."""
    pattern = r"^_([a-z]+)_[a-z_]+\.py$"
    named = F.array_distinct(F.transform(F.filter("paths", lambda p: F.lower(p).rlike(r"\.pyi?$")), dirname))
    files = F.filter("siblings", lambda s: basename(s).rlike(pattern) & F.array_contains(named, dirname(s)))
    keyed = F.transform(F.array_distinct(files), lambda s: F.struct(dirname(s).alias("dir"), F.regexp_extract(basename(s), pattern, 1).alias("prefix"), basename(s).alias("file")))
    groups = F.array_distinct(F.transform(keyed, lambda s: F.struct(s.dir.alias("dir"), s.prefix.alias("prefix"))))

    def one(g: Column) -> Column:
        own = F.array_sort(F.transform(F.filter(keyed, lambda s: (s.dir == g.dir) & (s.prefix == g.prefix)), lambda s: s.file))
        text = F.concat(F.lit("Directory `"), g.dir, F.lit("` has "), F.size(own).cast("string"), F.lit(" files `_"), g.prefix, F.lit("_*.py` ("), F.array_join(F.slice(own, 1, 5), ", "), F.lit("). Make them a package."))
        return F.when(F.size(own) >= 3, finding("PY-CODE-017", "HIGH", "block", text, None, F.struct(g.dir.alias("directory"), g.prefix.alias("prefix"), F.size(own).alias("count"))))

    return F.when(writes(), F.transform(groups, one))


def file_rules() -> list[Rule]:
    """The rules of files that need no syntax tree."""
    return [Rule("PY-CODE-017", AFTER, _siblings, many=True), Rule("LG-NODE-001", AFTER, _mutations, many=True), Rule("LG-API-001", AFTER, _old_calls, many=True)]
