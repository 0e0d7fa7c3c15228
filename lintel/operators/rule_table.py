"""Declarative rules as rows of a table, matched to events by a plan whose size does not follow their number.

A match of a pattern holds certain literals. An automaton of the literals of all rules goes over each text once and gives the
rules that may match it; those pairs only meet their rule's row, whose patterns and globs are then tested as columns. A rule
in whose patterns no literal is found may match any text. Automaton and rows go to every worker while the rules' text is
within `most_chars`; more rules are cut in so many parts, and each part is a pass over the events. Events are never shuffled.

Rules are rows of RULE_ROW; `place` orders them, as the order of a list does. Findings are equal to those of
rules.evaluate() with the same rules in that order.
"""

from __future__ import annotations

import re
import uuid
import warnings
from dataclasses import asdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..functions.paths import basename, lower_path
from .decide import severity_number
from .rules import FINDING, RegexRule, java_regex, pattern_error, settled

RULE_ROW = (
    "place long, rule_id string, events array<string>, target string, patterns array<string>, action string, severity string, title string, message string, context string, "
    "path_globs array<string>, exclude_path_globs array<string>, tool_matchers array<string>, case_sensitive boolean, multiline boolean"
)
KINDS = ("content", "path", "command", "prompt")
MOST_CHARS = 1 << 20
LEAST_LITERAL, MOST_ALTERNATIVES = 2, 64
_DOTTED = {0x130: "i", 0x131: "i"}  # what the engine's case-blind match takes for an i


def rule_rows(spark: SparkSession, rules: list[RegexRule]) -> DataFrame:
    columns = [x.split()[0] for x in RULE_ROW.split(", ")]
    return spark.createDataFrame([tuple(({"place": i} | asdict(r))[c] for c in columns) for i, r in enumerate(rules)], RULE_ROW)


# --- literals that a match must hold


def fold(text: str) -> str:
    """Texts that are equal when case does not count are equal folded."""
    return text.translate(_DOTTED).casefold()


def _best(options: list[list[str]]) -> list[str] | None:
    good = [o for o in options if o and min(map(len, o)) >= LEAST_LITERAL and len(o) <= MOST_ALTERNATIVES]
    return max(good, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _flat(items) -> list:
    """Items of a sequence with those of its plain groups in their place."""
    out = []
    for op, arg in items:
        name = str(op)
        if name in ("SUBPATTERN", "ATOMIC_GROUP"):
            out += _flat(arg[-1] if name == "SUBPATTERN" else arg)
        else:
            out.append((name, arg))
    return out


def _needed(items) -> list[str] | None:
    """Literals of which every match of a sequence holds one."""
    options, run = [], ""
    for name, arg in _flat(items):
        if name == "LITERAL":
            run += chr(arg)
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):  # no width: what stands around it is side by side
            continue
        repeats = name.endswith("_REPEAT")
        if repeats and 0 < arg[0] <= 8 and all(str(op) == "LITERAL" for op, _ in arg[2]):
            options.append([run + "".join(chr(c) for _, c in arg[2]) * arg[0]])
            run = ""
            continue
        options.append([run])
        run = ""
        if name == "BRANCH":
            each = [_needed(a) for a in arg[1]]
            if all(each):
                options.append([x for a in each for x in a])
        elif repeats and arg[0] > 0 and (inner := _needed(arg[2])):
            options.append(inner)
    return _best([*options, [run]])


def literals(pattern: str) -> list[str] | None:
    """Folded literals of which every match holds one; None where none is found. Patterns are the engine's; where another
    reader of patterns could take one otherwise, none is looked for."""
    if re.search(r"\[[^\]]*\[|\\0|&&", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            got = _needed(re._parser.parse(pattern))
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    got = [fold(x) for x in got or []]
    return list(dict.fromkeys(got)) if got and min(map(len, got)) >= LEAST_LITERAL else None


class Index:
    """Rules that may match a text, by kind of text."""

    def __init__(self, rules: list[tuple[int, str, list[str] | None]]) -> None:
        import ahocorasick

        held: dict[str, dict[str, set[int]]] = {k: {} for k in KINDS}
        self.always: dict[str, set[int]] = {k: set() for k in KINDS}
        for number, kind, found in rules:
            if found is None:
                self.always[kind].add(number)
            for x in found or []:
                held[kind].setdefault(x, set()).add(number)
        self.automata = {}
        for kind, by in held.items():
            if by:
                self.automata[kind] = ahocorasick.Automaton()
                for x, numbers in by.items():
                    self.automata[kind].add_word(x, tuple(numbers))
                self.automata[kind].make_automaton()

    def candidates(self, kind: str, texts: list[str | None]) -> set[int]:
        out = set(self.always[kind]) if texts else set()
        if kind in self.automata:
            for t in texts:
                for _, numbers in self.automata[kind].iter(fold(t or "")):
                    out.update(numbers)
        return out


_indexes: dict[str, Index] = {}  # of a worker; the last one's


def _index(token: str, rules: list) -> Index:
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = Index(rules)
    return _indexes[token]


# --- rules' rows against events


def any_of(text: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.rlike(text, p))


def _globs(globs: list[str]) -> list[tuple[bool, str]]:
    """(whether it is for the last part, pattern) of each glob, as functions.globs.path_matches reads it."""
    out = []
    for g in globs:
        g = g.replace("\\", "/").strip().lower()
        prefix = g.endswith("/") and "*" not in g
        out.append((not prefix and "/" not in g, "(?s)^" + re.sub(r"([^\w/])", r"\\\1", g) if prefix else glob_regex(g)))
    return out


def _glob_matches(path: Column, globs: Column) -> Column:
    low = lower_path(path)
    return F.exists(globs, lambda g: F.rlike(F.when(g.last, basename(low)).otherwise(low), g.regex))


COMPILED = "number int, place long, rule_id string, events array<string>, target string, patterns array<string>, action string, severity string, title string, message string, context string, globs array<struct<last:boolean,regex:string>>, excluded array<struct<last:boolean,regex:string>>, tools array<string>, why string"


def compiled(spark: SparkSession, rules: list) -> tuple[list[tuple], list[tuple[int, str, list[str] | None]]]:
    """Rows of COMPILED, and (number, kind, literals) of the patterns, for the rules of one part."""
    rows, found = [], []
    for n, r in enumerate(rules):
        patterns = [java_regex(p, r.case_sensitive is not False, r.multiline is not False) for p in r.patterns or []]
        tools = [rf"^(?:{t})\z" for t in r.tool_matchers or []]
        why = pattern_error((*patterns, *(r.tool_matchers or [])))
        if why:  # nothing of it may reach the engine
            patterns, tools = [], []
        globs, excluded = _globs(r.path_globs or []), _globs(r.exclude_path_globs or [])
        rows.append((n, r.place, r.rule_id, r.events, r.target, patterns, r.action, r.severity, r.title, r.message, r.context, globs, excluded, tools, why))
        for p in r.patterns or []:
            if r.target in KINDS and not why:
                found.append((n, r.target, literals(p)))
    return rows, found


def _finding() -> tuple[Column, Column]:
    """(whether the rule of this row matches its event, the FINDING); columns of the rule stand in `r`."""
    r = F.col("r")
    allowed = lambda p: (F.coalesce(p, F.lit("")) == "") | (((F.size(r.globs) == 0) | _glob_matches(p, r.globs)) & ((F.size(r.excluded) == 0) | ~_glob_matches(p, r.excluded)))
    none = F.array().cast("array<string>")
    hits = (
        F.when(r.target == "content", F.transform(F.filter("targets", lambda t: allowed(t.path) & any_of(t.content, r.patterns)), lambda t: t.path))
        .when(r.target == "path", F.filter("paths", lambda p: allowed(p) & any_of(p, r.patterns)))
        .when((r.target == "command") & (F.col("command") != "") & any_of(F.col("command"), r.patterns), none)
        .when((r.target == "prompt") & (F.col("prompt") != "") & any_of(F.col("prompt"), r.patterns), none)
    )
    found = hits.isNotNull() & (~r.target.isin("content", "path") | (F.size(hits) > 0)) & ((F.size(r.tools) == 0) | any_of(F.col("tool"), r.tools))
    named = F.array_join(F.array_sort(F.array_distinct(hits)), ", ")
    given = F.coalesce(r.message, F.lit("")) != ""
    message = F.replace(F.replace(F.replace(r.message, F.lit("{path}"), F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))), F.lit("{matched_paths}"), named), F.lit("{rule_id}"), r.rule_id)
    quiet = r.action == "context"
    out = F.struct(
        r.rule_id.alias("rule_id"), F.when(F.coalesce(r.title, F.lit("")) == "", r.rule_id).otherwise(r.title).alias("title"), severity_number(r.severity).alias("severity"), F.when(~quiet, r.action).alias("decision"),
        F.when(~quiet, F.when(given, message).otherwise(r.rule_id)).alias("message"), r.context.alias("context"), F.create_map().cast("map<string,string>").alias("updated_input"), F.to_json(F.struct(r.target.alias("target"), hits.alias("hits"))).alias("metadata"),
    )
    return found, out.cast(FINDING)


def _pass(events: DataFrame, rules: list, keep: list[str]) -> DataFrame:
    spark = events.sparkSession
    rows, found = compiled(spark, rules)
    sent, token = spark.sparkContext.broadcast(found), uuid.uuid4().hex
    broken = [x[0] for x in rows if x[-1]]

    @F.arrow_udf("array<int>")
    def candidates(contents: pa.Array, paths: pa.Array, commands: pa.Array, prompts: pa.Array) -> pa.Array:
        index = _index(token, sent.value)
        out = []
        for c, p, x, y in zip(contents.to_pylist(), paths.to_pylist(), commands.to_pylist(), prompts.to_pylist(), strict=True):
            asked = {"content": c or [], "path": p or [], "command": [x] if x else [], "prompt": [y] if y else []}
            out.append(sorted(set(broken).union(*(index.candidates(k, v) for k, v in asked.items()))))
        return pa.array(out, pa.list_(pa.int32()))

    table = F.broadcast(spark.createDataFrame(rows, COMPILED).select("number", F.struct(*(F.col(x.split()[0]) for x in COMPILED.split(", ")[1:])).alias("r")))
    asked = settled(events.withColumn("contents", F.transform("targets", lambda t: t.content)))
    asked = asked.withColumn("candidates", candidates("contents", "paths", "command", "prompt")).drop("contents")
    met = asked.withColumn("number", F.explode("candidates")).join(table, "number").where((F.col("mode") == "repo_strict") & ~F.col("skipped") & F.array_contains(F.col("r.events"), F.col("event")))
    matches, finding = _finding()
    out = met.where(F.col("r.why").isNotNull() | matches)
    return out.select(*keep, F.col("r.place").alias("place"), F.when(F.col("r.why").isNull(), finding).alias("finding"), F.when(F.col("r.why").isNotNull(), F.concat("r.rule_id", F.lit(": "), "r.why")).alias("error"))


def match_rules(events: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("ord",), most_chars: int = MOST_CHARS) -> DataFrame:
    """(keep, place, finding, error): a row for each rule that matches an event, or that cannot be compiled and would apply.

    events: canonical, with `mode` and `skipped`."""
    length = F.aggregate("patterns", F.lit(0).cast("long"), lambda a, p: a + F.length(p)) + 200
    total = rules.agg(F.sum(length)).first()[0] or 0
    parts = max(1, -(-total // most_chars))
    passes = []
    for k in range(parts):  # each within the bound, but for chance: one part is all that is held at once
        own = (rules if parts == 1 else rules.where(F.pmod(F.xxhash64("rule_id", "place"), F.lit(parts)) == k)).orderBy("place").collect()
        passes.append(_pass(events, own, list(keep)))
    return reduce(DataFrame.unionByName, passes)


def evaluate_rules(events: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("platform", "event", "session", "tool"), most_chars: int = MOST_CHARS) -> DataFrame:
    """(ord, keep, findings, errors) of the events that a rule matches: what decide() and render() ask for. Only findings are
    shuffled. ord: an event's own."""
    found = match_rules(events, rules, ("ord", *keep), most_chars)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("place", c)))), lambda x: x[c]).alias(f"{c}s")
    plain = found.withColumn("finding", F.to_json("finding"))  # maps do not sort
    out = plain.groupBy("ord", *keep).agg(listed("finding"), listed("error"))
    return out.withColumn("findings", F.transform("findings", lambda f: F.from_json(f, FINDING)))
