"""Declarative rules: patterns and globs held in rows, matched as one projection over canonical events.

Every rule becomes an expression with literal patterns, which the engine compiles once; cheap tests (event, tool,
glob) stand before the patterns. An event's findings are an array, so matching neither joins nor shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import any_matches

#: Severities and their weights, decisions and their ranks.
SEVERITIES = {"LOW": 10, "MEDIUM": 20, "HIGH": 30, "CRITICAL": 40}
RANKS = {"deny": 4, "block": 4, "ask": 3, "allow": 2}

FINDING = "struct<rule_id:string,title:string,severity:int,decision:string,message:string,context:string,updated_input:map<string,string>,metadata:string>"


@dataclass(frozen=True)
class RegexRule:
    rule_id: str
    events: list[str]
    target: str
    patterns: list[str]
    action: str = "deny"
    severity: str = "HIGH"
    title: str = ""
    message: str = ""
    context: str | None = None
    path_globs: list[str] = field(default_factory=list)
    exclude_path_globs: list[str] = field(default_factory=list)
    tool_matchers: list[str] = field(default_factory=list)
    case_sensitive: bool = True
    multiline: bool = True


@dataclass(frozen=True)
class Rule:
    """A built-in rule: events, when it applies and what it finds (a FINDING or an array of them)."""

    rule_id: str
    events: tuple[str, ...]
    find: Callable[[], Column]
    always: bool = False
    many: bool = False
    patterns: tuple[str, ...] = ()  # what the engine has to compile


def finding(rule_id: str, severity: str, decision: str | None = None, message: Column | str | None = None, context: Column | str | None = None, metadata: Column | None = None, title: str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(title or rule_id).alias("title"), F.lit(SEVERITIES.get(severity.upper(), 20)).alias("severity"), lit(decision).alias("decision"), lit(message).alias("message"), lit(context).alias("context"), F.create_map().cast("map<string,string>").alias("updated_input"), (F.to_json(metadata) if metadata is not None else F.lit("{}")).alias("metadata")).cast(FINDING)


def java_regex(pattern: str, case_sensitive: bool, multiline: bool) -> str:
    flags = ("ms" if multiline else "") + ("" if case_sensitive else "iu")
    return f"(?{flags})(?:{pattern})" if flags else pattern


def any_pattern(c: Column, rule: RegexRule) -> Column:
    out = F.lit(False)
    for p in rule.patterns:
        out = out | c.rlike(java_regex(p, rule.case_sensitive, rule.multiline))
    return out


def path_allowed(path: Column, rule: RegexRule) -> Column:
    ok = any_matches(path, rule.path_globs)
    if rule.exclude_path_globs:
        ok = ok & ~any_matches(path, rule.exclude_path_globs)
    return F.when(F.coalesce(path, F.lit("")) == "", True).otherwise(ok)


def regex_rule(rule: RegexRule) -> Rule:
    def find() -> Column:
        nothing = F.lit(None).cast("array<string>")
        hits = {
            "content": F.transform(F.filter("targets", lambda t: path_allowed(t.path, rule) & any_pattern(t.content, rule)), lambda t: t.path),
            "path": F.filter("paths", lambda p: path_allowed(p, rule) & any_pattern(p, rule)),
            "command": F.when((F.col("command") != "") & any_pattern(F.col("command"), rule), F.array().cast("array<string>")),
            "prompt": F.when((F.col("prompt") != "") & any_pattern(F.col("prompt"), rule), F.array().cast("array<string>")),
        }.get(rule.target, nothing)
        found = hits.isNotNull() & (F.size(hits) > 0) if rule.target in ("content", "path") else hits.isNotNull()
        if rule.tool_matchers:
            tools = F.lit(False)
            for t in rule.tool_matchers:
                tools = tools | F.col("tool").rlike(rf"^(?:{t})\z")
            found = tools & found
        named = F.array_join(F.array_sort(F.array_distinct(hits)), ", ")
        message: Column = F.lit(rule.message or rule.rule_id)
        for key, value in (("{path}", F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))), ("{matched_paths}", named), ("{rule_id}", F.lit(rule.rule_id))):
            message = F.replace(message, F.lit(key), value) if rule.message else message
        quiet = rule.action == "context"
        return F.when(found, finding(rule.rule_id, rule.severity, None if quiet else rule.action, None if quiet else message, rule.context, F.struct(F.lit(rule.target).alias("target"), hits.alias("hits")), rule.title))

    return Rule(rule.rule_id, tuple(rule.events), find, patterns=(*(java_regex(p, rule.case_sensitive, rule.multiline) for p in rule.patterns), *rule.tool_matchers))


def once(*columns: Column) -> Column:
    """A struct as the one row of a generator. Spark merges projections, and would evaluate what many later columns refer to
    once for each of them; a generator it leaves alone."""
    return F.explode(F.array(F.struct(*columns)))


def settled(df: DataFrame) -> DataFrame:
    """df with its columns evaluated here, for the same reason."""
    return df.select(once(*(F.col(c) for c in df.columns)).alias("own")).select("own.*")


def pattern_error(patterns: tuple[str, ...]) -> str | None:
    """What is wrong with the first pattern that the engine cannot compile."""
    compile_ = SparkSession.active()._jvm.java.util.regex.Pattern.compile
    for p in patterns:
        try:
            compile_(p)
        except Exception as e:  # noqa: BLE001
            return str(e).strip().splitlines()[0]
    return None


def evaluate(events: DataFrame, rules: list[Rule], disabled: tuple[str, ...] = ()) -> DataFrame:
    """events (canonical, with `mode` and `skipped`) plus `findings`, in the rules' order, and `errors`: of each rule that
    cannot be evaluated and would apply, its id and why. Such a rule stops no other."""
    parts, errors = [], []
    for r in rules:
        if r.rule_id in disabled:
            continue
        applies = F.col("event").isin(*r.events)
        if not r.always:
            applies = applies & (F.col("mode") == "repo_strict") & ~F.col("skipped")
        why = pattern_error(r.patterns)
        try:
            got = None if why else r.find() if r.many else F.array(r.find())
        except Exception as e:  # noqa: BLE001
            why = str(e)
        if why:
            errors.append(F.when(applies, f"{r.rule_id}: {why}"))
            continue
        none = F.array().cast(f"array<{FINDING}>")
        parts.append(F.coalesce(F.when(applies, got).cast(f"array<{FINDING}>"), none))
    found = F.concat(*parts) if parts else F.array().cast(f"array<{FINDING}>")
    failed = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    names = [c for c in events.columns if c not in ("findings", "errors")]
    own = once(F.filter(found, lambda f: f.isNotNull()).alias("findings"), failed.alias("errors"))
    return events.select(*names, own.alias("own")).select(*names, "own.findings", "own.errors")


def with_message(rule: RegexRule, message: str) -> RegexRule:
    return replace(rule, message=message)
