"""From an event's findings to one decision and the platform's answer. A projection over the findings array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variants import trimmed
from .rules import FINDING, RANKS, SEVERITIES, once


def enforcement_mode(enrolled: Column, disabled: Column) -> Column:
    return F.when(~F.coalesce(enrolled, F.lit(False)), "outside_repo").when(F.coalesce(disabled, F.lit(False)), "repo_relaxed").otherwise("repo_strict")


def rank(decision: Column) -> Column:
    out = F.lit(0)
    for d, n in RANKS.items():
        out = F.when(decision == d, n).otherwise(out)
    return out


def severity_number(name: Column) -> Column:
    out = F.lit(20)
    for s, n in SEVERITIES.items():
        out = F.when(F.upper(F.trim(name)) == s, n).otherwise(out)
    return out


def severity_name(number: Column) -> Column:
    out = F.lit("MEDIUM")
    for s, n in SEVERITIES.items():
        out = F.when(number == n, s).otherwise(out)
    return out


def override_severities(events: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """By rule id: `warn` lowers to LOW and takes the decision away, any other value sets the severity (unknown: MEDIUM)."""

    def one(f: Column) -> Column:
        severity, decision = f.severity, f.decision
        for rule_id, value in overrides.items():
            warn = value.lower() == "warn"
            severity = F.when(f.rule_id == rule_id, 10 if warn else SEVERITIES.get(value.upper(), 20)).otherwise(severity)
            decision = F.when(f.rule_id == rule_id, F.lit(None)).otherwise(decision) if warn else decision
        return f.withField("severity", severity).withField("decision", decision).cast(FINDING)

    return events.withColumn("findings", F.transform("findings", one)) if overrides else events


def top_decision(findings: Column) -> Column:
    """Highest rank, then highest severity, then first in the list."""
    order = F.transform(findings, lambda f, i: F.struct((-rank(f.decision)).alias("r"), (-f.severity).alias("s"), i.alias("i"), f.decision.alias("d")))
    return F.try_element_at(F.array_sort(order), F.lit(1))["d"]


def merged_context(findings: Column) -> Column:
    parts = F.filter(F.transform(findings, lambda f: f.context), lambda c: F.length(c) > 0)
    return F.when(F.size(parts) > 0, F.array_join(F.array_distinct(parts), "\n\n"))


def merged_input(findings: Column) -> Column:
    """Later findings win, key by key."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(findings, empty, lambda a, f: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(f.updated_input, k)), f.updated_input))


def joined_messages(findings: Column) -> Column:
    some = F.filter(findings, lambda f: F.length(f.message) > 0)
    return F.array_join(F.transform(some, lambda f: F.concat(F.lit("["), f.rule_id, F.lit(" | "), severity_name(f.severity), F.lit("] "), f.message)), "\n")


def decide(events: DataFrame) -> DataFrame:
    """Adds decision, context, updated_input and reason: the messages of findings whose decision is the top one itself."""
    names = [c for c in events.columns if c not in ("decision", "context", "updated_input", "reason")]
    e = events.select(*names, once(top_decision(F.col("findings")).alias("decision")).alias("own")).select(*names, "own.decision")
    said = joined_messages(F.filter("findings", lambda f: f.decision.eqNullSafe(F.col("decision"))))
    own = once(merged_context(F.col("findings")).alias("context"), merged_input(F.col("findings")).alias("updated_input"), said.alias("reason"))
    return e.select("*", own.alias("own")).select(*names, "decision", "own.context", "own.updated_input", "own.reason")


def render(events: DataFrame) -> DataFrame:
    """Adds `output`: the platform's JSON, NULL where it stays silent."""
    d, ctx, why, event, platform = F.col("decision"), F.col("context"), F.col("reason"), F.col("event"), F.col("platform")
    given = F.when(F.size("updated_input") > 0, F.col("updated_input"))
    s = lambda **kv: F.struct(*(v.alias(k) if isinstance(v, Column) else F.lit(v).alias(k) for k, v in kv.items()))
    js = lambda **kv: F.to_json(s(**kv))
    stops = d.isin("block", "deny", "ask")
    block, say = F.when(stops, "block"), F.when(stops, why)
    extra = lambda name: F.when(ctx.isNotNull(), s(hookEventName=name, additionalContext=ctx))
    permission = F.when(d == "block", "deny").when(d.isin("deny", "ask", "allow"), d)
    pre = F.when(permission.isNotNull() | ctx.isNotNull() | given.isNotNull(), js(hookSpecificOutput=s(hookEventName="PreToolUse", permissionDecision=permission, permissionDecisionReason=F.when(permission.isNotNull(), why), updatedInput=given, additionalContext=ctx)))
    request = F.when(d.isin("deny", "allow"), js(hookSpecificOutput=s(hookEventName="PermissionRequest", decision=s(behavior=d, updatedInput=F.when(d == "allow", given), message=F.when(d == "deny", why)))))
    start = F.when(ctx.isNotNull(), js(hookSpecificOutput=s(hookEventName="SessionStart", additionalContext=ctx)))
    talk = lambda name: F.when(stops | ctx.isNotNull(), js(decision=block, reason=say, hookSpecificOutput=extra(name)))
    both = F.when(ctx.isNull(), say).when(stops, F.when(why != "", trimmed(F.concat(why, F.lit("\n\n"), ctx))).otherwise(ctx))
    stop = F.when(stops | ctx.isNotNull(), js(decision=block, reason=both, systemMessage=F.when(~F.coalesce(stops, F.lit(False)), ctx)))
    message = F.when(ctx.isNotNull(), js(systemMessage=ctx))
    done = F.when(d.isin("block", "deny"), js(**{"continue": False, "stopReason": why})).otherwise(message)
    claude = F.when(event == "PreToolUse", pre).when(event == "PermissionRequest", request).when(event == "SessionStart", start).when(event == "UserPromptSubmit", talk("UserPromptSubmit")).when(event == "PostToolUse", talk("PostToolUse"))
    claude = claude.when(event.isin("Stop", "SubagentStop", "ConfigChange"), stop).when(event == "PostToolUseFailure", message).when(event.isin("TaskCompleted", "TeammateIdle"), done)
    critical = F.filter("findings", lambda f: (f.decision == "block") & (f.severity >= 40))
    halted = F.when(F.size(critical) > 0, js(**{"continue": False, "stopReason": joined_messages(critical), "hookSpecificOutput": extra("PostToolUse")})).otherwise(talk("PostToolUse"))
    codex = F.when(event == "PreToolUse", pre).when(event == "PostToolUse", halted).when(event == "SessionStart", start).when(event == "UserPromptSubmit", talk("UserPromptSubmit")).when(event == "Stop", stop)
    hard, only = d.isin("deny", "block"), F.when(ctx.isNotNull(), js(action="context", context=ctx))
    allow = (d == "allow") & given.isNotNull()
    open_ = F.when(event == "PreToolUse", F.when(hard, js(action="block", reason=why, context=ctx)).when(d == "ask", js(action="block", reason=why)).when(allow, js(action="allow", updated_args=given, context=ctx)).otherwise(only))
    open_ = open_.when(event == "PermissionRequest", F.when(d == "deny", js(action="block", reason=why)).when(allow, js(action="allow", updated_args=given)))
    open_ = open_.when(event == "PostToolUse", F.when(hard | ctx.isNotNull(), js(action=F.when(hard, "warn"), reason=F.when(hard, why), context=ctx)))
    open_ = open_.when(event == "SessionStart", only).when(event == "Stop", F.when(hard, js(action="continue", reason=why)).otherwise(only))
    out = F.when(platform == "claude", claude).when(platform == "codex", codex).when(platform == "opencode", open_)
    return events.withColumn("output", F.when(F.size("findings") > 0, out))
