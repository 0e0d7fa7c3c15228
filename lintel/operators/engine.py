"""Events to decisions in one plan: canonical form, rules, overrides, decision, answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from . import tree_rules as T
from .builtin_rules import FACTS, Policy, builtin_rules
from .decide import decide, enforcement_mode, override_severities, render
from .events import canonical
from .lint import Limits
from .rules import RegexRule, Rule, evaluate, regex_rule, settled
from .state import known_full_reads


def evaluate_events(raw: DataFrame, policy: Policy | None = None, regex_rules: list[RegexRule] | None = None, overrides: dict[str, str] | None = None, limits: Limits | None = Limits(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(ord, platform, raw, optional facts) -> one row per event with findings, errors, decision, context, reason and output.

    An event without an `enrolled` fact is taken as of an enrolled repository. limits: None leaves the syntax trees out.
    carry: further columns to keep. Rules are one projection, however many, without a join or a shuffle, so events may be a
    stream; of events that write Python files the sources also go to a Python worker."""
    policy = policy or Policy()
    facts = [c for c in FACTS if c in raw.columns]
    e = canonical(raw, carry=(*facts, *carry))
    e = e.withColumns({c: F.lit(None).cast(t) for c, t in FACTS.items() if c not in facts})
    e = e.withColumn("mode", enforcement_mode(F.coalesce("enrolled", F.lit(True)), F.col("repo_disabled"))).withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    e = settled(e)
    rules = builtin_rules(policy)
    if limits is not None:
        e = T.with_hits(e, limits)
        rules += [Rule("PY-CODE", (*T.BEFORE, *T.AFTER), lambda: T.tree_findings(limits, policy.disabled), many=True), *T.file_rules()]
    e = evaluate(e, [*rules, *(regex_rule(r) for r in regex_rules or [])], policy.disabled)
    if limits is not None:
        e = e.withColumn("errors", F.concat("errors", T.tree_errors())).drop("hits")
    return render(decide(override_severities(e, overrides or {})))


def full_reads(raw: DataFrame, at: Column) -> DataFrame:
    """raw (ord, platform, raw, ...) plus full_read_known, the fact that the rule against partial reads asks for.

    at: seconds of each event. A read without offset and limit makes its path known to its session for the time that
    state.known_full_reads() keeps it; paths count as their events name them, the last one of an event."""
    e = canonical(raw.withColumn("at", at.cast("long")), carry=("at",))
    reads = e.where((F.col("tool") == "Read") & F.col("event").isin("PreToolUse", "PermissionRequest") & (F.size("paths") > 0))
    whole = ~(V.has(F.col("i"), "offset") | V.has(F.col("i"), "limit"))
    known = known_full_reads(reads.select("ord", "session", F.element_at("paths", -1).alias("path"), "at", F.coalesce(whole, F.lit(True)).alias("full")))
    return raw.join(known.select("ord", F.col("known").alias("full_read_known")), "ord", "left")


def trace_results(decided: DataFrame) -> DataFrame:
    """The activity-log rows of decided events."""
    return decided.select("ord", F.col("event").alias("event_name"), "platform", F.col("session").alias("session_id"), F.col("tool").alias("tool_name"), "findings", "errors", "output", F.col("mode").alias("enforcement_mode"), "paths", "languages")
