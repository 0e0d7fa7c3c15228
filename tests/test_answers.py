"""Answers of the first platform for every event, decision and context."""

import itertools
import json

from lintel.operators.decide import decide, render
from lintel.operators.rules import FINDING

EVENTS = ["PreToolUse", "PermissionRequest", "SessionStart", "UserPromptSubmit", "PostToolUse", "Stop", "SubagentStop", "ConfigChange", "PostToolUseFailure", "TaskCompleted", "TeammateIdle", "Other"]
WHY = "[R | HIGH] m"


def want(event, decision, context):
    """Written from the platform's contract: what stops, what talks to the model, and what only talks to the user."""
    stops, extra = decision in ("deny", "block", "ask"), context and {"hookEventName": event, "additionalContext": context}
    if event == "PreToolUse":
        own = {"permissionDecision": "deny" if decision == "block" else decision, "permissionDecisionReason": WHY} if stops or decision == "allow" else {}
        return {"hookSpecificOutput": {"hookEventName": event} | own | ({"additionalContext": context} if context else {})} if own or context else None
    if event == "PermissionRequest":
        return {"hookSpecificOutput": {"hookEventName": event, "decision": {"behavior": decision} | ({"message": WHY} if decision == "deny" else {})}} if decision in ("deny", "allow") else None
    if event == "SessionStart":
        return {"hookSpecificOutput": extra} if context else None
    if event in ("UserPromptSubmit", "PostToolUse"):
        return ({"decision": "block", "reason": WHY} if stops else {}) | ({"hookSpecificOutput": extra} if context else {}) or None
    if event in ("Stop", "SubagentStop", "ConfigChange"):
        return {"decision": "block", "reason": f"{WHY}\n\n{context.rstrip()}" if context else WHY} if stops else {"systemMessage": context} if context else None
    if event in ("TaskCompleted", "TeammateIdle") and decision in ("deny", "block"):
        return {"continue": False, "stopReason": WHY}
    if event in ("PostToolUseFailure", "TaskCompleted", "TeammateIdle"):
        return {"systemMessage": context} if context else None
    return None


def test_answers(spark):
    cases = list(itertools.product(EVENTS, [None, "deny", "block", "ask", "allow"], [None, "say so ", "say"]))
    rows = [(i, "claude", e, [("R", "R", 30, d, "m", c, {}, "{}")]) for i, (e, d, c) in enumerate(cases)]
    got = {r.ord: r.output and json.loads(r.output) for r in render(decide(spark.createDataFrame(rows, f"ord long, platform string, event string, findings array<{FINDING}>"))).collect()}
    assert {cases[i]: got[i] for i in got} == {c: want(*c) for c in cases}
    none = spark.createDataFrame([(1, "claude", "Stop", [])], f"ord long, platform string, event string, findings array<{FINDING}>")
    assert render(decide(none)).first().output is None
