"""Configuration on the driver: JSON rules and policies, TOML settings, and the settings a file lacks."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import fields

from ..operators.builtin_rules import Policy
from ..operators.lint import Limits
from ..operators.rules import RegexRule

SKIP_MARK = "skip"


def load_rules(text: str) -> list[RegexRule]:
    """Rule rows from JSON; keys that a rule does not have are left out. Bad JSON raises."""
    known = {f.name for f in fields(RegexRule)}
    rows = json.loads(text) if text.strip() else []
    rows = rows.get("regex_rules", []) if isinstance(rows, dict) else rows
    return [RegexRule(**{k: v for k, v in r.items() if k in known}) for r in rows if isinstance(r, dict)]


def load_toml(text: str) -> dict:
    """Settings; bad TOML counts as none."""
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def policy_of(settings: dict) -> Policy:
    known = {f.name for f in fields(Policy)}
    return Policy(**{k: tuple(v) if k == "disabled" else v for k, v in settings.items() if k in known})


def limits_of(settings: dict) -> Limits:
    known = {f.name: type(f.default) for f in fields(Limits)}
    return Limits(**{k: v for k, v in settings.items() if k in known and isinstance(v, (int, float, str)) and not isinstance(v, bool)})


def overrides_of(settings: dict) -> dict[str, str]:
    return {str(k): str(v) for k, v in settings.get("severity_overrides", {}).items()}


def missing_settings(text: str, defaults: dict[str, dict]) -> list[tuple[str, str]]:
    """(section, key) pairs of the defaults that the file lacks."""
    have = load_toml(text)
    return [(s, k) for s, keys in defaults.items() for k in keys if k not in (have.get(s) or {})]


def add_missing(text: str, defaults: dict[str, dict]) -> str:
    """The file with the missing settings added to the end of their sections; nothing that stands there changes."""
    show = lambda v: json.dumps(v, ensure_ascii=False)
    lines, todo = text.splitlines(), {}
    for s, k in missing_settings(text, defaults):
        todo.setdefault(s, []).append(f"{k} = {show(defaults[s][k])}")
    heads = [(i, m[1]) for i, line in enumerate(lines) if (m := re.match(r"\s*\[([^\[\]]+)\]", line))]
    for n in range(len(heads) - 1, -1, -1):
        at, name = heads[n]
        if name in todo:
            end = heads[n + 1][0] if n + 1 < len(heads) else len(lines)
            while end > at + 1 and not lines[end - 1].strip():
                end -= 1
            lines[end:end] = todo.pop(name)
    for name, rows in todo.items():
        lines += ["", f"[{name}]", *rows]
    return "\n".join(lines).strip("\n") + "\n"
