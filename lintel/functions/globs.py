"""Path globs as regular expressions, made at plan time. `*` crosses slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, lower_path


def glob_regex(glob: str) -> str:
    """An anchored pattern that Java, RE2 and Python read alike."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "]") else i + 1) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]")
            i = close
        else:
            out.append("\\" + c if c in r"\.^$|+(){}[]-#&~" else c)
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def path_matches(path: Column, glob: str) -> Column:
    """A directory glob without `*` is a prefix; one without a slash is for the last part; else for the whole path."""
    g = glob.replace("\\", "/").strip().lower()
    low = lower_path(path)
    if g.endswith("/") and "*" not in g:
        return low.startswith(g)
    return (basename(low) if "/" not in g else low).rlike(glob_regex(g))


def any_matches(path: Column, globs: list[str]) -> Column:
    """True for no globs at all."""
    out = F.lit(not globs)
    for g in globs:
        out = out | path_matches(path, g)
    return out
