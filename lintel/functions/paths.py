"""Paths, URLs, patches and shell commands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by suffix.
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "js_ts", ".jsx": "js_ts", ".ts": "js_ts", ".tsx": "js_ts", ".mjs": "js_ts", ".cjs": "js_ts", ".rs": "rust"}
SHELL_PATH = r"([~./A-Za-z0-9_-]+/)*[A-Za-z0-9_.-]+\.[A-Za-z0-9]+"
#: What ends a line, besides CR LF.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def normalize_path(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("\\"), F.lit("/")))


def lower_path(c: Column) -> Column:
    return F.lower(normalize_path(c))


def basename(c: Column) -> Column:
    """The last part; trailing slashes do not count."""
    return F.regexp_extract(c, r"([^/]*)/*\z", 1)


def dirname(c: Column) -> Column:
    return F.regexp_replace(c, r"/*[^/]*/*\z", "")


def suffix(c: Column) -> Column:
    """The last dot and what follows, lower case; none for names that start with their only dot or end with one."""
    return F.lower(F.regexp_extract(basename(c), r"(?s).(\.[^.]+)\z", 1))


def language(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), suffix(c))


def splitlines(c: Column) -> Column:
    """Lines as Python's str.splitlines() gives them: no empty piece after a final line end, none for an empty text."""
    parts = F.split(c, f"\r\n|[{LINE_ENDS}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def shell_paths(command: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(command, F.lit(SHELL_PATH), F.lit(0)))


def patch_paths(patch: Column) -> Column:
    """Files a patch names, in order, each once."""
    heads = ("*** Update File: ", "*** Add File: ", "+++ b/", "--- a/")

    def named(line: Column) -> Column:
        out = F.lit("")
        for h in reversed(heads):
            out = F.when(line.startswith(h), F.trim(F.substring(line, len(h) + 1, 1 << 30))).otherwise(out)
        return out

    return F.array_distinct(F.filter(F.transform(splitlines(patch), named), lambda p: (p != "") & (p != "/dev/null")))


def patch_added(patch: Column) -> Column:
    added = F.filter(splitlines(patch), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(added, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def clone_url(c: Column, slash_first: bool = False) -> Column:
    """host/path for ssh and URL spellings of a repository, the host in lower case; anything else in lower case.

    slash_first: trailing slashes go before `.git` does, so that `x.git/` loses both; else `.git` goes first."""
    bare = F.trim(c)
    for pattern in (r"/+\z", r"\.git\z") if slash_first else (r"\.git\z", r"/+\z"):
        bare = F.regexp_replace(bare, pattern, "")
    ssh, url = r"^git@([^:]+):(.+)$", r"(?i)^[a-z]+://([^/]+)/(.+)$"
    part = lambda p, i: F.regexp_extract(bare, p, i)
    full = lambda p: F.concat(F.lower(part(p, 1)), F.lit("/"), F.regexp_replace(part(p, 2), "^/+|/+$", ""))
    return F.when(bare.rlike(ssh), full(ssh)).when(bare.rlike(url), full(url)).otherwise(F.lower(bare))


def constant_name(c: Column) -> Column:
    """A name for a string constant: capitals, digits and underscores, at most 48, not starting with a digit."""
    word = F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(word == "", "EXTRACTED_STRING").otherwise(F.left(F.when(word.rlike("^[0-9]"), F.concat(F.lit("STR_"), word)).otherwise(word), F.lit(48)))
