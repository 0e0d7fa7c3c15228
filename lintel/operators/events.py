"""Raw event payloads to canonical events. A projection: no shuffle, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.paths import language, patch_added, patch_paths, shell_paths
from .rules import settled

#: Keys in their order of precedence, tool names, and the dotted event names of one platform.
PATH_KEYS = ["resolved_file_path", "original_file_path", "file_path", "filePath", "path", "relative_path", "relativePath", "target_file", "target_filepath", "targetPath", "notebook_path", "notebookPath"]
CONTENT_KEYS = ["new_string", "newString", "newText", "new_text", "code_edit", "codeEdit", "body", "new_body", "newBody", "text", "content"]
PATCH_KEYS = ["patch", "patchText", "patch_text"]
OLD_KEYS = ["oldText", "old_text"]
EDIT_TOOLS = ["edit", "write", "multiedit", "notebookedit", "patch", "applypatch", "apply_patch"]
DOTTED_EVENTS = {"tool.execute.before": "PreToolUse", "tool.execute.after": "PostToolUse", "session.created": "SessionStart", "session.idle": "Stop", "permission.asked": "PermissionRequest"}
PLATFORMS = ("claude", "codex", "opencode")

TARGET = "struct<path:string,content:string,source:string>"


def is_edit_tool(tool: Column) -> Column:
    low = F.lower(tool)
    has = lambda x: low.contains(x)
    return low.isin(*EDIT_TOOLS) | has("edit_file") | has("editfile") | has("serena") | (has("morph") & (has("edit") | has("apply"))) | low.endswith("_edit")


def _target(path: Column, content: Column, source: str) -> Column:
    return F.struct(path.alias("path"), content.alias("content"), F.lit(source).alias("source"))


def _some(*targets: Column) -> Column:
    return F.array_compact(F.array(*targets))


def canonical(raw: DataFrame, default_cwd: str = "/", carry: tuple[str, ...] = ()) -> DataFrame:
    """(ord, platform, raw) -> one row per event with the columns that rules read, and those of raw named by `carry`.

    raw: JSON text. Blank or malformed text, and JSON that is no object, is an event without a name, which no rule
    supports. Wrong types count as absent. An unknown platform raises."""
    e = raw.select("ord", "platform", *carry, V.parse("raw").alias("v"))
    e = e.withColumn("platform", F.when(F.col("platform").isin(*PLATFORMS), F.col("platform")).otherwise(F.raise_error(F.concat(F.lit("unknown platform: "), F.coalesce("platform", F.lit("null"))))))
    e = e.withColumn("v", F.when(V.is_object(F.col("v")), F.col("v")))
    v, dotted = F.col("v"), F.col("platform") == "opencode"
    name = V.trimmed(V.python_str(v, "hook_event_name", ""))
    given = F.coalesce(V.text(v, "hook_event_name"), F.lit(""))
    mapped = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in DOTTED_EVENTS.items() for x in kv)), given), given)
    tool = V.first_text(v, ["tool_name", "tool"])
    own = F.coalesce(V.text(v, "tool_name"), F.lit(""))
    capital = F.when(own.rlike(r"^\p{Ll}"), F.concat(F.upper(F.left(own, F.lit(1))), F.lower(F.substring(own, 2, 1 << 30)))).otherwise(tool)
    i = F.when(V.is_object(V.member(v, "tool_input")), V.member(v, "tool_input"))
    response = F.when(V.has(v, "tool_response") | ~dotted, V.member(v, "tool_response")).otherwise(V.member(v, "tool_result"))
    e = e.select(
        "ord", "platform", *carry, "v", F.when(dotted, V.trimmed(mapped)).otherwise(name).alias("event"), F.when(dotted, V.trimmed(capital)).otherwise(tool).alias("tool"), i.alias("i"), response.alias("response"),
        F.coalesce(F.when(F.length(F.trim(V.text(v, "cwd"))) > 0, V.text(v, "cwd")), F.lit(default_cwd)).alias("cwd"),
        F.when(V.kind(V.member(v, "session_id")) == "VOID", "").otherwise(V.trimmed(V.python_str(v, "session_id", ""))).alias("session"), F.coalesce(V.text(v, "prompt"), F.lit("")).alias("prompt"),
    )
    e = settled(e)
    v, i = F.col("v"), F.col("i")
    e = e.withColumn("command", F.when(F.lower("tool") == "bash", F.coalesce(V.text(i, "command"), F.lit(""))).otherwise(""))
    # a key that the input has, whatever its type, hides the payload's
    above = lambda k: F.when(V.has(i, k), V.text(i, k)).otherwise(V.text(v, k))
    heads = [F.when(V.filled(above(k)), V.trimmed(above(k))) for k in PATH_KEYS[:2]]
    e = e.withColumn("path", F.coalesce(*heads, V.first_text(i, PATH_KEYS[2:])))
    e = e.withColumn("patch", V.first_text(i, PATCH_KEYS)).withColumn("edits", F.filter(V.members(i, "edits"), V.is_object))
    e = settled(e)
    content = V.first_text(i, CONTENT_KEYS, strip=False)
    single = _some(F.when((F.col("path") != "") & (content != ""), _target(F.col("path"), content, "tool_input")))

    def edited(x: Column) -> Column:
        path = F.coalesce(F.nullif(V.first_text(x, PATH_KEYS), F.lit("")), F.col("path"))
        new, old = V.first_text(x, CONTENT_KEYS, strip=False), V.first_text(x, OLD_KEYS, strip=False)
        return F.when((path != "") & (new != ""), _target(path, new, "multi_edit")).when((path != "") & (old != ""), _target(path, old, "multi_edit_old"))

    files = F.when(F.size(patch_paths(F.col("patch"))) > 0, patch_paths(F.col("patch"))).otherwise(F.array(F.lit("patch.diff")))
    added = F.coalesce(F.nullif(patch_added(F.col("patch")), F.lit("")), F.col("patch"))
    patched = F.when(F.col("patch") != "", F.transform(files, lambda p: _target(p, added, "patch"))).otherwise(F.array().cast(f"array<{TARGET}>"))
    e = e.withColumn("targets", F.array_distinct(F.concat(single.cast(f"array<{TARGET}>"), F.array_compact(F.transform("edits", edited)).cast(f"array<{TARGET}>"), patched.cast(f"array<{TARGET}>"))))
    one = lambda x: F.array(V.first_text(x, PATH_KEYS))
    none = F.array().cast("array<string>")
    paths = F.concat(one(v), one(i), F.transform("edits", lambda x: V.first_text(x, PATH_KEYS)), F.when(F.col("patch") != "", patch_paths(F.col("patch"))).otherwise(none), F.when(V.is_object(F.col("response")), one(F.col("response"))).otherwise(none), F.when(F.col("command") != "", shell_paths(F.col("command"))).otherwise(none))
    e = e.withColumn("paths", F.array_distinct(F.filter(paths, lambda p: p != "")))
    return e.withColumn("languages", F.array_sort(F.array_distinct(F.array_compact(F.transform("paths", language))))).drop("edits", "patch")
