"""Every registered query of the engine with its SQL twin, over whole tables.

The tables stand in for the engine's own inputs: events for an activity log (user as session, type as rule or event,
props as metadata), documents for file contents, pages for paths and URLs, conversations for transcripts, labels for
per-id settings, benchmark for a baseline and a constants file.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import variants as V
from ..functions.globs import any_matches
from ..operators import baseline as B
from ..operators import builtin_rules as R
from ..operators import decide as D
from ..operators import enclosing as E
from ..operators import lint as L
from ..operators import rulebook as rules_of
from ..operators import state as S
from ..operators import stats as T
from ..operators import text_checks as X
from ..operators.engine import evaluate_events, full_reads
from ..operators.events import canonical
from ..operators.lint import lint_documents
from ..operators.rule_table import match_rules
from ..operators.rule_table import rule_rows as rules_of_table
from ..operators.rules import FINDING, RegexRule, evaluate, finding, regex_rule
from ..sources.logs import read_log
from ..sources.shared import scratch
from ..sources.tails import last_responses, read_tails
from ..streaming.events import read_trace, stream_events, trace_stream
from .cases import RULE_CASES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark, sf_dir: str) -> DataFrame:
    """events as log rows: ord, session, rule_id, day, file."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("rule_id"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.get_json_object("props", "$.k").alias("file"), "value", "props")


# --- statistics of the activity log


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def stats_by_event(spark, sf_dir):
    return T.report(typed_entries(spark, sf_dir))["by_event"].select("event", "n")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def stats_daily(spark, sf_dir):
    return T.report(typed_entries(spark, sf_dir))["daily_counts"]


@query("SELECT min(strftime(ts, '%Y-%m-%d')) AS first_day, max(strftime(ts, '%Y-%m-%d')) AS last_day FROM events")
def stats_date_range(spark, sf_dir):
    return T.report(typed_entries(spark, sf_dir))["date_range"]


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, repeat('█', least(count(*) // 50, 60)::INT) AS bar FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def stats_daily_bars(spark, sf_dir):
    return T.daily_bars(stats_daily(spark, sf_dir))


@query("SELECT count(*) AS total_events, count(*) FILTER (user_id::VARCHAR LIKE '1%') AS fixture_filtered, count(DISTINCT user_id) FILTER (user_id::VARCHAR NOT LIKE '1%') AS sessions FROM events")
def stats_totals(spark, sf_dir):
    return T.report(typed_entries(spark, sf_dir, fixtures=True))["totals"]


ENTRY_SQL = """WITH f AS (SELECT CASE event_type WHEN 'error' THEN 'deny' WHEN 'purchase' THEN 'ask' END AS decision FROM events)
SELECT coalesce(decision, 'allow') AS decision, count(*) AS n FROM f GROUP BY 1"""


def entries(spark, sf_dir):
    """The log as JSON lines, read back as entries."""
    e = log(spark, sf_dir)
    decision = F.when(F.col("rule_id") == "error", "deny").when(F.col("rule_id") == "purchase", "ask")
    found = F.array(F.struct("rule_id", decision.alias("decision"), F.lit("LOW").alias("severity"), F.struct(F.concat(F.lit("f"), "file").alias("path")).alias("metadata")))
    line = F.to_json(F.struct(F.col("session").alias("session_id"), F.col("rule_id").alias("event_name"), F.col("ts").cast("string").alias("timestamp"), found.alias("findings")))
    return T.entries_of(e.select("ord", line.alias("value")))


def typed_entries(spark, sf_dir, fixtures: bool = False):
    """The log as entries without a detour through text. fixtures: sessions that start with 1 are those of tests."""
    e = log(spark, sf_dir)
    session = F.when(F.col("session").startswith("1"), F.concat(F.lit("test-"), "session")).otherwise(F.col("session")) if fixtures else F.col("session")
    decision = F.when(F.col("rule_id") == "error", "deny").when(F.col("rule_id") == "purchase", "ask")
    none = F.array().cast("array<string>")
    found = F.array(F.struct("rule_id", F.lit("LOW").alias("severity"), decision.alias("decision"), F.lit("").alias("message"), F.concat(F.lit("f"), "file").alias("path"), none.alias("hits"), decision.isNotNull().alias("has_decision")))
    return e.select("ord", session.alias("session"), F.col("rule_id").alias("event"), F.lit("(none)").alias("tool"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), found.alias("findings"))


@query(ENTRY_SQL)
def log_entries(spark, sf_dir):
    """The same counts from JSON lines, parsed."""
    return T.decisions(entries(spark, sf_dir)).select("decision", "n")


@query(ENTRY_SQL)
def stats_decisions(spark, sf_dir):
    return T.decisions(typed_entries(spark, sf_dir)).select("decision", "n")


@query("SELECT 'f' || json_extract_string(props, '$.k') AS file, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 15")
def stats_top_files(spark, sf_dir):
    return T.denied_files(typed_entries(spark, sf_dir)).select("file", "n")


@query("SELECT event_type AS rule_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC LIMIT 20")
def stats_top_rules(spark, sf_dir):
    return T.counted(T.denied(typed_entries(spark, sf_dir)), "rule_id", k=20).select("rule_id", "n")


@query("SELECT json_extract_string(props, '$.k') AS file, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 10")
def stats_top_tools(spark, sf_dir):
    return T.counted(log(spark, sf_dir), "file", k=10).select("file", "n")


@query("SELECT 'LOW' AS severity, count(*) AS n FROM events")
def stats_severity(spark, sf_dir):
    return T.counted(T.exploded(typed_entries(spark, sf_dir)), "severity").select("severity", "n")


@query("SELECT event_type AS rule_id, event_id AS ord, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3")
def stats_examples(spark, sf_dir):
    return T.first_examples(log(spark, sf_dir), "rule_id", "ord").select("rule_id", "ord", "value")


@query("""WITH p AS (SELECT user_id::VARCHAR AS session, event_type AS rule_id, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id::VARCHAR AS session, min(event_id) AS seen FROM events GROUP BY 1)
SELECT rule_id || ' (session ' || left(p.session, 1) || '...)' AS label, arg_max(n, seen) AS n FROM p JOIN s USING (session) WHERE n >= 2 GROUP BY 1""")
def stats_retry(spark, sf_dir):
    return T.retry_patterns(log(spark, sf_dir), k=None, prefix=1)


@query("SELECT event_type AS rule_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def stats_cutoff(spark, sf_dir):
    e = log(spark, sf_dir)
    last = e.agg(F.max("ts").cast("timestamp")).first()[0]
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    lines = e.select("ord", F.to_json(F.struct(F.col("rule_id").alias("event_name"), stamp.alias("timestamp"))).alias("value"))
    return T.counted(T.entries_of(lines, 7, F.lit(last)), "event").select(F.col("event").alias("rule_id"), "n")


@query("SELECT event_type AS rule_id, count(*) AS n FROM events WHERE user_id::VARCHAR NOT LIKE '1%' GROUP BY 1")
def stats_fixture_filter(spark, sf_dir):
    return T.report(typed_entries(spark, sf_dir, fixtures=True))["by_event"].select(F.col("event").alias("rule_id"), "n")


REPORT_SQL = """WITH e AS (SELECT event_id, user_id::VARCHAR AS s, event_type AS t, strftime(ts, '%Y-%m-%d') AS d, 'f' || json_extract_string(props, '$.k') AS file, CASE event_type WHEN 'error' THEN 'deny' WHEN 'purchase' THEN 'ask' END AS decision FROM events),
p AS (SELECT s, t, count(*) AS n, min(event_id) AS seen FROM e WHERE decision = 'deny' GROUP BY ALL),
r AS (SELECT 'by_event' AS section, t AS label, count(*) AS n, min(event_id) AS f, 0 AS g, 1000 AS most FROM e GROUP BY t
UNION ALL SELECT 'top_tools', '(none)', count(*), 0, 0, 10 FROM e UNION ALL SELECT 'by_severity', 'LOW', count(*), 0, 0, 1000 FROM e
UNION ALL SELECT 'by_decision', coalesce(decision, 'allow'), count(*), min(event_id), 0, 1000 FROM e GROUP BY decision
UNION ALL SELECT 'by_rule', t, count(*), min(event_id), 0, 1000 FROM e GROUP BY t
UNION ALL SELECT 'top_rules_denied', t, count(*), min(event_id), 0, 20 FROM e WHERE decision = 'deny' GROUP BY t
UNION ALL SELECT 'top_files_denied', file, count(*), min(event_id), 0, 15 FROM e WHERE decision = 'deny' AND file IS NOT NULL GROUP BY file
UNION ALL SELECT 'retry_patterns', t || ' (session ' || left(s, 8) || '...)', n, min(seen) OVER (PARTITION BY s), seen, 15 FROM p WHERE n >= 2),
k AS (SELECT section, row_number() OVER (PARTITION BY section ORDER BY n DESC, f, g) AS place, label, n, most FROM r)
"""


def kept_summary(spark, sf_dir, fixtures=False):
    """The report's counts as a small table, so that its parts do not read the log again."""
    path = scratch(spark, "summary")
    T.summary(typed_entries(spark, sf_dir, fixtures)).write.parquet(path)
    return T.unpacked(spark.read.parquet(path))


@query(REPORT_SQL + """SELECT section, place, label, n FROM k WHERE place <= most
UNION ALL SELECT 'daily_counts', row_number() OVER (ORDER BY d), d, count(*) FROM e GROUP BY d
UNION ALL SELECT 'sessions', 1, '', count(DISTINCT s) FROM e UNION ALL SELECT 'total_events', 1, '', count(*) FROM e""")
def stats_summary(spark, sf_dir):
    """All tables of the report from one scan of the log."""
    tables = kept_summary(spark, sf_dir)
    ranked = lambda df, *order: df.selectExpr("*", f"row_number() OVER (ORDER BY {', '.join(order)}) AS place")  # noqa: E731  of the report's few rows
    name = {"by_event": "event", "top_tools": "tool", "by_severity": "severity", "by_decision": "decision", "by_rule": "rule_id", "top_rules_denied": "rule_id", "top_files_denied": "file", "retry_patterns": "label"}
    out = ranked(tables["daily_counts"], "day").select(F.lit("daily_counts").alias("section"), "place", F.col("day").alias("label"), "n")
    for section, key in name.items():
        out = out.unionByName(ranked(tables[section], "n DESC", "first").select(F.lit(section).alias("section"), "place", F.col(key).alias("label"), "n"))
    for key in ("sessions", "total_events"):
        out = out.unionByName(tables["totals"].select(F.lit(key).alias("section"), F.lit(1).alias("place"), F.lit("").alias("label"), F.col(key).alias("n")))
    return out


@query(REPORT_SQL + """SELECT 1 AS section, place, '  ' || rpad(label, 12, ' ') || ' ' || lpad(format('{:,}', n), 6, ' ') || '  (' || printf('%.1f', n::DOUBLE / (SELECT count(*) FROM e) * 100) || '%)' AS line FROM k WHERE section = 'by_decision'
UNION ALL SELECT 2, place, '  ' || rpad(label, 25, ' ') || ' ' || lpad(format('{:,}', n), 6, ' ') FROM k WHERE section = 'by_event'
UNION ALL SELECT 4, place, '  ' || lpad(format('{:,}', n), 4, ' ') || '  ' || label FROM k WHERE section = 'top_files_denied' AND place <= most
UNION ALL SELECT 5, place, '  ' || lpad(format('{:,}', n), 3, ' ') || 'x  ' || label FROM k WHERE section = 'retry_patterns' AND place <= most""")
def report_lines(spark, sf_dir):
    """The text report's lines of decisions, events, files and retries."""
    lines = T.text_report(kept_summary(spark, sf_dir))
    return lines.where("section IN (1, 2, 4, 5) AND place BETWEEN 1 AND 1000").select("section", F.col("place").cast("long").alias("place"), "line")


# --- logs as files


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ord FROM events")
def log_ord(spark, sf_dir):
    """The log as JSON lines in several files, each line with its number in the whole log."""
    path = scratch(spark, "log")
    e = read(spark, sf_dir, "events")
    e.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").select(F.to_json(F.struct("event_id", "event_type", "props"))).write.text(path)
    return read_log(spark, path).select(F.try_variant_get(V.parse("value"), "$.event_id", "bigint").alias("event_id"), "ord")


@query("SELECT conv_id, arg_max(text, turn) AS said FROM conversations WHERE role = 'assistant' GROUP BY 1")
def tail_responses(spark, sf_dir):
    """A file for each conversation; what its assistant said last, from the file's end."""
    path = scratch(spark, "transcripts")
    c = read(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    c.select("conv_id", "turn", line.alias("value")).repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "value").write.partitionBy("conv_id").text(path)
    found = last_responses(read_tails(spark, path))
    return found.select(F.regexp_extract("path", r"conv_id=(-?\d+)/", 1).cast("long").alias("conv_id"), "said")


# --- payload projections


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, 'unknown' AS missing FROM events WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')")
def payload_json(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("v", V.parse(F.col("props")))
    return e.where(V.kind(V.member(F.col("v"), "k")) == "BIGINT").select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), V.python_str(F.col("v"), "absent", "unknown").alias("missing"))


DISTINCT = "list_filter(l, lambda x, i: list_position(l, x) = i)"


@query(f"WITH p AS (SELECT doc_id, regexp_extract_all(text, '{P.SHELL_PATH}', 0) AS l FROM documents) SELECT doc_id, array_to_string({DISTINCT}, ',') AS paths, len({DISTINCT}) AS n FROM p WHERE len(l) > 0")
def path_extract(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", P.shell_paths(F.col("text")).alias("p")).where(F.size("p") > 0)
    return d.select("doc_id", F.array_join("p", ",").alias("paths"), F.size("p").cast("long").alias("n"))


GLOBS = ["*.example.com/*", "**/en/*", "http://m.*", "[!h]*/x/"]


@query(r"SELECT page_id, regexp_matches(lower(url), '(?s)^.*\.example\.com/.*\z') OR regexp_matches(lower(url), '(?s)^.*.*/en/.*\z') OR regexp_matches(lower(url), '(?s)^http://m\..*\z') AS hit FROM pages")
def glob_match(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", any_matches(F.col("url"), GLOBS).alias("hit"))


SUFFIXES = {"en": "py", "fr": "tsx", "de": "rs", "es": "md"}


@query("SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'js_ts' WHEN 'de' THEN 'rust' END AS language, count(*) AS n FROM documents GROUP BY 1")
def lang_detect(spark, sf_dir):
    name = F.concat("source", F.lit("/d.x/"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv)), F.col("lang")))
    return read(spark, sf_dir, "documents").select(P.language(name).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '\.git$', ''), '/+$', '') AS u FROM pages)
SELECT page_id, lower(regexp_extract(u, '(?i)^[a-z]+://([^/]+)/(.+)$', 1)) || '/' || regexp_replace(regexp_extract(u, '(?i)^[a-z]+://([^/]+)/(.+)$', 2), '^/+|/+$', '', 'g') AS repo FROM c WHERE regexp_matches(u, '(?i)^[a-z]+://([^/]+)/(.+)$')
UNION ALL SELECT page_id, lower(u) FROM c WHERE NOT regexp_matches(u, '(?i)^[a-z]+://([^/]+)/(.+)$')""")
def url_normalise(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", P.clone_url(F.col("url")).alias("repo"))


@query(r"WITH t AS (SELECT doc_id, regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS t FROM documents) SELECT doc_id, len(string_split(t, chr(10))) - CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 1 ELSE 0 END AS n FROM t")
def split_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(P.splitlines(F.col("text"))).cast("long").alias("n"))


# --- rules and decisions

RULES = [
    RegexRule("WORD-001", ["PreToolUse"], "content", [r"\bidiot\b", r"\bmoron\b"], message="{rule_id}: {path}", case_sensitive=False, path_globs=["*.py", "*.tsx"]),
    RegexRule("MARK-001", ["PreToolUse"], "content", [r"\*{3}$"], action="block", severity="CRITICAL", message="marks in {matched_paths}", exclude_path_globs=["src0/*"]),
    RegexRule("PATH-001", ["PreToolUse"], "path", [r"^src1\d/"], action="ask", severity="LOW"),
]
DOC_PATH = "source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.tsx' WHEN 'de' THEN '.rs' ELSE '.md' END"
RULE_SQL = f"""WITH d AS (SELECT doc_id, text, {DOC_PATH} AS path FROM documents), f AS (
SELECT doc_id, 1 AS ord, 'WORD-001' AS rule_id, 'deny' AS decision, 30 AS severity, 'WORD-001: ' || path AS message FROM d WHERE regexp_matches(path, '\\.(py|tsx)$') AND regexp_matches(text, '(?i)\\b(idiot|moron)\\b')
UNION ALL SELECT doc_id, 2, 'MARK-001', 'block', 40, 'marks in ' || path FROM d WHERE path NOT LIKE 'src0/%' AND regexp_matches(text, '(?m)\\*{{3}}$')
UNION ALL SELECT doc_id, 3, 'PATH-001', 'ask', 10, 'PATH-001' FROM d WHERE regexp_matches(path, '^src1\\d/'))
"""


def written_documents(spark, sf_dir):
    """documents as write events."""
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".tsx").when(F.col("lang") == "de", ".rs").otherwise(".md")
    d = read(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end))
    target = F.struct("path", F.col("text").alias("content"), F.lit("tool_input").alias("source"))
    return d.select("doc_id", F.lit("claude").alias("platform"), F.lit("PreToolUse").alias("event"), F.lit("Write").alias("tool"), F.array(target).alias("targets"), F.array("path").alias("paths"), F.lit("").alias("command"), F.lit("").alias("prompt"), F.lit("repo_strict").alias("mode"), F.lit(False).alias("skipped"))


def ruled(spark, sf_dir):
    """documents as write events with their findings."""
    return evaluate(written_documents(spark, sf_dir), [regex_rule(r) for r in RULES])


@query(RULE_SQL + "SELECT doc_id, rule_id, message FROM f")
def rule_content(spark, sf_dir):
    return ruled(spark, sf_dir).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.rule_id", "f.message")


@query(RULE_SQL + """, t AS (SELECT doc_id, arg_min(decision, (-(CASE decision WHEN 'ask' THEN 3 ELSE 4 END), -severity, ord)) AS decision FROM f GROUP BY 1)
SELECT t.doc_id, t.decision, string_agg('[' || rule_id || ' | ' || CASE severity WHEN 30 THEN 'HIGH' WHEN 40 THEN 'CRITICAL' ELSE 'LOW' END || '] ' || message, chr(10) ORDER BY ord) AS reason FROM t JOIN f ON f.doc_id = t.doc_id AND f.decision = t.decision GROUP BY ALL""")
def top_decision(spark, sf_dir):
    return D.decide(ruled(spark, sf_dir).where(F.size("findings") > 0)).select("doc_id", "decision", "reason")


@query(RULE_SQL + """, t AS (SELECT doc_id, arg_min(decision, (-(CASE decision WHEN 'ask' THEN 3 ELSE 4 END), -severity, ord)) AS decision FROM f GROUP BY 1)
SELECT CASE decision WHEN 'block' THEN 'deny' ELSE decision END AS permission, count(*) AS n FROM t GROUP BY 1""")
def render_permission(spark, sf_dir):
    out = D.render(D.decide(ruled(spark, sf_dir))).where("output IS NOT NULL")
    return out.select(F.get_json_object("output", "$.hookSpecificOutput.permissionDecision").alias("permission")).groupBy("permission").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 10 WHEN l.quality = 1 THEN 30 WHEN l.quality = 0 THEN 40 ELSE 20 END AS severity, CASE WHEN l.toxic = 1 THEN NULL ELSE 'deny' END AS decision
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def severity_override(spark, sf_dir):
    kind = F.when(F.col("toxic") == 1, "TOXIC").when(F.col("quality") == 1, "GOOD").when(F.col("quality") == 0, "BAD")
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("kind", F.coalesce(kind, F.lit("NONE")))
    own = finding("?", "MEDIUM", "deny", "m").withField("rule_id", F.col("kind")).cast(FINDING)
    e = D.override_severities(d.select("doc_id", F.array(own).alias("findings")), {"TOXIC": "warn", "GOOD": "high", "BAD": "critical"})
    return e.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.severity", "f.decision")


@query("""WITH r AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, chr(10) || chr(10) ORDER BY t) AS context FROM r GROUP BY 1""")
def context_merge(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", D.merged_context(F.transform("t", lambda x: finding("R", "LOW", None, None, x.role))).alias("context"))


@query("SELECT CASE WHEN quality = 0 THEN 'outside_repo' WHEN toxic = 1 THEN 'repo_relaxed' ELSE 'repo_strict' END AS mode, count(*) AS n FROM labels GROUP BY 1")
def enforcement_mode(spark, sf_dir):
    return read(spark, sf_dir, "labels").groupBy(D.enforcement_mode(F.col("quality") == 1, F.col("toxic") == 1).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


# --- built-in rules


@query("SELECT page_id, regexp_matches(lower(url), 'example\\.com|/en/') AND NOT (lower(url) LIKE '%.test' OR lower(url) LIKE '%.bak') AS hit FROM pages")
def sensitive_path(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", R.sensitive_path(F.col("url"), ["example.com", "/(en)/"]).alias("hit"))


@query("SELECT page_id, lower(url) LIKE 'https://%' AS hit FROM pages")
def system_prefix(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", R.system_path(F.col("url"), ["HTTPS://"]).alias("hit"))


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 5000")
def large_content(spark, sf_dir):
    target = F.struct(F.lit("a.md").alias("path"), F.col("text").alias("content"), F.lit("tool_input").alias("source"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(R.large_targets(F.array(target), 5000)).alias("t"))
    return d.select("doc_id", F.length("t.content").cast("long").alias("chars"))


NOISE = {"en": "Traceback (most recent call last)\nKeyError: x", "fr": "3 failed, 2 passed\n4 passed in 0.1s", "de": "Build FAILED\nerror[E1]\nSuccessfully built"}
NOISE_SQL = "CASE lang WHEN 'en' THEN 'Traceback (most recent call last)' || chr(10) || 'KeyError: x' WHEN 'fr' THEN '3 failed, 2 passed' || chr(10) || '4 passed in 0.1s' WHEN 'de' THEN 'Build FAILED' || chr(10) || 'error[E1]' || chr(10) || 'Successfully built' ELSE '' END"


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


@query(
    f"WITH o AS (SELECT doc_id, text || chr(10) || {NOISE_SQL} AS o FROM documents), c AS (SELECT doc_id, o, "
    + " + ".join(f"regexp_matches(o, '{_sql_pattern(p)}')::INT" for p in R.ERROR_SIGNALS)
    + " AS n, "
    + " OR ".join(f"regexp_matches(o, '{_sql_pattern(p)}')" for p in R.SUCCESS_SIGNALS)
    + " AS good FROM o) SELECT doc_id, n, length(trim(o)) >= 10 AND n > 0 AND NOT (good AND n <= 1) AS bad FROM c"
)
def error_signals(spark, sf_dir):
    noise = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in NOISE.items() for x in kv)), F.col("lang")), F.lit(""))
    o = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), noise).alias("o"))
    return o.select("doc_id", R.signal_count(F.col("o")).alias("n"), R.error_signals(F.col("o")).alias("bad"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def last_assistant(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("t"))
    return turns.select("conv_id", R.last_assistant(F.col("t")).alias("text")).where("text IS NOT NULL")


@query("SELECT conv_id, CASE WHEN bool_or(contains(lower(text), 'was already')) THEN 'was already' END AS phrase FROM (SELECT conv_id, text || CASE role WHEN 'system' THEN ' It WAS already so' ELSE '' END AS text FROM conversations) GROUP BY 1")
def preexisting(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").select("conv_id", F.concat("text", F.when(F.col("role") == "system", " It WAS already so").otherwise("")).alias("text"))
    return said.groupBy("conv_id").agg(F.min(R.dismissal(F.col("text"))).alias("phrase"))


@query("SELECT regexp_extract(url, '//([^/?#]+)', 1) AS host, count(DISTINCT regexp_extract(url, '//[^/]+/([^/?#]*)', 1)) AS langs FROM pages GROUP BY 1 HAVING langs > 2")
def import_fanout(spark, sf_dir):
    """Each host as a module that imports one name for every language its pages stand under."""
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "//[^/]+/([^/?#]*)", 1).alias("lang"))
    names = F.array_join(F.transform(F.sequence(F.lit(1), F.count_distinct("lang").cast("int")), lambda i: F.concat(F.lit("n"), i.cast("string"))), ", ")
    files = p.groupBy("host").agg(names.alias("names")).select(F.concat("host", F.lit(".py")).alias("path"), F.concat(F.lit("from h import "), "names", F.lit("\n")).alias("source"), F.lit(False).alias("is_test"))
    found = L.runtime_findings(L.ast_facts(files), L.Limits(import_names=2)).where("rule_id = 'PY-IMPORT-001'")
    return found.select(F.regexp_replace("path", r"\.py$", "").alias("host"), F.col("value").alias("langs"))


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n)::BIGINT AS total, arg_min(event_type, (-n, event_type)) AS event_type, max(n) AS n FROM p GROUP BY 1)
SELECT user_id, event_type, n, total FROM t WHERE total >= 6 AND n / total > 0.3""")
def feature_envy(spark, sf_dir):
    return X.share_of_top(read(spark, sf_dir, "events"), "user_id", "event_type", 6, 0.3)


@query("WITH p AS (SELECT regexp_extract(url, '//[^/]*?\\.?([^./]+\\.[^./]+)/', 1) AS dir, regexp_extract(url, '//([a-z]{2})', 1) AS prefix FROM pages) SELECT dir, prefix, count(*) AS n FROM p WHERE dir <> '' AND prefix <> '' GROUP BY 1, 2 HAVING count(*) >= 3")
def flat_siblings(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"//[^/]*?\.?([^./]+\.[^./]+)/", 1).alias("dir"), F.regexp_extract("url", "//([a-z]{2})", 1).alias("prefix"))
    paths = p.where("dir <> '' AND prefix <> ''").select(F.concat("dir", F.lit("/_"), "prefix", F.lit("_page.py")).alias("path"))
    return L.flat_siblings(paths)


# --- lines and repeats

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), l2 AS (SELECT l.* FROM l JOIN documents d USING (doc_id) WHERE NOT (line = '' AND line_no = len(string_split(d.text, chr(10)))))"


@query(f"WITH {LINES} SELECT doc_id, line_no, length(line) AS length FROM l2 WHERE length(line) > 400 AND NOT starts_with(ltrim(line), '#') AND NOT regexp_matches(line, 'https?://')")
def long_lines(spark, sf_dir):
    return X.long_lines(X.lines(read(spark, sf_dir, "documents"), "doc_id"), 400).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("length").cast("long").alias("length"))


@query(f"WITH {LINES} SELECT doc_id, arg_min(line_no, (-length(line), line_no)) AS line_no, max(length(line)) AS length FROM l2 GROUP BY 1")
def worst_line(spark, sf_dir):
    return X.worst_line(X.lines(read(spark, sf_dir, "documents"), "doc_id"), "doc_id")


@query(f"WITH {LINES} SELECT CASE WHEN n > 30 THEN 'hard' WHEN n > 10 THEN 'soft' ELSE 'fine' END AS band, count(*) AS docs FROM (SELECT doc_id, count(*) AS n FROM l2 GROUP BY 1) GROUP BY 1 HAVING band <> 'fine'")
def oversized(spark, sf_dir):
    """Prose does not parse, so its files have the module's facts alone."""
    files = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("):\n"), "text").alias("source"), F.lit(False).alias("is_test"))
    found = L.simple_violations(L.ast_facts(files), L.Limits(module_hard=31, module_soft=11)).where("rule LIKE 'oversized%'")
    return found.groupBy(F.when(F.col("rule") == "oversized-module", "hard").otherwise("soft").alias("band")).agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT w AS literal, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}', 0)) AS w FROM documents) WHERE w NOT IN ('status', 'strings') GROUP BY 1 HAVING n > 10")
def repeated_literals(spark, sf_dir):
    return X.repeated_literals(read(spark, sf_dir, "documents"), "doc_id", "[A-Za-z]{6,}", 10, ["status", "strings"])


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_no, regexp_replace(trim(line), '\\s+', ' ', 'g') AS s FROM l2), k AS (SELECT * FROM s WHERE s <> ''),
b AS (SELECT doc_id, line_no, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS block FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT left(sha256(block), 16) AS hash, count(*) AS n, min((doc_id, line_no))[1] AS first_key, min((doc_id, line_no))[2] AS first_line FROM b WHERE block IS NOT NULL GROUP BY 1 HAVING n >= 2""")
def repeated_blocks(spark, sf_dir):
    return X.repeated_blocks(X.lines(read(spark, sf_dir, "documents"), "doc_id"), "doc_id")


CLONE_SQL = r"WITH h AS (SELECT doc_id, left(sha256(regexp_replace(regexp_replace(lower(text), '[0-9]+', 'N', 'g'), '[ \t\n]+', ' ', 'g')), 16) AS hash FROM documents), g AS (SELECT hash, count(*) AS n, list(doc_id ORDER BY doc_id) AS ids FROM h GROUP BY 1 HAVING n >= 2)"


@query(CLONE_SQL + " SELECT doc_id, h.hash, n, array_to_string(list_filter(ids, lambda x: x <> doc_id)[1:3], ',') AS others FROM h JOIN g USING (hash)")
def semantic_clone(spark, sf_dir):
    squeezed = F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "N"), "[ \t\n]+", " ")
    h = read(spark, sf_dir, "documents").select("doc_id", F.left(F.sha2(squeezed, 256), F.lit(16)).alias("hash"))
    return X.groups_of(h, "hash", "doc_id").select("doc_id", "hash", "n", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query("WITH s AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS seq, count(*) AS k FROM conversations GROUP BY 1) SELECT seq, count(*) AS n, min(conv_id) AS first_conv FROM s WHERE k >= 3 GROUP BY 1 HAVING n >= 2")
def call_sequence(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    seq = turns.where(F.size("t") >= 3).select("conv_id", F.transform("t", lambda x: x.role).alias("s"))
    return seq.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv")).where("n >= 2").select(F.array_join("s", ">").alias("seq"), "n", "first_conv")


@query("""WITH r AS (SELECT user_id, event_type = 'view' AS hit, row_number() OVER w - sum((event_type = 'view')::INT) OVER w AS island FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, max(n) AS run FROM (SELECT user_id, island, count(*) AS n FROM r WHERE hit GROUP BY ALL) GROUP BY 1""")
def assert_runs(spark, sf_dir):
    return X.longest_runs(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "view")


@query(f"WITH {LINES}, q AS (SELECT doc_id, coalesce(sum((length(line) - length(replace(line, '###', ''))) // 3) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS outside FROM l2) SELECT doc_id, count(*) AS lines, count(*) FILTER (outside) AS outside FROM q GROUP BY 1")
def docstring_parity(spark, sf_dir):
    rows = X.outside_quotes(X.lines(read(spark, sf_dir, "documents"), "doc_id"), "doc_id", "###")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("outside").alias("outside"))


# --- baseline

BASE_SQL = """WITH cur AS (SELECT lang AS rule, concat_ws('|', lang, source, left(sha256(text), 8)) AS stable_id FROM documents),
base AS (SELECT lang AS rule, concat_ws('|', lang, source, left(sha256(text), 8)) AS stable_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT 'en', concat_ws('|', 'en', 'benchmark', left(sha256(text), 8)) FROM benchmark)
"""


def violations(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    row = lambda rule, path: (rule.alias("rule"), B.stable_id(rule, path, B.short_hash(F.col("text")), F.lit("")).alias("stable_id"))
    good = docs.join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")
    base = good.select(*row(F.col("lang"), F.col("source"))).unionByName(read(spark, sf_dir, "benchmark").select(*row(F.lit("en"), F.lit("benchmark"))))
    return docs.select(*row(F.col("lang"), F.col("source"))), base


@query(BASE_SQL + "SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rule = cur.rule AND base.stable_id = cur.stable_id)")
def baseline_new(spark, sf_dir):
    return B.new_violations(*violations(spark, sf_dir))


@query(BASE_SQL + "SELECT DISTINCT * FROM base WHERE NOT EXISTS (SELECT 1 FROM cur WHERE base.rule = cur.rule AND base.stable_id = cur.stable_id)")
def baseline_fixed(spark, sf_dir):
    return B.fixed_ids(*violations(spark, sf_dir))


@query(BASE_SQL + """, c AS (SELECT rule, count(*) AS current_count FROM cur GROUP BY 1), b AS (SELECT rule, count(DISTINCT stable_id) AS baseline_count FROM base GROUP BY 1),
n AS (SELECT rule, count(*) AS new_count FROM cur WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rule = cur.rule AND base.stable_id = cur.stable_id) GROUP BY 1),
x AS (SELECT rule, count(DISTINCT stable_id) AS fixed_count FROM base WHERE NOT EXISTS (SELECT 1 FROM cur WHERE base.rule = cur.rule AND base.stable_id = cur.stable_id) GROUP BY 1)
SELECT rule, current_count, coalesce(baseline_count, 0) AS baseline_count, coalesce(new_count, 0) AS new_count, coalesce(fixed_count, 0) AS fixed_count, coalesce(new_count, 0) <= 0 AS passed FROM c LEFT JOIN b USING (rule) LEFT JOIN n USING (rule) LEFT JOIN x USING (rule)""")
def baseline_tally(spark, sf_dir):
    return B.tally(*violations(spark, sf_dir))


@query(BASE_SQL + ", c AS (SELECT rule, count(*) AS new_count FROM cur GROUP BY 1), b AS (SELECT rule, count(*) AS old_count FROM base GROUP BY 1) SELECT rule, coalesce(old_count, 0) AS old_count, new_count FROM c LEFT JOIN b USING (rule) WHERE new_count > coalesce(old_count, 0)")
def baseline_increase(spark, sf_dir):
    return B.increases(*violations(spark, sf_dir))


# --- rules as rows of a table


@query(RULE_SQL + "SELECT doc_id, rule_id, message FROM f")
def rule_rows(spark, sf_dir):
    """The same findings as rule_content, with the rules in a table."""
    found = match_rules(written_documents(spark, sf_dir), rules_of_table(spark, RULES), ("doc_id",))
    return found.select("doc_id", "finding.rule_id", "finding.message")


@query(r"""WITH b AS (SELECT item_id, array_to_string(list_transform(string_split(text, ' ')[1:3], lambda w: regexp_escape(w)), '\s+') AS pattern FROM benchmark WHERE text <> '')
SELECT item_id, doc_id FROM documents JOIN b ON regexp_matches(text, pattern)""")
def passage_rules(spark, sf_dir):
    """A rule for the beginning of each benchmark text, made from that table, against all documents."""
    words = F.transform(F.slice(F.split("text", " "), 1, 3), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1"))
    none = F.array().cast("array<string>")
    rules = read(spark, sf_dir, "benchmark").where("text <> ''").select(
        F.col("item_id").alias("place"), F.col("item_id").cast("string").alias("rule_id"), F.array(F.lit("PreToolUse")).alias("events"), F.lit("content").alias("target"), F.array(F.array_join(words, r"\s+")).alias("patterns"), F.lit("deny").alias("action"), F.lit("LOW").alias("severity"),
        F.lit("").alias("title"), F.lit("").alias("message"), F.lit(None).cast("string").alias("context"), none.alias("path_globs"), none.alias("exclude_path_globs"), none.alias("tool_matchers"), F.lit(True).alias("case_sensitive"), F.lit(False).alias("multiline"),
    )
    return match_rules(written_documents(spark, sf_dir), rules, ("doc_id",)).select(F.col("place").alias("item_id"), "doc_id")


# --- settings of enclosing folders


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '/+$', '') AS url FROM pages),
r AS (SELECT regexp_replace(url, '(/[^/]*){2}$', '') AS root, count(*) AS n FROM p WHERE regexp_matches(url, '(/[^/]*){2}$') GROUP BY 1)
SELECT page_id, max_by(root, length(root)) AS root, max_by(n, length(root)) AS n FROM p LEFT JOIN r ON url = root OR starts_with(url, root || '/') GROUP BY 1""")
def nearest_settings(spark, sf_dir):
    """The folder two levels above each page, with its number of pages, is a root; each page's nearest one."""
    p = read(spark, sf_dir, "pages").select("page_id", E.folder(F.col("url")).alias("url"))
    roots = p.where(F.col("url").rlike("(/[^/]*){2}$")).groupBy(F.regexp_replace("url", "(/[^/]*){2}$", "").alias("root")).agg(F.count(F.lit(1)).alias("n"))
    return E.nearest(p, roots, "url").select("page_id", "found.root", "found.n")


# --- events as a stream


@query(RULE_SQL + "SELECT rule_id, count(*) AS n FROM f GROUP BY 1")
def trace_of_stream(spark, sf_dir):
    """documents as payloads that arrive as a stream, decided and added to a trace, which is read back."""
    path = scratch(spark, "events")
    d = read(spark, sf_dir, "documents").where("text <> ''")
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".tsx").when(F.col("lang") == "de", ".rs").otherwise(".md")
    given = F.struct(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("file_path"), F.col("text").alias("content"))
    d.select(F.to_json(F.struct(F.lit("PreToolUse").alias("hook_event_name"), F.lit("Write").alias("tool_name"), given.alias("tool_input")))).write.text(f"{path}/in")
    decided = evaluate_events(stream_events(spark, f"{path}/in"), regex_rules=RULES, limits=None)
    trace_stream(decided, f"{path}/trace", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = T.exploded(T.entries_of(read_trace(spark, f"{path}/trace").select(F.col("batch").alias("ord"), "value")))
    return found.where(F.col("rule_id").isin([r.rule_id for r in RULES])).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# --- state


@query("""WITH r AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS path, epoch(ts)::BIGINT AS at, event_type = 'view' AS f, floor(epoch(ts))::BIGINT AS s FROM events)
SELECT event_id, coalesce(max(f::INT) OVER (PARTITION BY user_id, path ORDER BY s RANGE BETWEEN 360000 PRECEDING AND 1 PRECEDING), 0) = 1 OR coalesce(max(f::INT) OVER (PARTITION BY user_id, path, s ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS known FROM r""")
def full_read_ttl(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("session"), F.get_json_object("props", "$.k").alias("path"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") == "view").alias("full"))
    return S.known_full_reads(e, ttl=360000).select(F.col("ord").alias("event_id"), "known")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1")
def reminder_once(spark, sf_dir):
    return S.first_of(read(spark, sf_dir, "events").where("event_type = 'click'"), ["user_id"], "event_id").select("user_id", "event_id")


@query("""WITH w AS (SELECT event_id, user_id, event_type = 'purchase' AS r, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events WHERE event_type IN ('purchase', 'error'))
SELECT event_id, n, n >= 3 AS escalates FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS n FROM w WHERE NOT r)""")
def repeat_counter(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')").withColumn("fixed", F.col("event_type") == "purchase")
    return S.repeat_counts(e, ["user_id"], "event_id", "fixed").select("event_id", F.col("n").cast("long").alias("n"), "escalates")


# --- enrichment


@query(r"""WITH k AS (SELECT value, min(item_id) AS line FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+', 0)) AS value FROM benchmark) GROUP BY 1),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+', 0)) AS value FROM documents)
SELECT doc_id, count(*) AS words, count(line) AS known, min(line) AS first_line, min(CASE WHEN line IS NOT NULL THEN upper(left(value, 48)) END) AS first_name FROM w LEFT JOIN k USING (value) GROUP BY 1""")
def constant_lookup(spark, sf_dir):
    """Every word of a document as a literal, looked up among the constants that the words of the benchmark are."""
    words = lambda c: F.explode(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)))
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("line"), words("text").alias("text"))
    facts = b.select(F.lit("pkg/constants.py").alias("path"), F.lit("constant").alias("kind"), P.constant_name(F.col("text")).alias("name"), "line", "text")
    d = read(spark, sf_dir, "documents").select("doc_id", words("text").alias("text")).distinct().join(L.constants(facts), "text", "left")
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count("defined_at").alias("known"), F.min("defined_at").cast("long").alias("first_line"), F.min("constant").alias("first_name"))


@query(r"""WITH w AS (SELECT page_id, upper(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS w FROM pages)
SELECT page_id, CASE WHEN w = '' THEN 'EXTRACTED_STRING' WHEN regexp_matches(w, '^[0-9]') THEN left('STR_' || w, 48) ELSE left(w, 48) END AS name FROM w""")
def suggest_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", P.constant_name(F.col("url")).alias("name"))


# --- payloads, end to end


def payloads(spark, sf_dir, table: str, key: str, platform: str, **parts) -> DataFrame:
    """(ord, platform, raw): rows of a table as JSON payloads."""
    t = read(spark, sf_dir, table)
    return t.select(F.col(key).alias("ord"), F.lit(platform).alias("platform"), F.to_json(F.struct(*(v.alias(k) for k, v in parts.items()))).alias("raw"))


@query(f"SELECT doc_id, {DOC_PATH} AS path, length(text) AS chars, 'tool_input' AS source FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]')")
def content_targets(spark, sf_dir):
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".tsx").when(F.col("lang") == "de", ".rs").otherwise(".md")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end)
    raw = payloads(spark, sf_dir, "documents", "doc_id", "claude", hook_event_name=F.lit("PreToolUse"), tool_name=F.lit("Write"), tool_input=F.struct(path.alias("file_path"), F.col("text").alias("content")))
    return canonical(raw).select(F.col("ord").alias("doc_id"), F.explode("targets").alias("t")).select("doc_id", "t.path", F.length("t.content").cast("long").alias("chars"), "t.source")


@query(f"""WITH c AS (SELECT page_id, regexp_extract_all('cat src/p' || page_id || '.py && rm ./docs/d' || page_id % 7 || '.md src/p' || page_id || '.py', '{P.SHELL_PATH}', 0) AS l FROM pages)
SELECT page_id, 'top/' || page_id || '.txt,' || array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS paths FROM c""")
def candidate_paths(spark, sf_dir):
    no = F.col("page_id").cast("string")
    command = F.concat(F.lit("cat src/p"), no, F.lit(".py && rm ./docs/d"), (F.col("page_id") % 7).cast("string"), F.lit(".md src/p"), no, F.lit(".py"))
    raw = payloads(spark, sf_dir, "pages", "page_id", "codex", hook_event_name=F.lit("PreToolUse"), tool_name=F.lit("Bash"), file_path=F.concat(F.lit("top/"), no, F.lit(".txt")), tool_input=F.struct(command.alias("command")))
    return canonical(raw).select(F.col("ord").alias("page_id"), F.array_join("paths", ",").alias("paths"))


@query("""SELECT page_id, unnest(['old' || page_id || '.py', 'new.py']) AS path, url || chr(10) || 'end' AS content, 'patch' AS source FROM pages""")
def patch_text(spark, sf_dir):
    no = F.col("page_id").cast("string")
    patch = F.concat(F.lit("--- a/old"), no, F.lit(".py\n+++ b/new.py\n@@ -1 +1,2 @@\n-gone\n+"), "url", F.lit("\n same\n+end\n--- /dev/null\n"))
    raw = payloads(spark, sf_dir, "pages", "page_id", "claude", hook_event_name=F.lit("PreToolUse"), tool_name=F.lit("apply_patch"), tool_input=F.struct(patch.alias("patchText")))
    return canonical(raw).select(F.col("ord").alias("page_id"), F.explode("targets").alias("t")).select("page_id", "t.path", "t.content", "t.source")


@query("SELECT conv_id * 1000 + turn AS ord, CASE role WHEN 'assistant' THEN 'PostToolUse' WHEN 'user' THEN 'PreToolUse' ELSE 'Stop' END AS event, CASE role WHEN 'system' THEN '' ELSE 'Bash' END AS tool, CASE role WHEN 'system' THEN '' ELSE 'ls' END AS command, 's' || conv_id AS session FROM conversations")
def dotted_events(spark, sf_dir):
    name = F.when(F.col("role") == "assistant", "tool.execute.after").when(F.col("role") == "user", "tool.execute.before").otherwise("session.idle")
    tool = F.when(F.col("role") != "system", "bash")
    t = read(spark, sf_dir, "conversations").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    body = F.struct(name.alias("hook_event_name"), tool.alias("tool_name"), F.when(tool.isNotNull(), F.struct(F.lit("ls").alias("command"))).alias("tool_input"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"))
    return canonical(t.select("ord", F.lit("opencode").alias("platform"), F.to_json(body).alias("raw"))).select("ord", "event", "tool", "command", "session")


def labelled_findings(spark, sf_dir, platform: str, event: str) -> DataFrame:
    """labels as events: toxic ones are blocked by a critical finding, bad ones denied, all others get context."""
    label = read(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, finding("T-1", "CRITICAL", "block", "stop here")).when(F.col("quality") == 0, finding("Q-1", "HIGH", "deny", "not good")).otherwise(finding("C-1", "LOW", None, None, "fine"))
    return D.render(D.decide(label.select("doc_id", F.lit(platform).alias("platform"), F.lit(event).alias("event"), F.array(kind).alias("findings"))))


def members(df: DataFrame, *paths: str) -> DataFrame:
    return df.select("doc_id", *(F.get_json_object("output", f"$.{p}").alias(p.replace(".", "_")) for p in paths))


_KIND = "CASE WHEN toxic = 1 THEN {} WHEN quality = 0 THEN {} ELSE {} END"


@query("SELECT doc_id, " + _KIND.format("'false'", "NULL", "NULL") + ' AS "continue", ' + _KIND.format("'[T-1 | CRITICAL] stop here'", "NULL", "NULL") + ' AS "stopReason", ' + _KIND.format("NULL", "'block'", "NULL") + " AS decision, " + _KIND.format("NULL", "'[Q-1 | HIGH] not good'", "NULL") + ' AS reason, ' + _KIND.format("NULL", "NULL", "'fine'") + ' AS "hookSpecificOutput_additionalContext" FROM labels')
def render_codex(spark, sf_dir):
    return members(labelled_findings(spark, sf_dir, "codex", "PostToolUse"), "continue", "stopReason", "decision", "reason", "hookSpecificOutput.additionalContext")


@query("SELECT doc_id, " + _KIND.format("'block'", "'block'", "'context'") + " AS action, " + _KIND.format("'[T-1 | CRITICAL] stop here'", "'[Q-1 | HIGH] not good'", "NULL") + " AS reason, " + _KIND.format("NULL", "NULL", "'fine'") + " AS context FROM labels")
def render_opencode(spark, sf_dir):
    return members(labelled_findings(spark, sf_dir, "opencode", "PreToolUse"), "action", "reason", "context")


@query("SELECT doc_id, " + _KIND.format("'block'", "'block'", "NULL") + " AS decision, " + _KIND.format("'[T-1 | CRITICAL] stop here'", "'[Q-1 | HIGH] not good'", "NULL") + " AS reason, " + _KIND.format("NULL", "NULL", "'fine'") + ' AS "systemMessage" FROM labels')
def render_stop(spark, sf_dir):
    return members(labelled_findings(spark, sf_dir, "claude", "Stop"), "decision", "reason", "systemMessage")


@query("SELECT doc_id, " + _KIND.format("NULL", "'deny'", "NULL") + ' AS "hookSpecificOutput_decision_behavior", ' + _KIND.format("NULL", "'[Q-1 | HIGH] not good'", "NULL") + ' AS "hookSpecificOutput_decision_message" FROM labels')
def render_request(spark, sf_dir):
    return members(labelled_findings(spark, sf_dir, "claude", "PermissionRequest"), "hookSpecificOutput.decision.behavior", "hookSpecificOutput.decision.message")


@query("SELECT 'TOOL-1' AS rule_id, count(*) FILTER (doc_id % 2 = 0) AS n FROM documents UNION ALL SELECT 'PROMPT-1', count(*) FILTER (doc_id % 3 = 0) FROM documents UNION ALL SELECT 'CMD-1', count(*) FILTER (doc_id % 2 = 1 AND doc_id % 5 = 0) FROM documents")
def rule_targets(spark, sf_dir):
    """Rules over commands and prompts, and one for a tool only."""
    no = F.col("doc_id")
    e = read(spark, sf_dir, "documents").select("doc_id", F.lit("claude").alias("platform"), F.when(no % 3 == 0, "UserPromptSubmit").otherwise("PreToolUse").alias("event"), F.when(no % 2 == 0, "Write").otherwise("Bash").alias("tool"))
    none = F.array().cast("array<struct<path:string,content:string,source:string>>")
    e = e.withColumns({"targets": none, "paths": F.array(F.lit("a.py")), "command": F.when((no % 2 == 1) & (no % 5 == 0), "git push --force").otherwise(""), "prompt": F.when(no % 3 == 0, "please delete all").otherwise(""), "mode": F.lit("repo_strict"), "skipped": F.lit(False)})
    both = ["PreToolUse", "UserPromptSubmit"]
    rules = [RegexRule("TOOL-1", both, "path", [r"\.py$"], tool_matchers=["Write|Edit"]), RegexRule("CMD-1", both, "command", [r"push\s+--force"]), RegexRule("PROMPT-1", both, "prompt", ["DELETE"], case_sensitive=False, action="ask")]
    return evaluate(e, [regex_rule(r) for r in rules]).select(F.explode("findings").alias("f")).groupBy("f.rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'GOOD-1' AS rule_id, count(*) FILTER (starts_with(text, 'T')) AS n, count(*) AS failed FROM documents")
def rule_isolation(spark, sf_dir):
    """A rule whose pattern does not compile is an error of its events and stops no other."""
    target = F.struct(F.lit("a.py").alias("path"), F.col("text").alias("content"), F.lit("tool_input").alias("source"))
    e = read(spark, sf_dir, "documents").select("doc_id", F.lit("PreToolUse").alias("event"), F.lit("Write").alias("tool"), F.array(target).alias("targets"), F.array(F.lit("a.py")).alias("paths"), F.lit("").alias("command"), F.lit("").alias("prompt"), F.lit("repo_strict").alias("mode"), F.lit(False).alias("skipped"))
    out = evaluate(e, [regex_rule(RegexRule("BAD-1", ["PreToolUse"], "content", ["(open"])), regex_rule(RegexRule("GOOD-1", ["PreToolUse"], "content", ["^T"], multiline=False))])
    return out.agg(F.lit("GOOD-1").alias("rule_id"), F.count_if(F.exists("findings", lambda f: f.rule_id == "GOOD-1")).alias("n"), F.count_if(F.exists("errors", lambda x: x.startswith("BAD-1"))).alias("failed"))


# --- syntax trees: modules whose facts follow from the number of the document


def modules(spark, sf_dir) -> DataFrame:
    """documents as Python files: a function of doc_id % 8 parameters and doc_id % 7 nested ifs, then every fifth a handler
    that keeps silent, and on top of every sixth an import of Any."""
    no = F.col("doc_id").cast("int")
    lines = lambda n, f: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f), "\n")).otherwise("")
    params = F.array_join(F.slice(F.array(*(F.lit(x) for x in "abcdefgh")), F.lit(1), no % 8), ", ")
    nested = F.when(no % 7 > 0, F.concat(lines(no % 7, lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit("if go():"))), F.lit("\n"))).otherwise("")
    source = F.concat(F.when(no % 6 == 0, "from typing import Any\n").otherwise(""), F.lit("def f"), no.cast("string"), F.lit("("), params, F.lit("):\n"), nested, F.repeat(F.lit("    "), no % 7 + 1), F.lit("return work(1)\n"), F.when(no % 5 == 0, "try:\n    go()\nexcept Exception:\n    pass\n").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/m"), no.cast("string"), F.lit(".py")).alias("path"), source.alias("source"), F.lit(False).alias("is_test"))


@query("""WITH d AS (SELECT doc_id, 'src/m' || doc_id || '.py' AS path, doc_id % 8 AS k, doc_id % 7 AS depth, (doc_id % 6 = 0)::INT AS top FROM documents)
SELECT 'too-many-params' AS rule, path, 'f' || doc_id AS identifier, 'params=' || k AS detail FROM d WHERE k > 4
UNION ALL SELECT 'deep-nesting', path, 'f' || doc_id, 'depth=' || depth FROM d WHERE depth > 4
UNION ALL SELECT 'banned-any', path, 'import-Any', 'line 1' FROM d WHERE top = 1
UNION ALL SELECT 'silent-except', path, '<module>', 'line ' || (top + depth + 5) || ': pass' FROM d WHERE doc_id % 5 = 0""")
def lint_rules(spark, sf_dir):
    return L.simple_violations(L.ast_facts(modules(spark, sf_dir)))


@query("""WITH d AS (SELECT doc_id % 7 AS depth, count(*) OVER (PARTITION BY doc_id % 7) AS n FROM documents)
SELECT 'semantic-clone' AS rule, count(*) AS n FROM d WHERE depth >= 4 AND n > 1 UNION ALL SELECT 'duplicate-call-sequence', count(*) FROM d WHERE depth >= 2 AND n > 1""")
def lint_clones(spark, sf_dir):
    return L.duplicate_violations(L.ast_facts(modules(spark, sf_dir))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, doc_id % 8 AS k, doc_id % 7 AS depth FROM documents)
SELECT doc_id, 'PY-CODE-009' AS rule_id, 'deny' AS decision FROM d WHERE k > 4 UNION ALL SELECT doc_id, 'PY-CODE-011', 'deny' FROM d WHERE depth > 4 UNION ALL SELECT doc_id, 'PY-CODE-013', 'deny' FROM d WHERE depth = 0""")
def tree_rules(spark, sf_dir):
    """Syntax-tree rules from raw events to the decisions of their findings."""
    raw = modules(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.lit("claude").alias("platform"), F.to_json(F.struct(F.lit("PreToolUse").alias("hook_event_name"), F.lit("Write").alias("tool_name"), F.struct(F.col("path").alias("file_path"), F.col("source").alias("content")).alias("tool_input"))).alias("raw"))
    return evaluate_events(raw).select(F.col("ord").alias("doc_id"), F.explode("findings").alias("f")).where("f.rule_id LIKE 'PY-CODE-%'").select("doc_id", "f.rule_id", "f.decision")


@query("""WITH d AS (SELECT doc_id FROM documents) SELECT doc_id, 'LG-STATE-001' AS rule_id FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'LG-NODE-001' FROM d WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'LG-API-001' FROM d WHERE doc_id % 5 = 0""")
def graph_rules(spark, sf_dir):
    no = F.col("doc_id")
    source = F.concat(F.lit("from langgraph.graph import StateGraph\n"), F.when(no % 3 == 0, "class S(TypedDict):\n    items: list[str]\n    name: str\n").otherwise(""), F.when(no % 4 == 0, "def node(state):\n    state['x'] = 1\n    return {}\n").otherwise("# state['x'] = 1\n"), F.when(no % 5 == 0, "g.set_entry_point('a')\n").otherwise(""))
    body = F.to_json(F.struct(F.lit("PostToolUse").alias("hook_event_name"), F.lit("Edit").alias("tool_name"), F.struct(F.lit("g.py").alias("file_path")).alias("tool_input")))
    raw = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.lit("claude").alias("platform"), body.alias("raw"), F.array(F.struct(F.lit("g.py").alias("path"), source.alias("source"))).alias("files"))
    return evaluate_events(raw).select(F.col("ord").alias("doc_id"), F.explode("findings").alias("f")).where("f.rule_id LIKE 'LG-%'").select("doc_id", "f.rule_id")


@query("""WITH r AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS s, event_type = 'view' AS f FROM events WHERE event_type IN ('view', 'click')),
k AS (SELECT event_id, f, coalesce(max(f::INT) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING), 0) = 1 OR coalesce(max(f::INT) OVER (PARTITION BY user_id, s ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS known FROM r)
SELECT event_id, NOT f AND NOT known AS denied FROM k""")
def full_read_rule(spark, sf_dir):
    """Views as full reads and clicks as partial ones of one file in their sessions: the rule with the state it needs."""
    e = read(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    given = F.struct(F.lit("a.py").alias("file_path"), F.when(F.col("event_type") == "click", 3).alias("offset"))
    raw = e.select(F.col("event_id").alias("ord"), F.lit("claude").alias("platform"), F.to_json(F.struct(F.lit("PreToolUse").alias("hook_event_name"), F.lit("Read").alias("tool_name"), F.col("user_id").cast("string").alias("session_id"), given.alias("tool_input"))).alias("raw"), F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("at"))  # the nearest second, as the SQL has it
    out = evaluate_events(full_reads(raw, F.col("at")).drop("at"), limits=None)
    return out.select(F.col("ord").alias("event_id"), F.exists("findings", lambda f: f.rule_id == "BUILTIN-ENFORCE-FULL-READ").alias("denied"))


# --- rule rows: each case of the rulebook as the payload of some documents


def _case_sql() -> str:
    rows = ", ".join(f"({n}, '{rule}')" for n, (rule, _) in enumerate(RULE_CASES))
    return f"WITH c(k, rule_id) AS (VALUES {rows}) SELECT rule_id, count(*) AS n FROM documents JOIN c ON doc_id % {len(RULE_CASES)} = k GROUP BY 1"


@query(_case_sql())
def rulebook(spark, sf_dir):
    """The rule that a case is for must be among the findings of every document that carries the case."""
    cases = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(json.dumps({"hook_event_name": "PreToolUse"} | body)).alias("raw")) for rule, body in RULE_CASES))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.element_at(cases, (F.col("doc_id") % len(RULE_CASES) + 1).cast("int")).alias("c"))
    out = evaluate_events(d.select("ord", F.lit("claude").alias("platform"), "c.raw"), rules_of.POLICY, rules_of.RULES, limits=None)
    return out.select("ord", "findings").join(d.select("ord", "c.rule"), "ord").where(F.exists("findings", lambda f: f.rule_id == F.col("rule"))).groupBy(F.col("rule").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


# --- syntax-tree facts: no SQL can make them; the tests compare them with hand-written rows


@query()
def ast_facts(spark, sf_dir):
    return lint_documents(read(spark, sf_dir, "documents"))
