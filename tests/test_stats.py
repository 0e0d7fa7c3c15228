"""Log statistics on hand-written lines."""

import json

from pyspark.sql import functions as F

from lintel.operators import stats as T
from lintel.sources.logs import append_log, read_log


def line(session, findings=(), **kw):
    return json.dumps({"session_id": session, "event_name": "PreToolUse", "tool_name": "Bash", "timestamp": "2024-01-02T03:04:05+00:00", "findings": list(findings)} | kw)


def deny(rule="R", **kw):
    return {"rule_id": rule, "decision": "deny", "severity": "HIGH", "message": "m"} | kw


def table(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "ord long, value string")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(F.desc("n"), "first").collect()]


def test_scan(spark):
    e = T.entries_of(table(spark, "", "{bad", "[]", "{}", "3", '{"a": 1}', line(None, event_name=None, tool_name=""), line("s", tool_name=None, timestamp=1.0)))
    got = [(r.session, r.event, r.tool, r.ts) for r in e.orderBy("ord").collect()]
    assert got == [("unknown", "unknown", "(none)", ""), ("None", "None", "(none)", "2024-01-02T03:04:05+00:00"), ("s", "PreToolUse", "None", "1.0")]


def test_cutoff(spark):
    now = F.lit("2024-01-10T00:00:00Z").cast("timestamp")
    stamps = ["2024-01-09T00:00:00+00:00", "2024-01-02T00:00:00+00:00", "2024-01-02T00:00:00", "not-a-date", "2024-01-03T00:00:00+00:00"]
    e = T.entries_of(table(spark, *(line("s", timestamp=t) for t in stamps)), days=7, now=now)
    assert [r.ts for r in e.orderBy("ord").collect()] == [stamps[0], *stamps[2:]]


def test_report(spark):
    e = T.entries_of(
        table(
            spark, line("fixture-1", [deny()]), line("abcdefgh1", [deny(), deny(), deny("Q", metadata={"path": "p", "hits": ["h", 3]})]), line("abcdefgh2", [deny()] * 3), line("x"), line("x", [{"rule_id": "C", "decision": None}]),
            line("x", [{"rule_id": "C", "decision": "context", "severity": "LOW"}]), line("x", [{"rule_id": "N", "decision": 5}]), line("x", [3, {}]),
        )
    ).cache()
    r = T.report(e)
    assert r["totals"].first().asDict() == {"total_events": 8, "fixture_filtered": 1, "sessions": 3}
    assert rows(r["by_decision"], "decision", "n") == [("deny", 6), ("allow", 3), ("context", 1)]
    assert rows(r["top_rules_denied"], "rule_id", "n") == [("R", 5), ("Q", 1)]
    assert rows(r["top_files_denied"], "file", "n") == [("p", 1), ("h", 1)] or {x.file for x in r["top_files_denied"].collect()} == {"p", "h"}
    assert [(x.label, x.n) for x in r["retry_patterns"].collect()] == [("R (session abcdefgh...)", 3)]
    assert r["rule_examples"].groupBy("rule_id").count().orderBy("rule_id").collect() == [("Q", 1), ("R", 3)]
    assert [tuple(x) for x in r["daily_counts"].collect()] == [("2024-01-02", 7)]


def test_log_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "z int, a string")
    append_log(df, str(tmp_path / "log"))
    append_log(df.limit(1), str(tmp_path / "log"))
    back = read_log(spark, str(tmp_path / "log"))
    assert back.count() == 3 and {r.value for r in back.collect()} == {'{"a":"b","z":2}', '{"a":"a","z":1}'}
    assert T.counted(back, "value").count() == 2


def test_summary_equals_the_report_from_one_scan(spark, tmp_path):
    many = [line(f"session{i % 4}", [deny(f"R{i % 3}", metadata={"path": f"p{i % 5}", "hits": ["h", 3, f"p{i % 2}"]}, message=f"m{i}"), {"rule_id": "C", "decision": (None, "ask", 5)[i % 3], "severity": "LOW"}], timestamp=f"2024-01-{1 + i % 20:02d}T00") for i in range(90)]
    many += [line("fixture-1", [deny()]), line("test-2"), line("x"), line("x", [{"rule_id": "N", "decision": 5}]), line("y", timestamp=""), line("y", [3, {}])]
    e = T.entries_of(table(spark, *many))
    assert T.summary(e)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    T.summary(e).write.parquet(str(tmp_path / "summary"))
    got, want = T.unpacked(spark.read.parquet(str(tmp_path / "summary"))), T.report(e)
    keys = {"by_event": "event", "top_tools": "tool", "by_decision": "decision", "by_severity": "severity", "top_rules_denied": "rule_id"}
    for name, key in keys.items():
        assert rows(got[name], key, "n") == rows(want[name], key, "n"), name
    for name in ("totals", "daily_counts", "date_range"):
        assert [tuple(r) for r in got[name].collect()] == [tuple(r) for r in want[name].collect()], name
    assert [(r.label, r.n) for r in got["retry_patterns"].collect()] == [(r.label, r.n) for r in want["retry_patterns"].collect()]
    assert {(r.file, r.n) for r in got["top_files_denied"].collect()} == {(r.file, r.n) for r in want["top_files_denied"].collect()}
    assert rows(got["by_rule"], "rule_id", "n")[0] == ("C", 90) and [r.example for r in got["top_rules_denied"].collect()] == ["m0", "m1", "m2"]
    lines = [r.line for r in T.text_report(got, home="p").orderBy("section", "place", "part").collect()]
    at = lines.index("--- Decisions ---")
    assert lines[:4] == ["=" * 70, "HOOK ACTIVITY REPORT", "=" * 70, ""] and lines[4:8] == ["Date range: 2024-01-01 to 2024-01-20", "Total hook events: 96", "Fixture/test sessions filtered: 2", "Unique sessions: 6"]
    assert lines[at + 1] == "  deny             90  (93.8%)" and "  R0                           30" in lines and "    └─ e.g. m0" in lines and "  (none detected)" not in lines and "    60  h" not in lines
    T.summary(e.limit(0)).write.parquet(str(tmp_path / "none"))
    empty = [r.line for r in T.text_report(T.unpacked(spark.read.parquet(str(tmp_path / "none")))).orderBy("section", "place", "part").collect()]
    assert "Date range: unknown" in empty and "  (none detected)" in empty and "Total hook events: 0" in empty


def test_one_decimal(spark):
    values = [n / d * 100 for n, d in ((6005, 10000), (1, 3), (1, 8), (3, 8), (1, 16), (0, 5), (1, 1), (9995, 10000), (99999, 100000), (1235, 10000), (5, 10000), (15, 10000), *((n, 4000) for n in range(1, 4000, 7)))]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", T.one_decimal(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [f"{v:.1f}" for v in values]
