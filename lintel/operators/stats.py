"""Statistics of activity logs.

`entries` are log rows with `ord` (their place in the log), session, event, tool, ts (text) and findings, an array of
(rule_id, severity, decision, message, path, hits, has_decision). Ties in counts go to what came first in the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V

FIXTURE_PREFIXES = ("fixture-", "test-")


def entries_of(lines: DataFrame, days: int | None = None, now: Column | None = None) -> DataFrame:
    """(ord, value: a JSON line) -> entries. Blank and malformed lines, non-objects and empty objects are dropped.

    With `days`, entries stamped before now - days go; stamps without an offset, or that are no stamps, stay."""
    e = lines.select("ord", V.parse(F.col("value")).alias("v")).where(V.is_object(F.col("v")) & (V.kind(F.col("v")) != "OBJECT<>"))
    v = F.col("v")
    if days is not None:
        stamp = V.text(v, "timestamp")
        at = F.when(stamp.rlike(r"(?:Z|[+-]\d\d:?\d\d)\z"), F.try_to_timestamp(stamp))
        e = e.where(F.coalesce(at >= (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days)), F.lit(True)))

    def finding(f: Column) -> Column:
        meta = V.member(f, "metadata")
        hits = F.array_compact(F.transform(V.members(meta, "hits"), lambda h: F.when(V.kind(h) == "STRING", F.try_variant_get(h, "$", "string"))))
        return F.struct(
            V.python_str(f, "rule_id", "unknown").alias("rule_id"), V.python_str(f, "severity", "unknown").alias("severity"), V.text(f, "decision").alias("decision"), V.python_str(f, "message", "").alias("message"),
            V.text(meta, "path").alias("path"), hits.alias("hits"), (V.has(f, "decision") & (V.kind(V.member(f, "decision")) != "VOID")).alias("has_decision"),
        )

    found = F.filter(V.members(v, "findings"), lambda f: V.is_object(f) & (V.kind(f) != "OBJECT<>"))
    tool = V.python_str(v, "tool_name", "")
    return e.select("ord", V.python_str(v, "session_id", "unknown").alias("session"), V.python_str(v, "event_name", "unknown").alias("event"), F.when(tool == "", "(none)").otherwise(tool).alias("tool"), V.python_str(v, "timestamp", "").alias("ts"), F.transform(found, finding).alias("findings"))


def counted(rows: DataFrame, *keys: str, k: int | None = None) -> DataFrame:
    """(keys, n) by count, ties by first place; the top k if given. Partial counts are made before the shuffle."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return out if k is None else out.orderBy(F.desc("n"), "first").limit(k)


def is_fixture(session: Column) -> Column:
    return session.startswith(FIXTURE_PREFIXES[0]) | session.startswith(FIXTURE_PREFIXES[1])


def exploded(entries: DataFrame) -> DataFrame:
    """One row per finding; `ord` becomes (entry, place)."""
    return entries.select("ord", "session", "tool", "ts", F.posexplode("findings").alias("pos", "f")).select(F.struct("ord", "pos").alias("ord"), "session", "tool", "ts", "f.*")


def decisions(entries: DataFrame) -> DataFrame:
    """String decisions by finding, and an `allow` for every entry none of whose findings decides."""
    by_finding = exploded(entries).where("decision IS NOT NULL").select("ord", "decision")
    silent = entries.where(~F.exists("findings", lambda f: f.has_decision)).select(F.struct("ord", F.lit(1 << 30).alias("pos")).alias("ord"), F.lit("allow").alias("decision"))
    return counted(by_finding.unionByName(silent), "decision")


def denied(entries: DataFrame) -> DataFrame:
    return exploded(entries).where("decision = 'deny'")


def denied_files(entries: DataFrame, k: int = 15) -> DataFrame:
    rows = denied(entries).select("ord", F.explode(F.array_compact(F.concat(F.array("path"), F.coalesce("hits", F.array().cast("array<string>"))))).alias("file"))
    return counted(rows, "file", k=k)


def first_examples(rows: DataFrame, key: str, order: str, k: int = 3) -> DataFrame:
    """The first k rows of each key. The ranking drops what is past k before it shuffles."""
    return rows.selectExpr("*", f"row_number() OVER (PARTITION BY `{key}` ORDER BY `{order}`) AS nth").where(F.col("nth") <= k)


def retry_patterns(denies: DataFrame, k: int | None = 15, prefix: int = 8, suffix: str = "...") -> DataFrame:
    """(session, rule_id, ord) -> (label, n): rules denied twice or more in a session. Of sessions that share a label
    the one seen last counts; labels rank by count, ties by the first session's place."""
    per = denies.groupBy("session", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))
    seen = denies.groupBy("session").agg(F.min("ord").alias("session_seen"))
    rows = per.where("n >= 2").join(seen, "session").withColumn("label", F.concat("rule_id", F.lit(" (session "), F.left("session", F.lit(prefix)), F.lit(suffix + ")")))
    out = rows.groupBy("label").agg(F.max_by("n", "session_seen").alias("n"), F.min(F.struct("session_seen", "seen")).alias("first"))
    return (out if k is None else out.orderBy(F.desc("n"), "first").limit(k)).select("label", "n")


def report(entries: DataFrame) -> dict[str, DataFrame]:
    """All tables of the report, from one scan of the log kept by the caller's persist()."""
    real = entries.where(~is_fixture(F.col("session")))
    days = real.where("ts <> ''").withColumn("day", F.left("ts", F.lit(10)))
    return {
        "totals": entries.agg(F.count(F.lit(1)).alias("total_events"), F.count_if(is_fixture(F.col("session"))).alias("fixture_filtered"), F.count_distinct(F.when(~is_fixture(F.col("session")), F.col("session"))).alias("sessions")),
        "by_event": counted(real, "event"), "top_tools": counted(real, "tool", k=10), "by_decision": decisions(real), "by_severity": counted(exploded(real), "severity"),
        "top_rules_denied": counted(denied(real), "rule_id", k=20), "top_files_denied": denied_files(real), "rule_examples": first_examples(denied(real), "rule_id", "ord"), "retry_patterns": retry_patterns(denied(real)),
        "daily_counts": days.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy("day"), "date_range": days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")),
    }


def daily_bars(daily: DataFrame, last: int = 14, per: int = 50, most: int = 60) -> DataFrame:
    """The last days with a bar of one block per `per` events."""
    return daily.orderBy(F.desc("day")).limit(last).withColumn("bar", F.repeat(F.lit("█"), F.least((F.col("n") / per).cast("int"), F.lit(most)))).orderBy("day")


# --- the whole report from one pass


def groupings(entries: DataFrame) -> DataFrame:
    """(grouping, key, other, at, text): a row for each grouping that an entry or a finding of it counts in. These are grouping
    sets without the rows that no set wants; one aggregation serves them all."""
    shape = "array<struct<grouping:string,key:string,other:string,at:struct<ord:bigint,pos:int,part:int>,text:string>>"
    none = F.array().cast(shape)

    def row(grouping: str, key: Column | str, pos: Column | int = -1, part: Column | int = 0, other: Column | None = None, text: Column | None = None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        at = F.struct(F.col("ord").cast("long").alias("ord"), lit(pos).cast("int").alias("pos"), lit(part).cast("int").alias("part"))
        blank = F.lit(None).cast("string")
        return F.struct(F.lit(grouping).alias("grouping"), lit(key).alias("key"), (blank if other is None else other).alias("other"), at.alias("at"), (blank if text is None else text).alias("text"))

    def of_finding(f: Column, pos: Column) -> Column:
        files = F.array_compact(F.concat(F.array(f.path), F.coalesce(f.hits, F.array().cast("array<string>"))))
        always = F.array(row("severity", f.severity, pos), row("rule", f.rule_id, pos))
        decided = F.when(f.decision.isNotNull(), F.array(row("decision", f.decision, pos))).otherwise(none)
        deny = F.concat(F.array(row("denied_rule", f.rule_id, pos, text=f.message), row("denied", F.col("session"), pos, other=f.rule_id)), F.transform(files, lambda x, i: row("denied_file", x, pos, i)))
        return F.concat(always.cast(shape), decided.cast(shape), F.when(f.decision == "deny", deny.cast(shape)).otherwise(none))

    fixture = is_fixture(F.col("session"))
    all_ = F.array(row("entry", F.when(fixture, "fixture").otherwise("real")))
    real = F.array(row("event", F.col("event")), row("tool", F.col("tool")), row("session", F.col("session")))
    day = F.when(F.col("ts") != "", F.array(row("day", F.left("ts", F.lit(10))))).otherwise(none)
    silent = F.when(~F.exists("findings", lambda f: f.has_decision), F.array(row("decision", "allow", 1 << 30))).otherwise(none)
    own = F.concat(real.cast(shape), day.cast(shape), silent.cast(shape), F.flatten(F.transform("findings", of_finding)))
    return entries.select(F.explode(F.concat(all_.cast(shape), F.when(fixture, none).otherwise(own))).alias("g")).select("g.*")


def summary(entries: DataFrame) -> DataFrame:
    """(grouping, key, other, n, first, example) of all that the report shows, from one scan and one shuffle of partial counts.
    example: the text of a group's first row."""
    return groupings(entries).groupBy("grouping", "key", "other").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min_by("text", "at").alias("example"))


def unpacked(done: DataFrame) -> dict[str, DataFrame]:
    """The tables of report() from a summary that is kept, with `example` in place of three of each rule."""
    of = lambda grouping, name: done.where(F.col("grouping") == grouping).select(F.col("key").alias(name), "n", "first", "example")
    top = lambda df, k: df.orderBy(F.desc("n"), "first").limit(k)
    total = lambda grouping, key=None: F.coalesce(F.sum(F.when((F.col("grouping") == grouping) & (F.lit(True) if key is None else F.col("key") == key), F.col("n"))), F.lit(0))
    denied_ = done.where("grouping = 'denied'").select(F.col("key").alias("session"), F.col("other").alias("rule_id"), "n", F.col("first").alias("seen"))
    seen = denied_.groupBy("session").agg(F.min("seen").alias("session_seen"))
    label = F.concat("rule_id", F.lit(" (session "), F.left("session", F.lit(8)), F.lit("...)"))
    retries = denied_.where("n >= 2").join(seen, "session").groupBy(label.alias("label")).agg(F.max_by("n", "session_seen").alias("n"), F.min(F.struct("session_seen", "seen")).alias("first"))
    days = of("day", "day").select("day", "n")
    return {
        "totals": done.agg(total("entry").alias("total_events"), total("entry", "fixture").alias("fixture_filtered"), F.count_if(F.col("grouping") == "session").alias("sessions")),
        "by_event": of("event", "event"), "top_tools": top(of("tool", "tool"), 10), "by_decision": of("decision", "decision"), "by_severity": of("severity", "severity"), "by_rule": of("rule", "rule_id"),
        "top_rules_denied": top(of("denied_rule", "rule_id"), 20), "top_files_denied": top(of("denied_file", "file"), 15), "retry_patterns": top(retries, 15),
        "daily_counts": days.orderBy("day"), "date_range": days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")),
    }


def one_decimal(x: Column) -> Column:
    """Text of a number from 0 on, rounded as the binary number it is, halves to even; the engine's own formats round the
    decimal that it prints as."""
    part = x - F.floor(x)
    bits = 1 << 55  # a part of one is a whole number of them, but for what is too small to count
    scaled = F.when(x < 8, (part * float(2 * bits)).cast("long") * 10)  # in whole numbers
    tenths = F.when(x < 8, F.shiftright(scaled, 56)).otherwise(F.floor(part * 10))  # from 8 on the whole part's bits make room
    beyond = F.when(x < 8, (scaled - tenths * (2 * bits) - bits).cast("double")).otherwise(part * 10 - tenths - 0.5)
    up = (beyond > 0) | ((beyond == 0) & (tenths % 2 == 1))
    whole = F.floor(x) * 10 + tenths + up.cast("int")
    return F.concat(F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string"))


def text_report(tables: dict[str, DataFrame], home: str | None = None) -> DataFrame:
    """(section, place, part, line): the report's lines, in that order."""
    wide = lambda c, n: F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(n) - F.length(c), F.lit(0))))
    count = lambda n: F.lpad(F.format_number("n", 0), F.greatest(F.lit(n), F.length(F.format_number("n", 0))), F.lit(" "))
    ranked = lambda df, *order: df.selectExpr("*", f"row_number() OVER (ORDER BY {', '.join(order)}) AS place")  # noqa: E731  of a few rows, those of the report

    def rows(section: int, df: DataFrame, *lines: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), "place", F.posexplode(F.array_compact(F.array(*lines))).alias("part", "line"))

    def head(section: int, title: str) -> DataFrame:
        return rows(section, totals, F.lit(""), F.lit(f"--- {title} ---"))

    def tail(section: int, df: DataFrame, empty: str | None = None) -> DataFrame:
        some = df.agg(F.count(F.lit(1)).alias("k")).withColumn("place", F.lit(1 << 30))
        return rows(section, some, *([F.when(F.col("k") == 0, f"  {empty}")] if empty else []), F.lit(""))

    totals = tables["totals"].withColumn("place", F.lit(0))
    by_count = ("n DESC", "first")
    top = totals.crossJoin(F.broadcast(tables["date_range"]))  # one row and one row
    span = F.when(F.col("first_day").isNull(), "unknown").otherwise(F.concat("first_day", F.lit(" to "), "last_day"))
    bar = "=" * 70
    filtered = F.when(F.col("fixture_filtered") > 0, F.concat(F.lit("Fixture/test sessions filtered: "), F.format_number("fixture_filtered", 0)))
    out = [rows(0, top, F.lit(bar), F.lit("HOOK ACTIVITY REPORT"), F.lit(bar), F.lit(""), F.concat(F.lit("Date range: "), span), F.concat(F.lit("Total hook events: "), F.format_number("total_events", 0)), filtered, F.concat(F.lit("Unique sessions: "), F.col("sessions").cast("string")))]
    decided = ranked(tables["by_decision"].crossJoin(F.broadcast(tables["totals"].select("total_events"))), *by_count)
    share = one_decimal(F.col("n") / F.nullif("total_events", F.lit(0)) * 100)
    out += [head(1, "Decisions"), rows(1, decided, F.concat(F.lit("  "), wide(F.col("decision"), 12), F.lit(" "), count(6), F.lit("  ("), share, F.lit("%)")))]
    out += [head(2, "Event Types"), rows(2, ranked(tables["by_event"], *by_count), F.concat(F.lit("  "), wide(F.col("event"), 25), F.lit(" "), count(6)))]
    example = F.when(F.col("example").isNotNull(), F.concat(F.lit("    └─ e.g. "), F.left("example", F.lit(100))))
    out += [head(3, "Top Denied Rules"), rows(3, ranked(tables["top_rules_denied"], *by_count), F.concat(F.lit("  "), wide(F.col("rule_id"), 25), F.lit(" "), count(5)), example)]
    file = F.replace(F.col("file"), F.lit(home), F.lit("~")) if home else F.col("file")
    out += [head(4, "Top Denied Files"), rows(4, ranked(tables["top_files_denied"], *by_count), F.concat(F.lit("  "), count(4), F.lit("  "), file))]
    out += [head(5, "Retry Patterns (same rule denied 2+ in one session)"), rows(5, ranked(tables["retry_patterns"], *by_count), F.concat(F.lit("  "), count(3), F.lit("x  "), F.col("label"))), tail(5, tables["retry_patterns"], "(none detected)")]
    out += [head(6, "Daily Volume"), rows(6, ranked(daily_bars(tables["daily_counts"]), "day"), F.concat(F.lit("  "), F.col("day"), F.lit("  "), count(5), F.lit("  "), F.col("bar")))]
    out += [head(7, "Severity Breakdown"), rows(7, ranked(tables["by_severity"], *by_count), F.concat(F.lit("  "), wide(F.col("severity"), 10), F.lit(" "), count(6))), tail(7, tables["by_severity"])]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole
