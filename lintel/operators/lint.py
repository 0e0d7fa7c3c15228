"""Lint over tables of Python files: syntax facts once, then filters and groupings.

A file is (path, source, is_test). Facts come from one Arrow UDTF-like pass; everything after it is DataFrame work.
Violations are (rule, path, identifier, detail).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, constant_name, dirname
from ..functions.pyfacts import facts

FACTS = "path string, is_test boolean, kind string, name string, line int, end_line int, value long, text string"
#: Literals that never count, and path parts of code that is not one's own.
ALLOWED_NUMBERS = ["0", "1", "2", "3", "4", "5", "-1", "10", "100", "200", "255", "1000", "1024"]
ALLOWED_STRINGS = ["", " ", "\n", "\t", "utf-8", "r", "w", "rb", "wb", "GET", "POST", "PUT", "DELETE", "PATCH", "id", "name", "type", "value", "text", "status"]
VENDORED = [".venv/", "site-packages/", "node_modules/", ".tox/", ".nox/", "/.eggs/"]


@dataclass(frozen=True)
class Limits:
    complexity: int = 12
    params: int = 4
    method_lines: int = 50
    nesting: int = 4
    class_methods: int = 10
    class_lines: int = 400
    line_length: int = 120
    module_soft: int = 350
    module_hard: int = 600
    test_lines: int = 35
    test_calls: int = 7
    bare_asserts: int = 3
    number_files: int = 5
    string_files: int = 10
    clone_lines: int = 5
    call_sequence: int = 3
    envy_share: float = 0.60
    envy_least: int = 6
    import_names: int = 5
    logger_factory: str = ""
    logger_variable: str = "logger"


def ast_facts(files: DataFrame) -> DataFrame:
    """files (path, source, is_test) -> facts. Null source counts as empty; one row's facts at a time are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, source, test in zip(*(batch.column(c).to_pylist() for c in ("path", "source", "is_test")), strict=True):
                got = facts(source or "")
                if got:
                    cols = list(zip(*got, strict=True))
                    clean = lambda x: [s.encode("utf-8", "replace").decode() for s in x]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(got), pa.string()), pa.array([test] * len(got), pa.bool_()), pa.array(cols[0]), pa.array(clean(cols[1])), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()), pa.array(clean(cols[5]))], names=["path", "is_test", "kind", "name", "line", "end_line", "value", "text"])

    return files.select("path", "source", F.coalesce("is_test", F.lit(False)).alias("is_test")).mapInArrow(run, FACTS)


def _say(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def simple_violations(f: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Violations that one fact shows by itself, in one pass over the facts."""
    m = limits or Limits()
    kind, value, line, name, text, own, test = F.col("kind"), F.col("value"), F.col("line"), F.col("name"), F.col("text"), ~F.col("is_test"), F.col("is_test")
    n, at = value.cast("string"), _say("line ", line.cast("string"))
    rows = [  # (rule, fact, when, identifier, detail)
        ("high-complexity", "complexity", own & (value > m.complexity), name, _say("complexity=", n)),
        ("long-method", "body_lines", own & (value > m.method_lines), name, _say("lines=", n)),
        ("too-many-params", "params", own & (value > m.params), name, _say("params=", n)),
        ("deep-nesting", "nesting", own & (value > m.nesting), name, _say("depth=", n)),
        ("oversized-module", "module", own & (value > m.module_hard), basename(F.col("path")), _say("lines=", n, f" (hard limit={m.module_hard})")),
        ("oversized-module-soft", "module", own & (value > m.module_soft) & (value <= m.module_hard), basename(F.col("path")), _say("lines=", n, f" (soft limit={m.module_soft})")),
        ("unnecessary-wrapper", "wrapper", own, name, _say("delegates to ", text)),
        ("wrong-logger-name", "logger_name", own, _say("L", line.cast("string")), _say("'", name, f"' → use '{m.logger_variable}'")),
        ("direct-get-logger", "get_logger", own & F.lit(bool(m.logger_factory)), _say("L", line.cast("string")), F.lit(f"use {m.logger_factory}() instead")),
        ("banned-any", "any", own, name, text),
        ("type-suppression", "suppression", own, _say("line-", line.cast("string")), text),
        ("broad-except-swallow", "swallow", own, name, at),
        ("silent-datetime-fallback", "datetime", own, name, at),
        ("silent-except", "silent", own, name, _say(at, ": ", text)),
        ("long-line", "line", own & (value > m.line_length), _say("line-", line.cast("string")), _say("length=", n)),
        ("long-test", "test_lines", test & (value > m.test_lines), name, _say("lines=", n)),
        ("eager-test", "test_calls", test & (value > m.test_calls), name, _say("sut_calls=", n)),
        ("assertion-roulette", "bare_asserts", test & (value > m.bare_asserts), name, _say("consecutive_bare_asserts=", n)),
        ("conditional-assertion", "conditional", test, name, at),
        ("fixture-outside-conftest", "fixture", test & (basename(F.col("path")) != "conftest.py"), name, at),
    ]
    hit = F.coalesce(*(F.when((kind == k) & when, F.struct(F.lit(rule).alias("rule"), ident.alias("identifier"), detail.alias("detail"))) for rule, k, when, ident, detail in rows))
    return f.where(kind.isin(*{r[1] for r in rows})).withColumn("hit", hit).where("hit IS NOT NULL").select("hit.rule", "path", "hit.identifier", "hit.detail")


def assertion_free(f: DataFrame) -> DataFrame:
    """Tests without an assertion of their own and without a `with ….raises(…)`."""
    tests = f.where("is_test AND kind = 'test_asserts' AND value = 0")
    raising = f.where("is_test AND kind = 'raises'").select("path", F.explode(F.split("text", "\x1f")).alias("key")).distinct()
    keyed = tests.withColumn("key", F.concat_ws(":", "name", "line"))
    return keyed.join(raising, ["path", "key"], "left_anti").select(F.lit("assertion-free-test").alias("rule"), "path", F.col("name").alias("identifier"), F.lit("").alias("detail"))


def god_classes(f: DataFrame, limits: Limits | None = None) -> DataFrame:
    m = limits or Limits()
    c = f.where("NOT is_test AND kind IN ('class_methods', 'class_lines')").groupBy("path", "name", "line").agg(F.max(F.when(F.col("kind") == "class_methods", F.col("value"))).alias("methods"), F.max(F.when(F.col("kind") == "class_lines", F.col("value"))).alias("lines"))
    why = F.concat_ws(", ", F.when(F.col("methods") > m.class_methods, _say("methods=", F.col("methods").cast("string"))), F.when(F.col("lines") > m.class_lines, _say("lines=", F.col("lines").cast("string"))))
    return c.withColumn("detail", why).where("detail <> ''").select(F.lit("god-class").alias("rule"), "path", F.col("name").alias("identifier"), "detail")


def grouped(rows: DataFrame, key: str, rule: str, detail) -> DataFrame:
    """A violation for every member of a group of two or more, naming the first three other members.

    Only a group's first members are gathered; all of them are joined to that."""
    m = rows.withColumn("member", _say(F.col("path"), ":", F.col("name")))
    ranked = m.select(key, "path", "line", "name", "member").selectExpr("*", f"row_number() OVER (PARTITION BY `{key}` ORDER BY path, line, name) AS nth").where("nth <= 64")
    heads = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "line", "name", "member"))).alias("heads"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    joined = m.join(heads, key)
    others = F.slice(F.transform(F.filter("heads", lambda h: h.member != F.col("member")), lambda h: h.member), 1, 3)
    return joined.select(F.lit(rule).alias("rule"), "path", F.col("name").alias("identifier"), detail(F.array_join(others, ", ")).alias("detail"))


def duplicate_violations(f: DataFrame, limits: Limits | None = None) -> DataFrame:
    m = limits or Limits()
    own = f.where("NOT is_test")
    clones = grouped(own.where((F.col("kind") == "clone") & (F.col("value") >= m.clone_lines)), "text", "semantic-clone", lambda o: _say("hash=", F.col("text"), ", clones: ", o))
    head = F.split("text", "\x1f")
    calls = grouped(own.where((F.col("kind") == "calls") & (F.col("value") >= m.call_sequence)), "text", "duplicate-call-sequence", lambda o: _say("calls [", F.array_join(F.slice(head, 1, 5), ", "), F.when(F.size(head) > 5, "...").otherwise(""), "], shared with ", o))
    blocks = own.where("kind = 'block'")
    twice = blocks.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    repeated = blocks.join(twice, "text").select(F.lit("repeated-code-block").alias("rule"), "path", F.col("name").alias("identifier"), _say("lines ", F.col("line").cast("string"), "-", F.col("end_line").cast("string"), ", block hash ", F.col("text")).alias("detail"))
    return clones.unionByName(calls).unionByName(repeated)


def repeated_literals(f: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Numbers and strings in more files than allowed; a string that some constants file names already says so."""
    m = limits or Limits()
    own = f.where("NOT is_test")
    per = lambda kind, allowed: own.where((F.col("kind") == kind) & ~F.col("text").isin(*allowed)).groupBy("text").agg(F.count_distinct("path").alias("n"))
    said = lambda limit: _say("appears in ", F.col("n").cast("string"), f" files (max: {limit})")
    project = F.lit("<project>").alias("path")
    numbers = per("number", ALLOWED_NUMBERS).where(F.col("n") > m.number_files).select(F.lit("repeated-magic-number").alias("rule"), project, F.col("text").alias("identifier"), said(m.number_files).alias("detail"))
    strings = per("string", ALLOWED_STRINGS).where(F.col("n") > m.string_files).join(constants(f), "text", "left")
    known = F.when(F.col("constant").isNotNull(), _say("; already defined as ", F.col("constant"), " in ", F.col("defined_in"), ":", F.col("defined_at").cast("string"))).otherwise(_say("; consider `", constant_name(F.col("text")), "`"))
    strings = strings.select(F.lit("repeated-string-literal").alias("rule"), project, F.left(_say("'", F.col("text"), "'"), F.lit(40)).alias("identifier"), _say(said(m.string_files), known).alias("detail"))
    return numbers.unionByName(strings)


def constants(f: DataFrame) -> DataFrame:
    """(text, constant, defined_in, defined_at): the first definition by path, line and name, in files of constants."""
    home = basename(F.col("path")).rlike(r"^(?:(?:constants|settings|config|defaults)|.*_constants)\.py$") | F.col("path").rlike(r"(?:^|/)config/[^/]+\.py$")
    first = F.min(F.struct("path", "line", "name"))
    return f.where((F.col("kind") == "constant") & home).groupBy("text").agg(first.alias("d")).select("text", F.col("d.name").alias("constant"), F.col("d.path").alias("defined_in"), F.col("d.line").alias("defined_at"))


def lint(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """All violations of a table of files. The caller may persist ast_facts() and use the parts instead."""
    f = ast_facts(files)
    return simple_violations(f, limits).unionByName(assertion_free(f)).unionByName(god_classes(f, limits)).unionByName(duplicate_violations(f, limits)).unionByName(repeated_literals(f, limits))


def worst(f: DataFrame, kind: str, limit: int) -> DataFrame:
    """(path, name, value): the highest fact of a file over the limit, the first of equals."""
    best = F.min_by(F.struct("name", "value"), F.struct(-F.col("value"), "line"))
    return f.where((F.col("kind") == kind) & (F.col("value") > limit)).groupBy("path").agg(best.alias("w")).select("path", "w.name", "w.value")


def runtime_findings(f: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(rule_id, path, name, value): the syntax-tree rules of events, over the facts of the files that the events write."""
    m = limits or Limits()
    mine = f
    for part in VENDORED:
        mine = mine.where(~F.col("path").contains(part))
    mine = mine.where(F.lower("path").rlike(r"\.pyi?$"))
    row = lambda rule, df: df.select(F.lit(rule).alias("rule_id"), "path", "name", F.col("value").cast("long").alias("value"))
    out = row("PY-CODE-008", worst(mine, "span", m.method_lines))
    for rule, kind, limit in (("PY-CODE-009", "params_rule", m.params), ("PY-CODE-010", "worst_line", m.line_length), ("PY-CODE-011", "nesting_rule", m.nesting), ("PY-CODE-015", "complexity_rule", m.complexity)):
        out = out.unionByName(row(rule, worst(mine, kind, limit)))
    envy = mine.where((F.col("kind") == "access") & (F.col("end_line") >= m.envy_least) & (F.col("value") / F.col("end_line") > m.envy_share))
    return (
        out.unionByName(row("PY-CODE-012", envy)).unionByName(row("PY-CODE-013", mine.where("kind = 'wrapper_rule'"))).unionByName(row("PY-CODE-014", mine.where((F.col("kind") == "class_public") & (F.col("value") > m.class_methods))))
        .unionByName(row("PY-CODE-016", mine.where("kind = 'dead'").withColumn("value", F.col("line")))).unionByName(row("PY-IMPORT-001", mine.where((F.col("kind") == "imports") & (F.col("value") > m.import_names))))
    )


def draft_findings(f: DataFrame) -> DataFrame:
    """(rule_id, path, name, value): file-local rules that no rule set switches on by itself. The ids of tests also stand
    for pattern rules of other meaning, so both must not be used together."""
    row = lambda rule, df: df.select(F.lit(rule).alias("rule_id"), "path", "name", F.col("value").cast("long").alias("value"))
    local = lambda kind: f.where(F.col("kind") == kind).groupBy("path", "text").agg(F.count(F.lit(1)).alias("value"), F.min_by("name", "line").alias("name")).where("value >= 2")
    numbers = f.where((F.col("kind") == "number") & ~F.col("text").isin("0", "1", "-1", "2")).groupBy("path", "text").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).where("n > 3")
    most = numbers.groupBy("path").agg(F.min_by(F.struct("text", "n"), F.struct(-F.col("n"), "line")).alias("w")).select("path", F.col("w.text").alias("name"), F.col("w.n").alias("value"))
    return (
        row("PY-DUP-001", local("block")).unionByName(row("PY-DUP-002", local("calls").where(F.size(F.split("text", "\x1f")) >= 3))).unionByName(row("PY-DUP-003", local("clone"))).unionByName(row("PY-DUP-004", most))
        .unionByName(row("PY-TEST-001", f.where("kind = 'test_calls' AND value > 5"))).unionByName(row("PY-TEST-002", f.where("kind = 'bare_asserts' AND value > 3")))
        .unionByName(row("PY-TEST-003", f.where("kind = 'fixture' AND NOT endswith(path, 'conftest.py')"))).unionByName(row("PY-TEST-004", f.where("kind = 'conditional'").withColumn("value", F.col("line"))))
    )


def flat_siblings(paths: DataFrame, least: int = 3) -> DataFrame:
    """(dir, prefix, n): directories with `least` or more files named _prefix_rest.py."""
    p = paths.select(dirname(F.col("path")).alias("dir"), F.regexp_extract(basename(F.col("path")), r"^_([a-z]+)_[a-z_]+\.py$", 1).alias("prefix")).where("prefix <> ''")
    return p.groupBy("dir", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def lint_documents(docs: DataFrame) -> DataFrame:
    """Facts counted by kind over documents, each as the body of a small module that holds its text as strings."""
    line = F.transform(F.split(F.regexp_replace("text", r"[\\'\r\x00]", ""), "\n"), lambda x, i: _say("    v", i.cast("string"), " = work('", x, "')"))
    source = _say("def f", F.col("doc_id").cast("string"), "(a, b, c, d, e):\n", F.array_join(line, "\n"), "\n    return v0\n")
    f = ast_facts(docs.select(_say(F.col("source"), "/", F.col("doc_id").cast("string"), ".py").alias("path"), source.alias("source"), F.lit(False).alias("is_test")))
    return f.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"), F.max("value").alias("most"))
