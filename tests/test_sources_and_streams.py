"""Files, baselines, configuration, and streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from lintel.functions.globs import path_matches
from lintel.functions.paths import clone_url, constant_name, patch_paths, splitlines, suffix
from lintel.operators import baseline as B
from lintel.operators import state as S
from lintel.sources import baselines, config
from lintel.sources.tree import read_tree
from lintel.streaming.full_reads import known_full_reads


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "glob", "want"),
    [("src/a.py", "*.py", True), ("src/a.py", "src/", True), ("x/src/a.py", "src/", False), ("a/b/c.py", "a/*.py", True), ("c.py", "**/c.py", False), ("x/c.py", "**/c.py", True), ("A\\B.PY", "a/b.py", True), ("a[1].py", "a[[]1].py", True), ("ab.py", "a[!c].py", True), ("a+b", "a+b", True), ("a\nb", "a*", True)],
)
def test_globs(spark, path, glob, want):
    assert one(spark, path_matches(F.lit(path), glob)) is want


def test_text_functions(spark):
    for text in ("", "a", "a\n", "a\r\nb\x0bc\x85d e\r\r", "\n\n"):
        assert one(spark, splitlines(F.lit(text))) == text.splitlines()
    for p in ("a.py", "a.b.PY", ".bashrc", "a.", "x/.y/z", "a/b.tar.gz", "", "..x"):
        from pathlib import PurePosixPath

        assert one(spark, suffix(F.lit(p))) == PurePosixPath(p).suffix.lower(), p
    assert one(spark, constant_name(F.lit(" 9 lives! "))) == "STR_9_LIVES" and one(spark, constant_name(F.lit("--"))) == "EXTRACTED_STRING" and len(one(spark, constant_name(F.lit("x" * 99)))) == 48
    assert one(spark, clone_url(F.lit("git@Host.com:Own/Repo.git"))) == "host.com/Own/Repo" and one(spark, clone_url(F.lit("https://HOST/a/b.git/"))) == "host/a/b.git" and one(spark, clone_url(F.lit("https://HOST/a/b.git/"), True)) == "host/a/b"
    assert one(spark, patch_paths(F.lit("*** Add File: a \n--- a/b\n+++ b/b\n+++ /dev/null"))) == ["a", "b"]


def test_tree(spark, tmp_path):
    for name, data in (("a.py", b"x = 1"), ("pkg/b.py", b"\xff = 2"), ("pkg/c.txt", b""), (".venv/d.py", b""), ("tests/test_e.py", b"y = 1"), ("gen_pb2.py", b"")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.source, r.is_test) for r in read_tree(spark, str(tmp_path), exclude_files=["*_pb2.py"]).collect()}
    assert got == {"a.py": ("x = 1", False), "pkg/b.py": ("� = 2", False), "tests/test_e.py": ("y = 1", True)}
    scope = spark.createDataFrame([("a.py",)], "path string")
    assert [r.path for r in read_tree(spark, str(tmp_path), scope=scope).collect()] == ["a.py"]


def test_baselines(spark, tmp_path):
    v = spark.createDataFrame([("r", "r|b"), ("r", "r|a"), ("r", "r|a"), ("q", "q|x")], "rule string, stable_id string")
    baselines.write_baseline(v, str(tmp_path / "b"), "now")
    back = baselines.read_baseline(spark, str(tmp_path / "b" / "*.txt"))
    assert sorted(map(tuple, back.collect())) == [("q", "q|x"), ("r", "r|a"), ("r", "r|b")]
    with pytest.raises(Exception, match="baseline version 2"):
        baselines.parse_baseline(spark.createDataFrame([('{"schema_version": 2, "rules": {}}',)], "value string")).collect()
    now = spark.createDataFrame([("r", "r|a"), ("r", "r|n"), ("r", "r|n")], "rule string, stable_id string")
    assert B.new_violations(now, back).count() == 2 and sorted(r.stable_id for r in B.fixed_ids(now, back).collect()) == ["q|x", "r|b"]
    t = B.tally(now, back)
    assert [tuple(r) for r in t.collect()] == [("r", 3, 2, 2, 1, False)] and B.passed(t).first().exit_code == 1
    assert one(spark, B.stable_id(F.lit("r"), F.lit("p"), F.lit("i"), F.lit(""))) == "r|p|i"


def test_config():
    rules = config.load_rules(json.dumps({"regex_rules": [{"rule_id": "A", "events": ["X"], "target": "path", "patterns": ["p"], "odd": 1}]}))
    assert rules[0].rule_id == "A" and config.load_rules("") == [] and config.load_toml("= bad") == {}
    assert config.limits_of({"params": 9, "odd": 1, "nesting": True}).params == 9 and config.policy_of({"disabled": ["X"]}).disabled == ("X",)
    text = "[a]\nx = 1\n\n[b]\ny = 2\n"
    out = config.add_missing(text, {"a": {"x": 5, "z": "s"}, "c": {"q": [1]}})
    assert config.load_toml(out) == {"a": {"x": 1, "z": "s"}, "b": {"y": 2}, "c": {"q": [1]}} and config.add_missing(out, {"a": {"z": 0}}) == out


READS = [("s", "p", 0, 1000, True), ("s", "p", 1, 4600, False), ("s", "p", 2, 4601, False), ("s", "q", 3, 1001, False), ("t", "p", 4, 1001, False), ("s", "p", 5, 9000, True), ("s", "p", 6, 9000, False), ("u", "p", 7, 5, False), ("u", "p", 8, 5, True)]


def test_full_reads_batch_and_stream(spark, tmp_path):
    schema = "session string, path string, ord long, at long, full boolean"
    df = spark.createDataFrame(READS, schema)
    want = {(r.ord, r.known) for r in S.known_full_reads(df).collect()}
    assert {o for o, k in want if k} == {1, 6}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = known_full_reads(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("reads").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.ord, r.known) for r in spark.table("reads").collect()} == want


def test_counters(spark):
    df = spark.createDataFrame([(1, "k", False), (2, "k", False), (3, "k", False), (4, "k", True), (5, "k", False)], "ord long, key string, fixed boolean")
    assert [(r.ord, r.n, r.escalates) for r in S.repeat_counts(df, ["key"], "ord", "fixed").orderBy("ord").collect()] == [(1, 1, False), (2, 2, False), (3, 3, True), (5, 1, False)]


def test_look_back_over_spans(spark):
    import random

    rng = random.Random(5)
    for ttl in (0, 1, 7, 50):
        rows = [(rng.choice(["s", "t", None]), rng.choice(["p", None]), i, rng.randrange(-60, 120), rng.choice([True, False, False, None])) for i in range(300)]
        df = spark.createDataFrame(rows, "session string, path string, ord long, at long, full boolean")
        want = {o: any(f and (s2, p2) == (s, p) and (a - ttl <= a2 < a or a2 == a and o2 < o) for s2, p2, o2, a2, f in rows) for s, p, o, a, _ in rows}
        out = S.known_full_reads(df, ttl=ttl)
        assert out.columns == [*df.columns, "known"] and {r.ord: r.known for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan


def test_a_hot_key_is_dealt_by_its_spans(spark):
    df = spark.range(20_000).select(F.lit("s").alias("session"), F.lit("p").alias("path"), F.col("id").alias("ord"), (F.col("id") * 10).alias("at"), (F.col("id") % 50 == 0).alias("full"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = S.known_full_reads(df, ttl=300)
        by = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(by) == 4 and max(by) < 10_000 and out.where("known").count() == 20_000 // 50 * 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
