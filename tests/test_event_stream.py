"""Events as a stream: no join or shuffle in the plan, equal to the batch, and a batch is added once."""

import json
import os

from pyspark.sql import functions as F

from lintel.operators.engine import evaluate_events, trace_results
from lintel.operators.lint import Limits
from lintel.operators.rules import RegexRule
from lintel.sources import shared
from lintel.streaming.events import commit_batch, read_trace, stream_events, trace_stream

RULES = [RegexRule("TODO", ["PreToolUse"], "content", [r"\bTODO\b"], message="in {path}")]
LIMITS = Limits()
LONG = "def f(" + ", ".join(f"a{i}" for i in range(12)) + "):\n    return 1\n"


def payloads(n, k=0):
    for i in range(n):
        yield json.dumps({"hook_event_name": "PreToolUse", "tool_name": "Write", "session_id": f"s{k}", "tool_input": {"file_path": f"{k}-{i}.py", "content": ("# TODO", "x", LONG)[i % 3]}})


def put(folder, k, lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.jsonl").write_text("\n".join(lines) + "\n")


def test_evaluation_neither_joins_nor_shuffles(spark):
    raw = spark.createDataFrame([(1, "claude", "{}", True, ["a"])], "ord long, platform string, raw string, enrolled boolean, siblings array<string>")
    plan = evaluate_events(raw, regex_rules=RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "ArrowEvalPython" in plan
    twice = spark.createDataFrame([(1, "claude", "{}"), (1, "claude", "{}")], "ord long, platform string, raw string")
    assert evaluate_events(twice).count() == 2


def test_stream_equals_batch_and_a_batch_is_added_once(spark, tmp_path):
    src, trace, checkpoint = tmp_path / "in", str(tmp_path / "trace"), str(tmp_path / "checkpoint")
    run = lambda: trace_stream(evaluate_events(stream_events(spark, str(src)), regex_rules=RULES, limits=LIMITS), trace, checkpoint).trigger(availableNow=True).start().awaitTermination()
    put(src, 0, payloads(7))
    run()
    put(src, 1, ["", "{bad", *payloads(5, 1)])
    run()
    lines = [json.loads(r.value) for r in read_trace(spark, trace).collect()]
    raw = spark.createDataFrame([(i, "claude", x) for i, x in enumerate([*payloads(7), "{bad", *payloads(5, 1)])], "ord long, platform string, raw string")
    want = [(r.session_id, [f.rule_id for f in r.findings], r.output) for r in trace_results(evaluate_events(raw, regex_rules=RULES, limits=LIMITS)).collect()]
    got = [(x["session_id"], [f["rule_id"] for f in x["findings"]], x.get("output")) for x in lines if x["event_name"] or x["paths"] or x["session_id"]]
    assert sorted(got, key=str) == sorted((w for w in want if w[0]), key=str) and {"TODO", "PY-CODE-009"} <= {i for w in want for i in w[1]}
    before = read_trace(spark, trace).count()
    last = max(int(x) for x in os.listdir(f"{checkpoint}/commits") if x.isdigit())
    os.remove(f"{checkpoint}/commits/{last}")  # the batch was written, but its end was not noted: it runs again
    os.remove(f"{checkpoint}/commits/.{last}.crc")
    run()
    assert read_trace(spark, trace).count() == before


def test_a_broken_write_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "trace")
    assert read_trace(spark, path).count() == 0
    one = spark.range(3).select(F.col("id").cast("string").alias("value"))
    assert commit_batch(one, 0, path) and not commit_batch(one, 0, path)
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise("x").alias("value"))
    try:
        commit_batch(bad, 1, path)
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert [(r.batch, r.value) for r in read_trace(spark, path).orderBy("value").collect()] == [(0, "0"), (0, "1"), (0, "2")]
    assert commit_batch(one, 1, path) and read_trace(spark, path).count() == 6
    assert shared.children(spark, f"{path}/nowhere") == []
