"""Row numbers of logs, ends of files by range, and files that grow."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from lintel.operators import stats as T
from lintel.operators.engine import evaluate_events
from lintel.sources import logs, tails


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ord_counts_lines_over_splits_and_files(spark, tmp_path, small_splits):
    rng, want = random.Random(1), []
    for name, n in (("a", 300), ("b", 0), ("c", 1), ("d", 900), ("e", 7)):
        lines = [f"{name}{i} " + "x" * rng.randrange(90) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{x}\n" for x in lines))
        want += lines
    log = logs.read_log(spark, str(tmp_path))
    assert log.rdd.getNumPartitions() > 4 and log.schema["ord"].dataType.typeName() == "long"
    assert [(r.ord, r.value) for r in log.orderBy("ord").collect()] == list(enumerate(want))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    with pytest.raises(Exception, match="split otherwise"):
        log.select("ord", "value").collect()


def test_a_log_file_runs_end_to_end(spark, tmp_path, small_splits):
    payloads = [{"hook_event_name": "PreToolUse", "tool_name": "Bash", "session_id": f"s{i}", "tool_input": {"command": "git commit --no-verify" if i % 3 == 0 else "ls"}} for i in range(60)]
    (tmp_path / "log.jsonl").write_text("\n".join(["", *map(json.dumps, payloads)]))
    out = evaluate_events(logs.replayed(logs.read_log(spark, str(tmp_path))), limits=None).collect()
    assert {r.ord: [f.rule_id for f in r.findings] for r in out} == {i: ["GIT-001"] if i and i % 3 == 1 else [] for i in range(61)}
    lines = logs.read_log(spark, str(tmp_path))
    top = T.counted(T.entries_of(lines), "session", k=3).select("session", "first").collect()
    assert [tuple(r) for r in top] == [("s0", 1), ("s1", 2), ("s2", 3)]


def transcript(*entries):
    return "".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in entries)


def test_tails_read_only_the_ends(spark, tmp_path):
    said = lambda text, **kw: {"type": "assistant", "message": {"content": text}} | kw
    filler = [{"type": "user", "message": {"content": "u" * 990}}] * 3000
    (tmp_path / "big").write_text(transcript(said("too early"), *filler, said("last"), {"type": "user"}))
    (tmp_path / "old").write_text(transcript(said("out of the lines"), *[{"type": "user"}] * 20))
    (tmp_path / "blocks").write_text(transcript(said("x"), said([{"type": "text", "text": "a"}, {"type": "tool"}, 3, {"type": "text", "text": "b"}], type=None, role="assistant"), "{bad", {"type": "assistant", "message": "m"}, {"type": 3, "role": "assistant", "message": {"content": "no"}}, "[1]"))
    (tmp_path / "none").write_text("")
    (tmp_path / "_hidden").write_text(transcript(said("hidden")))
    t = tails.read_tails(spark, str(tmp_path))
    read = {r.path.rsplit("/", 1)[1]: (r.size, r.b, r.n) for r in t.groupBy("path", "size").agg(F.max("bytes_read").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    assert read["big"][0] > 3_000_000 and read["big"][1:] == (32_768, 20) and set(read) == {"big", "old", "blocks"}
    got = {r.path.rsplit("/", 1)[1]: r.said for r in tails.last_responses(t).collect()}
    assert got == {"big": "last", "blocks": "a b"}
    one = tails.last_responses(tails.read_tails(spark, str(tmp_path / "big"), most_bytes=10)).collect()
    assert one == [] and tails.read_tails(spark, str(tmp_path / "nowhere")).count() == 0


def test_ranges_share_lines_out(tmp_path):
    rng = random.Random(3)
    for _ in range(40):
        lines = [b"x" * rng.choice([0, 1, 5, 200]) for _ in range(rng.randrange(30))]
        data = b"\n".join(lines) + b"\n" * bool(lines)
        want, at = [], 0
        for x in lines:
            want.append((at, x))
            at += len(x) + 1
        for size in (1, 7, 64, 10_000):
            assert [x for a in range(0, len(data), size) for x in tails.lines_of(io.BytesIO(data), a, min(a + size, len(data)))] == want
        assert tails.line_end(io.BytesIO(data + b"open"), len(data) + 4) == len(data)


def test_lines_of_growing_files_come_once(spark, tmp_path, monkeypatch):
    src, checkpoint = tmp_path / "logs", str(tmp_path / "checkpoint")
    src.mkdir()
    seen = []

    def run():
        q = tails.follow_lines(spark, str(src), range_bytes=50).writeStream.foreachBatch(lambda df, _: seen.extend((r.path.rsplit("/", 1)[1], r.offset, r.value) for r in df.collect())).option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        q.stop()

    (src / "a").write_bytes(b"one\ntwo\nhalf a l")
    run()
    assert sorted(seen) == [("a", 0, "one"), ("a", 4, "two")]
    with (src / "a").open("ab") as f:
        f.write(b"ine\n" + b"y" * 300 + b"\n")
    (src / "b").write_bytes("é\r\n\n".encode())
    run()
    assert sorted(seen) == [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "half a line"), ("a", 20, "y" * 300), ("b", 0, "é"), ("b", 4, "")]
    run()
    assert len(seen) == 6
