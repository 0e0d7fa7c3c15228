"""State of sessions over streams against the batch operators, over several batches and a restart."""

import random

import pytest

from lintel.operators import state as S
from lintel.streaming import sessions

READS = "session string, path string, ord long, at long, full boolean"


def fed(spark, tmp_path, name, frames, schema, build, stop_after=1):
    """All that a query gives for frames that come one after the other; it is stopped and started again in between."""
    src, out = tmp_path / name, []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = build(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()

    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        if k + 1 >= stop_after:
            run()
    return out


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_full_reads_equal_the_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((rng.randrange(20_000), rng.choice("st"), rng.choice(["p", "q"]), rng.random() < 0.3) for _ in range(160))
    rows = [(s, p, i, at, full) for i, (at, s, p, full) in enumerate(rows)]
    want = {(r.ord, r.known) for r in S.known_full_reads(spark.createDataFrame(rows, READS)).collect()}
    got = fed(spark, tmp_path, "reads", [rows[:50], rows[50:110], rows[110:]], READS, sessions.known_full_reads)
    assert {(r.ord, r.known) for r in got} == want and any(k for _, k in want) and len(got) == 160


def test_full_reads_begin_with_what_a_table_knows(spark, tmp_path):
    known = spark.createDataFrame([("s", "p", 1000), ("s", "q", 2000), ("t", "p", 10)], "session string, path string, at long")
    rows = [("s", "p", 0, 4600, False), ("s", "p", 1, 4601, False), ("s", "q", 2, 4601, False), ("t", "q", 3, 20, False), ("u", "p", 4, 20, False), ("t", "p", 5, 3610, False), ("t", None, 6, 3611, True), ("t", None, 7, 3612, False)]
    got = fed(spark, tmp_path, "begin", [rows], READS, lambda df: sessions.known_full_reads(df, initial=known))
    assert {r.ord for r in got if r.known} == {0, 2, 5, 7} and len(got) == 8


def test_expired_reads_leave_the_store(spark, tmp_path):
    rows = [("s", "p", 0, 1000, True)], [("s", "q", 1, 100_000, True)], [("s", "q", 2, 200_000, False)], [("z", "q", 3, 300_000, False)]
    fed(spark, tmp_path, "old", rows, READS, sessions.known_full_reads)
    fed(spark, tmp_path, "new", rows[:1], READS, sessions.known_full_reads)
    assert spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "new-checkpoint")).count() == 1
    left = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "old-checkpoint")).count()
    assert left == 0


def test_repeats_equal_the_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), i, rng.random() < 0.2) for i in range(120)]
    shape = "key string, ord long, reset boolean"
    want = {(r.key, r.ord, r.n, r.escalates) for r in S.repeat_counts(spark.createDataFrame(rows, shape), ["key"], "ord", "reset").collect()}
    got = fed(spark, tmp_path, "repeats", [rows[:30], rows[30:31], rows[31:]], shape, sessions.repeat_counts)
    assert {tuple(r) for r in got} == want and any(e for *_, e in want)
    begin = spark.createDataFrame([("a", 2)], "key string, n long")
    got = fed(spark, tmp_path, "more", [[("a", 0, False), ("b", 1, False), ("a", 2, True), ("a", 3, False)]], shape, lambda df: sessions.repeat_counts(df, begin))
    assert sorted((r.ord, r.n, r.escalates) for r in got) == [(0, 3, True), (1, 1, False), (3, 1, False)]
