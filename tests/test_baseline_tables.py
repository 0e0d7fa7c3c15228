"""Baselines as tables of versions: missing ones, broken writers, and two writers at once."""

import pytest
from pyspark.sql import functions as F

from lintel.operators import baseline as B
from lintel.sources import baselines, shared

IDS = "rule string, stable_id string"


def held(spark, path):
    return sorted(map(tuple, baselines.committed_baseline(spark, path).collect()))


def test_missing_baselines_are_empty(spark, tmp_path):
    now = spark.createDataFrame([("r", "r|a"), ("r", "r|a")], IDS)
    for none in (baselines.read_baseline(spark, str(tmp_path / "no.json")), baselines.committed_baseline(spark, str(tmp_path / "no"))):
        assert none.count() == 0 and none.columns == ["rule", "stable_id"]
        assert [tuple(r) for r in B.tally(now, none).collect()] == [("r", 2, 0, 2, 0, False)]
        assert [tuple(r) for r in B.tally(now, none, generating=True).collect()] == [("r", 2, 0, 0, 0, True)]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "baseline")
    first = spark.createDataFrame([("r", "r|b"), ("r", "r|a"), ("r", "r|a"), ("q", "q|x")], IDS).repartition(3)
    assert baselines.commit_baseline(first, path, "now") == 1 and held(spark, path) == [("q", "q|x"), ("r", "r|a"), ("r", "r|b")]
    second = baselines.committed_baseline(spark, path).where("rule = 'r'")
    assert baselines.commit_baseline(second, path, "later", after=1) == 2 and held(spark, path) == [("r", "r|a"), ("r", "r|b")]
    with pytest.raises(ValueError, match="version 2 is in force, not 1"):
        baselines.commit_baseline(first, path, "late", after=1)
    assert baselines.commit_baseline(first.limit(0), path, "none") == 3 and held(spark, path) == [] and baselines.versions(spark, path) == [2, 3]


def test_a_broken_writer_leaves_the_version_in_force(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "baseline")
    baselines.commit_baseline(spark.createDataFrame([("r", "r|a")], IDS), path, "now")
    bad = spark.range(9).select(F.lit("r").alias("rule"), F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise("x").alias("stable_id"))
    with pytest.raises(Exception, match="lost"):
        baselines.commit_baseline(bad, path, "now")
    with monkeypatch.context() as m:  # written, but gone before the rename

        def gone(*_):
            raise KeyboardInterrupt

        m.setattr(shared, "moved", gone)
        with pytest.raises(KeyboardInterrupt):
            baselines.commit_baseline(spark.createDataFrame([("r", "r|b")], IDS), path, "now")
    assert held(spark, path) == [("r", "r|a")] and baselines.versions(spark, path) == [1]
    with monkeypatch.context() as m:  # another writer took the number in between
        m.setattr(baselines, "versions", lambda *_: [])
        with pytest.raises(ValueError, match="taken meanwhile"):
            baselines.commit_baseline(spark.createDataFrame([("r", "r|b")], IDS), path, "now")
    assert held(spark, path) == [("r", "r|a")]


def test_another_layout_raises(spark, tmp_path):
    path = str(tmp_path / "baseline")
    row = spark.createDataFrame([(2, "now", "r", "r|a")], baselines.ROWS)
    row.write.parquet(baselines.version_folder(path, 1))
    with pytest.raises(Exception, match="baseline version 2, expected 1"):
        baselines.committed_baseline(spark, path).collect()
