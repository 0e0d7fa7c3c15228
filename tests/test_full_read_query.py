"""The query of full reads against its SQL where fractions of a second decide."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from lintel.plans import catalog


def test_seconds_are_rounded_as_in_the_sql(spark, tmp_path):
    at = lambda s: datetime.fromisoformat(f"2024-01-01T{s}")
    rows = [
        (1, at("00:00:00.400000"), 1, "view"), (2, at("01:00:00.600000"), 1, "click"),  # 3600.2 s apart, 3601 rounded
        (3, at("00:00:00.600000"), 2, "view"), (4, at("01:00:01.400000"), 2, "click"),  # 3600.8 s apart, 3600 rounded
        (5, at("00:00:01.500000"), 3, "view"), (6, at("00:00:02.500000"), 3, "click"),  # halves go to the even second
    ]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").withColumns({"value": F.lit(1.0), "props": F.lit('{"k": 1}')})
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.event_id, r.denied) for r in catalog.QUERIES["full_read_rule"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(con.sql(catalog.SQL["full_read_rule"]).fetchall()) == {(1, False), (2, True), (3, False), (4, False), (5, False), (6, False)}
