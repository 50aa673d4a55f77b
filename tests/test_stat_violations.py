"""stat_violations on events without a user or a type."""

import duckdb

from tidemark import plans


def test_events_without_a_part_of_their_id_are_one_group_as_in_the_sql(spark, tmp_path):
    """Halves and whole numbers, so no mean depends on the order of adding."""
    rows = [("a", 1, 2.0), ("a", 1, 4.0), ("a", None, -3.0), ("a", None, 5.0), (None, 1, -8.5), (None, None, 1.0), ("b", 2, -1.0), ("", 2, None)]
    spark.createDataFrame(rows, "event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = plans.QUERIES["stat_violations"](spark, str(tmp_path)).select("code", "severity", "id", "detail").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, db.sql(plans.ORACLE["stat_violations"]).fetchall()))
    assert [r["detail"] for r in got if r["code"] == "STAT-007" and r["id"] is None] == ["4"]
