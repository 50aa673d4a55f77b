"""key_geometry names every row that breaks a rule of keys."""

import duckdb
import os

from tidemark import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_violation_is_a_row_and_agrees_with_the_sql(spark):
    db = duckdb.connect()
    for name in ("orders", "customer", "nation"):
        db.sql(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    got = plans.QUERIES["key_geometry"](spark, SF).select("code", "severity", "id").collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(f"SELECT code, severity, id FROM ({plans.ORACLE['key_geometry']})").fetchall())
    assert {r["code"] for r in got} >= {"CMP-001", "CMP-002", "CMP-003", "CMP-004"} and len(got) > 500
