"""Shards of a report must share their identity."""

from tidemark.operators import registry as R

SCHEMA = "run string, tokenizer string, suite int, side struct<head: string, rows: bigint>, report string, field int"


def test_differences_are_named_by_path(spark):
    d = spark.createDataFrame(
        [
            ("same", "t", 1, ("h", 5), "x", 1), ("same", "t", 1, ("h", 5), "y", 2), ("same", "t", 1, ("h", 5), None, None),
            ("other", "t", 1, ("h", 5), "x", 1), ("other", "T", 1, ("h", 6), "x", 1),
            ("gap", "t", None, None, "x", 1), ("gap", "t", 2, ("h", None), "x", 1),
            ("one", "t", 1, ("h", 5), "x", 1), ("none", None, None, None, "x", 1), ("none", None, None, None, "x", 1),
            (None, "a", 1, ("h", 5), "x", 1), (None, "b", 1, ("h", 5), "x", 1),
        ],
        SCHEMA,
    )
    got = R.identity_disagreements(d, "run", ["tokenizer", "suite", "side.head", "side.rows"])
    assert got.columns == ["run", "field", "least", "most", "absent", "shards"]
    v = lambda x: f'{{"v":"{x}"}}'
    assert {tuple(r) for r in got.collect()} == {
        ("other", "tokenizer", v("T"), v("t"), 0, 2), ("other", "side.rows", '{"v":5}', '{"v":6}', 0, 2),
        ("gap", "suite", '{"v":2}', '{"v":2}', 1, 2), ("gap", "side.head", v("h"), v("h"), 1, 2),
        (None, "tokenizer", v("a"), v("b"), 0, 2),
    }


def test_no_reports(spark):
    assert R.identity_disagreements(spark.createDataFrame([], SCHEMA), "run", ["tokenizer", "side.head"]).collect() == []


def test_many_shards_are_judged_by_partial_aggregates(spark):
    d = spark.range(100_000).selectExpr("'r' AS run", "IF(id = 77777, 'b', 'a') AS tokenizer")
    got = R.identity_disagreements(d, "run", ["tokenizer"])
    assert [tuple(r) for r in got.collect()] == [("r", "tokenizer", '{"v":"a"}', '{"v":"b"}', 0, 100_000)]
