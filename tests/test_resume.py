"""Work that was stopped half way: exactly what is absent or changed is computed again."""

import glob
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import resume

SCHEMA = "k long, total long"


@pytest.fixture
def rows(spark):
    return spark.range(1000).select((F.col("id") % 7).alias("p"), (F.col("id") % 10).alias("k"), F.col("id").alias("x"))


class Work:
    def __init__(self, fail_at=None):
        self.seen, self.fail_at = [], fail_at

    def __call__(self, some):
        parts = sorted(r["p"] for r in some.select("p").distinct().collect())
        if self.fail_at is not None and len(self.seen) >= self.fail_at:
            raise RuntimeError("stopped")
        self.seen += parts
        return some.groupBy(F.col("p").cast("string").alias("part"), "k").agg(F.sum("x").alias("total")).where("part <> '6'")


def result(d):
    return sorted((r["part"], r["k"], r["total"]) for r in d.collect())


def run(rows, folder, work, params=None, schema=SCHEMA):
    return resume.resumed(rows, "p", work, schema, folder, params or {"a": 1}, groups=4)


@pytest.fixture
def clean(rows):
    return sorted((str(r["p"]), r["k"], r["total"]) for r in rows.where("p <> 6").groupBy("p", "k").agg(F.sum("x").alias("total")).collect())


def test_a_second_run_computes_nothing(rows, clean, tmp_path):
    first, second = Work(), Work()
    assert result(run(rows, f"file://{tmp_path}/f", first)) == clean and sorted(first.seen) == list(range(7))
    again = run(rows, f"file://{tmp_path}/f", second)
    assert result(again) == clean and second.seen == [] and again.where("NOT reused").count() == 0


def test_a_stopped_run_leaves_its_sealed_parts(rows, clean, tmp_path):
    stopped, second = Work(fail_at=2), Work()
    with pytest.raises(RuntimeError):
        run(rows, f"file://{tmp_path}/f", stopped)
    assert 0 < len(stopped.seen) < 7
    out = run(rows, f"file://{tmp_path}/f", second)
    assert result(out) == clean and sorted(stopped.seen + second.seen) == list(range(7))


def test_altered_lost_and_unsealed_parts_are_computed_again(spark, rows, clean, tmp_path):
    folder = f"{tmp_path}/f"
    run(rows, f"file://{folder}", Work())
    changed = glob.glob(f"{folder}/rows/run=*/part=2")[0]
    d = spark.read.parquet(changed).withColumn("total", F.col("total") + 1).collect()
    shutil.rmtree(changed)
    spark.createDataFrame(d, SCHEMA).write.parquet(changed)
    shutil.rmtree(glob.glob(f"{folder}/rows/run=*/part=4")[0])
    # a run that was stopped between its rows and its manifest
    spark.createDataFrame([(1, 1)], SCHEMA).write.parquet(f"{folder}/rows/run=zz-0000/part=1")
    second = Work()
    out = run(rows, f"file://{folder}", second)
    assert result(out) == clean and sorted(second.seen) == [2, 4]
    assert {r["part"] for r in out.where("NOT reused").select("part").distinct().collect()} == {"2", "4"}


def test_changed_inputs_and_parameters(rows, tmp_path):
    folder = f"file://{tmp_path}/f"
    run(rows, folder, Work())
    third = Work()
    more = rows.withColumn("x", F.when((F.col("p") == 3) & (F.col("x") == 3), 99).otherwise(F.col("x")))
    run(more, folder, third)
    assert third.seen == [3]
    fourth, back = Work(), Work()
    run(rows, folder, fourth, {"a": 2})
    assert sorted(fourth.seen) == list(range(7))
    run(rows.repartition(5), folder, back, {"a": 2})
    assert back.seen == []


def test_refusals(rows, tmp_path):
    with pytest.raises(ValueError):
        run(rows, f"file://{tmp_path}/f", Work(), {"a": float("nan")})
    with pytest.raises(Exception, match="belongs to no part"):
        run(rows.withColumn("p", F.when(F.col("x") > 5, F.col("p"))), f"file://{tmp_path}/g", Work())


def test_no_rows(rows, tmp_path):
    assert run(rows.limit(0), f"file://{tmp_path}/f", Work()).collect() == []
