import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import jobs


def test_npy_and_safetensors(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(5, dtype=np.int32))
    assert files.read_npy(spark, str(tmp_path / "a.npy")).first()["tokens"] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="refused"):
        np.save(tmp_path / "b.npy", np.zeros(3))
        files.npy_values((tmp_path / "b.npy").read_bytes())
    data = np.arange(6, dtype="<f4").tobytes()
    head = json.dumps({"h": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "t.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + data)
    rows = files.read_safetensors(spark, str(tmp_path / "t.safetensors"), "h").orderBy("position").collect()
    assert [r["vec"] for r in rows] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]


def test_strict_json_refuses():
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            files.unique_object(bad)


def test_jsonl_round_trip_and_checksums(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, "a")], "id long, x string")
    files.write_canonical_jsonl(d, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id long, x string").orderBy("id").collect() == d.orderBy("id").collect()
    f = spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b"2"))], "path string, content binary")
    files.write_checksums(f, str(tmp_path / "sums"))
    changed = spark.createDataFrame([("p", bytearray(b"x")), ("r", bytearray(b"2"))], "path string, content binary")
    assert {(r["path"], r["problem"]) for r in files.verify_checksums(spark, changed, str(tmp_path / "sums")).collect()} == {("p", "mismatch"), ("q", "missing"), ("r", "undeclared")}


def test_streamed_histogram_equals_the_batch_one(spark, tmp_path):
    from tidemark.operators import sketch

    d = spark.range(2000).select((F.col("id") / 1000).alias("x"))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.tail_histogram(s, "x").writeStream.outputMode("complete").format("memory").queryName("hist").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("hist").collect())) == sorted(map(tuple, sketch.histogram(d, "x").collect()))


def test_lease_machine_refuses_illegal_steps(spark, tmp_path):
    spark.createDataFrame([(1, 1, "PREPARED"), (1, 2, "TERMINAL"), (1, 3, "ACTIVE"), (2, 4, "ACTIVE")], "user_id long, event_id long, state string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("user_id long, event_id long, state string").parquet(str(tmp_path / "in"))
    q = jobs.lease_machine(s, [(None, "PREPARED"), ("PREPARED", "TERMINAL")]).writeStream.outputMode("update").format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "ck")).start()
    for _ in range(300):  # with a timeout the query never runs out of batches
        if spark.table("leases").count():
            break
        time.sleep(0.2)
    q.stop()
    assert {(r["user_id"], r["state"], r["refused"]) for r in spark.table("leases").collect()} == {(1, "TERMINAL", 1), (2, "", 1)}


def test_a_line_that_names_a_key_twice_fails_the_read(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"id": 1, "x": {"a": 2}}\n\n{"id": 2, "x": null}\n')
    (tmp_path / "bad.jsonl").write_text('{"id": 1, "x": {"a": 2, "a": 3}}\n')
    schema = "id long, x struct<a:long>"
    assert [(r["id"], r["x"] and r["x"]["a"]) for r in files.read_unique_jsonl(spark, f"{tmp_path}/good.jsonl", schema).collect()] == [(1, 2), (2, None)]
    with pytest.raises(Exception, match="names a key twice"):
        files.read_unique_jsonl(spark, f"{tmp_path}/bad.jsonl", schema).collect()


def test_a_corpus_tree_is_read_with_its_strata(spark, tmp_path):
    for name, text in (("a/x.txt", "one"), ("b/y.txt", "two")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert files.read_corpus_tree(spark, str(tmp_path)).count() == 2


def test_the_ladder_adds_up_shards_and_refuses_what_arrives_twice(spark, tmp_path):
    source, schema = tmp_path / "in", "idx long, n long, m double"
    source.mkdir()

    def arrive(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(("idx", "n", "m"), r, strict=True))) for r in rows))
        (tmp_path / name).rename(source / name)
        stream = spark.readStream.schema(schema).json(str(source))
        query = jobs.ladder(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/own").trigger(availableNow=True).start()
        query.awaitTermination(120)

    arrive("a.json", [(0, 10, 1.0), (1, 30, 2.0)])
    arrive("b.json", [(2, 60, 3.0)])
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/ladder").orderBy("batch").select("contexts", "positions", "token_mean", "macro_mean").collect()]
    assert got == [(2, 40, 1.75, 1.5), (3, 100, 2.5, 2.0)]
    with pytest.raises(Exception, match="arrive twice"):
        arrive("c.json", [(3, 1, 1.0), (1, 5, 9.0)])
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 3
