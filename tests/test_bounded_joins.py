"""Collections of many rows aren't sent to every task, however small their files are."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import closure, shared
from tidemark.operators import constraints as C


@pytest.fixture
def registry(spark, tmp_path, monkeypatch):
    """30 measurements of 20 artifacts and one row of the others, where 10 rows are many."""
    monkeypatch.setattr(shared, "FEW", 10, raising=False)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole paths in plans
    rows = {
        "models": (1, ["'m' AS id", "named_struct('artifact_ref', 'a3') AS canonical_weights"]),
        "artifacts": (20, ["concat('a', id) AS id", "'m' AS model_ref", "'base' AS kind", "IF(id = 7, 'gone', NULL) AS derived_from_artifact_ref", "IF(id = 5, 'x', 's') AS scope_digest"]),
        "panels": (1, ["'p' AS id", "array('m') AS model_scope"]),
        "references": (1, ["'r' AS id", "'a4' AS artifact_ref", "'p' AS panel_ref", "named_struct('floor_measurement_ref', 'o99') AS self_consistency"]),
        "pipelines": (1, ["'l' AS id"]),
        "measurements": (30, ["concat('o', id) AS id", "concat('a', id) AS artifact_ref", "'p' AS panel_ref", "'r' AS reference_ref", "'l' AS pipeline_ref", "'m' AS model_ref", "'s' AS scope_digest"]),
    }
    out = {}
    for name, (n, fields) in rows.items():
        d = spark.range(n).selectExpr(*fields)
        d = d.select(F.from_json(F.to_json(F.struct(*d.columns)), C.SCHEMAS[name]).alias("row")).select("row.*")
        d.write.parquet(f"{tmp_path}/{name}")
        out[name] = spark.read.schema(d.schema).parquet(f"{tmp_path}/{name}")
    yield out
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def sent_whole(d) -> list[str]:
    """The scans of artifacts or measurements that a broadcast holds with no join between them."""
    lines, found = d._jdf.queryExecution().executedPlan().toString().splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(re.match(r"[\s:+\-]*", line).group())
            for below in lines[i + 1 :]:
                if len(re.match(r"[\s:+\-]*", below).group()) <= depth or "Join" in below or "distinct" in below or "HashAggregate" in below:
                    break
                found += re.findall(r"FileScan.*?/(artifacts|measurements)\b", below)
    return found


@pytest.mark.parametrize("codes", [("SCOPE-001",), ("REF-001",), ("REF-010",), ("REF",)])
def test_a_large_collection_is_joined_without_a_broadcast_of_it(spark, registry, codes):
    assert not sent_whole(C.violations(registry, [], codes=codes))


def test_rows_that_are_sought_in_large_collections_are_judged_as_before(spark, registry):
    got = {(r["code"], r["id"]) for r in C.violations(registry, [], codes=("REF-001", "REF-010", "SCOPE-001")).collect()}
    gone = {("REF-001", f"o{i}") for i in range(20, 30)}  # of artifacts that aren't there
    assert got == gone | {("SCOPE-001", "o5"), ("REF-001", "a7"), ("REF-010", "r")}


def test_allowed_ids_are_sought_in_large_collections(spark, registry):
    assert [r["id"] for r in C.unmeasured(registry["measurements"], ["o3", "o77"]).collect()] == ["o77"]


def test_chains_of_many_edges_are_followed_without_a_broadcast_of_them(spark, monkeypatch):
    for module, name in ((shared, "FEW"), (closure, "SENT")):
        monkeypatch.setattr(module, name, 10, raising=False)
    edges = shared.written(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "node long, up long"), "chain")
    pairs = spark.createDataFrame([(0, 40), (3, 2), (100, 101), (5, 5)], "lower long, upper long")
    whole = closure.forest(edges)
    assert whole.ends.where("root = 40").count() == 40 and whole.ends.where("cycle = 100").count() == 2
    found = closure.descends(pairs, edges)
    assert sorted(map(tuple, found.collect())) == [(0, 40), (5, 5), (100, 101)]
    met = closure.followed(edges, "up", edges.select("node", F.col("up").alias("at")), 42)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
