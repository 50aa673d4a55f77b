"""Places and quantiles of groups that are never sorted in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference
from tidemark.operators import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = [(k, "a" if rng.random() < 0.7 else rng.choice("bc"), rng.choice([None, 1.0, 2.0, 2.0]) if rng.random() < 0.3 else round(rng.gauss(0, 3), 2)) for k in range(800)]
    return out, spark.createDataFrame([*out, (800, "d", None)], "id long, g string, x double")


@pytest.mark.parametrize("buckets", [1, 2, 16, 64])
def test_places_and_quantiles(rows, buckets):
    plain, d = rows
    place = {r["id"]: r["place"] for r in O.placed(d, ["g"], "x", "id", buckets).collect()}
    at = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["q"]): r["x"] for r in O.quantiles(d, ["g"], "x", at, buckets).collect()}
    for g in "abc":
        own = sorted((x is None, x or 0, k) for k, h, x in plain if h == g)
        assert [place[k] for _, _, k in own] == list(range(1, len(own) + 1))
        values = [x for missing, x, _ in own if not missing]
        assert [got[g, q] for q in at] == pytest.approx(list(np.quantile(values, at)), abs=1e-12)
    assert place[800] == 1 and ("d", 0.5) not in got
    assert {r["q"]: r["x"] for r in O.quantiles(d, [], "x", [0.5], buckets).collect()} == {0.5: pytest.approx(np.median([x for _, _, x in plain if x is not None]))}


def test_average_ranks(rows):
    plain, d = rows
    got = {r["id"]: (r["rk"], r["t"]) for r in O.average_ranks(d.where("x IS NOT NULL"), "g", F.abs("x")).collect()}
    for g in "abc":
        own = [(k, abs(x)) for k, h, x in plain if h == g and x is not None]
        for k, x in own[::7]:
            below, same = sum(y < x for _, y in own), sum(y == x for _, y in own)
            assert got[k] == (below + (same + 1) / 2, same)


def test_empty_frames(rows):
    none = rows[1].limit(0)
    assert O.placed(none, ["g"], "x", "id").collect() == O.quantiles(none, ["g"], "x", [0.5]).collect() == []


@pytest.mark.parametrize("seed", [7, (3, 1)])
@pytest.mark.parametrize("g", [1, 3, 70_000])
def test_resamples_in_blocks_are_one_draw(seed, g):
    b = 50 if g > 1000 else 501
    whole = np.random.default_rng(seed).integers(0, g, size=(b, g))
    assert (np.concatenate(list(inference.picks(g, b, seed, cells=7 * g))) == whole).all()


def test_half_of_all_rows_with_one_value_are_spread(spark, monkeypatch):
    """200 ranges of 20,000 rows: none has over twice the mean, though 10,000 rows are equal; and the input is computed once."""
    d = spark.range(20_000).select("id", F.lit("g").alias("g"), F.when(F.col("id") % 2 == 0, 5.0).otherwise((F.col("id") * 7919 % 20_011).cast("double")).alias("x"))
    seen = []
    monkeypatch.setattr(O, "ranged", lambda *a, f=O.ranged: seen.append(f(*a)) or seen[-1])
    got = sorted((r["place"], r["x"], r["id"]) for r in O.placed(d, ["g"], "x", "id", 200).collect())
    assert got == [(k + 1, x, i) for k, (x, i) in enumerate(sorted((5.0 if i % 2 == 0 else float(i * 7919 % 20_011), i) for i in range(20_000)))]
    sizes = [r["count"] for r in seen[0][0].groupBy("bucket").count().collect()]
    assert len(sizes) > 150 and max(sizes) < 400
    assert {r["q"]: r["x"] for r in O.quantiles(d, ["g"], "x", [0.3], 7).collect()} == {0.3: np.quantile([x for _, x, _ in got], 0.3)}
    few = {r["id"]: r["rk"] for r in O.average_ranks(d, "g", F.col("x"), entries=100).collect()}
    many = {r["id"]: r["rk"] for r in O.average_ranks(d, "g", F.col("x")).collect()}
    assert few == many and len(few) == 20_000


def test_null_groups_are_groups(spark):
    d = spark.createDataFrame([(1, None, 2.0), (2, None, 1.0), (3, "a", 4.0)], "id long, g string, x double")
    for buckets in (1, 3):
        assert sorted((r["id"], r["place"]) for r in O.placed(d, ["g"], "x", "id", buckets).collect()) == [(1, 2), (2, 1), (3, 1)]
        assert {(r["g"], r["x"]) for r in O.quantiles(d, ["g"], "x", [0.5], buckets).collect()} == {(None, 1.5), ("a", 4.0)}


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_brackets_find_the_same_quantiles(rows, spark, monkeypatch, accuracy):
    plain, d = rows
    at = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    monkeypatch.setattr(O, "counted", lambda *a: pytest.fail("the long way"))
    got = {(r["g"], r["q"]): r["x"] for r in O.quantiles(d, ["g"], "x", at, accuracy=accuracy).collect()}
    want = {(g, q): x for g in "abc" for q, x in zip(at, np.quantile([x for _, h, x in plain if h == g and x is not None], at), strict=True)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert O.quantiles(d, [], "x", [0.5], accuracy=accuracy).first()["x"] == pytest.approx(np.median([x for _, _, x in plain if x is not None]))
    monkeypatch.setattr(O, "GROUPS", 0)
    monkeypatch.setattr(O, "ENTRIES", 50)
    again = {(r["g"], r["q"]): r["x"] for r in O.quantiles(d, ["g"], "x", at, accuracy=accuracy).collect()}
    assert again.keys() == want.keys() and all(again[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_a_missed_bracket_takes_the_long_way(rows, monkeypatch):
    plain, d = rows
    monkeypatch.setattr(O, "_bracketed", lambda *a: None)
    assert O.quantiles(d, [], "x", [0.5]).first()["x"] == pytest.approx(np.median([x for _, _, x in plain if x is not None]))
