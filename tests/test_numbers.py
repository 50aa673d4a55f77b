"""Known answers, analytic values, and gates that must fire."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, special
from tidemark.functions import vector as V
from tidemark.operators import inference, registry, sketch


def test_comparability_key_known_answer(spark):
    parts = ["panel--x.heldout", "reference--x.bf16.heldout", "mean_of_run_means_tokenwise_kld", "reference_to_candidate", "float64", "same_stack", "native_head"]
    assert spark.range(1).select(registry.comparability_key(*map(F.lit, parts))).first()[0] == "cmp--4cac6dc7b760877a"


@pytest.mark.parametrize("part", [None, "a|b"])
def test_key_refuses_missing_parts_and_separators(spark, part):
    with pytest.raises(Exception, match="key part"):
        spark.range(1).select(registry.comparability_key(F.lit("x"), F.lit(part).cast("string"))).collect()


def test_paired_report_against_plain_numpy(spark):
    rng = np.random.default_rng(1)
    d = {g: np.round(rng.normal(0.02, 0.1, n), 2) for g, n in (("x", 30), ("y", 12), ("one", 1))}
    rows = [(g, k, float(v)) for g, own in d.items() for k, v in enumerate(own)]
    got = {r["g"]: r for r in inference.paired_report(spark.createDataFrame(rows, "g string, window_id int, b_minus_a double"), "g").collect()}
    for g in ("x", "y"):
        v, r = d[g], got[g]
        half = special.t_ppf(0.975, len(v) - 1) * v.std(ddof=1) / math.sqrt(len(v))
        assert (r["windows"], r["a_better"], r["b_better"], r["ties"]) == (len(v), (v > 0).sum(), (v < 0).sum(), (v == 0).sum())
        assert r["b_minus_a"] == pytest.approx(v.mean()) and r["t_low"] == pytest.approx(v.mean() - half) and r["t_high"] == pytest.approx(v.mean() + half)
        bca = inference.bca(v)
        assert (r["bca_low"], r["bca_high"]) == (pytest.approx(bca["bca_low"]), pytest.approx(bca["bca_high"]))
        n, k = (v != 0).sum(), min((v > 0).sum(), (v < 0).sum())
        assert r["sign_p"] == pytest.approx(min(1, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n))
        w = np.abs(v[v != 0])
        rank = np.array([(w < x).sum() + ((w == x).sum() + 1) / 2 for x in w])
        ties = sum(t**3 - t for t in np.unique(w, return_counts=True)[1])
        z = (rank[v[v != 0] > 0].sum() - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert r["wilcoxon_z"] == pytest.approx(z) and r["wilcoxon_p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert got["one"]["t_low"] is None and got["one"]["bca_low"] is None


def test_kl_of_a_row_with_itself_is_zero_and_analytic_value(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    r = d.select(V.kl(V.log_softmax(F.col("a")), V.log_softmax(F.col("a"))).alias("same"), V.kl(V.log_softmax(F.col("a")), V.log_softmax(F.col("b"))).alias("kl")).first()
    p = np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()
    assert r["same"] == 0.0
    assert abs(r["kl"] - float((p * np.log(3 * p)).sum())) < 1e-15


@pytest.mark.parametrize("b", [[1.0, float("nan")], [1.0, 2.0, 3.0]])
def test_checked_kl_refuses(spark, b):
    d = spark.createDataFrame([([0.0, 1.0], b)], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="refused divergence"):
        d.select(V.checked_kl(V.log_softmax(F.col("a")), V.log_softmax(F.col("b")))).collect()


def test_argmax_takes_the_first_of_equals(spark):
    assert spark.createDataFrame([([1.0, 5.0, 5.0],)], "v array<double>").select(V.first_argmax(F.col("v"))).first()[0] == 1


def test_histogram_bucket_is_the_number_of_edges_not_above(spark):
    import bisect

    values = [0.0, 1e-13, *sketch.EDGES, *(math.nextafter(e, 0) for e in sketch.EDGES), 250.0]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(sketch.bucket(F.col("v"))).collect()]
    assert got == [bisect.bisect_right(sketch.EDGES, v) for v in values]


def test_distributions():
    assert abs(special.t_ppf(0.975, 6) - 2.4469118511449692) < 1e-12
    assert abs(special.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(special.binomial_two_sided(5, 25) - 0.004077315330505371) < 1e-15
    assert special.binomial_two_sided(0, 4) == 0.125
    assert special.binomial_two_sided(0, 0) == 1.0


def test_bca_is_repeatable_and_holds_the_mean():
    v = np.random.default_rng(1).lognormal(size=25)
    a, b = inference.bca(v), inference.bca(v)
    assert a == b and a["bca_low"] < a["mean"] < a["bca_high"]


def test_codecs():
    x = np.array([1.0, -2.5, 0.15625], np.float32)
    assert (codecs.bf16_to_float32(codecs.float32_to_bf16(x).astype("<u2").tobytes()) == x).all()
    assert codecs.unpack_bits(bytes([0b11100100]), 2, 4).tolist() == [0, 1, 2, 3]
    assert codecs.e2m1(bytes([0x21, 0xF7]), np.array([2.0]), group=4).tolist() == [1.0, 2.0, 12.0, -12.0]
    assert codecs.E4M3[0x38] == 1.0 and codecs.E4M3[0x7E] == 448.0 and np.isnan(codecs.E4M3[0x7F])
    block = np.float16(0.5).tobytes() + np.arange(-16, 16, dtype=np.int8).tobytes()
    assert codecs.q8_0(block).tolist() == [0.5 * k for k in range(-16, 16)]
    with pytest.raises(ValueError, match="no decoder"):
        codecs.decode("Q9_X", b"")


def test_superblocks_decode_with_plain_scales():
    one = np.float16(1.0).tobytes()
    q4 = one + one + bytes([1] * 8) + bytes([0x11] * 4) + bytes([0x53] * 128)
    assert set(codecs.q4_k(q4).tolist()) == {2.0, 4.0}  # codes 3 and 5, scale 1, minimum 1
    q6 = bytes([0x00] * 128) + bytes([0xAA] * 64) + bytes([1] * 16) + one
    assert set(codecs.q6_k(q6).tolist()) == {0.0}  # high bits 2: code 32 is zero


def test_index_ranges_refuse_what_is_malformed():
    from tidemark.plans.registry_queries import _ids

    assert _ids("0-3,7") == [(0, 3), (7, 7)]
    for bad in ("3-1", "a", "1-", ""):
        with pytest.raises(ValueError, match="malformed"):
            _ids(bad)
