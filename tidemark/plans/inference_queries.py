"""Paired and interval inference over windows and documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import special as S
from tidemark.operators import inference as I
from tidemark.operators import ordering

from .aggregate_queries import k_rows, sql_k
from .catalog import query, table

T_TABLE = "tt(df, t) AS (VALUES " + ", ".join(f"({d}, CAST({S.t_ppf(0.975, d)!r} AS DOUBLE))" for d in range(1, 60)) + ")"
WM = "wm AS (SELECT label, window_id, avg(kld) AS m FROM k GROUP BY 1, 2)"


def window_means(spark: SparkSession, sf: str, bits: int = 4, kind: str = "perrow") -> DataFrame:
    return k_rows(spark, sf, bits, kind).groupBy("label", "window_id").agg(F.avg("kld").alias("m"))


@query("domain_table", f"WITH {sql_k()}, {WM}, {T_TABLE}, d AS (SELECT label, avg(m) AS mean, count(*) AS windows, stddev_samp(m) AS sd FROM wm GROUP BY label) SELECT label, windows, round(mean, 9) AS mean, CASE WHEN windows > 1 THEN round(exp(ln(mean) - t * sd / sqrt(windows) / mean), 8) END AS low, CASE WHEN windows > 1 THEN round(exp(ln(mean) + t * sd / sqrt(windows) / mean), 8) END AS high, windows < 10 AS small_g FROM d LEFT JOIN tt ON tt.df = windows - 1")
def domain_table(spark: SparkSession, sf: str) -> DataFrame:
    return I.delta_t_log(window_means(spark, sf), "label")


PAIR = f"a AS (SELECT label, window_id, m FROM (WITH {sql_k(4)}, {WM} SELECT * FROM wm)), b AS (SELECT label, window_id, m FROM (WITH {sql_k(6)}, {WM} SELECT * FROM wm)), p AS (SELECT label, window_id, a.m - b.m AS d FROM a JOIN b USING (label, window_id))"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = window_means(spark, sf, 4), window_means(spark, sf, 6).withColumnRenamed("m", "other")
    return a.join(b, ["label", "window_id"]).select("label", "window_id", (F.col("m") - F.col("other")).alias("d"))


@query("paired_delta", f"WITH {PAIR} SELECT label, count(*) AS windows, round(-avg(d), 9) AS b_minus_a, round(stddev_samp(d) / sqrt(count(*)), 9) AS se FROM p GROUP BY label")
def paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).groupBy("label").agg(F.count("*").alias("windows"), F.round(-F.avg("d"), 9).alias("b_minus_a"), F.round(F.stddev_samp("d") / F.sqrt(F.count("*")), 9).alias("se"))


@query("paired_report")
def paired_report(spark: SparkSession, sf: str) -> DataFrame:
    return I.paired_report(pairs(spark, sf).select("label", "window_id", (-F.col("d")).alias("b_minus_a")), "label")


@query("sign_counts", f"WITH {PAIR} SELECT label, CAST(count(*) FILTER (d < 0) AS BIGINT) AS a_better, CAST(count(*) FILTER (d > 0) AS BIGINT) AS b_better, CAST(count(*) FILTER (d = 0) AS BIGINT) AS ties FROM p GROUP BY label")
def sign_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).groupBy("label").agg(F.count_if(F.col("d") < 0).alias("a_better"), F.count_if(F.col("d") > 0).alias("b_better"), F.count_if(F.col("d") == 0).alias("ties"))


SIGN_P = "CASE WHEN a_better + b_better > 0 THEN round(least(1, 2 * list_sum([exp(lgamma(a_better + b_better + 1) - lgamma(k + 1) - lgamma(a_better + b_better - k + 1) - (a_better + b_better) * ln(CAST(2 AS DOUBLE))) FOR k IN range(0, least(a_better, b_better) + 1)])), 10) ELSE CAST('NaN' AS DOUBLE) END"


@query("sign_test", f"WITH {PAIR}, s AS (SELECT label, CAST(count(*) FILTER (d < 0) AS BIGINT) AS a_better, CAST(count(*) FILTER (d > 0) AS BIGINT) AS b_better, CAST(count(*) FILTER (d = 0) AS BIGINT) AS ties FROM p GROUP BY label) SELECT *, {SIGN_P} AS p FROM s")
def sign_test(spark: SparkSession, sf: str) -> DataFrame:
    return sign_counts(spark, sf).withColumn("p", F.round(S.sign_test_p("a_better", "b_better"), 10))


DOC = "d AS (SELECT l_orderkey AS doc, avg(l_discount - l_tax) AS diff FROM lineitem GROUP BY 1)"


@query("document_level_paired", f"WITH {DOC} SELECT count(*) AS documents, round(avg(diff), 9) AS mean, round(stddev_samp(diff) / sqrt(count(*)), 9) AS se, CAST(count(*) FILTER (diff < 0) AS BIGINT) AS a_better, CAST(count(*) FILTER (diff > 0) AS BIGINT) AS b_better FROM d")
def document_level_paired(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("diff"))
    return d.agg(F.count("*").alias("documents"), F.round(F.avg("diff"), 9).alias("mean"), F.round(F.stddev_samp("diff") / F.sqrt(F.count("*")), 9).alias("se"), F.count_if(F.col("diff") < 0).alias("a_better"), F.count_if(F.col("diff") > 0).alias("b_better"))


@query("mcnemar_counts", "WITH c AS (SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS b01, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS BIGINT) AS b10 FROM labels) SELECT b01 AS a_only, b10 AS b_only, b01 + b10 AS discordant, CASE WHEN b01 + b10 > 0 THEN round(greatest(abs(b01 - b10) - 1, 0) ** 2 / CAST(b01 + b10 AS DOUBLE), 9) END AS chi2 FROM c")
def mcnemar_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "labels").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("a_only"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("b_only"))
    n = F.col("a_only") + F.col("b_only")
    return c.select("a_only", "b_only", n.alias("discordant"), F.when(n > 0, F.round(F.greatest(F.abs(F.col("a_only") - F.col("b_only")) - 1, F.lit(0)) ** 2 / n, 9)).alias("chi2"))


@query("mcnemar_test")
def mcnemar_test(spark: SparkSession, sf: str) -> DataFrame:
    return mcnemar_counts(spark, sf).withColumns({"p": S.chi2_upper("chi2", F.lit(1.0)), "p_exact": S.sign_test_p("a_only", "b_only")})


WIL = "WITH d AS (SELECT event_type, event_id, round(value, 0) - 20 AS d FROM events WHERE round(value, 0) <> 20), r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / CAST(2 AS DOUBLE) AS rk, count(*) OVER (PARTITION BY event_type, abs(d)) AS t FROM d WINDOW w AS (PARTITION BY event_type ORDER BY abs(d))) "


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select("event_type", "event_id", (F.round("value", 0) - 20).alias("d")).where("d <> 0")
    return ordering.average_ranks(d, "event_type", F.abs("d"))


@query("average_ranks", WIL + "SELECT event_type, event_id, rk FROM r")
def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return ranks(spark, sf).select("event_type", "event_id", "rk")


@query("wilcoxon_ranks", WIL + ", s AS (SELECT event_type, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1) SELECT event_type, n, w AS w_plus, round((w - n * (n + 1) / CAST(4 AS DOUBLE)) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48), 9) AS z FROM s")
def wilcoxon_ranks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select("event_type", (F.round("value", 0) - 20).alias("d"))
    return I.signed_ranks(d, "event_type", "d").select("event_type", "n", "w_plus", F.round("z", 9).alias("z"))


@query("wilcoxon_test")
def wilcoxon_test(spark: SparkSession, sf: str) -> DataFrame:
    return wilcoxon_ranks(spark, sf).withColumn("p", F.least(F.lit(1.0), 2 * (1 - S.norm_cdf(F.abs("z")))))


@query("wider_interval", f"WITH {sql_k()}, {WM}, s AS (SELECT label, avg(m) AS mu, stddev_samp(m) / sqrt(count(*)) AS se, max(m) - min(m) AS r FROM wm GROUP BY label) SELECT label, round(CASE WHEN r >= 2 * 1.96 * se THEN mu - r / 2 ELSE mu - 1.96 * se END, 9) AS low, CASE WHEN r >= 2 * 1.96 * se THEN 'range' ELSE 'z' END AS source FROM s")
def wider_interval(spark: SparkSession, sf: str) -> DataFrame:
    s = window_means(spark, sf).groupBy("label").agg(F.avg("m").alias("mu"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"), (F.max("m") - F.min("m")).alias("r"))
    wide = F.col("r") >= 2 * 1.96 * F.col("se")
    return s.select("label", F.round(F.when(wide, F.col("mu") - F.col("r") / 2).otherwise(F.col("mu") - 1.96 * F.col("se")), 9).alias("low"), F.when(wide, "range").otherwise("z").alias("source"))


@query("comparison_class", "WITH s AS (SELECT *, coalesce(lead(s_suppkey) OVER (ORDER BY s_suppkey), min(s_suppkey) OVER ()) AS next FROM supplier) SELECT a.s_suppkey AS id, CASE WHEN a.s_nationkey % 4 = 0 THEN 'refused: same states, other head' WHEN sha256(a.s_name) = sha256(b.s_name) THEN 'reproduction' WHEN a.s_nationkey = b.s_nationkey THEN 'run-to-run floor' ELSE 'measurement' END AS class FROM s a JOIN supplier b ON b.s_suppkey = CASE WHEN a.s_suppkey % 3 = 0 THEN a.s_suppkey ELSE a.next END")
def comparison_class(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier against itself or the one with the next key; the last key's next is the first."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.sha2("s_name", 256).alias("h"))
    width = max(1, math.isqrt(s.count()))  # the next key is sought in a block of keys, else in the next block; both are as many as the root of the rows
    a = s.withColumn("block", F.floor(F.col("s_suppkey") / width))
    blocks = a.groupBy("block").agg(F.min("s_suppkey").alias("first"))
    after = blocks.select("block", F.coalesce(F.lead("first").over(Window.orderBy("block")), F.min("first").over(Window.partitionBy())).alias("after"))
    a = a.withColumn("next", F.lead("s_suppkey").over(Window.partitionBy("block").orderBy("s_suppkey"))).join(after, "block")
    a = a.select(F.col("s_suppkey").alias("id"), "n", "h", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")).otherwise(F.coalesce("next", "after")).alias("other"))
    b = s.select(F.col("s_suppkey").alias("other"), F.col("n").alias("n2"), F.col("h").alias("h2"))
    c = F.when(F.col("n") % 4 == 0, "refused: same states, other head").when(F.col("h") == F.col("h2"), "reproduction").when(F.col("n") == F.col("n2"), "run-to-run floor").otherwise("measurement")
    return a.join(b, "other").select("id", c.alias("class"))


@query("bca_interval")
def bca_interval(spark: SparkSession, sf: str) -> DataFrame:
    return I.bca_by(window_means(spark, sf), "label")


@query("cluster_bootstrap")
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("cluster")).agg(F.sum("l_discount").alias("total"), F.count("*").alias("n"))
    return I.cluster_bootstrap(c, "l_returnflag")


@query("bootstrap_t_log")
def bootstrap_t_log(spark: SparkSession, sf: str) -> DataFrame:
    return I.bootstrap_t_log(window_means(spark, sf), "label")


@query("position_bootstrap")
def position_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return I.position_bootstrap(k_rows(spark, sf).select("window_id", F.col("kld").alias("x")))
