"""Aggregates over scored rows, runs, shards and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import ordering, scoring, sketch

from .catalog import query, table
from .vector_queries import SQL_KL, sql_lp


def sql_k(bits: int = 4) -> str:
    return f"{sql_lp(bits)}, k AS (SELECT vec_id, vec_id // 25 AS window_id, vec_id % 25 AS position, label, {SQL_KL} AS kld FROM lp)"


W = "w AS (SELECT window_id, count(*) AS n, avg(kld) AS m, stddev_samp(kld) AS sd FROM k GROUP BY 1)"
WL = "w AS (SELECT window_id, label, count(*) AS n, avg(kld) AS m, stddev_samp(kld) AS sd FROM k GROUP BY 1, 2)"


def k_rows(spark: SparkSession, sf: str, bits: int = 4, kind: str = "perrow") -> DataFrame:
    return scoring.scored(table(spark, sf, "embeddings"), bits=bits, kind=kind).select("vec_id", "window_id", "position", "label", "kld")


@query("token_vs_macro_mean", f"WITH {sql_k()}, {WL} SELECT round(sum(m * n) / sum(n), 9) AS token_mean, round(avg(m), 9) AS macro_mean, count(*) AS contexts, CAST(sum(n) AS BIGINT) AS positions FROM w")
def token_vs_macro_mean(spark: SparkSession, sf: str) -> DataFrame:
    return A.windows(k_rows(spark, sf), "label").agg(F.round(A.weighted_mean("m", "n"), 9).alias("token_mean"), F.round(F.avg("m"), 9).alias("macro_mean"), F.count("*").alias("contexts"), F.sum("n").alias("positions"))


@query("stratum_rollup", f"WITH {sql_k()}, {WL} SELECT label AS stratum, count(*) AS contexts, CAST(sum(n) AS BIGINT) AS positions, round(sum(m * n) / sum(n), 9) AS token_mean, round(avg(m), 9) AS macro_mean, round(max(m), 9) AS worst FROM w GROUP BY label")
def stratum_rollup(spark: SparkSession, sf: str) -> DataFrame:
    w = A.windows(k_rows(spark, sf), "label")
    return w.groupBy(F.col("label").alias("stratum")).agg(F.count("*").alias("contexts"), F.sum("n").alias("positions"), F.round(A.weighted_mean("m", "n"), 9).alias("token_mean"), F.round(F.avg("m"), 9).alias("macro_mean"), F.round(F.max("m"), 9).alias("worst"))


@query("domain_window_means", f"WITH {sql_k()}, {WL} SELECT label, round(avg(m), 9) AS mean_of_window_means, count(*) AS windows FROM w GROUP BY label")
def domain_window_means(spark: SparkSession, sf: str) -> DataFrame:
    return A.windows(k_rows(spark, sf), "label").groupBy("label").agg(F.round(F.avg("m"), 9).alias("mean_of_window_means"), F.count("*").alias("windows"))


@query("depth_buckets", f"WITH {sql_k()}, b AS (SELECT window_id, CASE WHEN position < 5 THEN '0-4' WHEN position < 10 THEN '5-9' WHEN position < 15 THEN '10-14' ELSE '15-24' END AS depth, avg(kld) AS m, count(*) AS n FROM k GROUP BY 1, 2) SELECT depth, round(avg(m), 9) AS mean_kld, CAST(sum(n) AS BIGINT) AS positions FROM b GROUP BY depth")
def depth_buckets(spark: SparkSession, sf: str) -> DataFrame:
    b = k_rows(spark, sf).groupBy("window_id", A.bucket(F.col("position"), [0, 5, 10, 15, 25]).alias("depth")).agg(F.avg("kld").alias("m"), F.count("*").alias("n"))
    return b.groupBy("depth").agg(F.round(F.avg("m"), 9).alias("mean_kld"), F.sum("n").alias("positions"))


@query("stats_block", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, CAST(0.5 AS DOUBLE)), 4) AS median, round(quantile_cont(l_extendedprice, CAST(0.95 AS DOUBLE)), 4) AS p95, round(quantile_cont(l_extendedprice, CAST(0.99 AS DOUBLE)), 4) AS p99, round(quantile_cont(l_extendedprice, CAST(0.999 AS DOUBLE)), 4) AS p999, round(max(l_extendedprice), 4) AS max FROM lineitem GROUP BY l_returnflag")
def stats_block(spark: SparkSession, sf: str) -> DataFrame:
    return A.stats_block(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 4)


@query("rental_spread", "WITH g AS (SELECT l_returnflag AS provider, l_linestatus AS gpu, count(*) AS n, min(l_extendedprice) AS lo, quantile_cont(l_extendedprice, CAST(0.5 AS DOUBLE)) AS med, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2) SELECT provider, gpu, n, round(lo, 4) AS lowest, round(med, 4) AS median, round(hi, 4) AS highest, round(hi / nullif(lo, 0), 2) AS spread, row_number() OVER (ORDER BY med NULLS LAST, provider, gpu) AS place FROM g")
def rental_spread(spark: SparkSession, sf: str) -> DataFrame:
    by = ["provider", "gpu"]
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("gpu"), "l_extendedprice")
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    g = g.join(ordering.wide(ordering.quantiles(d, by, "l_extendedprice", [0.5]), by, {0.5: "med"}), by, "left")
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("med"), "provider", "gpu")).cast("long")  # a row per pair
    return g.select("provider", "gpu", "n", F.round("lo", 4).alias("lowest"), F.round("med", 4).alias("median"), F.round("hi", 4).alias("highest"), F.round(F.try_divide("hi", "lo"), 2).alias("spread"), place.alias("place"))


POOLED = f"WITH {sql_k()}, {W}, g AS (SELECT sum(m * n) / sum(n) AS gm, sum(n) AS nn, count(*) AS g FROM w), s AS (SELECT gm, nn, g, sum((n - 1) * sd * sd + n * (m - gm) * (m - gm)) AS ss, sum((n * (m - gm)) * (n * (m - gm))) AS cc FROM w, g GROUP BY 1, 2, 3) "


@query("pooled_variance", POOLED + "SELECT CAST(nn AS BIGINT) AS n, g AS windows, round(gm, 9) AS mean, round(sqrt(ss / (nn - 1)), 9) AS pooled_sd, round(sqrt(ss / (nn - 1) / nn), 9) AS se_naive FROM s")
def pooled_variance(spark: SparkSession, sf: str) -> DataFrame:
    return A.pooled(A.windows(k_rows(spark, sf))).select(F.col("nn").alias("n"), F.col("g").alias("windows"), F.round("gm", 9).alias("mean"), F.round("pooled_sd", 9).alias("pooled_sd"), F.round("se_naive", 9).alias("se_naive"))


@query("clustered_se", POOLED + "SELECT round(sqrt(CAST(g AS DOUBLE) / (g - 1) * cc) / nn, 9) AS se_clustered, round((sqrt(CAST(g AS DOUBLE) / (g - 1) * cc) / nn / sqrt(ss / (nn - 1) / nn)) ** 2, 6) AS design_effect FROM s")
def clustered_se(spark: SparkSession, sf: str) -> DataFrame:
    return A.pooled(A.windows(k_rows(spark, sf))).select(F.round("se_clustered", 9).alias("se_clustered"), F.round(F.try_divide("se_clustered", "se_naive") ** 2, 6).alias("design_effect"))


@query("population_sd", "SELECT event_type, round(stddev_pop(value), 8) AS sd FROM events GROUP BY event_type")
def population_sd(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.stddev_pop("value"), 8).alias("sd"))


RUNS = f"WITH {sql_k()}, r AS (SELECT label, position % 5 AS run, avg(kld) AS m FROM k GROUP BY 1, 2), s AS (SELECT label, count(*) AS runs, stddev_samp(m) AS sigma, avg(m) AS mean, max(m) - min(m) AS spread FROM r GROUP BY label), e AS (SELECT label, stddev_samp(kld) / sqrt(count(*)) AS se FROM k GROUP BY label) "


@query("sigma_run_quadrature", RUNS + "SELECT label, runs, round(sigma, 9) AS sigma_run, round(spread, 9) AS spread, round(se, 9) AS se_stat, round(sqrt(se * se + sigma * sigma), 9) AS se_total, sigma / se <= 0.2 AS gate_ok FROM s JOIN e USING (label)")
def sigma_run_quadrature(spark: SparkSession, sf: str) -> DataFrame:
    k = k_rows(spark, sf)
    s = k.groupBy("label", (F.col("position") % 5).alias("run")).agg(F.avg("kld").alias("m")).groupBy("label").agg(F.count("*").alias("runs"), F.stddev_samp("m").alias("sigma"), (F.max("m") - F.min("m")).alias("spread"))
    e = k.groupBy("label").agg((F.stddev_samp("kld") / F.sqrt(F.count("*"))).alias("se"))
    return s.join(e, "label").select("label", "runs", F.round("sigma", 9).alias("sigma_run"), F.round("spread", 9).alias("spread"), F.round("se", 9).alias("se_stat"), F.round(F.hypot("se", "sigma"), 9).alias("se_total"), (F.try_divide("sigma", "se") <= 0.2).alias("gate_ok"))


@query("determinism_verdict", "WITH r AS (SELECT o_custkey % 500 AS row_id, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE sha256(CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE 'same' END) END AS digest FROM orders) SELECT row_id, count(*) AS runs, count(DISTINCT CASE WHEN length(digest) = 64 THEN digest END) AS digests, CASE WHEN count(DISTINCT CASE WHEN length(digest) = 64 THEN digest END) > 1 THEN 'false' WHEN count(*) >= 2 AND count(CASE WHEN length(digest) = 64 THEN 1 END) = count(*) AND count(DISTINCT CASE WHEN length(digest) = 64 THEN digest END) = 1 THEN 'true' ELSE 'unknown' END AS verdict FROM r GROUP BY row_id")
def determinism_verdict(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "orders").select((F.col("o_custkey") % 500).alias("row_id"), F.when(F.col("o_orderkey") % 11 == 0, "none").otherwise(F.sha2(F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderstatus")).otherwise("same"), 256)).alias("digest"))
    return r.groupBy("row_id").agg(F.count("*").alias("runs"), F.count_distinct(F.when(F.length("digest") == 64, F.col("digest"))).alias("digests"), A.determinism("digest").alias("verdict"))


SQL_V = "CASE WHEN count(DISTINCT CASE WHEN {c} <> 'unrecorded' THEN {c} END) > 1 THEN 'fail' WHEN sum(CASE WHEN {c} = 'unrecorded' THEN 1 ELSE 0 END) > 0 THEN 'unknown' ELSE 'pass' END"
MEMBERS = "WITH m AS (SELECT o_custkey AS grp, CASE WHEN o_orderkey % 7 = 0 THEN 'unrecorded' ELSE 'lane' || CAST(o_custkey % 2 AS VARCHAR) END AS lane, CASE WHEN o_custkey % 5 = 0 THEN o_orderstatus ELSE 'p' END AS pipeline FROM orders), v AS (SELECT grp, count(*) AS members, " + SQL_V.format(c="lane") + " AS lane, " + SQL_V.format(c="pipeline") + " AS pipeline FROM m GROUP BY grp) "


@query("group_predicate", MEMBERS + "SELECT grp, members, lane, pipeline, CASE WHEN lane = 'fail' OR pipeline = 'fail' THEN 'false' WHEN lane = 'unknown' OR pipeline = 'unknown' THEN 'unknown' ELSE 'true' END AS comparable FROM v")
def group_predicate(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.when(F.col("o_orderkey") % 7 == 0, "unrecorded").otherwise(F.concat(F.lit("lane"), (F.col("o_custkey") % 2).cast("string"))).alias("lane"), F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderstatus")).otherwise("p").alias("pipeline"))
    v = m.groupBy("grp").agg(F.count("*").alias("members"), A.verdict_of(F.col("lane")).alias("lane_v"), A.verdict_of(F.col("pipeline")).alias("pipeline_v"))
    return v.select("grp", "members", F.col("lane_v").alias("lane"), F.col("pipeline_v").alias("pipeline"), A.combined(["lane_v", "pipeline_v"]).alias("comparable"))


@query("scope_digest", "SELECT s_nationkey AS scope, sha256(string_agg(seg, '|' ORDER BY seg)) AS digest FROM (SELECT s_nationkey, 'class' || CAST(s_suppkey % 5 AS VARCHAR) || '=quant:' || CAST(s_suppkey AS VARCHAR) || '@4' AS seg FROM supplier) GROUP BY 1")
def scope_digest(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.concat(F.lit("class"), (F.col("s_suppkey") % 5).cast("string"), F.lit("=quant:"), F.col("s_suppkey").cast("string"), F.lit("@4"))
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("scope")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(seg)), "|"), 256).alias("digest"))


@query("suite_hash", "SELECT source, count(*) AS records, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS suite_sha256 FROM documents GROUP BY source")
def suite_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("records"), A.digest_in_order("doc_id", F.sha2("text", 256)).alias("suite_sha256"))


@query("capture_digest", "SELECT conv_id, count(*) AS records, count(*) - count(DISTINCT turn) AS duplicate_indexes, sha256(string_agg(CAST(turn AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY turn)) AS content_sha256 FROM conversations GROUP BY conv_id")
def capture_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("records"), (F.count("*") - F.count_distinct("turn")).alias("duplicate_indexes"), A.digest_in_order("turn", F.concat_ws(":", F.col("turn").cast("string"), F.sha2("text", 256))).alias("content_sha256"))


@query("functional_dependency", "WITH p AS (SELECT DISTINCT l_orderkey, l_shipdate FROM lineitem), a AS (SELECT max(n) = 1 AS x FROM (SELECT count(*) AS n FROM p GROUP BY l_orderkey)), b AS (SELECT max(n) = 1 AS y FROM (SELECT count(*) AS n FROM p GROUP BY l_shipdate)) SELECT x AS l_shipdate_by_l_orderkey, y AS l_orderkey_by_l_shipdate FROM a, b")
def functional_dependency(spark: SparkSession, sf: str) -> DataFrame:
    return A.depends(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")


@query("partition_by_digest", "SELECT sha256(text) AS digest, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def partition_by_digest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return d.where("n > 1").select("digest", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("members"))


LADDER = (1_000, 2_000, 5_000, 10_000, 1_000_000)


@query("ladder_state", "SELECT event_type, count(*) AS positions, " + "CASE " + " ".join(f"WHEN count(*) >= {x} THEN {x}" for x in reversed(LADDER)) + " END AS rung FROM events GROUP BY event_type")
def ladder_state(spark: SparkSession, sf: str) -> DataFrame:
    rung = F
    for x in reversed(LADDER):
        rung = rung.when(F.count("*") >= x, F.lit(x))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("positions"), rung.alias("rung"))


ATTR = f"WITH {sql_k(4)}, f AS (SELECT label, avg(kld) AS fl FROM (WITH {sql_k(8)} SELECT label, kld FROM k) GROUP BY label), c AS (SELECT label, avg(kld) AS m FROM k GROUP BY label) "


@query("attributable", ATTR + "SELECT label, round(m, 9) AS mean_kld, round(fl, 9) AS floor, round(m - fl, 9) AS attributable, round((m - fl) / nullif(m, 0), 9) AS fraction FROM c JOIN f USING (label)")
def attributable(spark: SparkSession, sf: str) -> DataFrame:
    c = k_rows(spark, sf, 4).groupBy("label").agg(F.avg("kld").alias("m"))
    f = k_rows(spark, sf, 8).groupBy("label").agg(F.avg("kld").alias("fl"))
    gap = F.col("m") - F.col("fl")
    return c.join(f, "label").select("label", F.round("m", 9).alias("mean_kld"), F.round("fl", 9).alias("floor"), F.round(gap, 9).alias("attributable"), F.round(F.try_divide(gap, F.col("m")), 9).alias("fraction"))


@query("attributable_ratio", ATTR + "SELECT a.label AS label_a, b.label AS label_b, round((a.m - fa.fl) / nullif(b.m - fb.fl, 0), 6) AS ratio FROM c a JOIN f fa ON fa.label = a.label, c b JOIN f fb ON fb.label = b.label WHERE a.label < b.label")
def attributable_ratio(spark: SparkSession, sf: str) -> DataFrame:
    d = attributable_raw(spark, sf)
    b = d.select(F.col("label").alias("label_b"), F.col("gap").alias("gap_b"))
    pairs = d.join(F.broadcast(b), F.col("label") < F.col("label_b"))  # one row per domain on each side
    return pairs.select(F.col("label").alias("label_a"), "label_b", F.round(F.try_divide("gap", "gap_b"), 6).alias("ratio"))


def attributable_raw(spark: SparkSession, sf: str) -> DataFrame:
    c = k_rows(spark, sf, 4).groupBy("label").agg(F.avg("kld").alias("m"))
    return c.join(k_rows(spark, sf, 8).groupBy("label").agg(F.avg("kld").alias("fl")), "label").select("label", (F.col("m") - F.col("fl")).alias("gap"))


@query("tail_disclosure", f"WITH {sql_k()}, s AS (SELECT window_id, count(*) AS m FROM k GROUP BY 1), c AS (SELECT k.kld, k.kld / m / (SELECT count(*) FROM s) AS part, row_number() OVER (ORDER BY k.kld / m DESC, k.vec_id) AS rn FROM k JOIN s USING (window_id)) SELECT round(max(kld), 9) AS max_value, round(sum(CASE WHEN rn <= 3 THEN part ELSE 0 END) / nullif(sum(part), 0), 9) AS top3_share FROM c")
def tail_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    k = k_rows(spark, sf)
    s = k.groupBy("window_id").agg(F.count("*").alias("m"))
    c = k.join(s, "window_id").withColumn("part", F.col("kld") / F.col("m"))
    top = c.orderBy(F.desc("part"), "vec_id").limit(3).agg(F.sum("part").alias("t"))  # a top-k, not a global window
    return c.agg(F.max("kld").alias("x"), F.sum("part").alias("s")).join(F.broadcast(top)).select(F.round("x", 9).alias("max_value"), F.round(F.try_divide("t", "s"), 9).alias("top3_share"))


@query("half_declared_counts", "SELECT l_orderkey % 20 AS panel, CASE WHEN count(n) = 0 THEN 'equal' WHEN count(n) < count(*) THEN 'refused' ELSE 'weighted' END AS weighting, CASE WHEN count(n) = 0 THEN round(avg(x), 6) WHEN count(n) = count(*) THEN round(sum(x * n) / sum(n), 6) END AS mean FROM (SELECT l_orderkey, l_discount AS x, CASE WHEN l_orderkey % 20 < 5 THEN NULL WHEN l_orderkey % 20 < 10 AND l_linenumber = 2 THEN NULL ELSE l_quantity END AS n FROM lineitem) GROUP BY 1")
def half_declared_counts(spark: SparkSession, sf: str) -> DataFrame:
    panel = F.col("l_orderkey") % 20
    d = table(spark, sf, "lineitem").select(panel.alias("panel"), F.col("l_discount").alias("x"), F.when((panel < 5) | (panel < 10) & (F.col("l_linenumber") == 2), None).otherwise(F.col("l_quantity")).alias("n"))
    none, some = F.count("n") == 0, F.count("n") < F.count("*")
    return d.groupBy("panel").agg(F.when(none, "equal").when(some, "refused").otherwise("weighted").alias("weighting"), F.when(none, F.round(F.avg("x"), 6)).when(~some, F.round(A.weighted_mean("x", "n"), 6)).alias("mean"))


@query("row_vs_summary", "WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) AS total FROM lineitem GROUP BY 1), g AS (SELECT o_orderkey, total, o_totalprice, abs(total - o_totalprice) / nullif(greatest(abs(total), abs(o_totalprice)), 0) AS gap FROM orders JOIN s ON o_orderkey = l_orderkey) SELECT count(*) AS orders, CAST(count(*) FILTER (gap <= 0.05) AS BIGINT) AS consistent, round(avg(gap), 6) AS mean_gap FROM g")
def row_vs_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("total"))
    g = table(spark, sf, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).select(F.try_divide(F.abs(F.col("total") - F.col("o_totalprice")), F.greatest(F.abs("total"), F.abs("o_totalprice"))).alias("gap"))
    return g.agg(F.count("*").alias("orders"), F.count_if(F.col("gap") <= 0.05).alias("consistent"), F.round(F.avg("gap"), 6).alias("mean_gap"))


@query("corpus_totals", "SELECT lang AS stratum, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(*) FILTER (strlen(text) < 400) AS BIGINT) AS too_short FROM documents GROUP BY lang")
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.octet_length("text") < 400).alias("too_short"))


@query("bit_histogram", "SELECT p_type AS kind, p_size % 4 + 3 AS bits, count(*) AS n FROM part GROUP BY 1, 2")
def bit_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("kind"), (F.col("p_size") % 4 + 3).alias("bits")).agg(F.count("*").alias("n"))


@query("kept_windows_mean", f"WITH {sql_k()}, {W} SELECT count(*) AS windows, round(avg(m), 9) AS mean FROM w WHERE window_id % 3 <> 1")
def kept_windows_mean(spark: SparkSession, sf: str) -> DataFrame:
    w = A.windows(k_rows(spark, sf))
    keep = w.select("window_id").where("window_id % 3 <> 1")
    return w.join(keep, "window_id", "left_semi").agg(F.count("*").alias("windows"), F.round(F.avg("m"), 9).alias("mean"))


@query("code_identity", "SELECT p_brand, 'harness--' || substr(sha256('boundary' || chr(10) || string_agg(p_type || '=' || sha256(p_name), chr(10) ORDER BY p_type, p_partkey)), 1, 16) AS identity FROM part GROUP BY p_brand")
def code_identity(spark: SparkSession, sf: str) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("p_type", "p_partkey", F.concat("p_type", F.lit("="), F.sha2("p_name", 256)).alias("v")))), lambda x: x["v"])
    return table(spark, sf, "part").groupBy("p_brand").agg(F.concat(F.lit("harness--"), F.substring(F.sha2(F.concat(F.lit("boundary\n"), F.array_join(roles, "\n")), 256), 1, 16)).alias("identity"))


EDGE_SQL = "[" + ", ".join(f"CAST({e!r} AS DOUBLE)" for e in sketch.EDGES) + "]"
HIST = f"WITH {sql_k()}, e AS (SELECT {EDGE_SQL} AS edges), h AS (SELECT len([x FOR x IN edges if x <= kld]) AS bucket, count(*) AS n, max(kld) AS top FROM k, e GROUP BY 1)"


@query("kld_histogram", HIST + " SELECT CAST(bucket AS INTEGER) AS bucket, n FROM h")
def kld_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.histogram(k_rows(spark, sf), "kld").select("bucket", "n")


@query("histogram_merge", HIST + " SELECT CAST(bucket AS INTEGER) AS bucket, n, round(top, 9) AS top FROM h")
def histogram_merge(spark: SparkSession, sf: str) -> DataFrame:
    shards = sketch.histogram(k_rows(spark, sf).withColumn("shard", F.col("window_id") % 4), "kld", "shard")
    return sketch.merged(shards).select("bucket", "n", F.round("top", 9).alias("top"))


@query("histogram_quantile_bounds", HIST + ", c AS (SELECT bucket, n, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total, max(top) OVER () AS top FROM h), q AS (SELECT CAST(unnest([0.5, 0.9, 0.95, 0.99]) AS DOUBLE) AS q), d AS (SELECT *, (total - 1) * q AS hh FROM c, q), r AS (SELECT *, CAST(floor(hh) AS BIGINT) + 1 AS k, CASE WHEN hh = floor(hh) THEN CAST(floor(hh) AS BIGINT) + 1 ELSE least(CAST(floor(hh) AS BIGINT) + 2, total) END AS k2 FROM d) SELECT q AS quantile, max(CASE WHEN upto >= k AND upto - n < k THEN CASE WHEN bucket = 0 THEN CAST(0 AS DOUBLE) ELSE edges[bucket] END END) AS lower, round(max(CASE WHEN upto >= k2 AND upto - n < k2 THEN least(coalesce(edges[bucket + 1], top), top) END), 12) AS upper, CAST(max(total) AS BIGINT) AS total FROM r, e GROUP BY q")
def histogram_quantile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    d = sketch.quantile_bounds(sketch.histogram(k_rows(spark, sf), "kld"), [0.5, 0.9, 0.95, 0.99])
    return d.select(F.col("q").alias("quantile"), "lower", F.round("upper", 12).alias("upper"), "total")


@query("exceedance", HIST + ", p AS (SELECT unnest([-4, -3, -2, -1, 0]) AS log10) SELECT log10, CAST(coalesce((SELECT sum(CASE WHEN kld >= 10.0 ** log10 THEN 1 ELSE 0 END) FROM k), 0) AS BIGINT) AS positions FROM p")
def exceedance(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.exceedances(sketch.histogram(k_rows(spark, sf), "kld"), [-4, -3, -2, -1, 0])


STRAT = f"WITH {sql_k()}, s AS (SELECT window_id AS w, kld AS x FROM k WHERE position % 3 = 0), a AS (SELECT w, count(*) AS m, avg(x) AS mean, coalesce(var_samp(x), 0) AS s2 FROM s GROUP BY w), b AS (SELECT a.*, CAST(25 AS DOUBLE) AS nn, CAST(25 AS DOUBLE) / (25 * (SELECT count(*) FROM a)) AS share FROM a), r AS (SELECT sum(share * mean) AS mu, sum(CASE WHEN m > 1 THEN share ** 2 * (1 - m / nn) * s2 / m ELSE 0 END) AS v FROM b) "


@query("stratified_fpc", STRAT + "SELECT round(mu, 9) AS mean, round(v, 12) AS variance, round(mu - 1.959963984540054 * sqrt(v), 9) AS low, round(mu + 1.959963984540054 * sqrt(v), 9) AS high FROM r")
def stratified_fpc(spark: SparkSession, sf: str) -> DataFrame:
    d = A.stratified(k_rows(spark, sf).where("position % 3 = 0").select(F.col("window_id").alias("w"), F.lit(25.0).alias("nn"), F.col("kld").alias("x")))
    half = F.lit(1.959963984540054) * F.sqrt("var")
    return d.select(F.round("mu", 9).alias("mean"), F.round("var", 12).alias("variance"), F.round(F.col("mu") - half, 9).alias("low"), F.round(F.col("mu") + half, 9).alias("high"))


@query("panel_gate", f"WITH {sql_k()}, p AS (SELECT label % 3 AS panel, window_id, avg(kld) AS m FROM k WHERE NOT (label % 3 = 1 AND window_id = 4) GROUP BY 1, 2) SELECT panel, count(*) AS used, CASE WHEN count(*) = (SELECT count(DISTINCT window_id) FROM k) THEN round(avg(m), 9) END AS panel_mean, CASE WHEN count(*) = (SELECT count(DISTINCT window_id) FROM k) THEN 'all windows' ELSE 'refused: window subset' END AS reason FROM p GROUP BY panel")
def panel_gate(spark: SparkSession, sf: str) -> DataFrame:
    k = k_rows(spark, sf)
    total = k.agg(F.count_distinct("window_id").alias("t"))
    p = k.where("NOT (label % 3 = 1 AND window_id = 4)").groupBy((F.col("label") % 3).alias("panel"), "window_id").agg(F.avg("kld").alias("m")).groupBy("panel").agg(F.count("*").alias("used"), F.avg("m").alias("mean"))
    full = F.col("used") == F.col("t")
    return p.join(F.broadcast(total)).select("panel", "used", F.when(full, F.round("mean", 9)).alias("panel_mean"), F.when(full, "all windows").otherwise("refused: window subset").alias("reason"))
