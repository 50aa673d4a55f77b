"""Scoring a candidate's rows against a teacher's.

Teacher rows are ``embedding * 16`` in double; a candidate is the same row after rounding to
nearest at some width.  A window is ``vec_id div 25``, a position ``vec_id % 25``, a domain ``label``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.operators import scoring

from .catalog import query, table

TEACHER = "t AS (SELECT vec_id, label, [CAST(x AS DOUBLE) * 16 FOR x IN embedding] AS v FROM embeddings)"


def sql_rtn(bits: int, src: str = "t") -> str:
    q = 2 ** (bits - 1) - 1
    return (
        f"s0_{bits} AS (SELECT vec_id, label, v, list_max([abs(x) FOR x IN v]) / CAST({q} AS DOUBLE) AS s0 FROM {src}), "
        f"s_{bits} AS (SELECT vec_id, label, v, CASE WHEN s0 = 0 THEN CAST(1 AS DOUBLE) ELSE s0 END AS s FROM s0_{bits}), "
        f"q_{bits} AS (SELECT vec_id, label, v, [least(greatest(round_even(x / s, 0), CAST({-q - 1} AS DOUBLE)), CAST({q} AS DOUBLE)) * s FOR x IN v] AS w FROM s_{bits})"
    )


def sql_lsm(col: str) -> str:
    return f"[x - (list_max({col}) + ln(list_sum([exp(y - list_max({col})) FOR y IN {col}]))) FOR x IN {col}]"


def sql_lp(bits: int) -> str:
    return f"{TEACHER}, {sql_rtn(bits)}, lp AS (SELECT vec_id, label, v, w, {sql_lsm('v')} AS p, {sql_lsm('w')} AS q FROM q_{bits})"


SQL_KL = "list_sum([exp(p[i]) * (p[i] - q[i]) FOR i IN range(1, len(p) + 1)])"


@query("rtn_quantize", f"WITH {TEACHER}, {sql_rtn(4)} SELECT vec_id, round(s_err, 9) AS max_abs_error, round(code_sum, 6) + 0.0 AS code_sum FROM (SELECT vec_id, list_max([abs(v[i] - w[i]) FOR i IN range(1, len(v) + 1)]) AS s_err, list_sum(w) AS code_sum FROM q_4)")
def rtn_quantize(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.rows(table(spark, sf, "embeddings"), bits=4)
    return d.select("vec_id", F.round(V.max_abs_difference("teacher", "candidate"), 9).alias("max_abs_error"), (F.round(V.total("candidate"), 6) + 0.0).alias("code_sum"))


GROUP16 = "g AS (SELECT vec_id, v, [v[k*16+1:k*16+16] FOR k IN range(0, 4)] AS gs FROM t), a AS (SELECT vec_id, v, flatten([[least(greatest(round_even((x - list_min(z)) / (CASE WHEN list_max(z) = list_min(z) THEN CAST(1 AS DOUBLE) ELSE (list_max(z) - list_min(z)) / CAST(15 AS DOUBLE) END), 0), CAST(0 AS DOUBLE)), CAST(15 AS DOUBLE)) * (CASE WHEN list_max(z) = list_min(z) THEN CAST(1 AS DOUBLE) ELSE (list_max(z) - list_min(z)) / CAST(15 AS DOUBLE) END) + list_min(z) FOR x IN z] FOR z IN gs]) AS w FROM g)"


@query("rtn_group_affine", f"WITH {TEACHER}, {GROUP16} SELECT vec_id, round(list_max([abs(v[i] - w[i]) FOR i IN range(1, len(v) + 1)]), 9) AS max_abs_error, round(list_sum(w), 6) + 0.0 AS code_sum FROM a")
def rtn_group_affine(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.rows(table(spark, sf, "embeddings"), bits=4, kind="group16")
    return d.select("vec_id", F.round(V.max_abs_difference("teacher", "candidate"), 9).alias("max_abs_error"), (F.round(V.total("candidate"), 6) + 0.0).alias("code_sum"))


@query("rtn_global", f"WITH {TEACHER}, m AS (SELECT max(list_max([abs(x) FOR x IN v])) / CAST(7 AS DOUBLE) AS s FROM t) SELECT vec_id, round(list_max([abs(x - least(greatest(round_even(x / s, 0), CAST(-8 AS DOUBLE)), CAST(7 AS DOUBLE)) * s) FOR x IN v]), 9) AS max_abs_error FROM t, m")
def rtn_global(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.rows(table(spark, sf, "embeddings"), bits=4, kind="global")
    return d.select("vec_id", F.round(V.max_abs_difference("teacher", "candidate"), 9).alias("max_abs_error"))


@query("token_kld", f"WITH {sql_lp(4)} SELECT vec_id // 25 AS window_id, vec_id % 25 AS position, label, round({SQL_KL}, 9) AS kld FROM lp")
def token_kld(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.scored(table(spark, sf, "embeddings"), bits=4).select("window_id", "position", "label", F.round("kld", 9).alias("kld"))


@query("kld_by_label", f"WITH {sql_lp(4)}, k AS (SELECT vec_id // 25 AS window_id, label, {SQL_KL} AS kld, CASE WHEN list_position(v, list_max(v)) = list_position(w, list_max(w)) THEN 1 ELSE 0 END AS hit FROM lp) SELECT label, count(*) AS positions, round(avg(kld), 9) AS mean_kld, round(max(kld), 9) AS max_kld, round(avg(CAST(hit AS DOUBLE)), 9) AS top1_agreement FROM k GROUP BY label")
def kld_by_label(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.scored(table(spark, sf, "embeddings"), bits=4)
    return d.groupBy("label").agg(F.count("*").alias("positions"), F.round(F.avg("kld"), 9).alias("mean_kld"), F.round(F.max("kld"), 9).alias("max_kld"), F.round(F.avg(F.col("top1_match").cast("double")), 9).alias("top1_agreement"))


SQL_JSD = "0.5 * (list_sum([exp(p[i]) * (p[i] - ln(greatest((exp(p[i]) + exp(q[i])) * 0.5, 1e-30))) FOR i IN range(1, len(p) + 1)]) + list_sum([exp(q[i]) * (q[i] - ln(greatest((exp(p[i]) + exp(q[i])) * 0.5, 1e-30))) FOR i IN range(1, len(p) + 1)])) / ln(CAST(2 AS DOUBLE))"


@query("jsd_by_label", f"WITH {sql_lp(3)} SELECT label, count(*) AS positions, round(avg({SQL_JSD}), 9) AS mean_jsd_bits FROM lp GROUP BY label")
def jsd_by_label(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.scored(table(spark, sf, "embeddings"), bits=3)
    return d.groupBy("label").agg(F.count("*").alias("positions"), F.round(F.avg("jsd"), 9).alias("mean_jsd_bits"))


@query("jsd_weighted_mean", f"WITH {sql_lp(3)}, w AS (SELECT vec_id // 25 AS window_id, count(*) AS n, avg({SQL_JSD}) AS m FROM lp GROUP BY 1) SELECT round(sum(m * n) / sum(n), 9) AS jsd_bits FROM w")
def jsd_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    w = scoring.scored(table(spark, sf, "embeddings"), bits=3).groupBy("window_id").agg(F.count("*").alias("n"), F.avg("jsd").alias("m"))
    return w.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 9).alias("jsd_bits"))


@query("top1_agreement", " UNION ALL ".join(f"(WITH {sql_lp(b)} SELECT {b} AS bits, count(*) AS positions, CAST(sum(CASE WHEN list_position(v, list_max(v)) = list_position(w, list_max(w)) THEN 1 ELSE 0 END) AS BIGINT) AS matches, round(avg({SQL_KL}), 9) AS mean_kld FROM lp)" for b in (2, 3, 4, 6, 8)))
def top1_agreement(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.scored_at(table(spark, sf, "embeddings"), (2, 3, 4, 6, 8))
    return d.groupBy("bits").agg(F.count("*").alias("positions"), F.sum(F.col("top1_match").cast("long")).alias("matches"), F.round(F.avg("kld"), 9).alias("mean_kld"))


@query("entropy_rows", f"WITH {sql_lp(4)} SELECT vec_id, round(-list_sum([exp(x) * x FOR x IN p]), 9) AS entropy FROM lp")
def entropy_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.scored(table(spark, sf, "embeddings"), bits=4).select("vec_id", F.round(V.entropy("lp"), 9).alias("entropy"))


@query("canary_self_kld", f"WITH {TEACHER}, l AS (SELECT {sql_lsm('v')} AS p, {sql_lsm('v[1:48]')} AS m FROM t) SELECT 'unmasked' AS scope, count(*) AS positions, CAST(count(*) FILTER (list_sum([exp(x) * (x - x) FOR x IN p]) <> 0) AS BIGINT) AS nonzero, max(abs(list_sum([exp(x) * (x - x) FOR x IN p]))) AS max_abs FROM l UNION ALL SELECT 'masked', count(*), CAST(count(*) FILTER (list_sum([exp(x) * (x - x) FOR x IN m]) <> 0) AS BIGINT), max(abs(list_sum([exp(x) * (x - x) FOR x IN m]))) FROM l")
def canary_self_kld(spark: SparkSession, sf: str) -> DataFrame:
    t = scoring.rows(table(spark, sf, "embeddings"), bits=4)
    out = None
    for scope, v in (("unmasked", F.col("teacher")), ("masked", V.masked(F.col("teacher"), 48))):
        d = t.select(V.log_softmax(v).alias("p")).select(V.kl(F.col("p"), F.col("p")).alias("d"))
        part = d.agg(F.count("*").alias("positions"), F.sum((F.col("d") != 0).cast("long")).alias("nonzero"), F.max(F.abs("d")).alias("max_abs")).select(F.lit(scope).alias("scope"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("canary_shift", f"WITH {sql_lp(4)}, s AS (SELECT vec_id // 25 AS window_id, p, lag(p) OVER (PARTITION BY vec_id // 25 ORDER BY vec_id) AS q FROM lp), m AS (SELECT window_id, avg(-list_sum([exp(x) * x FOR x IN p])) AS entropy, avg(CASE WHEN q IS NOT NULL THEN {SQL_KL} END) AS shift FROM s GROUP BY window_id) SELECT window_id, round(entropy, 9) AS mean_entropy, round(shift, 9) AS mean_shift_kld, CASE WHEN shift >= 3 * entropy THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m")
def canary_shift(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.scored(table(spark, sf, "embeddings"), bits=4).withColumn("before", F.lag("lp").over(Window.partitionBy("window_id").orderBy("vec_id")))
    m = d.groupBy("window_id").agg(F.avg(V.entropy("lp")).alias("e"), F.avg(F.when(F.col("before").isNotNull(), V.kl(F.col("lp"), F.col("before")))).alias("s"))
    return m.select("window_id", F.round("e", 9).alias("mean_entropy"), F.round("s", 9).alias("mean_shift_kld"), F.when(F.col("s") >= 3 * F.col("e"), "PASS").otherwise("FAIL").alias("verdict"))


@query("masked_vs_full_kld", f"WITH {sql_lp(4)}, m AS (SELECT vec_id, label, {SQL_KL} AS f, {sql_lsm('v[1:48]')} AS p, {sql_lsm('w[1:48]')} AS q FROM lp) SELECT label, round(avg(f), 9) AS full_kld, round(avg({SQL_KL}), 9) AS masked_kld, round(avg({SQL_KL} - f), 9) AS mean_difference FROM m GROUP BY label")
def masked_vs_full_kld(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.scored(table(spark, sf, "embeddings"), bits=4)
    m = d.withColumn("m", V.kl(V.log_softmax(V.masked(F.col("teacher"), 48)), V.log_softmax(V.masked(F.col("candidate"), 48))))
    return m.groupBy("label").agg(F.round(F.avg("kld"), 9).alias("full_kld"), F.round(F.avg("m"), 9).alias("masked_kld"), F.round(F.avg(F.col("m") - F.col("kld")), 9).alias("mean_difference"))


@query("offset_audit", f"WITH {sql_lp(4)}, o AS (SELECT unnest([-1, 0, 1]) AS off), j AS (SELECT o.off, a.p, b.q FROM lp a, o, lp b WHERE b.vec_id // 25 = a.vec_id // 25 AND b.vec_id = a.vec_id + o.off) SELECT off AS row_offset, count(*) AS positions, round(avg({SQL_KL}), 9) AS mean_kld FROM j GROUP BY off")
def offset_audit(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.offset_audit(scoring.scored(table(spark, sf, "embeddings"), bits=4))


@query("score_from", f"WITH {sql_lp(4)} SELECT vec_id // 25 AS window_id, count(*) AS positions, round(avg({SQL_KL}), 9) AS mean_kld FROM lp WHERE vec_id % 25 >= 8 GROUP BY 1")
def score_from(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.scored(table(spark, sf, "embeddings").where(F.col("vec_id") % 25 >= 8), bits=4)
    return d.groupBy("window_id").agg(F.count("*").alias("positions"), F.round(F.avg("kld"), 9).alias("mean_kld"))


@query("partial_sum_order", f"WITH {TEACHER} SELECT vec_id, round(list_sum(v), 9) AS sequential, round(list_sum(list_reverse(v)), 9) AS reversed, round(list_sum(list_sort(v)), 9) AS ascending FROM t")
def partial_sum_order(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.rows(table(spark, sf, "embeddings"), bits=4)
    return d.select("vec_id", F.round(V.total("teacher"), 9).alias("sequential"), F.round(V.total(F.reverse("teacher")), 9).alias("reversed"), F.round(V.total(F.array_sort("teacher")), 9).alias("ascending"))


@query("chunked_normalizer", f"WITH {TEACHER}, x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM t), c AS (SELECT vec_id, (i - 1) // 16 AS chunk, max(x) AS m FROM x GROUP BY 1, 2), d AS (SELECT x.vec_id, (x.i - 1) // 16 AS chunk, c.m, sum(exp(x.x - c.m)) AS s FROM x JOIN c ON x.vec_id = c.vec_id AND (x.i - 1) // 16 = c.chunk GROUP BY 1, 2, 3), g AS (SELECT vec_id, max(m) AS gm FROM d GROUP BY 1) SELECT d.vec_id, round(any_value(gm) + ln(sum(s * exp(m - gm))), 9) AS log_normalizer FROM d JOIN g USING (vec_id) GROUP BY d.vec_id")
def chunked_normalizer(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.chunked_normalizer(scoring.rows(table(spark, sf, "embeddings"), bits=4), chunk=16)


@query("hidden_replay", f"WITH {TEACHER}, h AS (SELECT vec_id AS tok, v AS w FROM t WHERE vec_id < 32) SELECT t.vec_id, h.tok AS token, round(list_sum([t.v[i] * h.w[i] FOR i IN range(1, 65)]), 6) AS logit FROM t, h")
def hidden_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Every row against a head of 32 rows, which stands for a model's fixed output matrix."""
    d = scoring.rows(table(spark, sf, "embeddings"), bits=4).select("vec_id", F.col("teacher").alias("v"))
    return scoring.replay(d, d.where("vec_id < 32").select(F.col("vec_id").alias("token"), F.col("v").alias("w")))


@query("live_vs_replay", f"WITH {sql_lp(6)} SELECT vec_id, round(list_sum([exp(p[i]) * (p[i] - q2[i]) FOR i IN range(1, 65)]), 9) AS kld FROM (SELECT vec_id, p, {sql_lsm('q')} AS q2 FROM lp)")
def live_vs_replay(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.scored(table(spark, sf, "embeddings"), bits=6)
    return d.select("vec_id", F.round(V.kl(F.col("lp"), V.log_softmax(F.col("lq"))), 9).alias("kld"))


@query("max_abs_difference", f"WITH {TEACHER}, {sql_rtn(8)} SELECT label, round(max(list_max([abs(v[i] - w[i]) FOR i IN range(1, 65)])), 9) AS max_abs, CAST(count(*) FILTER (v = w) AS BIGINT) AS bitwise_equal FROM q_8 GROUP BY label")
def max_abs_difference(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.rows(table(spark, sf, "embeddings"), bits=8)
    return d.groupBy("label").agg(F.round(F.max(V.max_abs_difference("teacher", "candidate")), 9).alias("max_abs"), F.sum((F.col("teacher") == F.col("candidate")).cast("long")).alias("bitwise_equal"))


@query("top_k_distribution", f"WITH {sql_lp(4)}, s AS (SELECT vec_id, list_sort([exp(x) FOR x IN p], 'DESC') AS pr, -list_sum([exp(x) * x FOR x IN p]) AS e FROM lp) SELECT vec_id, round(list_sum(pr[1:5]), 9) AS top5_mass, round(pr[1], 9) AS top1, round(e, 9) AS entropy, round(ln(CAST(64 AS DOUBLE)), 9) AS uniform_entropy, e > 0.98 * ln(CAST(64 AS DOUBLE)) AS degenerate FROM s")
def top_k_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.scored(table(spark, sf, "embeddings"), bits=4).select("vec_id", F.sort_array(F.transform("lp", F.exp), False).alias("pr"), V.entropy("lp").alias("e"))
    uniform = F.log(F.lit(64.0))
    return d.select("vec_id", F.round(V.total(F.slice("pr", 1, 5)), 9).alias("top5_mass"), F.round(F.get("pr", F.lit(0)), 9).alias("top1"), F.round("e", 9).alias("entropy"), F.round(uniform, 9).alias("uniform_entropy"), (F.col("e") > 0.98 * uniform).alias("degenerate"))


@query("kl_sanity", f"WITH {sql_lp(2)} SELECT count(*) AS positions, CAST(count(*) FILTER ({SQL_KL} < -1e-9) AS BIGINT) AS negative, CAST(count(*) FILTER (NOT isfinite({SQL_KL})) AS BIGINT) AS not_finite FROM lp")
def kl_sanity(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.scored(table(spark, sf, "embeddings"), bits=2)
    return d.agg(F.count("*").alias("positions"), F.sum((F.col("kld") < -1e-9).cast("long")).alias("negative"), F.sum((F.isnan("kld") | (F.abs("kld") == float("inf"))).cast("long")).alias("not_finite"))


@query("router_remap", "SELECT vec_id, [CASE WHEN e // 16 = 1 THEN e % 16 ELSE -1 END FOR e IN [(vec_id * 7 + k * 13) % 64 FOR k IN range(0, 4)]] AS local_experts FROM embeddings")
def router_remap(spark: SparkSession, sf: str) -> DataFrame:
    experts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.pmod(F.col("vec_id") * 7 + k * 13, F.lit(64)))
    return table(spark, sf, "embeddings").select("vec_id", scoring.local_experts(experts, rank=1, per_rank=16).alias("local_experts"))


@query("sparse_to_dense", f"WITH {TEACHER}, k AS (SELECT vec_id, v, list_sort(v, 'DESC')[8] AS cut FROM t) SELECT vec_id, CAST(len([x FOR x IN v if x >= cut]) AS BIGINT) AS present, round(list_sum([x FOR x IN v if x >= cut]), 9) AS kept_sum FROM k")
def sparse_to_dense(spark: SparkSession, sf: str) -> DataFrame:
    d = scoring.rows(table(spark, sf, "embeddings"), bits=4)
    numbered = F.transform("teacher", lambda x, i: F.struct(i.alias("k"), x.alias("v")))
    entries = V.let(F.get(F.sort_array("teacher", False), F.lit(7)), lambda cut: F.map_from_entries(F.filter(numbered, lambda e: e["v"] >= cut)))
    dense = d.select("vec_id", V.dense_row(entries, 64).alias("r"))
    kept = F.filter("r", lambda x: x > float("-inf"))
    return dense.select("vec_id", F.size(kept).cast("long").alias("present"), F.round(V.total(kept), 9).alias("kept_sum"))


@query("placement_audit", f"""WITH {TEACHER}, {sql_rtn(4)}, sh AS (SELECT unnest([0, 1, 8, 64, 512]) AS shift),
j AS (SELECT sh.shift, list_sum([(a.w[i] - b.v[i]) ** 2 FOR i IN range(1, 65)]) AS d2, list_sum([x * x FOR x IN b.v]) AS n2 FROM q_4 a, sh, q_4 b WHERE b.vec_id = a.vec_id + sh.shift),
r AS (SELECT shift, sqrt(sum(d2)) / sqrt(sum(n2)) AS rel FROM j GROUP BY shift)
SELECT round(max(rel) FILTER (shift = 0), 9) AS aligned, round(min(rel) FILTER (shift > 0), 9) AS best_control,
  max(rel) FILTER (shift = 0) < 0.5 AND min(rel) FILTER (shift > 0) > 0.5 AND min(rel) FILTER (shift > 0) > 4 * max(rel) FILTER (shift = 0) AS passed FROM r""")
def placement_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every row, and four control shifts; a row without a shifted partner is left out of that shift."""
    d = scoring.rows(table(spark, sf, "embeddings"), bits=4)
    return scoring.placement_audit(d, shifts=(1, 8, 64, 512))
