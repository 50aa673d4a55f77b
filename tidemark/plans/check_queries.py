"""Validation queries: seals, panels, identities, scopes, disclosures, and the refusals around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import constraints
from tidemark.operators import corpus as C
from tidemark.operators import ordering
from tidemark.operators import registry as R
from tidemark.operators import rules as rulebook

from .catalog import query, table
from .registry_queries import M, measurements
from .text_queries import TOK, docs, sql_grams


def coded(d: DataFrame, checks: dict[str, Column], id_col: str) -> DataFrame:
    """``code``, ``id`` of every check that a row fails: all checks in one pass."""
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))
    return d.select(F.explode(codes).alias("code"), F.col(id_col).alias("id"))


@query("context_recheck", f"WITH {TOK}, b AS (SELECT DISTINCT unnest({sql_grams('c', 12)}) AS g FROM c), w AS (SELECT doc_id, unnest(range(0, len(t) // 64)) AS i, t FROM t), x AS (SELECT doc_id, i, t[i * 64 + 1:i * 64 + 64] AS t FROM w), y AS (SELECT doc_id, i, unnest({sql_grams('x', 12)}) AS g FROM x) SELECT count(*) AS rejected FROM (SELECT DISTINCT doc_id, i FROM y SEMI JOIN b USING (g))")
def context_recheck(spark: SparkSession, sf: str) -> DataFrame:
    w = C.token_windows(docs(spark, sf), 64).select(F.col("doc_id").alias("id"), "window_index", "text").withColumn("doc_id", F.struct("id", "window_index"))
    return C.calibration_overlap(w, table(spark, sf, "benchmark"), 12).agg(F.count_if(F.col("shared_ngrams") > 0).alias("rejected"))


@query("suite_validation", "WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, sha256(text) AS h FROM documents), v AS (SELECT source, count(*) AS n, count(DISTINCT h) AS hashes, max(doc_id) - min(doc_id) + 1 AS span, sha256(string_agg(h, chr(10) ORDER BY position)) AS suite FROM s GROUP BY source) SELECT source, n - hashes AS repeated_hashes, span = n AS dense, suite FROM v")
def suite_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated digests, whether ids are dense, and the suite's digest: one row of all its digests, as the format asks."""
    s = docs(spark, sf).select("source", "doc_id", F.sha2("text", 256).alias("h"))
    v = s.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("h").alias("k"), (F.max("doc_id") - F.min("doc_id") + 1).alias("span"), F.array_sort(F.collect_list(F.struct("doc_id", "h"))).alias("rows"))
    return v.select("source", (F.col("n") - F.col("k")).alias("repeated_hashes"), (F.col("span") == F.col("n")).alias("dense"), F.sha2(F.array_join(F.transform("rows", lambda r: r["h"]), "\n"), 256).alias("suite"))


@query("surface_sniff", "SELECT CASE WHEN p_name LIKE '%.gguf' OR p_type LIKE '%STEEL' THEN 'gguf' WHEN p_type LIKE 'PROMO%' THEN 'exl3' WHEN p_size < 10 THEN 'mlx' WHEN p_brand = 'Brand#11' THEN 'nvfp4' ELSE 'unknown' END AS surface, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def surface_sniff(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        {"name": "gguf", "when": {"any": [{"ends": ["p_name", ".gguf"]}, {"ends": ["p_type", "STEEL"]}]}}, {"name": "exl3", "when": {"begins": ["p_type", "PROMO"]}}, {"name": "mlx", "when": {"lt": ["p_size", 10]}}, {"name": "nvfp4", "when": {"eq": ["p_brand", "Brand#11"]}},
    ]
    return table(spark, sf, "part").groupBy(rulebook.first(rules, "unknown").alias("surface")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def _seal(name: Column, nation: Column, seal: Column) -> Column:
    return F.sha2(F.concat(F.lit('{"name":"'), name, F.lit('","nation":'), nation.cast("string"), F.lit(',"seal":"'), seal, F.lit('"}')), 256)


@query("seal_verify", "WITH s AS (SELECT s_suppkey, s_name, s_nationkey, sha256('{\"name\":\"' || s_name || '\",\"nation\":' || CAST(s_nationkey AS VARCHAR) || ',\"seal\":\"\"}') AS seal FROM supplier), t AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 13 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS n, seal FROM s) SELECT s_suppkey, seal = sha256('{\"name\":\"' || s_name || '\",\"nation\":' || CAST(n AS VARCHAR) || ',\"seal\":\"\"}') AS sealed FROM t")
def seal_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A document carries the digest of itself with the digest left blank; some are then changed."""
    s = table(spark, sf, "supplier").withColumn("seal", _seal(F.col("s_name"), F.col("s_nationkey"), F.lit("")))
    changed = s.withColumn("s_nationkey", F.col("s_nationkey") + F.when(F.col("s_suppkey") % 13 == 0, 1).otherwise(0))
    return changed.select("s_suppkey", (F.col("seal") == _seal(F.col("s_name"), F.col("s_nationkey"), F.lit(""))).alias("sealed"))


@query("digest_preimages", "SELECT conv_id, turn, sha256(role || chr(10) || CAST(length(text) AS VARCHAR) || chr(10) || text) AS text_digest, sha256('[' || CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) || ']') AS index_digest FROM conversations")
def digest_preimages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.sha2(F.concat_ws("\n", "role", F.length("text").cast("string"), "text"), 256).alias("text_digest"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.lit("]")), 256).alias("index_digest"))


@query("pooled_percentile_refusal", "SELECT l_returnflag, CASE WHEN count(l_tax) = count(*) AND l_returnflag <> 'N' THEN round(quantile_cont(l_tax, CAST(0.99 AS DOUBLE)), 9) END AS p99, CASE WHEN l_returnflag = 'N' THEN 'refused: no token rows' END AS reason FROM lineitem GROUP BY l_returnflag")
def pooled_percentile_refusal(spark: SparkSession, sf: str) -> DataFrame:
    """A pooled percentile needs the pooled rows: percentiles of windows can't be combined into one."""
    d, by = table(spark, sf, "lineitem").select("l_returnflag", "l_tax"), ["l_returnflag"]
    p = ordering.wide(ordering.quantiles(d.where("l_returnflag <> 'N'"), by, "l_tax", [0.99]), by, {0.99: "p"})
    g = d.groupBy(*by).agg((F.count("l_tax") == F.count("*")).alias("whole")).join(p, by, "left")
    refused = F.col("l_returnflag") == "N"
    return g.select("l_returnflag", F.when(F.col("whole") & ~refused, F.round("p", 9)).alias("p99"), F.when(refused, "refused: no token rows").alias("reason"))


@query("duration_parse", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 60 WHEN 2 THEN p_size * 3600 ELSE p_size * 86400 END AS seconds FROM part")
def duration_parse(spark: SparkSession, sf: str) -> DataFrame:
    d = F.concat(F.col("p_size").cast("string"), F.get(F.array(*map(F.lit, "smhd")), F.col("p_size") % 4))
    unit = F.create_map(*(F.lit(x) for k, v in (("s", 1), ("m", 60), ("h", 3600), ("d", 86400)) for x in (k, v)))
    p = table(spark, sf, "part").select("p_partkey", d.alias("d"))
    return p.select("p_partkey", (F.regexp_extract("d", r"^(\d+)([smhd])$", 1).cast("int") * unit[F.regexp_extract("d", r"^(\d+)([smhd])$", 2)]).alias("seconds"))


@query("pair_list", "WITH p(a, b) AS (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R')), m AS (SELECT l_returnflag AS lab, l_suppkey AS w, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2) SELECT p.a, p.b, count(*) AS windows, round(avg(m1.x - m2.x), 9) AS a_minus_b, CAST(count(*) FILTER (m1.x < m2.x) AS BIGINT) AS a_wins FROM p JOIN m m1 ON m1.lab = p.a JOIN m m2 ON m2.lab = p.b AND m2.w = m1.w GROUP BY 1, 2")
def pair_list(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("lab"), F.col("l_suppkey").alias("w")).agg(F.avg("l_discount").alias("x"))
    p = F.broadcast(spark.createDataFrame([("A", "N"), ("A", "R"), ("N", "R")], "a string, b string"))
    j = m.select(F.col("lab").alias("a"), "w", "x").join(p, "a").join(m.select(F.col("lab").alias("b"), "w", F.col("x").alias("y")), ["b", "w"])
    return j.groupBy("a", "b").agg(F.count("*").alias("windows"), F.round(F.avg(F.col("x") - F.col("y")), 9).alias("a_minus_b"), F.count_if(F.col("x") < F.col("y")).alias("a_wins"))


@query("attributable_gates", f"WITH {M}, f AS (SELECT key, lane, min(value) AS floor FROM m WHERE status = 'F' GROUP BY 1, 2), c AS (SELECT id, m.key, m.lane, value, floor FROM m LEFT JOIN f USING (key, lane)) SELECT CASE WHEN floor IS NULL THEN 'refused: no floor of this lane' WHEN floor = 0 THEN 'refused: zero floor' WHEN value < floor THEN 'refused: below the floor' ELSE 'attributable' END AS verdict, count(*) AS n, round(avg(value - floor), 4) AS mean_gap FROM c GROUP BY 1")
def attributable_gates(spark: SparkSession, sf: str) -> DataFrame:
    m = measurements(spark, sf)
    f = m.where("status = 'F'").groupBy("key", "lane").agg(F.min("value").alias("floor"))
    v = F.when(F.col("floor").isNull(), "refused: no floor of this lane").when(F.col("floor") == 0, "refused: zero floor").when(F.col("value") < F.col("floor"), "refused: below the floor").otherwise("attributable")
    return m.join(f, ["key", "lane"], "left").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") - F.col("floor")), 4).alias("mean_gap"))


RULES_SQL = """WITH v AS (
  SELECT 'REF-003' AS code FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 23 = 0
  UNION ALL SELECT 'STAT-001' FROM orders WHERE o_orderkey % 31 = 0
  UNION ALL SELECT 'STAT-003' FROM orders WHERE o_orderkey % 29 = 0
  UNION ALL SELECT 'DET-001' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority = '5-LOW'
  UNION ALL SELECT 'DET-003' FROM orders WHERE o_orderkey % 37 = 0
  UNION ALL SELECT 'BIAS-001' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0
  UNION ALL SELECT 'BIAS-003' FROM orders WHERE o_orderkey % 15 = 0)
SELECT code, count(*) AS n FROM v GROUP BY code"""


@query("measurement_rules", RULES_SQL)
def measurement_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as measurements of customers, some of which break rules, against the registry's rules."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    artifacts = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("model--"), "c_nationkey").alias("model_ref"), "c_nationkey")
    nations = artifacts.select(F.col("id").alias("artifact_ref"), "c_nationkey")
    o = table(spark, sf, "orders").withColumn("artifact_ref", F.col("o_custkey").cast("string")).join(nations, "artifact_ref", "left")
    bias = F.struct(F.lit("cross_stack_capture_replay").alias("kind"), F.lit("above").alias("direction"), F.lit("no floor was measured through this stack so far").alias("detail"), F.lit(None).cast("string").alias("floor_measurement_ref"))
    measurements = o.select(
        k.cast("string").alias("id"),
        "artifact_ref",
        F.concat(F.lit("model--"), (F.col("c_nationkey") + F.when(k % 23 == 0, 1).otherwise(0)).cast("string")).alias("model_ref"),
        F.struct(F.lit("mean_of_run_means_tokenwise_kld").alias("name"), v.alias("value"), F.when(k % 29 == 0, "bits").otherwise("nats").alias("units")).alias("metric"),
        F.struct(F.lit("bca").alias("method"), (v * 0.9).alias("ci95_low"), (v * F.when(k % 31 == 0, 0.95).otherwise(1.1)).alias("ci95_high")).alias("uncertainty"),
        F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "cross_stack").otherwise("same_stack").alias("stack_relation")).alias("estimator"),
        F.struct(F.when(k % 5 == 0, "strict").otherwise("advisory").alias("class"), F.when(k % 3 == 0, bias).alias("bias")).alias("comparability"),
        F.struct(
            F.lit(2).alias("run_count"),
            F.when(F.col("o_orderpriority") == "5-LOW", "report_sha256").otherwise("tokenwise_kld_sha256").alias("evidence_kind"),
            F.array(F.sha2(k.cast("string"), 256)).alias("evidence_hashes"),
            F.lit(1).alias("distinct_evidence_hash_count"),
            (k % 2 == 0).alias("identical_across_runs"),
            F.array(v, v * F.when(k % 37 == 0, 2.0).otherwise(1.0)).alias("run_means"),
        ).alias("determinism"),
    )
    wanted = {"REF-003", "STAT-001", "STAT-003", "DET-001", "DET-003", "BIAS-001", "BIAS-003"}
    rules = [r for r in constraints.MEASUREMENT_RULES if r[0] in wanted]
    return constraints.broken(constraints.referring(measurements, "m", a=("artifact_ref", artifacts)), rules).groupBy("code").agg(F.count("*").alias("n"))
