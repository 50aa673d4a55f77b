"""The registry's rules over a whole registry: orders as measurements of customers' artifacts on nations' panels, much of it broken on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import constraints
from tidemark.operators.registry import comparability_key
from tidemark.operators.shared import many, sought, written

from .catalog import query, table
from .registry_queries import M, measurements

NOTHING = "array(named_struct('code', 'no_known_deviations'))"
NOTE = "array(named_struct('code', '{}', 'asserts_provenance', {}, 'sources', {}, 'detail', '{}'))".format
NO_SOURCE, LOOSE_SOURCE = "filter(array(named_struct('uri', 'x')), x -> false)", "array(named_struct('uri', 'https://g/x/blob/main/a'))"
CUSTOMER_NOTES = f"""CASE WHEN c % 47 = 0 THEN array_repeat({NOTE('no_known_deviations', 'false', NO_SOURCE, '')}[0], 2)
  WHEN c % 53 = 0 THEN {NOTE('made_up', 'false', NO_SOURCE, '')} WHEN c % 59 = 0 THEN {NOTE('note', 'true', NO_SOURCE, '')} WHEN c % 61 = 0 THEN {NOTE('note', 'true', LOOSE_SOURCE, '')}
  WHEN c % 67 = 0 THEN {NOTE('note', 'false', NO_SOURCE, 'see convert.py for how')} ELSE {NOTE('no_known_deviations', 'false', NO_SOURCE, '')} END"""
KNOWN = ["no_known_deviations", "author_reported_only", "note"]


def typed(d: DataFrame, name: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a collection from SQL expressions; fields that aren't given are null."""
    d = d.selectExpr(*(f"{x} AS {c}" for c, x in fields.items()))
    return d.select(F.from_json(F.to_json(F.struct(*d.columns)), constraints.SCHEMAS[name]).alias("row")).select("row.*")


def key_of() -> Column:
    return comparability_key(*(F.expr(f).cast("string") for f in constraints.KEY_FIELDS.values()))


def broken_registry(spark: SparkSession, sf: str) -> constraints.Registry:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c"), F.col("c_nationkey").cast("long").alias("n"))
    last = F.broadcast(c.agg(F.max("c").alias("last")))
    models = typed(n, "models", {"id": "concat('m', n)", "tokenizer": "named_struct('id', 'tok')", "canonical_weights": "named_struct('artifact_ref', concat('b', n))", "disclosures": NOTHING})

    def assignments(treatment: str, fmt: str, bits: str, last_bits: str, without: str = "false") -> str:
        rows = (("embed_tokens", "native", "bf16", "16D"), ("lm_head", "native", "bf16", "16D"), ("attn.q", treatment, fmt, bits), ("mlp.up", treatment, fmt, last_bits))
        each = ", ".join(f"named_struct('tensor_class', '{c}', 'treatment', '{t}', 'format', '{f}', 'bits_per_weight', {b})" for c, t, f, b in rows)
        return f"filter(array({each}), x -> NOT ({without} AND x.tensor_class = 'embed_tokens'))"

    def scope(a: str) -> str:
        return f"named_struct('policy', 'uniform', 'head_policy', 'native', 'kv_cache_dtype', 'bf16', 'assignments', {a})"

    base = typed(n, "artifacts", {
        "id": "concat('b', n)", "model_ref": "concat('m', n)", "kind": "'base'", "scope": scope(assignments("native", "bf16", "16D", "16D")), "codec": "named_struct('bits_per_weight_effective', 16D)",
        "weights": "named_struct('size_bytes', 2000000000L, 'size_gb', 2D, 'size_basis', 'files')", "huggingface": "named_struct('repository', concat('b', n), 'revision', 'abc')", "disclosures": NOTHING,
    })
    own = typed(c.join(last), "artifacts", {
        "id": "concat('a', c)", "model_ref": "concat('m', n)", "kind": "'quantized'", "derived_from_artifact_ref": "CASE WHEN c % 71 = 1 AND c > 1 THEN concat('a', c - 1) WHEN c % 71 = 0 AND c > 0 AND c < last THEN concat('a', c + 1) ELSE concat('b', n) END",
        "scope": scope(assignments("quantized", "k6", "6D", "IF(c % 19 = 0, 4D, 6D)", "c % 23 = 0")),
        "codec": "named_struct('bits_per_weight_effective', IF(c % 29 = 0, 5D, 6D), 'calibration', IF(c % 31 = 0, named_struct('overlaps_any_panel', true), NULL))",
        "weights": "named_struct('size_bytes', 2000000000L, 'size_gb', IF(c % 37 = 0, 2.1D, 2D), 'size_basis', IF(c % 41 = 0, NULL, 'files'))", "cross_refs": "named_struct('local_ai_registry', IF(c % 43 = 0, named_struct('match_confidence', 'exact'), NULL))",
        "huggingface": "named_struct('repository', concat('a', c), 'revision', IF(c % 13 = 0, NULL, 'abc'))",
        "disclosures": CUSTOMER_NOTES,
    })
    artifacts = written(base.unionByName(own).withColumn("scope_digest", F.when(F.col("id").rlike("^a") & (F.substring("id", 2, 20).cast("long") % 17 == 0), "x").otherwise(constraints.scope_digest())), "artifacts")
    panels = typed(n, "panels", {
        "id": "concat('p', n)", "sealed": "n % 11 <> 5", "model_scope": "array(concat('m', n))", "tokenizer": "named_struct('id', IF(n = 24, 'other', 'tok'))", "contamination": "named_struct('checked', n % 7 <> 3)",
        "identity": "named_struct('panel_token_sha256', concat('t', n), 'hash_covers', IF(n % 5 = 1, 'file', 'token_ids'), 'panel_receipt_sha256', concat(IF(n % 5 = 3, 't', 'r'), n))", "structure": "named_struct('contexts', IF(n % 5 = 2, 21, 20), 'positions_per_context', 10, 'scored_positions_total', 200)", "disclosures": NOTHING,
    })
    references = typed(n, "references", {"id": "concat('r', n)", "artifact_ref": "concat('b', n)", "panel_ref": "concat('p', n)", "self_consistency": "named_struct('floor_measurement_ref', concat('f', n))", "disclosures": NOTHING})
    pipelines = typed(n, "pipelines", {"id": "concat('l', n)", "author": "named_struct('name', 'us')", "disclosures": NOTHING})

    refs = {"status": "'published'", "panel_ref": "concat('p', n)", "reference_ref": "concat('r', n)", "pipeline_ref": "concat('l', n)", "estimator": "named_struct('accumulation_dtype', 'float64', 'stack_relation', 'same_stack', 'head_policy', 'native_head')"}
    inputs = ", ".join(f"'{k}', {v}" for k, v in {"panel_id": "concat('p', n)", "reference_id": "concat('r', n)", "metric_name": "'mean_of_run_means_tokenwise_kld'", "direction": "{}", "accumulation_dtype": "'float64'", "stack_relation": "'same_stack'", "head_policy": "'native_head'"}.items())
    metric = "named_struct('name', 'mean_of_run_means_tokenwise_kld', 'value', {}, 'units', {}, 'direction', 'forward')".format
    evidence = "named_struct('run_count', {}, 'evidence_kind', {}, 'evidence_hashes', array(concat('d', {})), 'distinct_evidence_hash_count', 1, 'identical_across_runs', true, 'run_means', array_repeat({}, 5), 'min_run_mean', {}, 'max_run_mean', {}, 'population_stddev_of_run_means', 0D)".format
    source = "array(named_struct('kind', 'receipt_file', 'uri', {}, 'sha256', '1'))".format
    provenance = "named_struct('measured_by', 'self-measured', 'independently_verified', {}, 'measurer', named_struct('name', 'us', 'is_registry_maintainer', {}), 'sources', {})".format
    harness = "named_struct('recorded', true, 'harness_id', 'h', 'boundary', {}, 'repository', 'r', 'covers', array('metric.value'), 'code_digests', array(named_struct('role', 'score', 'path', 'bin/score', 'sha256', '3')), 'tool_versions', named_struct('numpy', '2'))".format
    cell = "named_struct('domain', '{}', 'windows', {}, 'ci95_low', 0.01D, 'interval_method', 'window_block_bca', 'bootstrap_b', {}, 'bootstrap_seed', {})".format
    # digests join the narrow rows of which measurements are made, not the measurements
    large = many(artifacts)

    def digested(d: DataFrame, ref: str, few: bool) -> DataFrame:
        digests = sought(artifacts.select("id", "scope_digest"), d, F.expr(ref), large, few)
        return d.withColumn("artifact_ref", F.expr(ref)).join(digests.select(F.col("id").alias("artifact_ref"), F.col("scope_digest").alias("digest")), "artifact_ref", "left")

    measured = digested(c, "concat('a', c)", False)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"), F.floor("o_totalprice").cast("double").alias("v")).join(measured, "c")
    floored = digested(n, "concat('b', n)", True)
    rows = {
        "id": "concat('o', k)", "scope_digest": "IF(k % 43 = 0, 'y', digest)", "artifact_ref": "concat('a', c)", "model_ref": "concat('m', IF(k % 23 = 0, (n + 1) % 25, n))", "supersedes": "IF(k % 31 = 0, concat('o', k), NULL)", **refs,
        "metric": metric("IF(k % 61 = 0, v + 0.5D, v)", "IF(k % 83 = 0, 'bits', 'nats')"), "auxiliary_metrics": "IF(k % 89 = 0, NULL, named_struct('top1_agreement', 0.9D))", "uncertainty": "named_struct('method', IF(k % 79 = 0, 'none', 'bca'), 'ci95_low', v - 1, 'ci95_high', IF(k % 73 = 0, v - 0.5D, v + 1))",
        "measurement_scope": "named_struct('covers_full_panel', true, 'scored_positions', 200, 'contexts', IF(k % 47 = 0, 19, 20))", "by_domain": f"array({cell('a', 'IF(k % 97 = 0, 6, 12)', 'IF(k % 103 = 0, NULL, 5000)', '1')}, {cell('b', '12', '5000', 'IF(k % 101 = 0, 1, 2)')})",
        "comparability": f"named_struct('class', 'strict', 'key_inputs', named_struct({inputs.format('IF(k % 41 = 0, ' + chr(39) + 'reverse' + chr(39) + ', ' + chr(39) + 'forward' + chr(39) + ')')}), 'bias', CASE WHEN k % 151 = 0 THEN named_struct('kind', 'x', 'floor_measurement_ref', concat('f', n)) WHEN k % 157 = 0 THEN named_struct('kind', 'x', 'floor_measurement_ref', concat('f', (n + 1) % 25)) END)",
        "determinism": evidence("CASE WHEN k % 71 = 0 THEN 0 WHEN k % 59 = 0 THEN 4 ELSE 5 END", "CASE WHEN k % 53 = 0 THEN 'report_sha256' WHEN k % 67 = 0 THEN NULL ELSE 'tokenwise_kld_sha256' END", "k", "v", "v", "v"),
        "provenance": provenance("k % 109 = 0", "k % 107 <> 0", source("IF(k % 113 = 0, '/home/x', 'receipts/x')")), "harness": f"IF(k % 131 = 0, NULL, {harness('IF(k % 137 = 0, NULL, ' + chr(39) + 'b' + chr(39) + ')')})",
        "disclosures": f"CASE WHEN k % 127 = 0 THEN array(named_struct('code', 'author_reported_only', 'severity', 'note')) WHEN k % 139 = 0 THEN array(named_struct('code', 'note', 'severity', 'blocking')) WHEN k % 149 = 0 THEN filter(array(named_struct('code', 'note', 'severity', 'note')), x -> false) ELSE array(named_struct('code', 'no_known_deviations', 'severity', 'note')) END",
    }
    floors = {
        "id": "concat('f', n)", "scope_digest": "digest", "artifact_ref": "concat('b', n)", "model_ref": "concat('m', n)", **refs, "metric": metric("20000D", "'nats'"), "auxiliary_metrics": "named_struct('top1_agreement', 0.9D)", "uncertainty": "named_struct('method', 'unknown', 'ci95_low', 19999D, 'ci95_high', 20001D)",
        "measurement_scope": "named_struct('covers_full_panel', false, 'scored_positions', 200, 'contexts', 20)", "comparability": f"named_struct('class', 'advisory', 'key_inputs', named_struct({inputs.format(chr(39) + 'forward' + chr(39))}))", "determinism": evidence("5", "'tokenwise_kld_sha256'", "n", "20000D", "20000D", "20000D"),
        "provenance": provenance("false", "true", source("'receipts/x'")), "harness": harness("'b'"), "disclosures": NOTHING,
    }
    m = typed(o, "measurements", rows).unionByName(typed(floored, "measurements", floors))
    wrong_key = F.col("id").startswith("o") & (F.substring("id", 2, 20).cast("long") % 37 == 0)
    m = m.withColumn("comparability", F.col("comparability").withField("key", F.when(wrong_key, "x").otherwise(key_of())))
    frames = {"models": models, "artifacts": artifacts, "panels": panels, "references": references, "pipelines": pipelines, "measurements": m}
    return {k: written(frames[k], k) for k in constraints.SCHEMAS}


# code, severity, the rows that break it: orders (k, v, c, n), customers (c, n) or nations (n)
ORDERS = {
    "REF-003": "k % 23 = 0", "REF-005": "k % 23 = 0", "REF-006": "k % 23 = 0", "REF-010": "k % 31 = 0", "CMP-001": "k % 37 = 0", "CMP-002": "k % 41 = 0", "SCOPE-001": "k % 43 = 0", "SCOPE-007": "k % 47 = 0 OR n % 5 = 2", "PANEL-006/warn": "n % 7 = 3", "PANEL-007": "n % 11 = 5",
    "BIAS-002": "(k % 151 = 0 AND k % 37 = 0) OR (k % 157 = 0 AND k % 151 <> 0)", "BIAS-003": "k % 151 = 0 OR k % 157 = 0", "BIAS-004": "k % 157 = 0 AND k % 151 <> 0", "DET-001": "k % 53 = 0 OR k % 67 = 0 OR k % 71 = 0", "DET-002": "k % 59 = 0 OR k % 71 = 0", "DET-003": "k % 61 = 0", "DET-004": "(k % 53 = 0 OR k % 67 = 0) AND k % 71 <> 0", "DET-005": "k % 71 = 0", "DET-006/warn": "k % 59 = 0 OR k % 71 = 0",
    "STAT-001": "k % 73 = 0", "STAT-002": "k % 79 = 0", "STAT-003": "k % 83 = 0", "STAT-005/warn": "k % 89 = 0", "STAT-007": "k % 97 = 0", "STAT-008": "k % 101 = 0", "STAT-009": "k % 103 = 0", "IDENT-001": "c % 13 = 0", "PROV-001": "k % 107 = 0", "PROV-003": "k % 109 = 0", "PROV-005/warn": "k % 113 = 0", "PROV-017": "k % 113 = 0", "PROV-007": "k % 127 = 0",
    "HARN-001": "k % 131 = 0", "HARN-002": "k % 137 = 0 AND k % 131 <> 0", "DISC-003": "k % 139 = 0 AND k % 127 <> 0", "DISC-001": "k % 149 = 0 AND k % 139 <> 0 AND k % 127 <> 0", "FLOOR-001": "v < 20000 AND k % 37 <> 0",
}
CUSTOMERS = {
    "SCOPE-002": "c % 17 = 0", "SCOPE-003": "c % 19 = 0", "SCOPE-004": "c % 23 = 0", "SCOPE-006/warn": "c % 29 = 0 AND c % 19 <> 0", "SCOPE-008": "c % 31 = 0", "IDENT-003": "c % 37 = 0", "IDENT-005": "c % 41 = 0", "IDENT-004/warn": "c % 43 = 0", "REF-009": "(c % 71 = 1 AND c > 1) OR (c % 71 = 0 AND c > 0 AND c < last)",
    "DISC-002": "c % 47 = 0", "DISC-004": "c % 53 = 0 AND c % 47 <> 0", "PROV-014": "c % 59 = 0 AND c % 53 <> 0 AND c % 47 <> 0", "PROV-015": "c % 61 = 0 AND c % 59 <> 0 AND c % 53 <> 0 AND c % 47 <> 0", "PROV-016": "c % 67 = 0 AND c % 61 <> 0 AND c % 59 <> 0 AND c % 53 <> 0 AND c % 47 <> 0",
}
NATIONS = {"PANEL-001": "n % 5 = 1 AND n % 11 <> 5", "PANEL-002": "n % 5 = 3", "PANEL-003": "n % 5 = 2", "REF-007": "n = 24", "CMP-005/warn": "n NOT IN (SELECT n FROM o)"}


def rules_sql(prefixes: tuple[str, ...] = ("",)) -> str:
    parts = ["SELECT 'CMP-004' AS code, 'error' AS severity, count(*) - count(DISTINCT c) AS n FROM o", "SELECT 'FLOOR-003', 'warn', 1 FROM o WHERE k % 37 = 0 HAVING count(*) > 1"]
    for source, codes in (("o", ORDERS), ("c", CUSTOMERS), ("n", NATIONS)):
        for code, condition in codes.items():
            name, _, severity = code.partition("/")
            parts.append(f"SELECT '{name}', '{severity or 'error'}', count(*) FROM {source} WHERE {condition}")
    keep = " OR ".join(f"starts_with(code, '{p}')" for p in prefixes)
    return f"""WITH n AS (SELECT n_nationkey AS n FROM nation), c AS (SELECT c_custkey AS c, c_nationkey AS n, max(c_custkey) OVER () AS last FROM customer),
o AS (SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice) AS v, n FROM orders JOIN c ON o_custkey = c),
v AS ({" UNION ALL ".join(parts)})
SELECT code, severity, CAST(n AS BIGINT) AS n FROM v WHERE n > 0 AND ({keep})"""


def found(spark: SparkSession, sf: str, *prefixes: str) -> DataFrame:
    return constraints.violations(broken_registry(spark, sf), KNOWN, codes=prefixes).groupBy("code", "severity").agg(F.count("*").alias("n"))  # a violation is one row


@query("registry_violations", rules_sql())
def registry_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule, on the whole registry."""
    return found(spark, sf)


@query("bias_checks", rules_sql(("BIAS", "FLOOR")))
def bias_checks(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, "BIAS", "FLOOR")


@query("scope_violations", rules_sql(("SCOPE",)))
def scope_violations(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, "SCOPE")


@query("panel_violations", rules_sql(("PANEL",)))
def panel_violations(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, "PANEL")


@query("identity_violations", rules_sql(("IDENT",)))
def identity_violations(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, "IDENT")


@query("disclosure_checks", rules_sql(("DISC",)))
def disclosure_checks(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, "DISC")


GEOMETRY_SQL = f"""WITH {M}, g AS (SELECT key, count(DISTINCT floor(value / 50000)) AS kinds, count(*) AS n FROM m GROUP BY key), n AS (SELECT n_nationkey AS n FROM nation), o AS (SELECT o_orderkey AS k, o_custkey AS c, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'CMP-003' AS code, 'error' AS severity, CAST(id AS VARCHAR) AS id FROM m JOIN g USING (key) WHERE kinds > 1 AND lane = 'sealed' UNION ALL SELECT 'CMP-005', 'warn', CAST(key AS VARCHAR) FROM g WHERE n = 1
UNION ALL SELECT 'CMP-001', 'error', 'o' || CAST(k AS VARCHAR) FROM o WHERE k % 37 = 0 UNION ALL SELECT 'CMP-002', 'error', 'o' || CAST(k AS VARCHAR) FROM o WHERE k % 41 = 0
UNION ALL SELECT 'CMP-004', 'error', id FROM (SELECT 'o' || CAST(k AS VARCHAR) AS id, row_number() OVER (PARTITION BY c ORDER BY 'o' || CAST(k AS VARCHAR)) AS place FROM o) WHERE place > 1
UNION ALL SELECT 'CMP-005', 'warn', 'f' || CAST(n AS VARCHAR) FROM n WHERE n NOT IN (SELECT n FROM o)"""


@query("key_geometry", GEOMETRY_SQL)
def key_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each violation: sealed orders of a nation whose prices lie in several bands, nations with one order, and the registry's rules of keys."""
    m = measurements(spark, sf)
    g = m.groupBy("key").agg(F.count_distinct(F.floor(F.col("value") / 50000)).alias("kinds"), F.count("*").alias("n"))
    several = F.broadcast(g.where("kinds > 1").select("key"))  # nations
    mixed = m.where("lane = 'sealed'").join(several, "key").select(F.lit("CMP-003").alias("code"), F.lit("error").alias("severity"), F.col("id").cast("string").alias("id"))
    alone = g.where("n = 1").select(F.lit("CMP-005").alias("code"), F.lit("warn").alias("severity"), F.col("key").cast("string").alias("id"))
    return mixed.unionByName(alone).unionByName(constraints.violations(broken_registry(spark, sf), KNOWN, codes=("CMP",)).select("code", "severity", "id"))
