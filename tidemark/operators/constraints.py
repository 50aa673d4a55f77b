"""Registry constraints: tables of rules over typed registry frames; what comes out are violations.

A registry is six frames (``SCHEMAS``).  A rule is (code, severity, condition): the condition is SQL over a row and
the rows that it refers to, joined by their ids, and says when the row breaks the rule; null doesn't.  All rules of a
collection are judged in one pass.  Rules over several rows (groups, chains, duplicates) are functions of their own.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import closure
from .registry import comparability_key, duplicates, floor_violations
from .shared import bounded, many, sought, written

Registry = dict[str, DataFrame]
Rule = tuple[str, str, str]

DISCLOSURES = "disclosures array<struct<code:string,severity:string,affects_comparability:boolean,detail:string,asserts_provenance:boolean,sources:array<struct<uri:string,sha256:string,lines:string>>>>"
SCHEMAS = {
    "models": f"id string, tokenizer struct<id:string>, canonical_weights struct<artifact_ref:string>, {DISCLOSURES}",
    "artifacts": "id string, model_ref string, kind string, derived_from_artifact_ref string, scope_digest string,"
    " scope struct<policy:string,head_policy:string,kv_cache_dtype:string,assignments:array<struct<tensor_class:string,treatment:string,format:string,bits_per_weight:double,layer_range:string,note:string>>>,"
    " codec struct<bits_per_weight_effective:double,calibration:struct<overlaps_any_panel:boolean,overlapping_panel_refs:array<string>>>, weights struct<size_bytes:bigint,size_gb:double,size_basis:string>,"
    f" huggingface struct<repository:string,revision:string,path:string>, producer struct<name:string>, cross_refs struct<local_ai_registry:struct<match_confidence:string,model_instance_id:string>>, {DISCLOSURES}",
    "panels": "id string, sealed boolean, model_scope array<string>, tokenizer struct<id:string>, contamination struct<checked:boolean>, derived_from string, derivation struct<kind:string>,"
    " identity struct<panel_token_sha256:string,hash_covers:string,panel_receipt_sha256:string>,"
    f" structure struct<contexts:bigint,positions_per_context:bigint,scored_positions_total:bigint,scoring_window:struct<windowed:boolean,score_from:bigint>>, {DISCLOSURES}",
    "references": f"id string, artifact_ref string, panel_ref string, self_consistency struct<floor_measurement_ref:string>, {DISCLOSURES}",
    "pipelines": f"id string, author struct<name:string>, lane struct<name:string,bridge:struct<panel_ref:string,sealed_measurement_ref:string>>, {DISCLOSURES}",
    "measurements": "id string, status string, artifact_ref string, panel_ref string, reference_ref string, pipeline_ref string, model_ref string, supersedes string, scope_digest string,"
    " metric struct<name:string,value:double,units:string,direction:string>, auxiliary_metrics struct<top1_agreement:double>, estimator struct<accumulation_dtype:string,stack_relation:string,head_policy:string>,"
    " uncertainty struct<method:string,ci95_low:double,ci95_high:double>, measurement_scope struct<covers_full_panel:boolean,scored_positions:bigint,contexts:bigint>,"
    " by_domain array<struct<domain:string,windows:bigint,ci95_low:double,interval_method:string,bootstrap_b:bigint,bootstrap_seed:bigint,df:double,t_critical:double,coverage_measured:struct<measured:double,nominal:double>>>,"
    " comparability struct<key:string,class:string,usable_as_floor:boolean,key_inputs:map<string,string>,bias:struct<kind:string,direction:string,detail:string,floor_measurement_ref:string>>,"
    " determinism struct<run_count:bigint,evidence_kind:string,evidence_hashes:array<string>,distinct_evidence_hash_count:bigint,identical_across_runs:boolean,run_means:array<double>,min_run_mean:double,max_run_mean:double,population_stddev_of_run_means:double>,"
    " provenance struct<measured_by:string,independently_verified:boolean,measurer:struct<name:string,handle:string,url:string,is_registry_maintainer:boolean>,sources:array<struct<kind:string,uri:string,sha256:string>>,verification:struct<verified_by:struct<name:string>,verification_measurement_ref:string>>,"
    f" harness struct<recorded:boolean,harness_id:string,boundary:string,repository:string,covers:array<string>,code_digests:array<struct<role:string,path:string,sha256:string>>,tool_versions:map<string,string>>, {DISCLOSURES}",
}

# The fields of a comparability key in order, kinds of evidence and of sources, lanes.
KEY_FIELDS = {"panel_id": "panel_ref", "reference_id": "reference_ref", "metric_name": "metric.name", "direction": "metric.direction", "accumulation_dtype": "estimator.accumulation_dtype", "stack_relation": "estimator.stack_relation", "head_policy": "estimator.head_policy"}
CONTENT_EVIDENCE = "'tokenwise_kld_sha256', 'logits_tensor_sha256', 'hidden_state_tensor_sha256', 'sealed_tokenwise_digest'"
HASHED_SOURCES = "'receipt_file', 'hf_file', 'github_file'"
SEALED_LANE = "sealed-ep8"
# How a census note spells a group of tensors; endings of source files, and a project whose name has one.
CENSUS = r"\\b\\d+ x ([A-Za-z0-9_:.\\-]+?(?:@\\d+(?:\\.\\d+)?)?) \\("
SOURCE_NAME = r"(?i)(?<![^\\s(),])(?![^\\w(),]*(?-i:llama\\.cpp)[^\\w./-]*([\\s(),]|$))[^\\s(),]+\\.(py|sh|c|cc|cpp|cu|h|hpp|rs|go|java|ts|js)[^\\w./-]*([\\s(),]|$)"


def disclosed(of: str, code: str, affects: bool = False) -> str:
    return f"coalesce(exists({of}.disclosures, d -> d.code = '{code}'{' AND coalesce(d.affects_comparability, false)' if affects else ''}), false)"


def unlike(a: str, b: str, rel: str = "1e-12", absolute: str = "1e-15") -> str:
    return f"abs({a} - {b}) > greatest({absolute}, {rel} * greatest(abs({a}), abs({b})))"


def mean(of: str) -> str:
    return f"aggregate({of}, 0D, (s, x) -> s + x) / size({of})"


def unresolved(field: str, row: str, optional: bool = False) -> str:
    return f"{field} IS NOT NULL AND {row} IS NULL" if optional else f"{row} IS NULL"


UNKNOWN = "coalesce(exists(a.scope.assignments, x -> x.treatment = 'unknown'), false)"
COVERS = "coalesce(exists(scope.assignments, x -> {}), false)"
QUANTIZED = "filter(scope.assignments, x -> x.treatment = 'quantized')"
FORMATS = f"size(array_distinct(transform({QUANTIZED}, x -> struct(x.format, x.bits_per_weight))))"
HASHED = f"filter(provenance.sources, s -> s.kind IN ({HASHED_SOURCES}) AND s.sha256 IS NOT NULL)"
SELF = "provenance.measured_by = 'self-measured'"
LANE = f"coalesce(l.lane.name, '{SEALED_LANE}')"
FLOOR_LANE = f"coalesce(fl.lane.name, '{SEALED_LANE}')"
CROSS = "estimator.stack_relation = 'cross_stack'"
STRICT = "comparability.class = 'strict'"
DET, BIAS = "determinism", "comparability.bias"
SEEDS = "transform(filter(by_domain, c -> c.ci95_low IS NOT NULL AND c.bootstrap_seed IS NOT NULL), c -> c.bootstrap_seed)"
SPREAD = f"sqrt(aggregate({DET}.run_means, 0D, (s, x) -> s + pow(x - {mean(f'{DET}.run_means')}, 2)) / size({DET}.run_means))"

# Conditions on a measurement.  a, p, r, l, o: its artifact, panel, reference, pipeline, model; ra: the reference's
# artifact; f, fl: its floor and the floor's pipeline; superseded, verifier: what it supersedes, what verifies it.
# No variable inside a condition has the name of such a row.
MEASUREMENT_RULES: list[Rule] = [
    *(("REF-001", "error", unresolved(field, row)) for field, row in (("artifact_ref", "a"), ("panel_ref", "p"), ("reference_ref", "r"), ("pipeline_ref", "l"), ("model_ref", "o"))),
    ("REF-003", "error", "a IS NOT NULL AND NOT a.model_ref <=> model_ref"),
    ("REF-004", "error", "r IS NOT NULL AND NOT r.panel_ref <=> panel_ref"),
    ("REF-005", "error", f"ra IS NOT NULL AND NOT ra.model_ref <=> model_ref AND NOT {disclosed('r', 'cross_model_reference')}"),
    ("REF-006", "error", "p IS NOT NULL AND NOT coalesce(array_contains(p.model_scope, model_ref), false)"),
    ("REF-010", "error", f"{unresolved('supersedes', 'superseded', True)} OR supersedes = id"),
    ("REF-010", "error", f"{unresolved(f'{BIAS}.floor_measurement_ref', 'f', True)} OR {BIAS}.floor_measurement_ref = id"),
    ("REF-010", "error", unresolved("provenance.verification.verification_measurement_ref", "verifier", True)),
    ("CMP-001", "error", "NOT comparability.key <=> want_key"),
    *(("CMP-002", "error", f"NOT comparability.key_inputs['{k}'] <=> {f}") for k, f in KEY_FIELDS.items()),
    ("SCOPE-001", "error", "a IS NOT NULL AND NOT scope_digest <=> a.scope_digest"),
    ("SCOPE-007", "error", "measurement_scope.covers_full_panel AND (measurement_scope.scored_positions <> p.structure.scored_positions_total OR measurement_scope.contexts <> p.structure.contexts)"),
    ("SCOPE-009", "error", f"{STRICT} AND {UNKNOWN}"),
    ("PANEL-006", "warn", f"{STRICT} AND NOT coalesce(p.contamination.checked, false)"),
    ("PANEL-007", "error", f"{STRICT} AND NOT coalesce(p.sealed, false)"),
    ("PANEL-002", "error", f"array_contains({DET}.evidence_hashes, p.identity.panel_receipt_sha256)"),
    ("BIAS-001", "error", f"{CROSS} AND ({BIAS} IS NULL OR NOT {BIAS}.kind <=> 'cross_stack_capture_replay' OR {BIAS}.direction <=> 'unknown' OR ({BIAS}.floor_measurement_ref IS NULL AND length(coalesce({BIAS}.detail, '')) < 40))"),
    ("BIAS-002", "error", "f IS NOT NULL AND NOT f.comparability.key <=> comparability.key"),
    ("BIAS-003", "error", f"{STRICT} AND {BIAS} IS NOT NULL"),
    ("BIAS-004", "error", "f IS NOT NULL AND NOT floor_is_unquantized"),
    ("BIAS-006", "error", f"f IS NOT NULL AND {LANE} <> {FLOOR_LANE}"),
    ("BIAS-007", "error", "NOT f.comparability.usable_as_floor"),
    ("DET-001", "error", f"{DET}.identical_across_runs AND (NOT coalesce({DET}.evidence_kind IN ({CONTENT_EVIDENCE}), false) OR coalesce(size({DET}.evidence_hashes), 0) <> 1 OR NOT {DET}.distinct_evidence_hash_count <=> 1 OR coalesce({DET}.run_count, 0) < 2)"),
    ("DET-002", "error", f"{DET}.run_means IS NOT NULL AND NOT size({DET}.run_means) <=> {DET}.run_count"),
    ("DET-002", "error", f"size({DET}.run_means) = {DET}.run_count AND size({DET}.run_means) > 0 AND (coalesce({unlike(f'{DET}.min_run_mean', f'array_min({DET}.run_means)')}, false) OR coalesce({unlike(f'{DET}.max_run_mean', f'array_max({DET}.run_means)')}, false) OR coalesce({unlike(f'{DET}.population_stddev_of_run_means', SPREAD)}, false))"),
    ("DET-003", "error", f"metric.name = 'mean_of_run_means_tokenwise_kld' AND size({DET}.run_means) > 0 AND coalesce({unlike('metric.value', mean(f'{DET}.run_means'))}, true)"),
    ("DET-004", "error", f"{DET}.run_means IS NOT NULL AND {DET}.population_stddev_of_run_means = 0 AND {DET}.run_count >= 2 AND {DET}.identical_across_runs AND NOT coalesce({DET}.evidence_kind IN ({CONTENT_EVIDENCE}), false)"),
    ("DET-005", "error", f"{DET}.run_count = 0 AND NOT status <=> 'pending'"),
    ("DET-006", "warn", f"{SELF} AND status = 'published' AND coalesce({DET}.run_count, 0) < 5 AND NOT {disclosed('m', 'reduced_run_count')} AND NOT {disclosed('m', 'single_run')}"),
    ("STAT-001", "error", "metric.value NOT BETWEEN uncertainty.ci95_low AND uncertainty.ci95_high"),
    ("STAT-002", "error", "uncertainty.method = 'none' AND (uncertainty.ci95_low IS NOT NULL OR uncertainty.ci95_high IS NOT NULL)"),
    ("STAT-002", "error", "coalesce(uncertainty.method, '') NOT IN ('none', 'unknown') AND uncertainty.ci95_low IS NULL"),
    ("STAT-003", "error", "endswith(metric.name, '_kld') AND NOT metric.units <=> 'nats'"),
    ("STAT-004", "error", "contains(metric.name, 'kld') AND metric.value < -1e-9"),
    ("STAT-005", "warn", "status = 'published' AND contains(metric.name, 'kld') AND auxiliary_metrics.top1_agreement IS NULL"),
    ("IDENT-001", "error", f"status = 'published' AND a.huggingface.revision IS NULL AND NOT {disclosed('m', 'revision_unpinned', True)} AND NOT {disclosed('a', 'revision_unpinned', True)}"),
    ("PROV-001", "error", f"{SELF} AND (NOT coalesce(provenance.measurer.is_registry_maintainer, false) OR coalesce(size({HASHED}), 0) = 0)"),
    ("PROV-002", "error", f"NOT coalesce({SELF}, false) AND (coalesce(provenance.measurer.is_registry_maintainer, false) OR NOT comparability.class <=> 'advisory' OR NOT {disclosed('m', 'author_reported_only')})"),
    ("PROV-003", "error", "provenance.independently_verified AND (provenance.verification IS NULL OR provenance.verification.verified_by.name <=> provenance.measurer.name)"),
    ("PROV-004", "error", f"provenance.independently_verified AND NOT coalesce(exists(provenance.sources, s -> s.kind IN ({HASHED_SOURCES}) OR (s.kind = 'url' AND s.sha256 IS NOT NULL)), false)"),
    ("PROV-005", "warn", "exists(provenance.sources, s -> s.kind = 'receipt_file' AND startswith(s.uri, '/')) AND NOT exists(provenance.sources, s -> s.kind IN ('hf_file', 'github_file'))"),
    ("PROV-007", "error", f"{SELF} AND {disclosed('m', 'author_reported_only')}"),
    ("PROV-008", "error", f"{SELF} AND l.author.name <> coalesce(provenance.measurer.name, '')"),
    ("PROV-012", "error", f"{LANE} <> '{SEALED_LANE}' AND (NOT {disclosed('m', 'non_sealed_lane', True)} OR {BIAS} IS NULL)"),
    ("PROV-017", "error", r"exists(provenance.sources, s -> s.uri RLIKE '^[/\\\\~]|^(?i)file:|^[A-Za-z]:[/\\\\]')"),
    ("HARN-001", "error", "harness IS NULL OR ((NOT coalesce(array_contains(harness.covers, 'metric.value'), false) OR NOT coalesce(harness.recorded, false)) AND NOT allowed)"),
    ("HARN-002", "error", "harness.recorded AND (harness.boundary IS NULL OR coalesce(size(harness.code_digests), 0) = 0 OR coalesce(size(harness.tool_versions), 0) = 0 OR harness.repository IS NULL)"),
    ("HARN-002", "error", "harness.recorded AND (size(array_distinct(harness.code_digests.role)) <> size(harness.code_digests) OR exists(harness.code_digests, d -> d.path RLIKE '^(/|[.][.])'))"),
    ("HARN-002", "error", "harness IS NOT NULL AND NOT coalesce(harness.recorded, false) AND (harness.harness_id IS NOT NULL OR size(harness.code_digests) > 0)"),
    ("HARN-004", "error", f"allowed AND harness IS NOT NULL AND NOT (coalesce(harness.recorded, false) AND coalesce(array_contains(harness.covers, 'metric.value'), false)) AND NOT {disclosed('m', 'harness_unrecorded')}"),
    ("STAT-008", "error", f"size(array_distinct({SEEDS})) < size({SEEDS})"),
    ("DISC-003", "error", "exists(m.disclosures, d -> d.severity = 'blocking') AND coalesce(status, '') NOT IN ('pending', 'retracted')"),
]

DOMAIN_RULES: list[Rule] = [
    ("STAT-007", "error", "c.windows < 10 AND c.coverage_measured IS NULL"),
    ("STAT-007", "warn", "c.coverage_measured.measured > c.coverage_measured.nominal + 0.02"),
    ("STAT-009", "error", "c.interval_method IS NULL"),
    ("STAT-009", "error", "c.ci95_low < 0"),
    ("STAT-009", "error", "CASE WHEN startswith(coalesce(c.interval_method, ''), 'window_block') THEN c.bootstrap_b IS NULL OR c.bootstrap_seed IS NULL ELSE c.df IS NULL OR c.t_critical IS NULL END"),
]

# Conditions on an artifact.  o: its model; parent: what it derives from; want_digest: its scope's digest, recomputed.
ARTIFACT_RULES: list[Rule] = [
    ("REF-001", "error", unresolved("model_ref", "o")),
    ("REF-001", "error", unresolved("derived_from_artifact_ref", "parent", True)),
    ("SCOPE-002", "error", "NOT scope_digest <=> want_digest"),
    ("SCOPE-003", "error", f"scope.policy = 'uniform' AND {FORMATS} > 1"),
    ("SCOPE-003", "error", f"scope.policy = 'mixed' AND {FORMATS} < 2 AND NOT {UNKNOWN}"),
    ("SCOPE-004", "error", "size(array_distinct(transform(scope.assignments, x -> struct(x.tensor_class, x.layer_range)))) <> size(scope.assignments)"),
    *(("SCOPE-004", "error", f"NOT {COVERS.format(c)}") for c in ("x.tensor_class = 'embed_tokens'", "x.tensor_class = 'lm_head'", "startswith(x.tensor_class, 'attn.')", "startswith(x.tensor_class, 'mlp.') OR startswith(x.tensor_class, 'moe.')")),
    ("SCOPE-005", "error", "scope.head_policy IN ('quantized', 'native') AND NOT get(filter(scope.assignments, x -> x.tensor_class = 'lm_head'), 0).treatment <=> scope.head_policy AND exists(scope.assignments, x -> x.tensor_class = 'lm_head')"),
    ("SCOPE-006", "warn", f"codec.bits_per_weight_effective NOT BETWEEN array_min(transform({QUANTIZED}, x -> x.bits_per_weight)) AND 16"),
    ("SCOPE-008", "error", "codec.calibration.overlaps_any_panel AND coalesce(size(codec.calibration.overlapping_panel_refs), 0) = 0"),
    ("SCOPE-009", "error", f"{UNKNOWN} AND NOT {disclosed('a', 'artifact_identity_incomplete')}"),
    ("SCOPE-011", "error", f"exists({QUANTIZED}, x -> size(regexp_extract_all(x.note, '{CENSUS}', 1)) > 0 AND forall(regexp_extract_all(x.note, '{CENSUS}', 1), t -> startswith(t, 'native:')))"),
    ("IDENT-003", "error", unlike("weights.size_gb", "weights.size_bytes / 1e9D", "1e-6")),
    ("IDENT-004", "warn", "cross_refs.local_ai_registry.match_confidence = 'exact' AND cross_refs.local_ai_registry.model_instance_id IS NULL"),
    ("IDENT-005", "error", "weights.size_bytes IS NOT NULL AND weights.size_basis IS NULL"),
]

# Conditions on a panel; parent: the panel that it derives from.
PANEL_RULES: list[Rule] = [
    ("REF-008", "error", unresolved("derived_from", "parent", True)),
    ("PANEL-001", "error", "sealed AND (identity.panel_token_sha256 IS NULL OR coalesce(identity.hash_covers, '') NOT IN ('token_ids', 'token_manifest'))"),
    ("PANEL-002", "error", "identity.panel_receipt_sha256 = identity.panel_token_sha256"),
    ("PANEL-003", "error", "NOT coalesce(structure.scoring_window.windowed, false) AND structure.contexts * structure.positions_per_context <> structure.scored_positions_total"),
    ("PANEL-005", "error", "parent IS NOT NULL AND derivation.kind = 'scoring_window_change' AND coalesce(structure.scoring_window.score_from, 0) <= coalesce(parent.structure.scoring_window.score_from, 0)"),
    ("PANEL-008", "error", "derivation.kind IN ('shard_subset', 'stratum_subset') AND identity.panel_token_sha256 = parent.identity.panel_token_sha256"),
    ("PANEL-009", "error", "derivation.kind = 'scoring_window_change' AND structure.scored_positions_total >= parent.structure.scored_positions_total"),
]

# Conditions on a reference (a, p, f: its artifact, panel, floor) and on a pipeline (p, f: its bridge's panel and sealed row).
REFERENCE_RULES: list[Rule] = [("REF-001", "error", unresolved("artifact_ref", "a")), ("REF-001", "error", unresolved("panel_ref", "p")), ("REF-010", "error", unresolved("self_consistency.floor_measurement_ref", "f", True))]
PIPELINE_RULES: list[Rule] = [
    ("REF-001", "error", unresolved("lane.bridge.panel_ref", "p", True)),
    ("REF-010", "error", unresolved("lane.bridge.sealed_measurement_ref", "f", True)),
    ("PROV-012", "error", "f IS NOT NULL AND (NOT f.panel_ref <=> coalesce(lane.bridge.panel_ref, f.panel_ref) OR f.pipeline_ref = id)"),
]

PINNED = "(s.sha256 IS NOT NULL OR (NOT lower(s.uri) RLIKE '/(blob|resolve|tree)/main/' AND s.uri RLIKE '(?i)(^|/)[0-9a-f]{40}(/|$)'))"
DISCLOSURE_RULES: list[Rule] = [
    ("DISC-001", "error", "coalesce(size(disclosures), 0) = 0"),
    ("DISC-002", "error", "exists(disclosures, d -> d.code = 'no_known_deviations') AND size(disclosures) > 1"),
    ("DISC-004", "error", "exists(disclosures, d -> NOT coalesce(array_contains(known_codes, d.code), false))"),
    ("PROV-014", "error", "exists(disclosures, d -> d.asserts_provenance AND coalesce(size(d.sources), 0) = 0)"),
    ("PROV-015", "error", f"exists(disclosures, d -> exists(d.sources, s -> (coalesce(d.asserts_provenance, false) OR s.lines IS NOT NULL) AND NOT coalesce({PINNED}, false)))"),
    ("PROV-016", "error", f"collection IN ('artifacts', 'models') AND exists(disclosures, d -> NOT coalesce(d.asserts_provenance, false) AND d.detail RLIKE '{SOURCE_NAME}')"),
]


def load(spark: SparkSession, folder: str) -> Registry:
    """The collections of a folder of ``<collection>.jsonl``; of rows with one id the last stays, an absent file is empty."""
    out = {}
    for name, schema in SCHEMAS.items():
        try:
            d = spark.read.schema(schema).json(f"{folder}/{name}.jsonl")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            d = spark.createDataFrame([], schema)
        row = F.struct(*d.columns)
        out[name] = d.withColumn("row", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by(row, "row").alias("last")).select("last.*")
    return out


def broken(d: DataFrame, rules: list[Rule], id_col: str = "id") -> DataFrame:
    """``code``, ``severity``, ``id``: every code that a row breaks, once, in one pass over the rows."""
    found = F.array(*(F.when(F.expr(condition), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, condition in rules))
    d = d.select(F.col(id_col).alias("id"), F.array_distinct(F.array_compact(found)).alias("found"))
    return d.select("id", F.explode("found").alias("v")).select("v.code", "v.severity", "id")


def about(rules: list[Rule], *rows: str) -> list[Rule]:
    """The rules that look at one of ``rows``, the names of what a row refers to."""
    return [r for r in rules if re.search(rf"(?<![\w.])({'|'.join(rows)})(?=\.| IS )", r[2])]


def narrow(target: DataFrame, name: str, rules: list[Rule], *more: str) -> DataFrame:
    """``id`` and what the rules look at of ``target`` by this ``name``, to two levels, and the fields ``more``."""
    paths = sorted({*more, *(x for r in rules for x in re.findall(rf"(?<![\w.]){name}\.(\w+(?:\.\w+)?)", r[2]))} - {"id"})
    tops: dict[str, list[str]] = {}
    for top, _, rest in (x.partition(".") for x in paths):
        tops.setdefault(top, []).append(rest)
    whole = lambda top: "" in tops[top] or not isinstance(target.schema[top].dataType, T.StructType)
    return target.select("id", *(F.col(top) if whole(top) else F.struct(*(f"{top}.{x}" for x in rest)).alias(top) for top, rest in tops.items()))


def judged(d: DataFrame, name: str, rules: list[Rule], optional: tuple[str, ...] = (), shuffled: tuple[str, ...] = (), /, **to: tuple[str, DataFrame]) -> list[DataFrame]:
    """``broken`` for rules over rows and what they refer to.

    Only references that rules look at are resolved, with the fields that they look at.  Rules that look at none are
    judged without a join, and those that look at an ``optional`` reference only where there is one: none of them is broken elsewhere.
    Rules that look at a ``shuffled`` reference have a join of their own, so that rows are shuffled with what these need.
    """
    parts, left = [], rules
    own = lambda some: referring(d, name, **{k: (field, narrow(target, k, some)) for k, (field, target) in to.items() if about(some, k)})
    for row in optional:
        some, left = about(left, row), [r for r in left if r not in about(left, row)]
        if some:
            field = to[row][0]
            parts.append(broken(own(some).where(f"{field} IS NOT NULL"), some))
    joined = about(left, *to)
    far = about(joined, *shuffled) if shuffled else []
    return parts + [broken(own(some), some) for some in ([r for r in left if r not in joined], [r for r in joined if r not in far], far) if some]


def referring(d: DataFrame, name: str, /, **to: tuple[str, DataFrame]) -> DataFrame:
    """Rows of ``d``, also whole as ``name``, with the row that each reference resolves to: name=(field, collection)."""
    d = d.withColumn(name, F.struct(*d.columns))
    for row, (field, target) in to.items():
        d = d.join(target.select(F.col("id").alias(f"{row}_id"), F.struct(*target.columns).alias(row)), F.expr(field) == F.col(f"{row}_id"), "left").drop(f"{row}_id")
    return d


def scope_digest(scope: str = "scope") -> Column:
    """The assignments in order, then head and cache; whole numbers of bits are written without a point."""
    bits = "CASE WHEN x.bits_per_weight = floor(x.bits_per_weight) THEN concat('@', cast(cast(x.bits_per_weight AS bigint) AS string)) ELSE coalesce(concat('@', cast(x.bits_per_weight AS string)), '') END"
    each = f"array_sort(transform({scope}.assignments, x -> concat(x.tensor_class, '=', x.treatment, ':', x.format, {bits})))"
    return F.expr(f"concat(array_join({each}, '|'), '|head=', {scope}.head_policy, '|kv=', {scope}.kv_cache_dtype)")


def cycles(records: DataFrame, parent: str, code: str) -> DataFrame:
    """Rows whose way up, however long, never ends."""
    ends = closure.forest(records.select(F.col("id").alias("node"), F.col(parent).alias("up"))).ends
    return ends.where("cycle IS NOT NULL").select(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col("node").alias("id"))


def token_families(panels: DataFrame) -> DataFrame:
    """PANEL-004: panels that share a token digest must come from one root by derivations that keep tokens.

    A panel whose derivations go round in a cycle has no root; REF-008 names it.
    """
    parent = F.when(F.col("derivation.kind").isin("reformat", "scoring_window_change"), F.col("derived_from"))
    root = closure.roots(panels.select(F.col("id").alias("node")), panels.select(F.col("id").alias("node"), parent.alias("up"))).select(F.col("node").alias("id"), "root")
    p = bounded(panels.select("id", F.col("identity.panel_token_sha256").alias("token")).where("token IS NOT NULL")).join(root, "id")
    return p.groupBy("token").agg(F.count_distinct("root").alias("roots"), F.min("id").alias("id")).where("roots > 1").select(F.lit("PANEL-004").alias("code"), F.lit("error").alias("severity"), "id")


def from_base(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The pairs (lower, upper) of which lower is an artifact of kind base that derives from upper, by artifacts of any kind."""
    base = written(artifacts.where("kind = 'base'").select(F.col("id").alias("lower")).distinct(), "base")
    return closure.descends(pairs.join(bounded(base), "lower"), artifacts.select(F.col("id").alias("node"), F.col("derived_from_artifact_ref").alias("up")))


def group_rules(m: DataFrame) -> DataFrame:
    """CMP-003, CMP-005 over the members of a recomputed key."""
    g = m.groupBy(F.col("want_key").alias("k")).agg(F.count("*").alias("n"), (F.count_distinct("measurement_scope.scored_positions") + F.max(F.col("measurement_scope.scored_positions").isNull().cast("int"))).alias("kinds"))
    return broken(m.join(g, F.col("want_key") == F.col("k")), [("CMP-003", "error", "kinds > 1 AND measurement_scope.covers_full_panel"), ("CMP-005", "warn", "n = 1")])


def unmeasured(measurements: DataFrame, allowed: list[str]) -> DataFrame:
    """HARN-006: allowed ids that no measurement has."""
    named = measurements.sparkSession.createDataFrame([(x,) for x in sorted(set(allowed))], "id string")
    there = sought(measurements.select("id"), named, F.col("id"), True, True)
    return named.join(there, "id", "left_anti").select(F.lit("HARN-006").alias("code"), F.lit("error").alias("severity"), "id")


def same_weights(artifacts: DataFrame) -> DataFrame:
    """IDENT-002, IDENT-006: the artifact before it has the same repository, revision and path."""
    w = Window.partitionBy("huggingface.repository", "huggingface.revision", F.coalesce("huggingface.path", F.lit(""))).orderBy("id")
    named = artifacts.where("huggingface.repository IS NOT NULL AND huggingface.revision IS NOT NULL")
    d = named.withColumns({"before": F.lag("id").over(w), "before_digest": F.lag("scope_digest").over(w)})
    return broken(d, [("IDENT-002", "error", "before IS NOT NULL AND scope_digest <=> before_digest"), ("IDENT-006", "warn", "before IS NOT NULL AND huggingface.path IS NULL")])


def violations(registry: Registry, known_codes: list[str], allowed: list[str] = (), codes: tuple[str, ...] = ()) -> DataFrame:
    """``code``, ``severity``, ``id`` of everything in the registry that breaks a rule, or one whose code begins with one of ``codes``.

    ``known_codes``: disclosure codes; ``allowed``: ids of measurements that may lack a recorded harness.
    Chains of derivation are followed to their ends, which writes tables to the shared folder.
    """
    models, artifacts, panels, references, pipelines, measurements = (registry[k] for k in SCHEMAS)
    large = {k for k, d in registry.items() if many(d)}

    def seek(target: str, rows: str, field: str) -> DataFrame:
        return sought(registry[target], registry[rows], F.expr(field), target in large, rows not in large)

    def listed(target: str) -> DataFrame:
        return registry[target].hint("merge") if target in large else registry[target]

    def to(rows: str, **fields: tuple[str, str]) -> dict[str, tuple[str, DataFrame]]:
        """What the rows of a collection refer to: name=(field, collection)."""
        return {name: (field, seek(target, rows, field)) for name, (field, target) in fields.items()}

    key = comparability_key(*(F.coalesce(F.translate(F.expr(f).cast("string"), "|", "¦"), F.lit("None")) for f in KEY_FIELDS.values()))
    wanted = lambda *own: not codes or any(c.startswith(tuple(codes)) for c in own)
    rules = [r for r in MEASUREMENT_RULES if wanted(r[0])]
    m = measurements.withColumns({"want_key": key, "allowed": F.coalesce(F.col("id").isin(*allowed), F.lit(False)) if allowed else F.lit(False)})
    of_floor = about(rules, "f", "fl")
    rules = [r for r in rules if r not in of_floor]
    of_floors = wanted("FLOOR-001", "FLOOR-002", "FLOOR-003")
    lane_of = seek("pipelines", "measurements", "pipeline_ref")
    parts: list[DataFrame] = []
    if of_floor or of_floors or about(rules, "r", "ra"):
        # references are joined with their artifacts before they are joined with the many rows that share them
        bound = written(referring(narrow(references, "r", rules, "artifact_ref"), "own", ra=("artifact_ref", narrow(seek("artifacts", "references", "artifact_ref"), "ra", rules))).drop("own"), "references")
        bound = bound.hint("merge") if "references" in large else bound
    if rules:
        of_reference = about(rules, "r", "ra")
        if of_reference:
            parts.append(broken(referring(m, "m", r=("reference_ref", bound)).withColumn("ra", F.col("r.ra")), of_reference))
        rules = [r for r in rules if r not in of_reference]
        refs = to("measurements", a=("artifact_ref", "artifacts"), p=("panel_ref", "panels"), l=("pipeline_ref", "pipelines"), o=("model_ref", "models"), superseded=("supersedes", "measurements"), verifier=("provenance.verification.verification_measurement_ref", "measurements"))
        parts += judged(m, "m", rules, ("superseded", "verifier"), ("a",) if "artifacts" in large else (), **refs)
    if of_floor:
        lanes = {"l": ("pipeline_ref", narrow(lane_of, "l", of_floor)), "fl": ("f.pipeline_ref", narrow(lane_of, "fl", of_floor))}
        floored = referring(m.where(f"{BIAS}.floor_measurement_ref IS NOT NULL"), "m", f=(f"{BIAS}.floor_measurement_ref", narrow(seek("measurements", "measurements", f"{BIAS}.floor_measurement_ref"), "f", of_floor, "artifact_ref", "pipeline_ref")), r=("reference_ref", bound), **{k: v for k, v in lanes.items() if about(of_floor, k)})
    if wanted("BIAS-004") or of_floors:
        upper = bound.select(F.col("id").alias("reference_ref"), F.col("artifact_ref").alias("upper"))
        pairs = [measurements.select(F.col("artifact_ref").alias("lower"), "reference_ref").join(upper, "reference_ref").drop("reference_ref")] if of_floors else []
        pairs += [floored.select(F.col("f.artifact_ref").alias("lower"), F.col("r.artifact_ref").alias("upper"))] if of_floor else []
        bases = bounded(written(from_base(reduce(DataFrame.unionByName, pairs), artifacts), "bases")).select(F.col("lower").alias("fa"), F.col("upper").alias("fr"), F.lit(True).alias("from_base"))
    else:
        bases = m.sparkSession.createDataFrame([], "fa string, fr string, from_base boolean")
    if of_floor:
        floored = floored.join(bases, (F.col("f.artifact_ref") == F.col("fa")) & (F.col("r.artifact_ref") == F.col("fr")), "left").withColumn("floor_is_unquantized", F.coalesce("from_base", F.lit(False)) | F.col("f.artifact_ref").eqNullSafe(F.col("r.artifact_ref")))
        parts.append(broken(floored, of_floor))

    def floor_rules() -> DataFrame:
        ranked = measurements.where("status = 'published' AND metric.value IS NOT NULL AND comparability.key IS NOT NULL")
        ranked = referring(ranked, "m", r=("reference_ref", bound), l=("pipeline_ref", lane_of.select("id", "lane")))
        ranked = ranked.join(bases, (F.col("artifact_ref") == F.col("fa")) & (F.col("r.artifact_ref") == F.col("fr")), "left")
        ranked = ranked.select("id", F.col("comparability.key").alias("key"), F.expr(LANE).alias("lane"), F.col("metric.value").alias("value"), (F.coalesce("from_base", F.lit(False)) | F.col("artifact_ref").eqNullSafe(F.col("r.artifact_ref"))).alias("zero"), F.coalesce("comparability.usable_as_floor", F.lit(True)).alias("usable"))
        # one row a key and lane: written, as its rows then tell whether it can go to the tasks
        floors = bounded(written(ranked.where("zero AND usable").groupBy("key", "lane").agg(F.max("value").alias("floor")), "floors"))
        return floor_violations(ranked.where("NOT zero"), floors).select("code", "severity", "id")

    cells = measurements.select("id", F.explode("by_domain").alias("c")).where("c.ci95_low IS NOT NULL")
    live = measurements.withColumns({"live": ~F.coalesce(F.col("status").isin("superseded", "retracted"), F.lit(False)), "name": F.col("metric.name"), "stack": F.col("estimator.stack_relation"), "head": F.col("estimator.head_policy"), "by": F.col("provenance.measured_by")})
    own = F.array(*map(F.lit, known_codes))
    disclosures = [d.select("id", "disclosures", F.lit(name).alias("collection")) for name, d in registry.items()]
    scopes = panels.select("id", F.col("tokenizer.id").alias("tokenizer"), F.explode("model_scope").alias("model")).join(listed("models").select(F.col("id").alias("model"), F.col("tokenizer.id").alias("other"), F.lit(True).alias("there")), "model", "left")
    weights = models.select("id", F.col("canonical_weights.artifact_ref").alias("ref")).join(seek("artifacts", "models", "canonical_weights.artifact_ref").select(F.col("id").alias("ref"), F.lit(True).alias("there")), "ref", "left")
    crossed = measurements.where(CROSS).select(F.col("reference_ref").alias("id")).distinct().join(listed("references").select("id", "self_consistency"), "id", "left")
    tables = [
        (cells, DOMAIN_RULES),
        (scopes, [("REF-001", "error", "there IS NULL"), ("REF-007", "error", "there AND NOT tokenizer <=> other")]),
        (weights, [("REF-001", "error", "there IS NULL")]),
        (crossed, [("REFC-004", "warn", "self_consistency.floor_measurement_ref IS NULL")]),
        (reduce(DataFrame.unionByName, disclosures).withColumn("known_codes", own), DISCLOSURE_RULES),
    ]
    referred = [
        (artifacts.withColumn("want_digest", scope_digest()), "a", ARTIFACT_RULES, ("parent",), to("artifacts", o=("model_ref", "models"), parent=("derived_from_artifact_ref", "artifacts"))),
        (panels, "panel", PANEL_RULES, ("parent",), to("panels", parent=("derived_from", "panels"))),
        (references, "ref", REFERENCE_RULES, ("f",), to("references", a=("artifact_ref", "artifacts"), p=("panel_ref", "panels"), f=("self_consistency.floor_measurement_ref", "measurements"))),
        (pipelines, "pipeline", PIPELINE_RULES, ("f", "p"), to("pipelines", p=("lane.bridge.panel_ref", "panels"), f=("lane.bridge.sealed_measurement_ref", "measurements"))),
    ]
    for d, name, all_rules, optional, refs in referred:
        parts += judged(d, name, [r for r in all_rules if wanted(r[0])], optional, **refs)
    over_several = [
        (("FLOOR-001", "FLOOR-002", "FLOOR-003"), floor_rules),
        (("CMP-003", "CMP-005"), lambda: group_rules(m)),
        (("CMP-004",), lambda: duplicates(live, ["artifact_ref", "panel_ref", "reference_ref", "pipeline_ref", "name", "stack", "head", "by"], "id", "live").select("code", "severity", "id")),
        (("IDENT-002", "IDENT-006"), lambda: same_weights(artifacts)),
        (("REF-009",), lambda: cycles(artifacts, "derived_from_artifact_ref", "REF-009")),
        (("PANEL-004",), lambda: token_families(panels)),
        (("REF-008",), lambda: cycles(panels, "derived_from", "REF-008")),
        (("HARN-006",), lambda: unmeasured(measurements, list(allowed))),
    ]
    kept = [(d, [r for r in rules if wanted(r[0])]) for d, rules in tables]
    parts += [broken(d, rules) for d, rules in kept if rules] + [make() for own_codes, make in over_several if wanted(*own_codes)]
    if not parts:
        raise ValueError(f"no rule has a code that begins with any of {codes}")
    found = reduce(DataFrame.unionByName, parts).distinct()
    return found.where(F.col("code").rlike(f"^({'|'.join(codes)})")) if codes else found
