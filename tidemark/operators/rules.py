"""Rules as data: predicate trees become one Column, and ordered rules of which the first that holds decides.

A tree is a dict of one operator, as it is read from JSON: ``{"all": [trees]}``, ``{"any": [trees]}``, ``{"not": tree}``,
``{"eq" | "ne" | "lt" | "le" | "gt" | "ge": [column, value]}``, ``{"in": [column, [values]]}``, ``{"null": column}``,
``{"same": [column, column]}`` (null equals null), ``{"contains" | "begins" | "ends": [column, text]}`` (``"icontains"``, ``"ieq"``: in any case), and
``{"matches": [column, pattern]}``.  A comparison with null doesn't hold, and neither is its ``not`` null: it holds.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tree = dict[str, Any]

COMPARISONS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "in": lambda c, v: c.isin(v), "contains": lambda c, v: c.contains(v), "begins": lambda c, v: c.startswith(v), "ends": lambda c, v: c.endswith(v),
    "matches": lambda c, v: c.rlike(v), "icontains": lambda c, v: F.lower(c).contains(v.lower()), "ieq": lambda c, v: F.lower(c) == v.lower(),
}


def compiled(tree: Tree) -> Column:
    """The tree as a condition that is never null; an unknown operator is refused."""
    if not isinstance(tree, dict) or len(tree) != 1:
        raise ValueError(f"a tree has one operator: {tree!r}")
    ((op, given),) = tree.items()
    if op == "all":
        return reduce(lambda a, b: a & b, map(compiled, given), F.lit(True))
    if op == "any":
        return reduce(lambda a, b: a | b, map(compiled, given), F.lit(False))
    if op == "not":
        return ~compiled(given)
    if op == "null":
        return F.col(given).isNull()
    if op == "same":
        return F.col(given[0]).eqNullSafe(F.col(given[1]))
    if op not in COMPARISONS:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(COMPARISONS[op](F.col(given[0]), given[1]), F.lit(False))


def read(text: str) -> list[dict]:
    """Rules from JSON; each has a ``name`` and a tree ``when`` that compiles, names occur once."""
    rules = json.loads(text)
    names = [r["name"] for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("a rule's name occurs twice")
    for r in rules:
        compiled(r["when"])
    return rules


def first(rules: list[dict], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*(F.when(compiled(r["when"]), F.lit(r["name"])) for r in rules), F.lit(otherwise).cast("string"))


def gated(d: DataFrame, rules: list[dict]) -> DataFrame:
    """``d`` with ``gate``, the first rule that refuses a row (null: none does), and ``refused``, all that do, in order."""
    every = F.array_compact(F.array(*(F.when(compiled(r["when"]), F.lit(r["name"])) for r in rules))) if rules else F.array().cast("array<string>")
    return d.withColumn("refused", every).withColumn("gate", F.get("refused", F.lit(0)))


def search(*, model: str | None = None, artifact: str | None = None, panel: str | None = None, lane: str | None = None, measured_by: str | None = None, metric: str | None = None, codec: str | None = None, bpw: float | None = None, klass: str | None = None) -> Tree:
    """What a search of the registry asks for, as a tree over the columns status, model, family, artifact, repository,
    producer, panel, lane, measured_by, measurer, metric, codec, bpw, class.

    Only published rows.  ``model`` is part of the model's name or the whole family's, ``artifact`` part of one of three names, ``panel`` part of
    the panel's, in any case; ``lane="none"`` asks for rows without a lane; the others are equal.
    """
    tests: list[Tree] = [{"eq": ["status", "published"]}]
    if model:
        tests.append({"any": [{"icontains": ["model", model]}, {"ieq": ["family", model]}]})
    if artifact:
        tests.append({"any": [{"icontains": [c, artifact]} for c in ("artifact", "repository", "producer")]})
    if panel:
        tests.append({"icontains": ["panel", panel]})
    if lane:
        tests.append({"null": "lane"} if lane == "none" else {"eq": ["lane", lane]})
    if measured_by:
        tests.append({"any": [{"eq": [c, measured_by]} for c in ("measured_by", "measurer")]})
    tests += [{"eq": [c, v]} for c, v in (("metric", metric), ("codec", codec), ("class", klass)) if v]
    if bpw is not None:
        tests.append({"eq": ["bpw", float(bpw)]})
    return {"all": tests}


# Classes of a decoder's tensors, by name, the first that fits.
TENSOR_CLASSES = [
    ("embed_tokens", r"^model\.(?:language_model\.)?embed_tokens\.weight$"),
    ("lm_head", r"^lm_head\.weight$"),
    ("mtp", r"^model\.(?:language_model\.)?layers\.(\d+)\.(eh_proj|enorm|hnorm|shared_head)\."),
    ("moe.router", r"^model\.(?:language_model\.)?layers\.\d+\.mlp\.gate\.(weight|e_score_correction_bias)$"),
    ("moe.experts", r"^model\.(?:language_model\.)?layers\.\d+\.mlp\.experts\.\d+\."),
    ("moe.shared_expert", r"^model\.(?:language_model\.)?layers\.\d+\.mlp\.shared_experts\."),
    ("mlp.gate", r"^model\.(?:language_model\.)?layers\.\d+\.mlp\.gate_proj\.weight$"),
    ("mlp.up", r"^model\.(?:language_model\.)?layers\.\d+\.mlp\.up_proj\.weight$"),
    ("mlp.down", r"^model\.(?:language_model\.)?layers\.\d+\.mlp\.down_proj\.weight$"),
    ("attn.qkv", r"^model\.(?:language_model\.)?layers\.\d+\.self_attn\.(q_a_proj|q_b_proj|kv_a_proj_with_mqa|kv_b_proj|q_proj|k_proj|v_proj)\.weight$"),
    ("attn.o", r"^model\.(?:language_model\.)?layers\.\d+\.self_attn\.o_proj\.weight$"),
    ("attn.other", r"^model\.(?:language_model\.)?layers\.\d+\.self_attn\."),
    ("norm", r"(^model\.(?:language_model\.)?norm\.weight$|layernorm|\.norm\.)"),
]
# The gates that two captures pass before they are compared, in order; a pair's columns are those of both sides, with _a and _b.
CAPTURE_GATES = [
    {"name": "form", "when": {"all": [{"not": {"same": ["form_a", "form_b"]}}, {"not": {"eq": ["allow_mixed_form", True]}}]}},
    {"name": "provenance", "when": {"all": [{"any": [{"eq": ["preview_a", True]}, {"eq": ["preview_b", True]}]}, {"not": {"eq": ["allow_preview", True]}}]}},
    {"name": "panel", "when": {"any": [{"not": {"same": [f"{c}_a", f"{c}_b"]}} for c in ("suite", "scoring_window", "tokenizer")]}},
    {"name": "head", "when": {"not": {"same": ["head_a", "head_b"]}}},
    {"name": "lane", "when": {"all": [{"not": {"same": ["lane_a", "lane_b"]}}, {"not": {"eq": ["allow_cross_lane", True]}}]}},
    {"name": "geometry", "when": {"any": [{"not": {"same": ["vocab_a", "vocab_b"]}}, {"all": [{"eq": ["form_a", "hidden"]}, {"eq": ["form_b", "hidden"]}, {"not": {"same": ["width_a", "width_b"]}}]}]}},
    {"name": "coverage", "when": {"all": [{"not": {"same": ["contexts_a", "contexts_b"]}}, {"not": {"eq": ["allow_partial", True]}}]}},
]


def tensor_class(column: str) -> Column:
    return first([{"name": n, "when": {"matches": [column, p]}} for n, p in TENSOR_CLASSES], "other")
