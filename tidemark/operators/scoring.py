"""Scoring operators: candidate rows against teacher rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vector as V

from .shared import written


def rows(embeddings: DataFrame, *, bits: int, kind: str = "perrow", scale: float = 16.0, window: int = 25) -> DataFrame:
    """``vec_id``, ``label``, ``window_id``, ``position``, ``teacher``, ``candidate``."""
    t = embeddings.select("vec_id", "label", F.floor(F.col("vec_id") / window).alias("window_id"), (F.col("vec_id") % window).alias("position"), V.widened(F.col("embedding"), scale).alias("teacher"))
    if kind == "perrow":
        return t.withColumn("candidate", V.rtn_symmetric(F.col("teacher"), bits))
    if kind == "group16":
        return t.withColumn("candidate", V.rtn_group_affine(F.col("teacher"), bits, 16))
    if kind == "global":
        top = t.agg(F.max(F.array_max(F.transform("teacher", F.abs))).alias("top"))  # one row
        return t.join(F.broadcast(top)).withColumn("candidate", V.rtn_symmetric(F.col("teacher"), bits, F.col("top"))).drop("top")
    raise ValueError(f"unknown quantiser {kind!r}")


def scored(embeddings: DataFrame, *, bits: int, kind: str = "perrow") -> DataFrame:
    """``rows`` with log-probabilities ``lp`` and ``lq``, ``kld``, ``jsd`` and ``top1_match``."""
    d = rows(embeddings, bits=bits, kind=kind).withColumns({"lp": V.log_softmax(F.col("teacher")), "lq": V.log_softmax(F.col("candidate"))})
    return d.withColumns({"kld": V.kl(F.col("lp"), F.col("lq")), "jsd": V.jsd_bits(F.col("lp"), F.col("lq")), "top1_match": (V.first_argmax(F.col("teacher")) == V.first_argmax(F.col("candidate"))).cast("int")})


def scored_at(embeddings: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """A row for each width: ``bits``, ``kld``, ``top1_match``.  The table is read, and the teacher scored, once."""
    t = rows(embeddings, bits=widths[0]).select("teacher", V.log_softmax(F.col("teacher")).alias("lp"), V.first_argmax(F.col("teacher")).alias("best"))
    each = F.array(*(F.struct(F.lit(b).alias("bits"), V.rtn_symmetric(F.col("teacher"), b).alias("w")) for b in widths))
    d = t.select("lp", "best", F.explode(each).alias("c"))
    return d.select("c.bits", V.kl(F.col("lp"), V.log_softmax(F.col("c.w"))).alias("kld"), (V.first_argmax(F.col("c.w")) == F.col("best")).cast("int").alias("top1_match"))


def offset_audit(d: DataFrame, offsets: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """Mean divergence with the candidate's rows shifted within their window; edge rows drop out.

    An equi-join on (window, shifted position): no theta join.
    """
    left = d.select("window_id", F.col("lp"), F.explode(F.array(*map(F.lit, offsets))).alias("row_offset"), "position").withColumn("at", F.col("position") + F.col("row_offset"))
    right = d.select("window_id", F.col("position").alias("at"), "lq")
    j = left.join(right, ["window_id", "at"])
    return j.groupBy("row_offset").agg(F.count("*").alias("positions"), F.round(F.avg(V.kl(F.col("lp"), F.col("lq"))), 9).alias("mean_kld"))


def chunked_normalizer(d: DataFrame, chunk: int) -> DataFrame:
    """log(sum(exp)) in two steps over chunks of a row: for rows too wide for one array expression."""
    long = d.select("vec_id", F.posexplode("teacher").alias("i", "x")).withColumn("chunk", F.floor(F.col("i") / chunk))
    tops = long.groupBy("vec_id", "chunk").agg(F.max("x").alias("m"), F.collect_list("x").alias("xs"))
    parts = tops.select("vec_id", "m", V.total(F.transform("xs", lambda x: F.exp(x - F.col("m")))).alias("s"))
    whole = parts.groupBy("vec_id").agg(F.max("m").alias("gm"), F.collect_list(F.struct("m", "s")).alias("ps"))
    return whole.select("vec_id", F.round(F.col("gm") + F.log(V.total(F.transform("ps", lambda p: p["s"] * F.exp(p["m"] - F.col("gm"))))), 9).alias("log_normalizer"))


def replay(hidden: DataFrame, head: DataFrame, *, head_bytes: int = 64 << 20) -> DataFrame:
    """Hidden rows (``vec_id``, ``v``) times a head matrix (``token``, ``w``): logits in long form.

    A head of up to ``head_bytes`` bytes, which is measured, goes to every task.  A larger one is dealt by a hash into blocks of
    about that size, which go to every task one after the other: no hidden row moves, and both sides are written once.
    """
    logit = lambda v, w: F.round(V.total(F.zip_with(v, w, lambda x, y: x * y)), 6)
    size = head.agg(F.count("*").alias("n"), F.max(F.size("w")).alias("width")).first()
    blocks = -(-8 * size["n"] * (size["width"] or 0) // head_bytes)
    if blocks <= 1:
        return hidden.join(F.broadcast(head)).select("vec_id", "token", logit("v", "w").alias("logit"))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    rows, dealt = written(hidden.select("vec_id", "v"), "hidden"), written(head.select("token", "w", part("token").alias("block")), "head")
    each = (rows.join(F.broadcast(dealt.where(F.col("block") == k))).select("vec_id", "token", logit("v", "w").alias("logit")) for k in range(blocks))
    return reduce(DataFrame.unionByName, each)


def local_experts(experts: Column, *, rank: int, per_rank: int) -> Column:
    """Expert ids as this rank's slots; others are -1."""
    return F.transform(experts, lambda e: F.when(F.floor(e / per_rank) == rank, F.pmod(e, F.lit(per_rank))).otherwise(F.lit(-1)).cast("long"))


def placement_audit(d: DataFrame, *, shifts: tuple[int, ...]) -> DataFrame:
    """Candidate rows against the teacher's own rows and against shifted ones, by relative L2 distance."""
    cand = d.select(F.explode(F.array(*map(F.lit, (0, *shifts)))).alias("shift"), F.col("vec_id").alias("row"), "candidate").withColumn("at", F.col("row") + F.col("shift"))
    j = cand.join(d.select(F.col("vec_id").alias("at"), "teacher"), "at")
    rel = F.sqrt(F.sum(V.total(F.zip_with("candidate", "teacher", lambda a, b: (a - b) * (a - b))))) / F.sqrt(F.sum(V.total(F.transform("teacher", lambda x: x * x))))
    r = j.groupBy("shift").agg(rel.alias("rel"))
    aligned, control = F.max(F.when(F.col("shift") == 0, F.col("rel"))), F.min(F.when(F.col("shift") > 0, F.col("rel")))
    return r.agg(aligned.alias("a"), control.alias("c")).select(F.round("a", 9).alias("aligned"), F.round("c", 9).alias("best_control"), ((F.col("a") < 0.5) & (F.col("c") > 0.5) & (F.col("c") > 4 * F.col("a"))).alias("passed"))
