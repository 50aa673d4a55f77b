"""Means, errors and verdicts over windows, strata and runs.

Each function takes long rows and returns an aggregate; sums run in double and what is published
is rounded, as the order of a distributed sum isn't fixed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering
from .shared import written


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    value, weight = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    return F.sum(value * weight) / F.sum(weight)


def windows(k: DataFrame, *by: str) -> DataFrame:
    """Count, mean and sample deviation of every window."""
    return k.groupBy("window_id", *by).agg(F.count("*").alias("n"), F.avg("kld").alias("m"), F.stddev_samp("kld").alias("sd"))


def bucket(value: Column, edges: list[int]) -> Column:
    """The label ``a-b`` of the half-open range [edges[i], edges[i+1]) that holds the value."""
    cases = [(value < hi, f"{lo}-{hi - 1}") for lo, hi in zip(edges, edges[1:], strict=False)]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0]))


def stats_block(d: DataFrame, by: list[str], value: str, digits: int = 9) -> DataFrame:
    """mean, median, p95, p99, p99.9 and max, exact, with linear interpolation."""
    names = {0.5: "median", 0.95: "p95", 0.99: "p99", 0.999: "p999"}
    d = written(d.select(*by, value), "values")  # computed once
    q = ordering.wide(ordering.quantiles(d, by, value, list(names)), by, names)
    ends = d.groupBy(*by).agg(F.round(F.avg(value), digits).alias("mean"), F.round(F.max(value), digits).alias("max"))
    return ends.join(q, by).select(*by, "mean", *(F.round(n, digits).alias(n) for n in names.values()), "max")


def pooled(w: DataFrame) -> DataFrame:
    """Pooled deviation, naive and window-clustered errors and their ratio, from window summaries (n, m, sd).

    (N-1) s^2 = sum (n-1) sd^2 + sum n (m-M)^2; the grand mean is one row and is joined as such.
    """
    grand = w.agg(weighted_mean("m", "n").alias("gm"), F.sum("n").alias("nn"), F.count("*").alias("g"))
    d = w.join(F.broadcast(grand))
    gap = F.col("n") * (F.col("m") - F.col("gm"))
    s = d.groupBy("gm", "nn", "g").agg(F.sum((F.col("n") - 1) * F.col("sd") * F.col("sd") + gap * (F.col("m") - F.col("gm"))).alias("ss"), F.sum(gap * gap).alias("cc"))
    return s.select("gm", "nn", "g", F.sqrt(F.col("ss") / (F.col("nn") - 1)).alias("pooled_sd"), F.sqrt(F.col("ss") / (F.col("nn") - 1) / F.col("nn")).alias("se_naive"), (F.sqrt(F.col("g") / (F.col("g") - 1) * F.col("cc")) / F.col("nn")).alias("se_clustered"))


def verdict_of(values: Column, unrecorded: str = "unrecorded") -> Column:
    """fail if members record different values, unknown if one records none, else pass."""
    recorded = F.count_distinct(F.when(values != unrecorded, values))
    return F.when(recorded > 1, "fail").when(F.sum((values == unrecorded).cast("int")) > 0, "unknown").otherwise("pass")


def combined(verdicts: list[str]) -> Column:
    any_is = lambda v: reduce(lambda a, b: a | b, [F.col(c) == v for c in verdicts])
    return F.when(any_is("fail"), "false").when(any_is("unknown"), "unknown").otherwise("true")


def determinism(digest: str, pattern: str = "^[0-9a-f]{64}$") -> Column:
    """true: two runs or more, every digest valid, one value; false: two valid values; else unknown."""
    valid = F.when(F.col(digest).rlike(pattern), F.col(digest))
    different, good = F.count_distinct(valid), F.count(valid)
    return F.when(different > 1, "false").when((F.count(F.lit(1)) >= 2) & (good == F.count(F.lit(1))) & (different == 1), "true").otherwise("unknown")


def digest_in_order(order: str, value: Column, separator: str = "\n") -> Column:
    """sha256 of the values in the order of ``order``.  The group becomes one string, as the digest asks."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), separator), 256)


def depends(d: DataFrame, a: str, b: str) -> DataFrame:
    """Whether ``b`` is a function of ``a``, and ``a`` of ``b``, over the pairs of ``d``."""
    pairs = d.select(a, b).distinct()
    most = lambda x, name: pairs.groupBy(x).agg(F.count("*").alias("n")).agg((F.max("n") == 1).alias(name))
    return most(a, f"{b}_by_{a}").join(F.broadcast(most(b, f"{a}_by_{b}")))


def stratified(samples: DataFrame) -> DataFrame:
    """Stratified mean and variance with finite-population correction.

    ``samples``: stratum ``w``, population ``nn``, value ``x``.  Strata with one sample add no variance.
    """
    s = samples.groupBy("w").agg(F.max("nn").alias("nn"), F.count("*").alias("m"), F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("s2"))
    whole = s.agg(F.sum("nn").alias("whole"))  # one row
    s = s.join(F.broadcast(whole)).withColumn("share", F.col("nn") / F.col("whole"))
    return s.agg(F.sum(F.col("share") * F.col("mean")).alias("mu"), F.sum(F.when(F.col("m") > 1, F.col("share") ** 2 * (1 - F.col("m") / F.col("nn")) * F.col("s2") / F.col("m")).otherwise(0.0)).alias("var"), F.sum("m").alias("m"))
