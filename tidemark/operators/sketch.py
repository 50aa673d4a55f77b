"""The mergeable tail histogram: 14 decades, 40 bins each, on literal edges.

Bucket of a value: how many edges are not above it.  Counts add across shards, quantiles are
bounded by bin edges, and exceedances above an edge are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH, PER_DECADE = -12.0, 2.0, 40
EDGES = [10.0 ** (LOW + i / PER_DECADE) for i in range(round((HIGH - LOW) * PER_DECADE) + 1)]


def bucket(value: Column) -> Column:
    """Number of edges <= value, by logarithm and corrected at the literal edges."""
    edges = F.array(*map(F.lit, EDGES))
    guess = F.greatest(F.lit(0), F.least(F.lit(len(EDGES)), (F.floor((F.log10(F.greatest(value, F.lit(1e-300))) - F.lit(LOW)) * PER_DECADE) + 1).cast("int")))
    low = F.greatest(guess - 1, F.lit(0))
    near = F.filter(F.slice(edges, low + 1, 3), lambda e: e <= value)
    return (low + F.size(near)).cast("int")


def histogram(values: DataFrame, value: str, *by: str) -> DataFrame:
    """``bucket``, ``n``, ``top`` (largest value): partial results that ``merged`` adds up."""
    return values.groupBy(*by, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"), F.max(value).alias("top"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def edge_frame(d: DataFrame) -> DataFrame:
    """``bucket``, ``lower``, ``upper`` of all 562 buckets."""
    rows = [(b, EDGES[b - 1] if b else 0.0, EDGES[b] if b < len(EDGES) else float("inf")) for b in range(len(EDGES) + 1)]
    return d.sparkSession.createDataFrame(rows, "bucket int, lower double, upper double")


def quantile_bounds(hist: DataFrame, quantiles: list[float]) -> DataFrame:
    """Guaranteed ``lower`` and ``upper`` of each quantile: at most 562 rows go through one window."""
    w = Window.orderBy("bucket")
    h = hist.join(F.broadcast(edge_frame(hist)), "bucket").select("bucket", "n", "lower", "upper", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"), F.max("top").over(Window.partitionBy()).alias("top"))
    q = h.sparkSession.createDataFrame([(x,) for x in quantiles], "q double")
    d = h.join(F.broadcast(q)).withColumn("h", (F.col("total") - 1) * F.col("q")).withColumn("k", (F.floor("h") + 1).cast("long"))
    d = d.withColumn("k2", F.when(F.col("h") == F.floor("h"), F.col("k")).otherwise(F.least(F.col("k") + 1, F.col("total"))))
    holds = lambda k: (F.col("upto") >= F.col(k)) & (F.col("upto") - F.col("n") < F.col(k))
    return d.groupBy("q").agg(F.max(F.when(holds("k"), F.col("lower"))).alias("lower"), F.max(F.when(holds("k2"), F.least(F.col("upper"), F.col("top")))).alias("upper"), F.max("total").alias("total"))


def exceedances(hist: DataFrame, powers: list[int]) -> DataFrame:
    """Exact numbers at or above 10^k."""
    at = [(k, next(i for i, e in enumerate(EDGES) if e >= 10.0**k)) for k in powers]
    return hist.select(F.explode(F.array(*(F.struct(F.lit(k).alias("log10"), F.when(F.col("bucket") > i, F.col("n")).otherwise(F.lit(0)).alias("n")) for k, i in at))).alias("x")).groupBy("x.log10").agg(F.sum("x.n").alias("positions"))
