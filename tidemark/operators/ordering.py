"""Ranks and quantiles of groups of any size: no group is sorted in one task, whatever its ties.

The input is computed once and written.  Places of rows: rows are cut into equal ranges of the order (group, value, id),
so rows of one value may lie in several ranges.  Quantiles and average ranks: equal values are counted where they are read,
and the order is that of different values with their counts.  Either way a range has about ``ENTRIES`` entries, and as many
ranges are made as that takes; sums over a group's earlier ranges and the order within a range give exact places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

ENTRIES = 100_000  # in a range
ACCURACY = 10_000  # of a sketch: its places are right to a share of one by this
ALL = "true"
GROUPS = 100_000  # whose brackets may go to every task


def ranged(d: DataFrame, order: list[Column], buckets: int | None) -> tuple[DataFrame, bool]:
    """``d``, which was written, with ``bucket``: equal ranges of ``order``; and whether there are several."""
    n = buckets or -(-d.count() // ENTRIES)
    if n < 2:
        return d.withColumn("bucket", F.lit(0)), False
    return written(d.repartitionByRange(n, *order).withColumn("bucket", F.spark_partition_id()), "ranges"), True


def matched(rows: DataFrame, table: DataFrame, by: list[str], often: Column | str | None = None) -> DataFrame:
    """``rows`` joined with ``table``, a row for each of ``by``, where null equals null.

    Rows of ``table`` for which ``often`` holds are asked for by so many rows that they can only be few: they are broadcast; ``ALL`` of them are where the table was counted.
    """
    t = table.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in table.columns if c not in by))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    keep = [*rows.columns, *(c for c in table.columns if c not in by)]
    if often is None:
        return rows.join(t, same).select(*keep)
    few = F.broadcast(t.where(often))
    if often is ALL:
        return rows.join(few, same).select(*keep)
    rest = rows.join(few, same, "left_anti").join(t.where(~often), same).select(*keep)
    return rows.join(few, same).select(*keep).unionByName(rest)


def before(d: DataFrame, by: list[str], size: Column) -> DataFrame:
    """For each group and bucket: what ``size`` adds up to in it (``n``) and in the group's buckets before it (``before``)."""
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return d.groupBy(*by, "bucket").agg(F.sum(size).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def placed(d: DataFrame, by: list[str], value: str, id_col: str, buckets: int | None = None) -> DataFrame:
    """``place``: the row number in the group by ascending value, nulls last, ties by id."""
    order = [F.asc_nulls_last(value), F.asc(id_col)]
    b, several = ranged(written(d, "rows"), [*map(F.asc, by), *order], buckets)
    own = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(*order))
    if not several:
        return b.withColumn("place", own.cast("long")).select(*d.columns, "place")
    offsets = before(b, by, F.lit(1)).drop("n")
    return matched(b.withColumn("own", own), offsets, [*by, "bucket"]).select(*d.columns, (F.col("before") + F.col("own")).alias("place"))


def counted(d: DataFrame, by: list[str], value: str, buckets: int | None = None) -> DataFrame:
    """A row for each different value of a group: ``n`` rows have it, ``before`` are less.  Nulls don't count."""
    e = written(d.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), "counts")
    b, several = ranged(e, [*map(F.asc, by), F.asc(value)], buckets)
    upto = F.sum("n").over(Window.partitionBy(*by, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    own = b.withColumn("own", upto - F.col("n"))
    if not several:
        return own.withColumnRenamed("own", "before").select(*by, value, "n", "before")
    offsets = before(b, by, F.col("n")).select(*by, "bucket", F.col("before").alias("offset"))
    return matched(own, offsets, [*by, "bucket"]).select(*by, value, "n", (F.col("offset") + F.col("own")).alias("before"))


def quantiles(d: DataFrame, by: list[str], value: str, at: list[float], buckets: int | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """``by``, ``q``, ``x``: exact quantiles with linear interpolation; nulls don't count.

    A sketch brackets each wanted place of each group between two values.  What lies below a bracket is counted, and
    only the different values within it are ordered, so no row moves but some n / ``accuracy`` a place.  A bracket that the
    counts show to miss its place sends everything the long way, over all different values; so does ``buckets``, their number of ranges.
    """
    d = written(d.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")), "values")
    if buckets is None:
        found = _bracketed(d, by, at, accuracy)
        if found is not None:
            return found
    places = written(counted(d, by, "v", buckets), "places")
    totals = places.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    # without groups there is one total
    rows = matched(places, totals, by, F.col("entries") > ENTRIES) if by else places.join(F.broadcast(totals))
    wanted = _wanted(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(q).alias("q")) for i, q in enumerate(at))))
    return _mixed(_covering(rows, by, wanted), by)


def _wanted(places: Column) -> Column:
    """The one or two places (``k``) around each quantile (structs of i, q) among ``total`` rows."""
    ends = lambda p: F.array_distinct(F.array(F.floor((F.col("total") - 1) * p["q"]), F.ceil((F.col("total") - 1) * p["q"])))
    return F.flatten(F.transform(places, lambda p: F.transform(ends(p), lambda k: F.struct(p["i"].alias("i"), p["q"].alias("q"), ((F.col("total") - 1) * p["q"]).alias("at"), k.alias("k")))))


def _covering(rows: DataFrame, by: list[str], wanted: Column) -> DataFrame:
    """For each entry (v, n, before) the wanted places that it covers, as ``e``."""
    covered = F.filter(wanted, lambda e: (e["k"] >= F.col("before")) & (e["k"] < F.col("before") + F.col("n")))
    return rows.select(*by, "v", F.explode(covered).alias("e"))


def _mixed(hit: DataFrame, by: list[str]) -> DataFrame:
    share = F.when(F.col("e.at") == F.col("e.k"), F.lit(1.0)).otherwise(1 - F.abs(F.col("e.at") - F.col("e.k")))
    return hit.groupBy(*by, F.col("e.q").alias("q")).agg(F.sum(share * F.col("v")).alias("x"))


def _bracketed(d: DataFrame, by: list[str], at: list[float], accuracy: int) -> DataFrame | None:
    """Quantiles of ``v`` by brackets; None where a bracket misses its place."""
    margin, m = 2.0 / accuracy, len(at)
    ends = [max(0.0, q - margin) for q in at] + [min(1.0, q + margin) for q in at]
    # the sketches of groups are merged a row a group; groups of many rows cost no more than others
    sketch = written(d.groupBy(*by).agg(F.count("*").alias("rows"), F.percentile_approx("v", ends, accuracy).alias("ends")).where("rows > 0"), "brackets")
    if not by:
        joined = d.join(F.broadcast(sketch))
    else:
        joined = matched(d, sketch, by, ALL if sketch.count() <= GROUPS else F.col("rows") > ENTRIES)
    # all of a small group lies in its brackets
    end = lambda i: F.when(F.col("rows") <= 2 * accuracy, F.lit(float("-inf" if i < m else "inf"))).otherwise(F.element_at("ends", i + 1))
    below = F.array(*(F.sum((F.col("v") < end(i)).cast("long")) for i in range(m)))
    facts = joined.groupBy(*by).agg(F.count("*").alias("total"), below.alias("below"))
    own = F.filter(F.array(*(F.when(F.col("v").between(end(i), end(m + i)), F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"))) for i, q in enumerate(at))), F.isnotnull)
    inside = joined.select(*by, "v", F.explode(own).alias("p")).groupBy(*by, "p", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    inside = inside.withColumn("upto", upto)
    rows = matched(inside, facts, by) if by else inside.join(F.broadcast(facts))
    rows = rows.withColumn("before", F.col("upto") + F.element_at("below", F.col("p.i") + 1))
    hit = written(_covering(rows, by, _wanted(F.array("p"))).withColumn("total", F.lit(0)), "places")
    places = sum((F.when((F.col("rows") - 1) * q == F.floor((F.col("rows") - 1) * q), 1).otherwise(2) for q in at), F.lit(0))
    asked = sketch.agg(F.coalesce(F.sum(places), F.lit(0))).first()[0]
    return _mixed(hit, by) if hit.count() == asked else None


def wide(q: DataFrame, by: list[str], names: dict[float, str]) -> DataFrame:
    """A column for each quantile."""
    columns = [F.max(F.when(F.col("q") == p, F.col("x"))).alias(name) for p, name in names.items()]
    return q.groupBy(*by).agg(*columns)


def average_ranks(d: DataFrame, by: str, size: Column, entries: int = ENTRIES) -> DataFrame:
    """``d`` with ``rk``, the mean of the places that its equals in ``size`` take, and ``t``, how many they are.

    A size that more than ``entries`` rows have (there are at most rows / ``entries`` of them) is broadcast, the others are joined.
    """
    d = d.withColumn("size", size)
    ranks = written(counted(d, [by], "size").select(by, "size", F.col("n").alias("t"), (F.col("before") + (F.col("n") + 1) / 2).alias("rk")), "ranks")
    return matched(d, ranks, [by, "size"], F.col("t") > entries).drop("size")
