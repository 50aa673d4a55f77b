"""Registry operators: keys, references, ranks, floors, constraints.

A constraint is a query that returns violations: code, severity, id, detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def comparability_key(*parts: Column) -> Column:
    """``cmp--`` and 16 digits of the digest of the parts joined by bars; a null part or one with a bar is refused."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | p.isNull() | p.contains("|")
    key = F.concat(F.lit("cmp--"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))
    return F.when(bad, F.raise_error(F.lit("a key part is missing or holds the separator")).cast("string")).otherwise(key)


def bits_per_weight(x: Column) -> Column:
    """6 and 6.0 are one spelling."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def close(a: Column, b: Column, rel: float, absolute: float = 0.0) -> Column:
    """Both null, or within the larger of the two tolerances."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)))


def relative_gap(a: Column, b: Column) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), top))


def derived_seed(seed: int, label: Column) -> Column:
    """seed xor the low 31 bits of the first 8 bytes of the label's digest."""
    low = F.conv(F.substring(F.sha2(label, 256), 9, 8), 16, 10).cast("long")
    return F.lit(seed).cast("long").bitwiseXOR(low.bitwiseAND(F.lit(0x7FFFFFFF)))


def violation(d: DataFrame, code: str, severity: str, id_col: str, detail: Column) -> DataFrame:
    return d.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(id_col).cast("string").alias("id"), detail.cast("string").alias("detail"))


def dangling(d: DataFrame, target: DataFrame, ref: str, key: str, id_col: str, code: str) -> DataFrame:
    """References to rows that aren't there; null references refer to nothing."""
    return violation(d.where(F.col(ref).isNotNull()).join(target.select(F.col(key).alias(ref)).distinct(), ref, "left_anti"), code, "error", id_col, F.col(ref))


def duplicates(d: DataFrame, keys: list[str], id_col: str, live: str) -> DataFrame:
    """Each row against the one before it with the same keys, if neither is withdrawn."""
    w = Window.partitionBy(*keys).orderBy(id_col)
    e = d.withColumns({"before": F.lag(id_col).over(w), "before_live": F.lag(live).over(w)})
    return violation(e.where(F.col("before").isNotNull() & F.col(live) & F.col("before_live")), "CMP-004", "error", id_col, F.col("before"))


def ranked(d: DataFrame, key: list[str], value: str, id_col: str) -> DataFrame:
    """Rank within key and lane, ascending, nulls last, ties by id; for the first few of each.  ``ordering.placed`` ranks all."""
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last(value), id_col)))


def floor_violations(rows: DataFrame, floors: DataFrame) -> DataFrame:
    """FLOOR-001 below a floor of the same key and lane; FLOOR-002 clearly below another lane's, only
    where the own lane has none; FLOOR-003 once per key of several rows without any floor.

    ``rows``: id, key, lane, value; ``floors``: key, lane, floor.  Floors are first reduced to one per
    key and lane (the largest: a value below any floor is below it).
    """
    own = floors.groupBy("key", "lane").agg(F.max("floor").alias("own_floor"))
    other = floors.groupBy("key").agg(F.max("floor").alias("key_floor"))
    d = rows.join(own, ["key", "lane"], "left").join(other, "key", "left")
    one = violation(d.where("value < own_floor"), "FLOOR-001", "error", "id", F.round("own_floor", 9))
    two = violation(d.where("own_floor IS NULL AND value < 0.95 * key_floor"), "FLOOR-002", "warn", "id", F.round("key_floor", 9))
    none = d.groupBy("key").agg(F.count("*").alias("n"), F.max("key_floor").alias("f")).where("n > 1 AND f IS NULL")
    return one.unionByName(two).unionByName(violation(none, "FLOOR-003", "warn", "key", F.col("n")))


def snapshot_diff(old: DataFrame, new: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Added and removed rows, and every changed field of the others."""
    o = old.select(F.col(id_col), F.struct(*fields).alias("o"))
    n = new.select(F.col(id_col), F.struct(*fields).alias("n"))
    d = o.join(n, id_col, "full_outer")
    kind = F.when(F.col("o").isNull(), F.array(F.lit("added"))).when(F.col("n").isNull(), F.array(F.lit("removed")))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields)))
    return d.select(F.col(id_col).alias("id"), F.explode(F.coalesce(kind, changed)).alias("change"))


def merge_class(old: DataFrame, new: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """insert, identical or conflict for every incoming row."""
    h = F.sha2(F.to_json(F.struct(*fields)), 256)
    d = new.select(F.col(id_col).alias("id"), h.alias("n")).join(old.select(F.col(id_col).alias("id"), h.alias("o")), "id", "left")
    return d.select("id", F.when(F.col("o").isNull(), "insert").when(F.col("o") == F.col("n"), "identical").otherwise("conflict").alias("verdict"))


def transition_violations(events: DataFrame, allowed: list[tuple[str | None, str]], key: str, order: list[str], state: str) -> DataFrame:
    """Events whose (state before, state) isn't allowed; the first must be allowed from nothing."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    d = events.withColumn("before", before)
    table = d.sparkSession.createDataFrame(allowed, "was string, now string")
    pairs = F.broadcast(table)  # the fixed table of transitions
    return d.join(pairs, F.col("before").eqNullSafe(F.col("was")) & (F.col(state) == F.col("now")), "left_anti").select(key, *order, "before", state)


def lineage(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``start``, ``hop``, ``node``: up to ``depth`` hops along child -> parent; a walk that closes a cycle ends.

    A bounded loop of equi-joins; the path seen so far rides along to detect cycles.
    """
    e = edges.select(F.col("child").alias("node"), "parent")
    step = starts.select(F.col("start"), F.lit(0).alias("hop"), F.col("start").alias("node"), F.array(F.col("start")).alias("path"))
    out = step
    for hop in range(1, depth + 1):
        step = step.join(e, "node").where(~F.array_contains("path", F.col("parent"))).select("start", F.lit(hop).alias("hop"), F.col("parent").alias("node"), F.concat("path", F.array("parent")).alias("path"))
        out = out.unionByName(step)
    return out.select("start", "hop", "node")


def in_partition(d: DataFrame, column: str, wanted: str, default: str = "analysis") -> DataFrame:
    """Rows of the partition; those without one belong to ``default``."""
    return d.where(F.coalesce(F.col(column), F.lit(default)) == wanted)


def first_match(walk: DataFrame, known: DataFrame) -> DataFrame:
    """Of a walk (start, hop, node) the first node that is ``known`` (node, matched, prio): least hop, then least prio, then node."""
    best = F.min(F.struct("hop", "prio", "node", "matched")).alias("b")
    return walk.join(known, "node").groupBy("start").agg(best).select("start", "b.hop", "b.node", "b.matched")


def id_ngrams(ids: str, n: int) -> Column:
    """Every run of ``n`` ids once; none where there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(ids) - (n - 1)), lambda i: F.slice(ids, i, n))
    return F.when(F.size(ids) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<array<long>>"))


def chosen_panel(prior: DataFrame, panels: DataFrame, references: DataFrame, streaming: bool) -> DataFrame:
    """For each model the pair of panel and reference for its next row, and the pairs behind it: ``place`` from 1.

    ``prior``: model, panel, reference of published rows; ``panels``: panel, sealed, subset; ``references``: reference, logits,
    native, floor.  The panel must be sealed and the reference's logits available; panels that are subsets count only for
    models without any other.  In order: a reference with a floor (where ``streaming``), a native one, the pair with the most
    rows, the panel's id.  A model has as many pairs as panels, so its pairs are ranked in one task.
    """
    pairs = prior.where("panel IS NOT NULL AND reference IS NOT NULL").groupBy("model", "panel", "reference").agg(F.count("*").alias("rows"))
    able = pairs.join(panels, "panel").join(references, "reference").where("sealed AND logits")
    whole = F.min(F.coalesce("subset", F.lit(False)).cast("int")).over(Window.partitionBy("model"))
    pool = able.withColumn("least", whole).where(F.coalesce("subset", F.lit(False)).cast("int") == F.col("least"))
    floor = F.coalesce("floor", F.lit(False)) if streaming else F.lit(False)
    order = Window.partitionBy("model").orderBy(floor.desc(), F.coalesce("native", F.lit(False)).desc(), F.desc("rows"), "panel", "reference")
    return pool.withColumn("place", F.row_number().over(order)).select("model", "panel", "reference", "rows", "place")


def nested_diff(old: DataFrame, new: DataFrame, id_col: str, cells: str, key: str, fields: list[str]) -> DataFrame:
    """As ``snapshot_diff`` for what lies in an array of structs: ``id``, ``key`` of the element, ``change``; elements meet by their key."""
    flat = lambda d: d.select(F.col(id_col).alias("id"), F.explode(cells).alias("x")).select("id", F.col(f"x.{key}").alias("key"), *(F.col(f"x.{f}").alias(f) for f in fields))
    both = old.select(F.col(id_col).alias("id")).join(new.select(F.col(id_col).alias("id")), "id")
    o = flat(old).join(both, "id", "left_semi").select("id", "key", F.struct(*fields).alias("o"))
    n = flat(new).join(both, "id", "left_semi").select("id", "key", F.struct(*fields).alias("n"))
    kind = F.when(F.col("o").isNull(), F.array(F.lit("added"))).when(F.col("n").isNull(), F.array(F.lit("removed")))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields)))
    return o.join(n, ["id", "key"], "full_outer").select("id", "key", F.explode(F.coalesce(kind, changed)).alias("change"))


def identity_view(fields: list[str]) -> list[Column]:
    """The fields that shards of one report must share, as text and under their paths; ``a.b`` reads within a struct.

    A missing struct gives null, as a missing field does.
    """
    return [F.when(F.col(f).isNotNull(), F.to_json(F.struct(F.col(f).alias("v")))).alias(f) for f in fields]


def identity_disagreements(reports: DataFrame, report: str, fields: list[str]) -> DataFrame:
    """``report``, ``field``, ``least``, ``most``, ``absent``, ``shards``: a row for each field on which a report's shards differ.

    A field that only some shards have differs too; one that none has does not.  Values are compared as canonical
    text, so 1 and "1" differ.  One aggregate with a partial step decides, so a report may have any number of
    shards.  Rows with a null report are one report.
    """
    names = [f"v{i}" for i in range(len(fields))]
    view = reports.select(F.col(report).alias("report"), *(c.alias(n) for c, n in zip(identity_view(fields), names, strict=True)))
    found = [F.struct(F.lit(f).alias("field"), F.min(n).alias("least"), F.max(n).alias("most"), (F.count("*") - F.count(n)).alias("absent")) for f, n in zip(fields, names, strict=True)]
    each = view.groupBy("report").agg(F.array(*found).alias("found"), F.count("*").alias("shards")).select("report", F.inline("found"), "shards")
    return each.where("least <> most OR absent BETWEEN 1 AND shards - 1").withColumnRenamed("report", report)
