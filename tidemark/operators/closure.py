"""Where chains of references end, whatever their length: pointer doubling over (node, up) edges.

Every node keeps a jump: the node it reaches and the steps that takes.  A round joins the open jumps (those that
haven't reached a node without an edge) with the table of all jumps, which doubles them, and writes the result; chains of
length L are done after log2(L) rounds.  A round that finishes no jump proves that the rest never end:
whatever is left runs into a cycle, since a longer chain would have a node of each smaller length.

Jumps may share a target, so it may be the key of any share of the rows.  A key with over one
``HEAVY``-th of them is one of ``HEAVY`` at most; the jumps of these go to the tasks by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import FEW as SENT
from .shared import bounded, many, written

HEAVY = 1000
FEW = 1 << 20  # rows of which no key is heavy for a task


@dataclass(frozen=True)
class Forest:
    """``ends``: node, root, steps, cycle, for each node with an edge; root and steps are null where the way ends in
    a cycle, named by its least node.  ``jumps``: (node, at) after 1, 2, 4, … steps, for nodes with so many.  Of ``large``
    ones no task gets all."""

    ends: DataFrame
    jumps: list[DataFrame]
    large: bool

    def target(self, df: DataFrame) -> DataFrame:
        """``df``, made of ``ends`` or ``jumps``, to be joined."""
        return df.hint("merge") if self.large else df


def followed(rows: DataFrame, key: str, table: DataFrame, n: int, few: int | None = None) -> DataFrame:
    """``rows``, which are ``n``, joined with ``table``, which has a row a ``node``, on ``key`` = node; keys of many rows don't meet in one task."""
    few = FEW if few is None else few
    to = table.withColumnRenamed("node", key)
    to = to.hint("merge") if n > SENT else to
    if n <= few:
        return rows.join(to, key)
    heavy = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > n // HEAVY).select(key)  # HEAVY rows at most
    named = F.broadcast(written(heavy, "heavy"))
    often = rows.join(named, key, "left_semi").join(F.broadcast(table.withColumnRenamed("node", key).join(named, key, "left_semi")), key)
    return rows.join(named, key, "left_anti").join(to, key).unionByName(often)


def forest(edges: DataFrame, few: int | None = None) -> Forest:
    """``edges``: node, up; of a node's several edges the one with the least ``up`` counts; null ends are no edges."""
    e = written(edges.where("node IS NOT NULL AND up IS NOT NULL").groupBy("node").agg(F.min("up").alias("up")), "edges")
    large = many(e)
    onward = e.select(F.col("node").alias("up"), F.lit(True).alias("more"))
    onward = onward.hint("merge") if large else onward
    first = e.join(onward, "up", "left").select("node", F.col("up").alias("at"), F.col("up").alias("least"), F.lit(1).cast("long").alias("steps"), F.coalesce("more", F.lit(False)).alias("open"))
    now = written(first, "jumps")
    done, jumps, opened, length = [now.where("NOT open")], [now.select("node", "at")], now.where("open").count(), 1

    def doubled(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
        to = table.select("node", F.col("at").alias("at2"), F.col("least").alias("least2"), F.col("steps").alias("steps2"), F.col("open").alias("open2"))
        return written(followed(rows, "at", to, n, few).select("node", F.col("at2").alias("at"), F.least("least", "least2").alias("least"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("open2").alias("open")), "jumps")

    while opened:
        now = doubled(now.where("open"), reduce(DataFrame.unionByName, [*done, now.where("open")]), opened)
        length *= 2
        left = now.where("open").count()
        if left == opened:
            break
        done.append(now.where("NOT open"))
        jumps.append(now.where(F.col("steps") == length).select("node", "at"))
        opened = left
    ends = reduce(DataFrame.unionByName, done).select("node", F.col("at").alias("root"), "steps", F.lit(None).cast(e.schema["up"].dataType).alias("cycle"))
    if opened:
        while length < opened:  # until a jump goes round its cycle at least once
            now = doubled(now, now, opened)
            length *= 2
        on = now.select("at").distinct()
        on = on.hint("merge") if opened > SENT else on
        names = on.join(now.select(F.col("node").alias("at"), F.col("least").alias("cycle")), "at").select(F.col("at").alias("node"), "cycle")
        lost = followed(now.select("node", "at"), "at", names, opened, few)
        ends = ends.unionByName(lost.select("node", F.lit(None).cast(e.schema["up"].dataType).alias("root"), F.lit(None).cast("long").alias("steps"), "cycle"))
    return Forest(ends, jumps, large)


def roots(nodes: DataFrame, edges: DataFrame, few: int | None = None) -> DataFrame:
    """``node``, ``root``, ``steps``, ``cycle`` for every row of ``nodes`` (node); a node without an edge is its own root."""
    whole = forest(edges, few)
    found = nodes.select("node").join(whole.target(whole.ends), "node", "left")
    own = F.col("cycle").isNull()
    return found.select("node", F.when(own, F.coalesce("root", "node")).alias("root"), F.when(own, F.coalesce("steps", F.lit(0))).alias("steps"), "cycle")


def descends(pairs: DataFrame, edges: DataFrame, few: int | None = None) -> DataFrame:
    """The distinct ``pairs`` (lower, upper) of which upper lies on the way up from lower, lower itself included.

    The way is as long as the difference of their distances to the root; it is walked by its binary digits, a
    join each.  A cycle is cut behind its least node, and what lies beyond the cut is looked up from there.
    """
    known = pairs.where("lower IS NOT NULL AND upper IS NOT NULL").select("lower", "upper").distinct()
    edges = edges.select("node", "up")
    whole = forest(edges, few)
    heads = whole.ends.where(F.col("node") == F.col("cycle")).select("node")
    if not heads.isEmpty():
        heads = bounded(written(heads, "heads"))
        behind = heads.join(edges, "node").groupBy("node").agg(F.min("up").alias("behind"))
        whole = forest(edges.join(heads, "node", "left_anti"), few)
        beyond = known.withColumnRenamed("lower", "node").join(whole.target(whole.ends).select("node", "root"), "node", "left").select(F.col("node").alias("lower"), "upper", F.coalesce("root", "node").alias("root"))
        beyond = beyond.join(behind.withColumnRenamed("node", "root"), "root").select("lower", "upper", F.col("behind").alias("at"))
    else:
        beyond = None
    tried = known.select("lower", "upper", F.col("lower").alias("at"))
    tried = tried if beyond is None else tried.unionByName(beyond)
    depth = whole.target(whole.ends).select("node", F.coalesce("root", "node").alias("root"), F.coalesce("steps", F.lit(0)).alias("steps"))
    for side, of in (("a", "at"), ("b", "upper")):
        own = depth.select(F.col("node").alias(of), F.col("root").alias(f"{side}_root"), F.col("steps").alias(f"{side}_steps"))
        tried = tried.join(own, of, "left").withColumns({f"{side}_root": F.coalesce(f"{side}_root", of), f"{side}_steps": F.coalesce(f"{side}_steps", F.lit(0))})
    way = tried.where("a_root = b_root AND a_steps >= b_steps").select("lower", "upper", "at", (F.col("a_steps") - F.col("b_steps")).alias("way"))
    for digit, jump in enumerate(whole.jumps):
        to = whole.target(jump).select(F.col("node").alias("at"), F.col("at").alias("to"), F.lit(True).alias("has"))
        far = F.shiftright("way", digit).bitwiseAND(F.lit(1)) == 1
        way = way.join(to, "at", "left").where(~far | F.col("has")).select("lower", "upper", F.when(far, F.col("to")).otherwise(F.col("at")).alias("at"), "way")
    return way.where("at = upper").select("lower", "upper").distinct()
