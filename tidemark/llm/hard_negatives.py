"""Hard negatives: for an anchor and each of its positives, the best rows of other labels that score just below the positive.

Candidates are sorted by length (norm), longest first, and cut into buckets; a bucket is a partition of the written
table, and its rows are never longer than those of the bucket before.  By Cauchy-Schwarz no row of a
bucket scores more than the anchor's length times the bucket's greatest, so an anchor passes over a bucket
that can't reach the lower limit of any of its windows, or the score of the last row it would keep.
Buckets are searched in bands, longest first; what a band finds raises the limits for the next, and within a
task each tile of candidates raises them for the tiles behind it.  Rows too short for every
anchor aren't read: the least length that may count goes to the scan as a filter.

Two such searches follow one another: the positives (own label, no window), then the negatives.
Components are integers, so scores are exact and ties are ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .vectors import TILE, bands, best, blocks, by_length, finite, in_rounds, one_of_each, places, put, slabs, squared_length

BUCKET_ROWS = 1 << 16
LONGEST = float(2**53)  # of squared lengths: all sums of products are then exact in double precision
LOWEST, HIGHEST = -(2**60), 2**60
FOUND = "anchor long, window int, candidate long, score long"


def quantised(rows: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id``, ``label``, ``vec`` (integers: floor of ``scale`` times the component), ``length2``."""
    part = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))
    part = part.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    part = part.withColumn("v", F.transform("v", lambda x: F.rint(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-1e9)), F.lit(1e9))))))
    part = part.withColumn("length2", squared_length(F.col("v"))).where(F.col("length2") < LONGEST)
    return part.select("id", "label", F.col("v").cast("array<int>").alias("vec"), F.col("length2").cast("long").alias("length2"))


def bucketed(rows: DataFrame, bucket_rows: int) -> tuple[DataFrame, int]:
    """Written in buckets of about ``bucket_rows`` rows at most, by length, longest first; and their number."""
    spark = rows.sparkSession
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    wanted = max(-(-n // bucket_rows), min(-(-n // 1024), 2 * cores), 1)
    at = scratch(spark, "buckets")
    cut = rows.repartitionByRange(wanted, F.desc("length2"), "id").withColumn("bucket", F.spark_partition_id())
    cut.sortWithinPartitions(F.desc("length2"), "id").write.partitionBy("bucket").parquet(at)
    out = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, bucket int").parquet(at)
    found = out.agg(F.max("bucket")).first()[0]
    return out, 0 if found is None else found + 1


def searched(url: str, k: int, same: bool):
    """For ``mapInArrow``: the ``k`` best candidates of each window, at most, that this task's rows hold.

    A question's columns: id, label, vec, length2, low, high, limit; the last three have an element a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            ids, labels = slab.column("id").to_numpy(), slab.column("label").to_numpy()
            for rows, vecs in by_length(slab.column("vec"), np.float64):
                lengths = np.einsum("ij,ij->i", vecs, vecs)
                order = np.lexsort((ids[rows], -lengths))
                store = vecs[order], ids[rows][order], labels[rows][order], lengths[order]
                for block in blocks(url):
                    for mine, asked in by_length(block.column("vec"), np.float64):
                        if asked.shape[1] == vecs.shape[1]:
                            yield from answers(block.take(pa.array(mine)), asked, *store)

    def answers(block: pa.RecordBatch, asked: np.ndarray, vecs: np.ndarray, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchor, own = block.column("id").to_numpy(), block.column("label").to_numpy()
        reach = np.sqrt(block.column("length2").to_numpy().astype(np.float64))
        low, high, limit = (ragged(block.column(c), fill) for c, fill in (("low", HIGHEST), ("high", LOWEST), ("limit", HIGHEST)))
        limit = np.maximum(low, limit)
        held = [(np.empty(0, np.int64),) * 3 for _ in range(low.shape[1])]  # anchor's row, score, id
        for start in range(0, len(ids), TILE):
            part = slice(start, start + TILE)
            bound = reach * np.sqrt(lengths[start]) * (1 + 1e-9) + 1
            live = (limit <= bound[:, None]) & (limit <= high)
            rows = np.flatnonzero(live.any(axis=1))
            if not len(rows):
                continue
            scores = asked[rows] @ vecs[part].T
            fits = (labels[part] == own[rows][:, None]) == same
            fits &= ids[part] != anchor[rows][:, None]
            for w in range(low.shape[1]):
                on = np.flatnonzero(live[rows, w])
                if not len(on):
                    continue
                r = rows[on]
                s = np.where(fits[on] & (scores[on] >= limit[r, w][:, None]) & (scores[on] <= high[r, w][:, None]), scores[on], -np.inf)
                if s.shape[1] > k:
                    s[s < np.partition(s, -k, axis=1)[:, -k][:, None]] = -np.inf
                at, col = np.nonzero(s > -np.inf)
                keys = np.concatenate([held[w][0], r[at]])
                values = np.concatenate([held[w][1], s[at, col].astype(np.int64)])
                names = np.concatenate([held[w][2], ids[part][col]])
                keep = best(keys, values, names, k)
                held[w] = keys[keep], values[keep], names[keep]
                full = places(held[w][0]) == k - 1
                limit[held[w][0][full], w] = np.maximum(limit[held[w][0][full], w], held[w][1][full])
        for w, (keys, values, names) in enumerate(held):
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keys]), pa.array(np.full(len(keys), w, np.int32)), pa.array(names), pa.array(values)], names=["anchor", "window", "candidate", "score"])

    return run


def ragged(column: pa.Array, fill: int) -> np.ndarray:
    """A column of lists as a matrix, short rows filled up."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(lengths), max(lengths.max(initial=0), 1)), fill, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def search(candidates: DataFrame, buckets: int, questions: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """``anchor``, ``window``, ``candidate``, ``score``, ``rank``: the ``k`` best of each window."""
    least: list[float] = [0.0]

    def ask(so_far: DataFrame | None) -> str:
        now = questions
        if so_far is not None:
            last = so_far.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last"))
            now = questions.join(last, questions["id"] == last["anchor"], "left").drop("anchor")
            better = F.transform("limit", lambda x, w: F.greatest(x, F.coalesce(F.col("last")[w.cast("int")], F.lit(LOWEST))))
            now = now.withColumn("limit", better).drop("last")
        at = put(now, f"{name}-questions")
        # an anchor needs rows of a length of its least limit over its own length; windows that nothing can fit need none
        need = F.array_min(F.filter(F.zip_with(F.zip_with("limit", "low", lambda x, y: F.greatest(x, y)), "high", lambda x, h: F.when(x <= h, x)), F.isnotnull))
        ratio = F.greatest(F.col("need"), F.lit(0)).cast("double") / F.sqrt(F.greatest("length2", F.lit(1)))
        found = questions.sparkSession.read.schema(now.schema).parquet(at).withColumn("need", need).where("need IS NOT NULL").agg(F.min(ratio)).first()[0]
        least[0] = -1.0 if found is None else max(found * (1 - 1e-9) - 1, 0.0) ** 2
        return at

    def look(part: tuple[int, int], url: str) -> DataFrame:
        rows = candidates.where((F.col("bucket") >= part[0]) & (F.col("bucket") < part[1]) & (F.col("length2") >= int(least[0])))
        if least[0] < 0:
            rows = rows.where(F.lit(False))
        return rows.select("id", "label", "vec").mapInArrow(searched(url, k, same), FOUND)

    return in_rounds(bands(1, max(buckets, 1)), ask, look, ["anchor", "window"], k, name)


def percent(share: int, score: Column, rounded: Callable[[Column], Column]) -> Column:
    """``share`` percent of an integer, rounded exactly."""
    return rounded((score.cast("decimal(20,0)") * F.lit(share).cast("decimal(9,0)")) / F.lit(100).cast("decimal(3,0)")).cast("long")


def mine(
    rows: DataFrame, is_anchor: Column, *, scale: float = 256.0, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, bucket_rows: int = BUCKET_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition on ``id``.  An anchor's positives are the ``positives`` best other rows of its label (all, if fewer); for
    each, the ``negatives`` best rows of other labels whose score lies between ``low_percent`` and ``high_percent``
    of the positive's are returned.  A score is the inner product of vectors whose components became
    floor(``scale`` * x); ties go to the smaller id.

    Rows take no part whose id, label or vector is null, whose vector is empty or holds a null or a component that isn't finite, or
    whose squared length in integers is 2^53 or more (their scores would not be exact).  Vectors of different
    lengths have no inner product and never meet.  An id is never its own candidate; of an anchor's rows
    the least (label, vector) asks, while other rows that repeat an id count one by one.  Anchors without positives,
    and positives with nothing in their window, give no rows, and nor does an empty table.  Other columns are not read.
    """
    candidates, buckets = bucketed(quantised(rows, scale, id_col, vec_col, label_col), bucket_rows)
    anchors = one_of_each(candidates.drop("bucket").where(is_anchor), "id")
    plain = {"low": F.array(F.lit(LOWEST)), "high": F.array(F.lit(HIGHEST)), "limit": F.array(F.lit(LOWEST))}
    first = search(candidates, buckets, anchors.withColumns({c: v.cast("array<long>") for c, v in plain.items()}), positives, True, "positives")
    low, high = percent(low_percent, F.col("score"), F.ceil), percent(high_percent, F.col("score"), F.floor)
    windows = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((F.col("rank") - 1).alias("window"), low.alias("low"), high.alias("high")))).alias("w"))  # ``positives`` at most
    questions = anchors.join(windows, anchors["id"] == windows["anchor"]).select("id", "label", "vec", "length2", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.transform("w", lambda x: F.lit(LOWEST).cast("long")).alias("limit"))
    second = search(candidates, buckets, questions, negatives, False, "negatives")
    of = first.select("anchor", (F.col("rank") - 1).alias("window"), F.col("candidate").alias("positive_id"), F.col("score").alias("positive_score"))
    return second.join(of, ["anchor", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("candidate").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
