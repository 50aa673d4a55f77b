"""Nearest neighbours by largest inner product, as a block matrix join on 8-bit codes.

A vector x is stored as a scale s and codes of one byte, x = s c + e.  The product of a tile of queries' codes with a
tile of candidates' is a tile of integers, and by Cauchy-Schwarz the true product of x and y differs
from s s' (c . c') by at most |s c| |e'| + |e| |y|.  So each tile gives lower and upper bounds of
all its products; a query's k-th largest lower bound, or the k-th best score known, is its limit, and
pairs whose upper bound reaches it are computed again in double precision from the original vectors and
go through the query's heap of k.  Nothing that belongs to the k nearest is lost: recall is 1.

Candidates are dealt into bands of growing size by a hash of the id; the heaps' worst scores after a band are the
limits for the next (see ``vectors.in_rounds``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .vectors import TILE, bands, best, blocks, by_length, finite, in_rounds, one_of_each, put, slabs, squared_length

FIRST_BAND = 4096
EXACT_DIMENSIONS = 1024  # 127 * 127 * 1024 < 2^24: sums of so many products of codes are exact in single precision
PAIRS_AT_ONCE = 1 << 16
FOUND = "query long, candidate long, score double"


@dataclass(frozen=True)
class Codes:
    """Vectors with their 8-bit codes; ``size`` is |s c|, ``error`` |e|, ``length`` |x|."""

    vecs: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    size: np.ndarray
    error: np.ndarray
    length: np.ndarray


def coded(vecs: np.ndarray) -> Codes:
    scale = np.abs(vecs).max(axis=1) / 127.0
    safe = np.where(scale > 0, scale, 1.0)
    codes = np.rint(vecs / safe[:, None]).clip(-127, 127).astype(np.int8)
    rough = codes * safe[:, None]
    norm = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
    return Codes(vecs, codes, safe, norm(rough), norm(vecs - rough), norm(vecs))


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of two tiles of codes, by the single-precision matrix product."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIMENSIONS):
        part = slice(d, d + EXACT_DIMENSIONS)
        out += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return out


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of rows ``i`` of ``a`` and ``j`` of ``b`` in double precision, summed from the first component on."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS_AT_ONCE):
        p = slice(at, at + PAIRS_AT_ONCE)
        x, y = i[p], j[p]
        for d in range(a.shape[1]):
            out[p] += a[x, d] * b[y, d]
    return out


def nearest(asked: Codes, names: np.ndarray, limit: np.ndarray, store: Codes, ids: np.ndarray, k: int) -> Iterator[tuple[int, float, int]]:
    """(query's row, score, id) of the ``k`` best that reach the query's limit, from one store of candidates."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in names]
    limit = limit.copy()
    rounding = 4 * np.finfo(np.float64).eps * (store.vecs.shape[1] + 4)
    for start in range(0, len(ids), TILE):
        part = slice(start, start + TILE)
        near = tile_products(asked.codes, store.codes[part]) * asked.scale[:, None] * store.scale[part]
        slack = asked.size[:, None] * store.error[part] + asked.error[:, None] * store.length[part] + rounding * asked.length[:, None] * store.length[part]
        near[names[:, None] == ids[part]] = -np.inf
        open_ = np.array([len(h) < k for h in heaps])
        if near.shape[1] >= k and open_.any():
            floor = np.partition(near[open_] - slack[open_], -k, axis=1)[:, -k]
            limit[open_] = np.maximum(limit[open_], floor)
        rows, cols = np.nonzero((near + slack >= limit[:, None]) & (near > -np.inf))
        scores = exact(asked.vecs, store.vecs, rows, cols + start)
        reach = scores >= limit[rows]
        rows, cols, scores = rows[reach], cols[reach] + start, scores[reach]
        keep = best(rows, scores, ids[cols], k)
        for r, s, c in zip(rows[keep].tolist(), scores[keep].tolist(), ids[cols][keep].tolist(), strict=True):
            h = heaps[r]
            if len(h) < k:
                heapq.heappush(h, (s, -c))
            elif (s, -c) > h[0]:
                heapq.heapreplace(h, (s, -c))
            if len(h) == k:
                limit[r] = max(limit[r], h[0][0])
    for r, h in enumerate(heaps):
        for s, c in h:
            yield r, s, -c


def searched(url: str, k: int):
    """For ``mapInArrow``: the ``k`` best candidates of each query, at most, that this task's rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            ids = slab.column("id").to_numpy()
            for rows, vecs in by_length(slab.column("vec"), np.float64):
                store, own = coded(vecs), ids[rows]
                for block in blocks(url):
                    names, limits = block.column("id").to_numpy(), block.column("limit").to_numpy()
                    for mine, asked in by_length(block.column("vec"), np.float64):
                        if asked.shape[1] == vecs.shape[1]:
                            found = list(nearest(coded(asked), names[mine], limits[mine], store, own, k))
                            if found:
                                r, s, c = zip(*found, strict=True)
                                yield pa.RecordBatch.from_arrays([pa.array(names[mine][list(r)]), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query", "candidate", "score"])

    return run


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    part = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    size = squared_length(F.col("vec"))
    return part.where(F.col("id").isNotNull() & finite(F.col("vec")) & F.exists("vec", lambda x: x != 0) & (size < float("inf")))


def dealt(rows: DataFrame, first_band: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Written with the number of the band of each row; and the bands.  The first is small and spread over some tasks."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < 2 * cores:
        rows = rows.repartition(2 * cores)
    n, at = rows.count(), scratch(spark, "bands")
    shares = [hi / max(n, 1) for _, hi in bands(first_band, n)]
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    band = F.lit(0)
    for share in shares[:-1]:
        band = band + (place >= share).cast("int")
    rows.withColumn("band", band).write.partitionBy("band").parquet(at)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return spark.read.schema(f"{schema}, band int").parquet(at), [(b, b + 1) for b in range(len(shares))]


def search(rows: DataFrame, is_query: Column, *, k: int = 20, first_band: int = FIRST_BAND, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` rows of largest inner product, nearest first, ties to the smaller id.

    ``is_query`` is a condition on ``id``.  Every row is a candidate but for queries of its own id.  Scores are sums in double
    precision of the original components' products, from the first on.

    Rows take no part whose id or vector is null, whose vector is empty, zero or holds a null or a component
    that isn't finite, or whose squared length exceeds double precision.  Vectors of different lengths never meet.  Of a
    query's rows the least vector asks; other rows that repeat an id count one by one.  A query with fewer
    than ``k`` candidates gets all; without any, and in an empty table, there are no rows.  Other columns are not read.
    """
    candidates, ranges = dealt(usable(rows, id_col, vec_col), first_band)
    queries = one_of_each(candidates.drop("band").where(is_query), "id")

    def ask(so_far: DataFrame | None) -> str:
        if so_far is None:
            return put(queries.withColumn("limit", F.lit(float("-inf"))), "queries")
        last = so_far.where(F.col("rank") == k).select("query", F.col("score").alias("last"))
        return put(queries.join(last, queries["id"] == last["query"], "left").select("id", "vec", F.coalesce("last", F.lit(float("-inf"))).alias("limit")), "queries")

    def look(part: tuple[int, int], url: str) -> DataFrame:
        here = candidates.where(F.col("band") == part[0]).select("id", "vec")
        return here.mapInArrow(searched(url, k), FOUND)

    found = in_rounds(ranges or [(0, 1)], ask, look, ["query"], k, "nearest")
    return found.select(F.col("query").alias("query_id"), "rank", F.col("candidate").alias("vec_id"), "score")
