"""Centroid clustering with ball trees: Lloyd's rounds in integers, in which whole balls of vectors are assigned at once.

Each task packs its vectors into metric trees, once, and the trees are written to the shared folder: a row a
tree, of bounded size.  A node is a run of the tree's vectors and stores their number, their integer sum, and
the radius around their mean.  A round goes down each tree, level by level, with the centroids that
may still be nearest to something in a ball: by the triangle inequality a centroid is out if its distance less
the radius exceeds another's distance plus the radius.  Where one is left it takes the whole ball, whose
count and sum are known; leaves with several are settled by exact integer distances.  A round returns one
row a task and centroid, and the driver holds only the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .vectors import finite, slabs

TREE_ROWS = 4096
LEAF_ROWS = 32
LARGEST = 2**20  # of components: distances and sums of products are then exact in double precision up to 2,000 dimensions
TREE = "ids array<long>, vecs binary, starts array<int>, ends array<int>, lefts array<int>, radii array<double>, sums binary"


def spread_out(vecs: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the vectors, and nodes (start, end, number of the left child or -1); parents come before children.

    A run is cut at the median along the axis on which it is widest; equal vectors are one leaf.
    """
    order, nodes, todo = np.arange(len(vecs)), [], [(0, len(vecs), -1)]
    while todo:
        start, end, parent = todo.pop(0)
        if parent >= 0 and nodes[parent][2] < 0:
            nodes[parent] = (*nodes[parent][:2], len(nodes))
        nodes.append((start, end, -1))
        if end - start <= LEAF_ROWS:
            continue
        own = vecs[order[start:end]]
        width = own.max(axis=0) - own.min(axis=0)
        if not width.any():
            continue
        axis, half = int(width.argmax()), (end - start) // 2
        order[start:end] = order[start:end][np.argpartition(own[:, axis], half)]
        todo += [(start, start + half, len(nodes) - 1), (start + half, end, len(nodes) - 1)]
    return order, nodes


def grown(ids: list[int | None], vecs: np.ndarray) -> dict:
    """A tree of these vectors, as a row."""
    order, nodes = spread_out(vecs)
    vecs = vecs[order]
    sums = np.array([vecs[a:b].sum(axis=0) for a, b, _ in nodes])
    radii = [float(np.sqrt(((vecs[a:b] - s / (b - a)) ** 2).sum(axis=1).max())) for (a, b, _), s in zip(nodes, sums, strict=True)]
    return {"ids": [ids[i] for i in order], "vecs": vecs.astype(np.int32).tobytes(), "starts": [n[0] for n in nodes], "ends": [n[1] for n in nodes], "lefts": [n[2] for n in nodes], "radii": radii, "sums": sums.astype(np.int64).tobytes()}


def planted(rows: DataFrame, dimensions: int) -> DataFrame:
    """The trees of ``rows`` (id, vec), written; a row holds at most ``TREE_ROWS`` vectors."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("vecs", pa.binary()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("lefts", pa.list_(pa.int32())), ("radii", pa.list_(pa.float64())), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            for i in range(0, slab.num_rows, TREE_ROWS):
                part = slab.slice(i, TREE_ROWS)
                vecs = part.column("vec").flatten().to_numpy().reshape(-1, dimensions).astype(np.float64)
                yield pa.RecordBatch.from_pylist([grown(part.column("id").to_pylist(), vecs)], schema=schema)

    return written(rows.mapInArrow(run, TREE), "ball-trees")


def assigned(tree: dict, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each vector's centroid, and by centroid the number and sum of its vectors; and how many vectors were taken with whole balls.

    ``centroids`` and vectors are integers in double precision; equal distances go to the smaller number.
    """
    k, d = centroids.shape
    vecs = np.frombuffer(tree["vecs"], np.int32).reshape(-1, d)
    starts, ends, lefts, radii = (np.asarray(tree[c]) for c in ("starts", "ends", "lefts", "radii"))
    sums = np.frombuffer(tree["sums"], np.int64).reshape(-1, d)
    means = sums / (ends - starts)[:, None]
    cluster, counts, totals, whole = np.empty(len(vecs), np.int32), np.zeros(k, np.int64), np.zeros((k, d), np.int64), 0
    level, may = np.array([0]), np.ones((1, k), bool)
    while len(level):
        far = np.sqrt(np.maximum(((means[level][:, None, :] - centroids) ** 2).sum(axis=2), 0.0))
        room = radii[level] + 1e-9 * (far.max(axis=1) + radii[level] + 1.0)
        reach = np.where(may, far, np.inf).min(axis=1) + room
        may &= far - room[:, None] <= reach[:, None]
        alone, inner = may.sum(axis=1) == 1, lefts[level] >= 0
        for node, c in zip(level[alone].tolist(), may[alone].argmax(axis=1).tolist(), strict=True):
            cluster[starts[node] : ends[node]] = c
            counts[c] += ends[node] - starts[node]
            totals[c] += sums[node]
            whole += int(ends[node] - starts[node])
        for node, left in zip(level[~alone & ~inner].tolist(), may[~alone & ~inner], strict=True):
            here, among = slice(starts[node], ends[node]), np.flatnonzero(left)
            x = vecs[here].astype(np.float64)
            near = among[((x[:, None, :] - centroids[among]) ** 2).sum(axis=2).argmin(axis=1)]
            cluster[here] = near
            counts += np.bincount(near, minlength=k)
            np.add.at(totals, near, vecs[here].astype(np.int64))
        down = ~alone & inner
        level, may = np.concatenate([lefts[level[down]], lefts[level[down]] + 1]), np.concatenate([may[down], may[down]])
    return cluster, counts, totals, whole


def trees_of(batch: pa.RecordBatch) -> Iterator[dict]:
    names = [n for n in batch.schema.names if n != "ids"]
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in names} | {"ids": batch.column("ids")[i].values}


def moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floor of the mean of each one's vectors; one without vectors stays."""
    k, d = len(centroids), len(centroids[0])
    at = np.array(centroids, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            for tree in trees_of(batch):
                _, n, s, _ = assigned(tree, at)
                counts += n
                totals += s
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(own, pa.int32()), "n": pa.array(counts[own]), "sums": pa.array(totals[own].tolist(), pa.list_(pa.int64()))})

    parts = trees.mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]
    found = {r["cluster"]: r for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()}  # a row a centroid
    return [[int(found[c][f"s{i}"]) // found[c]["n"] for i in range(d)] if c in found else old for c, old in enumerate(centroids)]


def cluster(rows: DataFrame, *, dimensions: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Vectors count that have exactly ``dimensions`` components, none null or not finite, and become integers,
    floor(``scale`` * x).  The first centroids are the ``k`` of them (all, if fewer) with the smallest sha256 of
    "seed:id", ties by vector; after ``rounds`` rounds each vector is assigned once more, to the nearest
    centroid, ties to the smaller number.  Inertia is the sum of distances, over the cluster and over all (null
    where a sum exceeds a long); the digest is of the final centroid's components joined by commas.

    A vector with a component beyond 2^20 in size takes no part: its distances would not be exact.  A null id is
    clustered like any other but never a first centroid.  Repeated rows stay and count each time.  Without vectors, as
    in an empty table, there are no rows.  Other columns are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(finite(F.col("v")) & (F.size("v") == dimensions))
    kept = kept.where(F.forall("v", lambda x: F.abs(x.cast("double") * scale) < LARGEST)).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vec"))
    cores = spark.sparkContext.defaultParallelism
    trees = planted(kept.repartition(2 * cores) if kept.rdd.getNumPartitions() < 2 * cores else kept, dimensions)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = [list(r["vec"]) for r in kept.where(F.col("id").isNotNull()).orderBy(rank, "vec").limit(k).collect()]
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if centroids:
        for _ in range(rounds):
            centroids = moved(trees, centroids)
        at = np.array(centroids, np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree in trees_of(batch):
                    own, _, _, _ = assigned(tree, at)
                    vecs = np.frombuffer(tree["vecs"], np.int32).reshape(-1, dimensions)
                    far = ((vecs - at[own]) ** 2).sum(axis=1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([tree["ids"], pa.array(own), pa.array(far)], names=["id", "cluster", "distance"])

        found = written(trees.mapInArrow(run, out), "clusters")
    else:
        found = spark.createDataFrame([], out)
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # a row a centroid
    fits = lambda x: int(x) if x < 2**63 else None
    total = sum((r["s"] for r in by_cluster), 0)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(r["cluster"], fits(r["s"]), fits(total), digest[r["cluster"]]) for r in by_cluster], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").cast(kind).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
