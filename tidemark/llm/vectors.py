"""What the vector operators share: rows that take part, matrices of batches, questions that tasks read, rounds of a search.

A search has questions (a bounded share of the rows, each with a vector and a limit that a candidate must reach) and
candidates in bands.  Bands grow eightfold, and a task looks through its candidates for every question, a
block at a time, and returns at most the ``k`` best it has.  After each band the best so far are
written to the shared folder, and the score of the ``k``-th becomes the limit for the next: a band
returns some seven times ``k`` rows a question, however many tasks it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

SLAB_BYTES = 16 << 20
BLOCK_ROWS = 1024
TILE = 2048
BAND_GROWTH = 8


def finite(vector: Column) -> Column:
    """A vector with components, none of which is null or not finite."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, number)


def squared_length(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def one_of_each(rows: DataFrame, id_col: str) -> DataFrame:
    """A row for each id: the least one."""
    rest = [c for c in rows.columns if c != id_col]
    return rows.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("least")).select(id_col, *(F.col("least")[c].alias(c) for c in rest))


def by_length(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the column's lists: which rows have it, and their matrix."""
    offsets = column.offsets.to_numpy()
    flat, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        if len(rows) == len(lengths):
            yield rows, flat[offsets[0] : offsets[-1]].reshape(-1, d).astype(kind)
        else:
            yield rows, flat[offsets[rows][:, None] + np.arange(d)].astype(kind)


def slabs(batches: Iterator[pa.RecordBatch], most: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """A task's rows in batches of some ``most`` bytes, so that questions are read once for many rows."""
    held, n = [], 0
    for batch in batches:
        step = max(1, most * batch.num_rows // max(batch.nbytes, 1))
        for i in range(0, batch.num_rows, step):
            piece = batch.slice(i, step)
            if held and n + piece.nbytes > most:
                yield pa.concat_batches(held)
                held, n = [], 0
            held.append(piece)
            n += piece.nbytes
    if held:
        yield pa.concat_batches(held)


def put(rows: DataFrame, name: str, rows_a_file: int = 1 << 15) -> str:
    """Writes ``rows`` to the shared folder in files of bounded size; returns where."""
    at = scratch(rows.sparkSession, name)
    once = written(rows, name)
    once.coalesce(1 + once.count() // rows_a_file).write.parquet(at)
    return at


def blocks(url: str, rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """In a task: what ``put`` wrote, ``rows`` rows at a time.  Any file system that pyarrow opens will do."""
    system, path = pa.fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else "file://" + url)
    for found in sorted(f.path for f in system.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".parquet")):
        with system.open_input_file(found) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=rows)


def places(rows: np.ndarray) -> np.ndarray:
    """The place of each entry within its row; ``rows`` ascends."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def best(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The entries that are among the ``k`` first of their key: larger scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, keys))
    return order[places(keys[order]) < k]


def top(found: DataFrame, keys: list[str], k: int, score: str = "score", id_col: str = "candidate") -> DataFrame:
    """``rank`` from 1; Spark keeps ``k`` rows a key in each task before they move."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), id_col)
    return found.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bands(first: int, total: int) -> list[tuple[int, int]]:
    """Half-open ranges that cover 0 to ``total``; each end is ``BAND_GROWTH`` times the one before."""
    ends = [min(first, total)]
    while ends[-1] < total:
        ends.append(min(ends[-1] * BAND_GROWTH, total))
    return list(zip([0, *ends], ends, strict=False))


def in_rounds(ranges: list[tuple[int, int]], ask: Callable[[DataFrame | None], str], search: Callable[[tuple[int, int], str], DataFrame], keys: list[str], k: int, name: str) -> DataFrame:
    """The ``k`` best for each of ``keys`` over all ranges.

    ``ask`` writes the questions, given the best so far, and says where; ``search`` looks through a range.
    """
    so_far = None
    for part in ranges:
        found = search(part, ask(so_far))
        so_far = written(top(found if so_far is None else so_far.drop("rank").unionByName(found), keys, k), name)
    return so_far
