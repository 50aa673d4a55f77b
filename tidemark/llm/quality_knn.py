"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte pairs; an extension of the plain method is a term for each level of repetition.  A truncated singular value decomposition of
a bounded sample's term weights gives the space; the sample's vectors and labels are broadcast, and
every document's cosine with every one of them is computed in blocks.  The nearest vote, weighted
by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, raw_text, words
from .labelled import labelled_sample
from .quality_rules import repeated_words

PAIR_TERMS, LEVELS = 2048, 11
TERMS = PAIR_TERMS + LEVELS
PAIR = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(13)) % np.uint64(PAIR_TERMS)).astype(np.int64)


def terms(raw: bytes) -> np.ndarray:
    """Roots of the shares of hashed byte pairs, and one term for the share of words in repeated windows."""
    out = np.zeros(TERMS, np.float32)
    b = np.frombuffer(raw, np.uint8).astype(np.uint16)
    if len(b) > 1:
        out[:PAIR_TERMS] = np.sqrt(np.bincount(PAIR[(b[:-1] << 8) | b[1:]], minlength=PAIR_TERMS) / (len(b) - 1))
        tokens = words(raw)
        if tokens:
            out[PAIR_TERMS + (LEVELS - 1) * repeated_words(tokens) // len(tokens)] = 0.5
    return out


@dataclass(frozen=True)
class Space:
    weight: np.ndarray  # of each term
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled, of length 1
    labels: np.ndarray
    neighbours: int
    prior: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weight) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, cosine: np.ndarray) -> np.ndarray:
        """Which of the labelled texts are a row's neighbours: the first of those as near as the last to enter."""
        k = min(self.neighbours, cosine.shape[1])
        edge = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        inside, tied = cosine > edge, cosine == edge
        return inside | tied & (np.cumsum(tied, axis=1) <= k - inside.sum(axis=1, keepdims=True))

    def score(self, x: np.ndarray) -> np.ndarray:
        cosine = self.embed(x) @ self.vectors.T
        vote = np.where(self.nearest(cosine), np.maximum(cosine, 0.0) ** 4, 0.0).astype(np.float64)
        total = vote.sum(axis=1)
        return np.where(total > 0, vote @ self.labels / np.maximum(total, 1e-30), self.prior)


def fit(sample: list[tuple[bytes, int]], totals: dict[int, int], *, dimensions: int = 48, neighbours: int = 15) -> Space | None:
    """None without labelled texts."""
    if not sample:
        return None
    x = np.array([terms(t) for t, _ in sample])
    y = np.array([y for _, y in sample], np.float32)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    a = x * weight
    values, left = np.linalg.eigh((a @ a.T).astype(np.float64))
    keep = np.argsort(values)[::-1][:dimensions]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-300)]
    axes = (a.T @ left[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    seen = sum(totals.values())
    space = Space(weight, axes, np.empty((0, len(keep)), np.float32), y, neighbours, totals.get(1, 0) / max(seen, 1))
    return Space(weight, axes, space.embed(x), y, neighbours, space.prior)


def learn(documents: DataFrame, labels: DataFrame, learn: Column, *, sample: int = 2400, max_bytes: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space | None:
    """The space from at most ``sample`` labelled texts of up to ``max_bytes`` bytes, half of each label.

    ``learn`` is a condition on ``id``.  See ``labelled_sample`` for repeated and conflicting rows.  None,
    whose scores are all 0, without such texts, as in empty tables.
    """
    rows, totals = labelled_sample(documents, labels, label_col, learn, per_class={0: sample // 2, 1: sample // 2}, max_bytes=max_bytes, id_col=id_col, text_col=text_col)
    return fit(rows, totals)


def score(documents: DataFrame, space: Space | None, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ``score`` in [0, 1], ``predicted``.

    Whole texts are read.  A text without terms (null, empty, one byte) has no neighbours and gets
    the share of label 1; without labels every score is 0.  Equal similarities at the edge of
    the neighbourhood are settled by position in the sample.  Repeated rows and null ids stay; other
    columns are not read.  An empty table gives no rows.
    """
    schema = f"{id_col} {documents.schema[id_col].dataType.simpleString()}, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                if space is None:
                    s = np.zeros(batch.num_rows)
                else:
                    s = space.score(np.array([terms(raw.as_py()) for raw in batch.column(1)])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return documents.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels are never learned from: crc32 of the id modulo 5 is 0."""
    return bucket_of(F.col(id_col), 5) == 0
