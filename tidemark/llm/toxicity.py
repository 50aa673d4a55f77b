"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text.  A text is cut into
windows of whole words; what the toxic dictionary saves over the ordinary one in a window is its gain.
Of toxic texts the trainer gets the windows that set them apart (a test of their byte strings'
frequencies chooses them), for most of a toxic text is ordinary prose.  So that windows are not told apart by
which chance prose either dictionary happens to hold, the toxic one goes on with the ordinary one's.

A text is judged by its windows' gains above two thresholds, against its number of windows.  What they have
to reach is calibrated on texts that the dictionaries haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, lower_words, raw_text, release, rows_kept
from .labelled import labelled_sample

GRAM = 5
COUNTERS = 22  # bits: strings are counted by hash, so the counts' memory is fixed
THRESHOLDS = (0, 2)  # bytes of gain from which on a window counts
_coders: dict[tuple[bytes, bytes], tuple] = {}


def _spaced(raw: bytes) -> bytes:
    return b" " + b" ".join(lower_words(raw)) + b" "


def grams(text: bytes, n: int) -> np.ndarray:
    """The ``n``-byte strings at every position, as integers."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(b) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(b) - n + 1, np.uint64)
    for k in range(n):
        h = (h << np.uint64(8)) | b[k : k + len(h)]
    return h


def counters(text: bytes) -> np.ndarray:
    """The counter of the string at every position."""
    return ((grams(text, GRAM) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def distinct_texts(texts: list[bytes]) -> list[bytes]:
    """Without texts that mostly repeat an earlier one: else a family of copies would look like a habit."""
    seen, out = set(), []
    for t in texts:
        g = grams(_spaced(t), 8)
        if not len(g):
            continue
        g = g ^ (g >> np.uint64(29))
        marks = [(k, int(np.min(g * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))) for k in range(4)]
        if sum(m in seen for m in marks) < 3:
            out.append(t)
        seen.update(marks)
    return out


def apart(toxic: list[bytes], ordinary: list[bytes], *, least_texts: int = 3, log_odds: float = 1.5, evidence: float = 16.0) -> np.ndarray:
    """Which counters stand for strings that toxic texts have more often than chance explains.

    A text counts log2(1 + occurrences), so that no single text decides; ``evidence`` is the likelihood
    ratio statistic of the two frequencies.
    """

    def frequency(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        total, held = np.zeros(1 << COUNTERS, np.float32), np.zeros(1 << COUNTERS, np.int32)
        for t in texts:
            at, n = np.unique(counters(_spaced(t)), return_counts=True)
            total[at] += np.log2(1 + n)
            held[at] += 1
        return total, held

    (a, held), (b, _) = frequency(toxic), frequency(ordinary)
    out = np.zeros(1 << COUNTERS, bool)
    some = np.flatnonzero(held >= least_texts)
    a, b = a[some].astype(float), b[some].astype(float)
    share = len(toxic) / (len(toxic) + len(ordinary))
    term = lambda x, expected: x * np.log(np.maximum(x, 1e-12) / expected)
    ratio = 2 * (term(a, (a + b) * share) + term(b, (a + b) * (1 - share)))
    odds = np.log((a + 0.5) / (len(toxic) + 1)) - np.log((b + 0.5) / (len(ordinary) + 1))
    out[some[(odds > log_odds) & (ratio >= evidence)]] = True
    return out


def telling_windows(toxic: list[bytes], marked: np.ndarray) -> list[bytes]:
    """The runs of words of toxic texts in which each word holds, between its spaces, a marked string."""
    out = []
    for t in toxic:
        text = _spaced(t)
        hits = np.concatenate([[0], np.cumsum(marked[counters(text)])])
        space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = np.minimum(space[:-1], len(hits) - 1)
        behind = np.clip(space[1:] + 2 - GRAM, first, len(hits) - 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hits[behind] > hits[first], [0]])))
        out += [text[space[i] : space[j] + 1] for i, j in zip(edges[::2], edges[1::2], strict=True)]
    return out


def trained(size: int, pieces: list[bytes]) -> bytes:
    """A dictionary of ``pieces``, trained by zstandard; what too few pieces leave empty holds pieces themselves."""
    import zstandard as z

    try:
        out = z.train_dictionary(size, pieces).as_bytes()
    except z.ZstdError:  # too little to train on
        out = b""
    rest = b"".join(dict.fromkeys(pieces))
    return rest[max(0, len(rest) + len(out) - size) :] + out if len(out) < size else out


def windows(raw: bytes, size: int) -> list[bytes]:
    w = lower_words(raw)
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)]


def coder(content: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    p = z.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=3, strategy=z.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(compression_params=p, dict_data=d).compress


@dataclass(frozen=True)
class Model:
    """The dictionaries, and the weights of a text's ``figures``."""

    ordinary: bytes
    toxic: bytes
    window: int
    weights: np.ndarray

    def gains(self, raw: bytes) -> np.ndarray:
        """By how many bytes the toxic dictionary compresses each window better; no words: one window, 0."""
        key = (self.ordinary, self.toxic)
        if key not in _coders:
            _coders.clear()
            _coders[key] = coder(self.ordinary), coder(self.toxic)
        plain, toxic = _coders[key]
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(raw, self.window)] or [0])

    def score(self, texts: list[bytes]) -> np.ndarray:
        return probability(figures([self.gains(t) for t in texts]), self.weights)


def figures(gains: list[np.ndarray]) -> np.ndarray:
    """Per text: for each threshold the log of all gain above it, the log of the number of windows, one."""
    above = [[np.maximum(g - t, 0).sum() for t in THRESHOLDS] for g in gains]
    return np.column_stack([np.log(np.array(above, float).reshape(-1, len(THRESHOLDS)) + 0.5), np.log([len(g) for g in gains]), np.ones(len(gains))])


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    r = np.full(len(w), ridge)
    r[-1] = 1e-6
    for _ in range(40):
        p = probability(x, w)
        h = (x.T * (weight * p * (1 - p))) @ x + np.diag(r)
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - r * w)
    return w


def dictionaries(ordinary: list[bytes], toxic: list[bytes], *, prose_bytes: int, toxic_bytes: int) -> tuple[bytes, bytes]:
    """The ordinary dictionary and the toxic one."""
    ordinary, toxic = distinct_texts(ordinary), distinct_texts(toxic)
    prose = trained(prose_bytes, [w for t in ordinary for w in windows(t, 32)])
    found = telling_windows(toxic, apart(toxic, ordinary))
    return prose, (trained(toxic_bytes, found) if found else b"") + prose


def fit(sample: list[tuple[bytes, int]], totals: dict[int, int], *, window: int = 12, prose_bytes: int = 8192, toxic_bytes: int = 4096) -> Model | None:
    """Dictionaries of two thirds of the sample, calibrated on the rest; None with under two texts of a label.

    For the calibration texts are weighted so that the labels have the shares that ``totals`` gives them.
    """
    texts = [[t for t, y in sample if y == label] for label in (0, 1)]
    if min(map(len, texts)) < 2:
        return None
    model = Model(*dictionaries(*([t for k, t in enumerate(x) if k % 3] for x in texts), prose_bytes=prose_bytes, toxic_bytes=toxic_bytes), window, np.zeros(0))
    rest = [x[::3] for x in texts]
    y = np.repeat([0, 1], [len(x) for x in rest])
    weight = np.array([totals[label] / len(rest[label]) for label in (0, 1)], float)[y]
    x = figures([model.gains(t) for part in rest for t in part])
    return replace(model, weights=logistic(x, y, weight * len(y) / weight.sum()))


def learn(documents: DataFrame, labels: DataFrame, learn: Column, *, per_class: int = 4000, max_bytes: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """The model from at most ``per_class`` labelled texts of each label, of up to ``max_bytes`` bytes.

    ``learn`` is a condition on ``id``.  See ``labelled_sample`` for repeated and conflicting rows.  None,
    whose scores are all 0, if either label has fewer than two such texts, as in empty tables.
    """
    sample, totals = labelled_sample(documents, labels, label_col, learn, per_class={0: per_class, 1: per_class}, max_bytes=max_bytes, id_col=id_col, text_col=text_col)
    return fit(sample, totals)


def score(documents: DataFrame, model: Model | None, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ``score`` in [0, 1], ``predicted``.

    Every window of every text is compressed.  Null and empty texts have one empty window; without a
    model (no labels of one kind) every score is 0.  Repeated rows and null ids stay; other columns
    are not read.  An empty table gives no rows.
    """
    schema = f"{id_col} {documents.schema[id_col].dataType.simpleString()}, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                s = np.zeros(batch.num_rows)
            else:
                s = model.score([raw.as_py() for raw in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return documents.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels are never learned from: crc32 of the id modulo 4 is 2."""
    return bucket_of(F.col(id_col), 4) == 2


def accepted(documents: DataFrame, model: Model | None, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, with all their columns.

    Null ids, repeated rows and columns of any name stay as they are; without a model every row is kept.
    """

    def judge():
        release()

        def accepts(raws: list[bytes]) -> np.ndarray:
            if model is None or not raws:
                return np.ones(len(raws), bool)
            return model.score(raws) < threshold

        return accepts

    return rows_kept(documents, text_col, judge)
