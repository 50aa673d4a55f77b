"""Interpolated modified Kneser-Ney language model, counted in Spark, read through memory maps.

Counting is one Spark job of three steps.  Tasks count the word pairs of their texts and hand on,
for each shard, one packed and compressed array.  A shard merges its arrays, writes its part of the
model (pair keys in order, counts), and hands on what each word gathers as context and as successor.
Word shards merge that and write theirs.  Nothing but a few totals reaches the driver.

The model is a folder of sorted hash arrays in the shared folder.  Workers map the files and look up a
batch's sorted keys by binary search, so memory holds only a batch, and executors on one machine
share the pages.  A file's number of entries is part of the model: a file that is absent or short, as on a
worker that doesn't share the folder, is refused instead of read as empty.

    P(w | h) = max(c(h w) - D(c(h w)), 0) / c(h) + gamma(h) * P(w)
    P(w)     = max(N1+(. w) - D'(N1+(. w)), 0) / N1+(. .) + gamma' / (V + 1)

with three discounts a level from the counts of counts; V + 1 leaves a place for unknown words.
"""

from __future__ import annotations

import math
import mmap
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_path, lower_words, raw_text, scratch
from .decontaminate import token_hashes

U = np.uint64
BEGIN, END = b"\n<s>", b"\n</s>"  # no word holds white space
SPREAD = 16  # parts over which the successors of one context are spread
CHUNK_BYTES, MERGE_PAIRS = 4 << 20, 2_500_000
MAPS = 8192  # files that a worker keeps mapped; a process may have some 65,000 maps


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def pair_keys(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """64-bit keys; the first 16 bits, which choose the shard, depend on the context and a 16th of its successors."""
    place = _mix(h1 + (h2 % U(SPREAD)) * U(0x9E3779B97F4A7C15))
    return (place & U(0xFFFF000000000000)) | (_mix(h1 * U(0x9E3779B97F4A7C15) ^ h2) >> U(16))


def _edges(n: int) -> np.ndarray:
    """The first key of each of ``n`` shards but the first: what ``_slices`` finds without listing them."""
    return np.array([-(-(k << 64) // n) for k in range(1, n)], U)


def _slices(keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted ``keys``, without empty ones; shard k of ``n`` holds floor(key * n / 2^64) = k."""
    if not len(keys):
        return
    low = ((keys & U(0xFFFFFFFF)) * U(n)) >> U(32)
    shard = ((keys >> U(32)) * U(n) + low) >> U(32)
    cut = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(keys)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(shard[a]), int(a), int(b)


def _packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(arrays[0])) + b"".join(a.tobytes() for a in arrays))


def _unpacked(blobs: pa.ChunkedArray, kinds: tuple) -> list[np.ndarray]:
    import zstandard

    parts: list[list] = [[] for _ in kinds]
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
        (n,), at = struct.unpack_from("<q", raw), 8
        for p, kind in zip(parts, kinds, strict=True):
            p.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.empty(0, k) for p, k in zip(parts, kinds, strict=True)]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, and the sums of each of ``values`` by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


def _chunks(column: pa.Array) -> Iterator[list[list[bytes]]]:
    size, part = 0, []
    for raw in column:
        raw = raw.as_py()
        part.append(lower_words(raw))
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield part
            size, part = 0, []
    if part:
        yield part


def _pairs(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of all tokens, and each text's number of tokens; texts one after the other."""
    marks = token_hashes([[BEGIN, END]])[0]
    hashes = token_hashes(texts)
    n = np.array([len(h) + 1 for h in hashes], np.int64)
    h2 = np.concatenate([x for h in hashes for x in (h, marks[1:])]) if hashes else np.empty(0, U)
    h1 = np.empty_like(h2)
    h1[1:] = h2[:-1]
    h1[np.cumsum(n) - n] = marks[0]
    return h1, h2, n


def _count(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merge() -> None:
            key, h1, h2, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            held[:] = [(key[first], h1[order[first]], h2[order[first]], np.add.reduceat(n[order], first))]

        def out() -> pa.RecordBatch:
            (key, h1, h2, n), rows = held[0], []
            for k, a, b in _slices(key, shards):
                rows.append((k, _packed(h1[a:b], h2[a:b], n[a:b].astype(np.uint32))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "part"])

        for batch in batches:
            for texts in _chunks(batch.column(0)):
                h1, h2, _ = _pairs(texts)
                key = pair_keys(h1, h2)
                key, at, n = np.unique(key, return_index=True, return_counts=True)
                held.append((key, h1[at], h2[at], n))
                if sum(len(x[0]) for x in held) > MERGE_PAIRS:
                    merge()
                    if len(held[0][0]) > MERGE_PAIRS // 2:
                        yield out()
        if held:
            merge()
            yield out()

    return run


def _relay_pairs(shards: int):
    """Second level of counting: rows cut for a range of shards are cut for the shards."""

    def run(group: pa.Table) -> pa.Table:
        h1, h2, n = _unpacked(group.column("part"), (U, U, np.uint32))
        key = pair_keys(h1, h2)
        order = np.argsort(key, kind="stable")
        rows = [(k, _packed(*(x[order[a:b]] for x in (h1, h2, n)))) for k, a, b in _slices(key[order], shards)]
        return pa.table([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "part"])

    return run


CONTEXT = (U, np.int64, np.uint32, np.uint32, np.uint32)  # word, c(w), successors seen once, twice, more often
WORD = (U, np.uint32, np.int64)  # word, contexts, occurrences
STATS = ("n1", "n2", "n3", "n4", "pairs")
PAIRS, WORDS = (U, np.uint32), (U, *[np.int64] * 6)  # the columns of the two kinds of files


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Number of entries, then the arrays; complete or absent."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        f.write(struct.pack("<q", len(arrays[0])))
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    os.replace(own, f"{folder}/{name}")


def _merge_pairs(folder: str, word_shards: int, slices: int):
    """``word_shards``: shards of words, or ranges of them; ``slices``: parts of a range, by the pairs' shard."""

    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        h1, h2, n = _unpacked(group.column("part"), (U, U, np.uint32))
        key = pair_keys(h1, h2)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, h1, h2, n = key[first], h1[order[first]], h2[order[first]], np.add.reduceat(n[order].astype(np.int64), first)
        _save(folder, f"pairs-{shard}", key, n.astype(np.uint32))
        one, two = (n == 1).astype(np.uint32), (n == 2).astype(np.uint32)
        contexts = _summed(h1, n, one, two, (n > 2).astype(np.uint32))
        words = _summed(h2, np.ones(len(n), np.uint32), n)
        stats = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)]
        rows = []
        for kind, arrays, kinds in ((0, contexts, CONTEXT), (1, words, WORD)):
            for k, a, b in _slices(arrays[0], word_shards):
                rows.append((k, shard % slices, kind, _packed(*(x[a:b].astype(t) for x, t in zip(arrays, kinds, strict=True))), -1 if rows else shard, *([0] * 5 if rows else stats)))
        return _handed(rows)

    return run


def _handed(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 5]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word_shard", "slice", "kind", "part", "shard", *STATS])


def _relay_words(word_shards: int):
    """Second level of what shards of pairs hand on; their totals go with an empty part."""

    def run(group: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        rows = []
        for kind, kinds in ((0, CONTEXT), (1, WORD)):
            arrays = _unpacked(group.filter(pc.equal(group.column("kind"), kind)).column("part"), kinds)
            order = np.argsort(arrays[0], kind="stable")
            for k, a, b in _slices(arrays[0][order], word_shards):
                rows.append((k, 0, kind, _packed(*(x[order[a:b]] for x in arrays)), -1, *[0] * 5))
        nothing = _packed(*(np.empty(0, t) for t in CONTEXT))
        for own in group.filter(pc.greater_equal(group.column("shard"), 0)).to_pylist():
            rows.append((rows[0][0], 0, 0, nothing, own["shard"], *(own[s] for s in STATS)))
        return _handed(rows)

    return run


TOTALS = ("words", "tokens", "types", "m1", "m2", "m3", "m4", "more", *STATS)


def _merge_words(folder: str):
    def run(group: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        shard = group.column("word_shard")[0].as_py()
        part = lambda kind: group.filter(pc.equal(group.column("kind"), kind)).column("part")
        c = _unpacked(part(0), CONTEXT)
        contexts = _summed(c[0], *(x.astype(np.int64) for x in c[1:]))
        w = _unpacked(part(1), WORD)
        words = _summed(w[0], *(x.astype(np.int64) for x in w[1:]))
        keys = np.union1d(contexts[0], words[0])
        placed = lambda own, x: (lambda y: (y.__setitem__(np.searchsorted(keys, own), x), y)[1])(np.zeros(len(keys), np.int64))
        total, one, two, more = (placed(contexts[0], x) for x in contexts[1:])
        before, count = (placed(words[0], x) for x in words[1:])
        _save(folder, f"words-{shard}", keys, count, total, before, one, two, more)
        row = [int((count > 0).sum()), int(count.sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)), int((before > 2).sum())]
        row += [int(np.sum(group.column(s).to_numpy())) for s in STATS]
        own = group.filter(pc.greater_equal(group.column("shard"), 0))
        lists = [pa.array([own.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("shard", "pairs")]
        return pa.table([*(pa.array([x], pa.int64()) for x in (shard, len(keys), *row)), *lists], names=["word_shard", "entries", *TOTALS, "pair_shards", "pair_entries"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Indexed by count, 0 to 3 (3: or more); where counts of counts are missing, halves."""
    if not all((n1, n2, n3, n4)):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))])


@dataclass(frozen=True)
class Model:
    """``pairs`` and ``words``: the entries of each shard's file, 0 where there is none."""

    folder: str
    pairs: np.ndarray
    words: np.ndarray
    totals: dict[str, int]


class Reader:
    """The mapped files of a model."""

    def __init__(self, model: Model):
        self.model, t = model, model.totals
        self.open: dict[str, list[np.ndarray]] = {}
        self.d2, self.d1 = discounts(*(t[k] for k in ("n1", "n2", "n3", "n4"))), discounts(*(t[k] for k in ("m1", "m2", "m3", "m4")))
        self.unknown = (float(self.d1[1] * t["m1"] + self.d1[2] * t["m2"] + self.d1[3] * t["more"]) / t["types"] if t["types"] else 1.0) / (t["words"] + 1)

    def arrays(self, name: str, entries: int, kinds: tuple) -> list[np.ndarray]:
        """The columns of a file; the least recently used map is given up for a new one."""
        found = self.open.pop(name, None)
        if found is None:
            path = f"{self.model.folder}/{name}"
            with open(path, "rb") as f:
                view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
            if len(view) != 8 + entries * sum(np.dtype(k).itemsize for k in kinds) or struct.unpack_from("<q", view) != (entries,):
                raise ValueError(f"{path} does not hold the {entries} entries of the model")
            found, at = [], 8
            for k in kinds:
                found.append(np.frombuffer(view, k, entries, at))
                at += entries * np.dtype(k).itemsize
            if len(self.open) >= MAPS:
                self.open.pop(next(iter(self.open)))
        self.open[name] = found
        return found

    def find(self, keys: np.ndarray, what: str, sizes: np.ndarray, kinds: tuple) -> list[np.ndarray]:
        """Values of sorted ``keys``; 0 where absent."""
        out = [np.zeros(len(keys), np.int64) for _ in kinds[1:]]
        for k, a, b in _slices(keys, len(sizes)):
            if sizes[k]:
                own, *values = self.arrays(f"{what}-{k}", int(sizes[k]), kinds)
                at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                hit = own[at] == keys[a:b]
                for o, v in zip(out, values, strict=True):
                    o[a:b] = np.where(hit, v[at], 0)
        return out

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        t = self.model.totals
        h1, h2, n = _pairs(texts)
        distinct, at = np.unique(np.concatenate([h1, h2]), return_inverse=True)
        count, total, before, one, two, more = self.find(distinct, "words", self.model.words, WORDS)
        key = pair_keys(h1, h2)
        order = np.argsort(key)
        pair = np.empty(len(key), np.int64)
        (pair[order],) = self.find(key[order], "pairs", self.model.pairs, PAIRS)
        low = np.maximum(before - self.d1[np.minimum(before, 3)], 0) / max(t["types"], 1) + self.unknown
        gamma = np.where(total > 0, (self.d2[1] * one + self.d2[2] * two + self.d2[3] * more) / np.maximum(total, 1), 1.0)
        a, b = at[: len(h1)], at[len(h1) :]
        p = np.maximum(pair - self.d2[np.minimum(pair, 3)], 0) / np.maximum(total[a], 1) + gamma[a] * low[b]
        base = np.log10((count[b] + 0.1) / (t["tokens"] + 0.1 * (t["words"] + 1)))
        first = np.cumsum(n) - n
        return n, np.add.reduceat((count[b] > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


_readers: dict[str, Reader] = {}


def levels(shards: int, fan: int) -> tuple[int, int]:
    """Shards, and the ranges that lead to them: 1 where up to ``fan`` shards are reached at once, else as many as shards a range."""
    if shards <= fan:
        return shards, 1
    ranges = math.isqrt(shards - 1) + 1
    return ranges * -(-shards // ranges), ranges


def train(documents: DataFrame, *, text_col: str = "text", shards: int | None = None, fan: int = 2048) -> Model:
    """The model of all ``documents``; every pair is counted.

    A task hands on a row for each shard that it meets.  Of more than ``fan`` shards it hands on a row for each
    range of shards instead, and a second level of tasks, as many as the first and as large, cuts them for the
    shards.  So rows grow with the power 1.5 of the input beyond.  The model is the same, byte by byte.

    ``shards``: by default twice the tasks that read the texts, so a shard's memory doesn't grow with
    the input.  The driver gets one row for each of a fourth as many word shards, and keeps 8 bytes a shard.  A
    null text is the end alone; repeated rows count as often; ids and other columns are not read.  Empty
    tables give a model of nothing.
    """
    spark = documents.sparkSession
    folder = local_path(scratch(spark, "kneser-ney"))
    texts = documents.select(raw_text(text_col).alias("text"))
    tasks = texts.rdd.getNumPartitions()
    shards, ranges = levels(shards or max(8, 2 * tasks), fan)
    word_shards, word_ranges = levels(max(1, shards // 4), fan)
    counted = texts.mapInArrow(_count(ranges if ranges > 1 else shards), "shard int, part binary")
    if ranges > 1:
        counted = counted.withColumn("slice", F.spark_partition_id() % -(-tasks // ranges)).groupBy("shard", "slice").applyInArrow(_relay_pairs(shards), "shard int, part binary")
    handed = "word_shard int, slice int, kind int, part binary, shard int, " + ", ".join(f"{s} long" for s in STATS)
    merge = _merge_pairs(folder, word_ranges if word_ranges > 1 else word_shards, -(-shards // word_ranges))
    merged = counted.groupBy("shard").applyInArrow(merge, handed)
    if word_ranges > 1:
        merged = merged.groupBy("word_shard", "slice").applyInArrow(_relay_words(word_shards), handed)
    kinds = ", ".join(f"{s} long" for s in ("word_shard", "entries", *TOTALS)) + ", pair_shards array<long>, pair_entries array<long>"
    rows = merged.groupBy("word_shard").applyInArrow(_merge_words(folder), kinds).collect()
    pairs, words = np.zeros(shards, np.int64), np.zeros(word_shards, np.int64)
    for r in rows:
        words[r["word_shard"]] = r["entries"]
        pairs[r["pair_shards"]] = r["pair_entries"]
    return Model(folder, pairs, words, {s: sum(r[s] for r in rows) for s in TOTALS})


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end; a null or empty
    text is the end alone.  ``score`` is the model's log10 probability of the text, ``base_score`` that of
    add-0.1 unigrams.  A model of no texts gives every token its only place, so both are 0.  Repeated
    rows and null ids stay; other columns are not read.  An empty table gives no rows.
    """
    schema = f"{id_col} {documents.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _readers:
            _readers.clear()
            _readers[model.folder] = Reader(model)
        reader = _readers[model.folder]
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                n, known, base, own = reader.score(texts)
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(known), pa.array(np.full(len(n), model.totals["tokens"])), pa.array(base), pa.array(own)], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return documents.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that the model isn't learned from: crc32 of the id modulo 10 is 0."""
    from .common import bucket_of

    return bucket_of(F.col(id_col), 10) == 0
