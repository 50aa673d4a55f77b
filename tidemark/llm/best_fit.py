"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Pieces of one length are interchangeable, so the packing plan depends on nothing but how
many pieces there are of each length: at most ``capacity`` numbers, whatever the corpus.
The plan is made from that histogram exactly as best-fit decreasing would do it one
document at a time: lengths in falling order, each piece into the open bin with the least
room that still suffices, which a segment tree over the remaining capacities finds in
logarithmic time; runs of equal pieces that meet runs of equal bins are placed at once.
The plan is a list of runs (length, first rank, first bin, offset).  Executors then place
every piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import held, raw_text, task_id, words, written

CACHE_WORDS = 500_000


# The tokenizer's own cut of a word into pieces, and the words for which Python's agrees with it
# (printable ASCII and Latin-1: nothing that normalisation would compose).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile("[!-~\u00a1-\u00ff]+").fullmatch
WORD_END = "</w>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of a text, word by word: this tokenizer never joins across ASCII white space.

    New words are cut into pieces, new pieces encoded in one go (each ends with a word-end token,
    so the ids can be told apart).  Ids of words and pieces are kept in two generations: a full
    store becomes the old one, and what is met again moves back, so frequent words stay known.
    """

    def __init__(self, path: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cut = regex.compile(PIECE).findall
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True

    def _encoded(self, pieces: list[str]) -> None:
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        raw, ends = ids.tobytes(), 4 * (np.flatnonzero(self.ends[ids]) + 1)
        self.pieces.update((p, raw[a:b]) for p, a, b in zip(pieces, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        if len(self.pieces) > CACHE_WORDS:
            self.pieces, self.old_pieces = {}, self.pieces
        missing = set().union(*texts).difference(self.known)
        again = missing & self.old.keys()
        self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        plain, other, cuts = [], [], set()
        for raw in missing - again:
            word = raw.decode("utf-8", "replace")
            if PLAIN(word):
                word = word.lower()
                core = word.rstrip(MARKS)
                if core.isalpha():  # the usual word: letters, then marks or nothing
                    cut = (core, word[len(core) :]) if len(core) < len(word) else (core,)
                else:
                    cut = self.cut(word)
                cuts.update(cut)
                plain.append((raw, cut))
            else:
                other.append((raw, word))
        new = cuts.difference(self.pieces)
        again = new & self.old_pieces.keys()
        self.pieces.update(zip(again, map(self.old_pieces.__getitem__, again), strict=True))
        new = list(new - again)
        for i in range(0, len(new), 8192):
            self._encoded(new[i : i + 8192])
        get = self.pieces.__getitem__
        self.known.update((raw, get(cut[0]) if len(cut) == 1 else b"".join(map(get, cut))) for raw, cut in plain)
        coded = self.tokenizer.encode_batch_fast([w for _, w in other], add_special_tokens=False)
        self.known.update((raw, np.asarray(e.ids, "<u4").tobytes()) for (raw, _), e in zip(other, coded, strict=True))

    def ids(self, text: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, text))


def encoder(path: str) -> WordEncoder:
    return held(f"encoder {path}", lambda: WordEncoder(path))


def _chunks(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of about ``most`` bytes: bounds what is split into words at once."""
    first, size, part = 0, 0, []
    for i, raw in enumerate(batch.column(column)):
        part.append(raw.as_py())
        size += len(part[-1])
        if size >= most:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part


PIECES = "id {id}, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces_of(documents: DataFrame, tokenizer: str, *, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece; ``nth`` counts the pieces of one length within a task."""
    schema = PIECES.format(id=documents.schema[id_col].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, width = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        seen, task = np.zeros(capacity + 1, np.int64), task_id()
        for batch in batches:
            ids = batch.column(0)
            rows, piece, length, crc, nth = [], [], [], [], []
            for first, texts in _chunks(batch, 1):
                split = [words(t) for t in texts]
                coder.learn(split)
                for i, text in enumerate(split, first):
                    buf = coder.ids(text) + end
                    for k, at in enumerate(range(0, len(buf), width)):
                        part = buf[at : at + width]
                        n = len(part) // 4
                        rows.append(i), piece.append(k), length.append(n), crc.append(zlib.crc32(part)), nth.append(seen[n])
                        seen[n] += 1
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(np.asarray(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(n, task, np.int32)), pa.array(nth, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return documents.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text")).mapInArrow(run, schema)


class Rooms:
    """Segment tree over remaining capacities: the least room >= n that an open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.leaves, bool)

    def set(self, room: int, present: bool) -> None:
        i = room + self.leaves
        self.tree[i] = present
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def least(self, n: int) -> int | None:
        i = n + self.leaves
        while not self.tree[i]:  # climb to the first right neighbour with something in it
            while i & 1:
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, offset), sorted; each holds up to the next row's first rank.

    ``counts``: pieces by length.  Ranks of a row's pieces are consecutive, and so are their bins.
    """
    rooms, open_bins, out, bins = Rooms(capacity), {}, [], 0

    def put_back(first: int, n: int, room: int) -> None:
        if n and room:
            open_bins.setdefault(room, []).append((first, n))
            rooms.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.least(length)
            if room is None:  # new bins, as many as the rest could fill
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.set(room, False)
            each = room // length  # a bin in use stays the tightest until no more fits
            full = min(n, left // each)
            for in_use, bin0, many in ((each, first, full), (left - full * each if full < n else 0, first + full, 1)):
                if in_use and many:
                    for k in range(in_use):
                        out.append((length, rank, bin0, capacity - room + k * length))
                        rank += many
                    left -= in_use * many
                    put_back(bin0, many, room - in_use * length)
                    first, n = bin0 + many, n - many
            put_back(first, n, room)
    return np.asarray(sorted(out), np.int64).reshape(-1, 4)


def pack(documents: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a word-level BPE file.  A document longer than ``capacity`` is cut
    into pieces of that length, the last may be shorter; pieces fill sequences without gaps.  A null
    or empty text is the end token alone; null and repeated ids are documents like any other; equal
    lengths are taken in no stated order.  Other columns are not read.  An empty table gives no rows.

    Driver memory: the histogram and plan, bounded by ``capacity`` and not by the corpus.
    """
    pieces = written(pieces_of(documents, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    schema = f"{id_col} {documents.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    key = runs[:, 0] << 48 | runs[:, 1]  # ranks stay below 2^48

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            cols = [batch.column(k) for k in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, schema)
