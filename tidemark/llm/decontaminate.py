"""Benchmark decontamination by spaced seeds.

A seed is a window of tokens of which a fixed mask ignores some, hashed.  Test and training
seeds meet on equal hashes; a hit fixes a diagonal (document position - item position), along
which the whole item is compared token by token.  Substituted tokens fall on ignored positions
of one mask or another, so a passage with some of its words replaced is still hit, and the
comparison decides.

The masks miss no overlap.  A stretch of 13 tokens or more with 75 % equal holds one of 13 to 25
tokens with 75 % equal, and in each of those, wherever the substitutions lie, one of ``MASKS``
fits: the tests enumerate all placements.  Shorter items, and other limits, get a seed as long as
the run of equal tokens that must then exist.  Such light seeds also meet by chance; only hits with
enough equal tokens near them are compared along their diagonal.

The benchmark's seeds are sorted in Spark tasks and written to the shared folder in blocks of bounded size.  Each
task maps them one after the other for its batch of documents, so documents are read once, the
driver holds only the blocks' names, and memory holds a batch and one block's pages.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import held, local_path, lower_words, raw_text, rows_kept, scratch

MASKS = ("111011", "110111", "11111", "101111", "111101", "11001011")
HITS_AT_ONCE = 1 << 14
MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(32)], np.uint64)
FILTER_BITS = 20
CACHE_WORDS = 300_000
BLOCKS_OPEN = 64


def token_hashes(texts: list[list[bytes]]) -> list[np.ndarray]:
    """64-bit hash of every token; the hashes of words are kept, the store is emptied when full."""
    import xxhash

    known = held("words", lambda: {"hashes": {}, "banks": {}})["hashes"]
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in set().union(*texts).difference(known) if texts else ():
        known[w] = xxhash.xxh3_64_intdigest(w)
    return [np.fromiter(map(known.__getitem__, t), np.uint64, len(t)) for t in texts]


def mixed(h: np.ndarray, span: int, done: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each place in a mask, what a token there adds to a seed; all masks share these."""
    out = done or []
    out += [(h[j:] ^ MIX[j]) * MIX[31 - j] for j in range(len(out), min(span, len(h)))]
    return out


def seeds(parts: list[np.ndarray], mask: str) -> np.ndarray:
    """The seed at every position of a token-hash array, of which ``parts`` are the mixed hashes."""
    if len(mask) > len(parts):
        return np.empty(0, np.uint64)
    n = len(parts[len(mask) - 1])
    out = np.zeros(n, np.uint64)
    for j, keep in enumerate(mask):
        if keep == "1":
            out += parts[j][:n]
    return out ^ (out >> np.uint64(29))


def sure_run(sizes: Iterable[int], share: float) -> int:
    """The equal tokens in a row that every stretch of these sizes has, if ``share`` of it is equal."""
    runs = []
    for n in sizes:
        equal = math.ceil(share * n - 1e-9)
        runs.append(-(-equal // (n - equal + 1)))
    return max(1, min(runs))


def masks_of(size: int, masks: tuple[str, ...] | None, least: int, share: float) -> tuple[str, ...]:
    """Masks of which one fits every overlap with an item of ``size`` tokens."""
    if masks is not None:
        return masks
    if min(size, least) >= 12 and share >= 0.75:
        return MASKS
    # an overlap is the whole of a short item; a longer one holds one of fewer than twice ``least`` tokens
    return ("1" * min(len(MIX), sure_run([size] if size < least else range(least, 2 * least), share)),)


class Seeds:
    """The seeds of a document by mask, made once for all blocks."""

    def __init__(self, doc: np.ndarray):
        self.doc, self.parts, self.made = doc, [], {}

    def __getitem__(self, mask: str) -> np.ndarray:
        if mask not in self.made:
            self.parts = mixed(self.doc, len(mask), self.parts)
            self.made[mask] = seeds(self.parts, mask)
        return self.made[mask]


class Bank:
    """The seeds of a block of benchmark items (id, text), sorted for look-up.

    ``flat`` holds the hashes of all items in a row, each followed by a gap as wide as a hit's surroundings;
    ``real`` marks what is no gap.
    """

    def __init__(self, items: list[tuple[object, bytes]], masks: tuple[str, ...] | None, least: int, share: float, kind: pa.DataType | None = None):
        tokens = token_hashes([lower_words(t) for _, t in items])
        sizes, reach = np.array([len(t) for t in tokens], np.int64), 2 * least - 1
        flat = np.zeros(int((sizes + reach).sum()) + reach, np.uint64)
        real = np.zeros(len(flat), bool)
        of_mask: dict[str, list] = {}
        at = reach
        for k, t in enumerate(tokens):
            flat[at : at + len(t)], real[at : at + len(t)] = t, True
            at += len(t) + reach
            for mask in masks_of(len(t), masks, least, share) if len(t) else ():
                if len(s := seeds(mixed(t, len(mask)), mask)):
                    of_mask.setdefault(mask, []).append((s, np.full(len(s), k, np.int32), np.arange(len(s), dtype=np.int32)))
        self._set(pa.array([i for i, _ in items], kind), sizes, flat, real, [(mask, *self._sorted(parts)) for mask, parts in of_mask.items()], least, share)

    def _set(self, ids: pa.Array, sizes: np.ndarray, flat: np.ndarray, real: np.ndarray, tables: list[tuple], least: int, share: float) -> None:
        self.ids, self.sizes, self.flat, self.real, self.masks, self.least, self.share = ids, sizes, flat, real, tables, least, share
        self.reach = 2 * least - 1
        self.enough = np.ceil(share * np.minimum(sizes, least) - 1e-9).astype(np.int64)
        self.starts = self.reach + np.cumsum(sizes + self.reach) - sizes - self.reach
        self.tokens = [flat[a : a + n] for a, n in zip(self.starts.tolist(), sizes.tolist(), strict=True)]
        self.span = max((len(t[0]) for t in tables), default=0)

    @staticmethod
    def _sorted(parts: list) -> tuple:
        """Seeds in order, their items and places, and which low bits occur at all."""
        s, k, p = (np.concatenate([x[i] for x in parts]) for i in range(3))
        order = np.argsort(s, kind="stable")
        quick = np.zeros(1 << FILTER_BITS, bool)
        quick[(s & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        return s[order], k[order], p[order], quick

    def save(self, folder: str) -> None:
        """Complete or absent."""
        own = f"{folder}.{os.getpid()}"
        os.makedirs(own)
        for name in ("sizes", "flat", "real"):
            np.save(f"{own}/{name}.npy", getattr(self, name))
        for i, (_, *columns) in enumerate(self.masks):
            for j, column in enumerate(columns):
                np.save(f"{own}/mask-{i}-{j}.npy", column)
        with pa.OSFile(f"{own}/ids.arrow", "wb") as f, pa.ipc.new_file(f, pa.schema([("id", self.ids.type)])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([self.ids], names=["id"]))
        with open(f"{own}/bank.json", "w") as f:
            json.dump({"masks": [t[0] for t in self.masks], "least": self.least, "share": self.share}, f)
        os.replace(own, folder)

    @classmethod
    def load(cls, folder: str) -> Bank:
        """The saved bank, its arrays mapped."""
        with open(f"{folder}/bank.json") as f:
            head = json.load(f)
        mapped = lambda name: np.load(f"{folder}/{name}.npy", mmap_mode="r").view(np.ndarray)
        with pa.OSFile(f"{folder}/ids.arrow", "rb") as f:
            ids = pa.ipc.open_file(f).read_all().column("id").combine_chunks()
        tables = [(mask, *(mapped(f"mask-{i}-{j}") for j in range(4))) for i, mask in enumerate(head["masks"])]
        bank = cls.__new__(cls)
        bank._set(ids, mapped("sizes"), mapped("flat"), mapped("real"), tables, head["least"], head["share"])
        return bank

    def matches(self, doc: np.ndarray, own: Seeds | None = None) -> list[tuple[int, int, int, int]]:
        """(item, first position, aligned tokens, equal tokens) of each verified overlap; the best of an item."""
        near, best, own = set(), {}, own or Seeds(doc)
        waiting, count = [], 0
        for mask, s, k, p, quick in self.masks:
            d = own[mask]
            at = np.flatnonzero(quick[(d & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(s, d[at], "left"), np.searchsorted(s, d[at], "right")
            met = hi > lo
            at, lo, hits = at[met], lo[met], (hi - lo)[met]
            done, ends = 0, np.cumsum(hits)
            while done < len(at):  # some hits at a time: a phrase of both texts may meet very often
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS_AT_ONCE, "right")))
                n = hits[done:upto]
                which = np.repeat(lo[done:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                here = np.repeat(at[done:upto], n)
                waiting.append(np.stack([k[which].astype(np.int64), here - p[which], here]))
                count, done = count + len(which), upto
                if count > HITS_AT_ONCE:
                    near |= self._close(doc, waiting)
                    waiting, count = [], 0
        if waiting:
            near |= self._close(doc, waiting)
        for item, diagonal in sorted(near):
            found = overlap(doc, self.tokens[item], diagonal, self.least, self.share)
            if found and found[2] > best.get(item, (0, 0, 0))[2]:
                best[item] = found
        return [(item, *x) for item, x in best.items()]

    def _close(self, doc: np.ndarray, hits: list[np.ndarray]) -> set[tuple[int, int]]:
        """(item, diagonal) of the hits with as many equal tokens around them as the shortest overlap has.

        An overlap of under twice ``least`` tokens that holds a hit lies within ``reach`` of it.
        """
        near, around = set(), np.arange(-self.reach, self.reach + self.span)
        hits = np.concatenate(hits, axis=1)
        for i in range(0, hits.shape[1], HITS_AT_ONCE):
            item, diagonal, at = hits[:, i : i + HITS_AT_ONCE]
            a = at[:, None] + around
            b = np.clip(a + (self.starts[item] - diagonal)[:, None], 0, len(self.flat) - 1)
            same = (doc[np.clip(a, 0, len(doc) - 1)] == self.flat[b]) & self.real[b] & (a >= 0) & (a < len(doc))
            close = same.sum(1) >= self.enough[item]
            near.update(zip(item[close].tolist(), diagonal[close].tolist(), strict=True))
        return near


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, least: int, share: float) -> tuple[int, int, int] | None:
    """The longest stretch of the diagonal with at least ``share`` equal tokens, if it is long enough.

    Long enough: ``least`` tokens, or the whole item where that is shorter.
    """
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = item[a:b] == doc[a + diagonal : b + diagonal]
    # a stretch [i, j) qualifies if prefix[j] - prefix[i] >= 0, prefix counting equal - share
    prefix = np.concatenate([[0.0], np.cumsum(same - share)])
    low = np.minimum.accumulate(prefix)  # non-increasing: the first i with prefix[i] <= prefix[j]
    first = np.searchsorted(-low, -prefix - 1e-9, "left")
    size = np.arange(len(prefix)) - first
    j = int(np.argmax(size))
    i, n = int(first[j]), int(size[j])
    if n < min(least, len(item)) or n == 0:
        return None
    return a + diagonal + i, n, int(same[i:j].sum())


def banks(benchmark: DataFrame, item_col: str, item_text_col: str, masks: tuple[str, ...] | None, least: int, share: float, block_items: int, block_bytes: int) -> list[str]:
    """The folders of the benchmark's blocks, each of about ``block_items`` items or ``block_bytes`` bytes at most."""
    items = benchmark.select(F.col(item_col).alias("id"), raw_text(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(size["bytes"] or 0) // block_bytes), -(-size["n"] // block_items))
    folder = local_path(scratch(benchmark.sparkSession, "benchmark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, t) for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if rows:
            os.makedirs(folder, exist_ok=True)
            name = f"{folder}/block-{os.urandom(8).hex()}"
            Bank(rows, masks, least, share, kind).save(name)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    kind = to_arrow_type(items.schema["id"].dataType)
    return sorted(r["name"] for r in items.repartition(blocks).mapInArrow(run, "name string").collect())


def opened(name: str) -> Bank:
    """A block, kept open for the next batch or document."""
    known = held("words", lambda: {"hashes": {}, "banks": {}})["banks"]
    if name not in known:
        if len(known) >= BLOCKS_OPEN:
            known.pop(next(iter(known)))
        known[name] = Bank.load(name)
    return known[name]


def contaminated(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] | None = None, least: int = 13, share: float = 0.75, block_items: int = 20_000, block_bytes: int = 4 << 20) -> DataFrame:
    """A row per document and benchmark item that it overlaps: ids, ``position``, ``n_tokens``, ``n_equal``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  An overlap is an aligned
    stretch of ``least`` tokens (the whole item if shorter) of which ``share`` are equal; an item is
    reported once per document, with its longest stretch.  Every position of every text is searched,
    and ``masks`` None, the default, misses no overlap.  Documents are read once, against blocks of at
    most about ``block_items`` items and ``block_bytes`` bytes.  Null and empty texts and items overlap
    nothing; null ids stay; repeated documents and items each have their rows; other columns are not read;
    empty tables give no rows.
    """
    id_type, item_type = documents.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"{id_col} {id_type.simpleString()}, {item_col} {item_type.simpleString()}, position long, n_tokens long, n_equal long"
    names = banks(benchmark, item_col, item_text_col, masks, least, share, block_items, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                docs = [(t, Seeds(t)) for t in token_hashes([lower_words(raw.as_py()) for raw in batch.column(1)])]
                for name in names:
                    bank = opened(name)
                    found = [(i, *m) for i, doc in enumerate(docs) for m in bank.matches(*doc)]
                    row, item, *numbers = np.asarray(found, np.int64).reshape(-1, 5).T
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), bank.ids.take(pa.array(item)), *map(pa.array, numbers)], names=[id_col, item_col, "position", "n_tokens", "n_equal"])

    return documents.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text")).mapInArrow(run, schema)


def clean(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] | None = None, least: int = 13, share: float = 0.75, block_items: int = 20_000, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``documents`` that ``contaminated`` has no row for, with all their columns.

    Null ids, repeated rows and columns of any name stay as they are; an empty benchmark rejects nothing.
    """
    names = banks(benchmark, item_col, item_text_col, masks, least, share, block_items, block_bytes)

    def judge():
        def accepts(raws: list[bytes]) -> np.ndarray:
            docs, good = [(t, Seeds(t)) for t in token_hashes([lower_words(raw) for raw in raws])], np.ones(len(raws), bool)
            for name in names:
                bank = opened(name)
                for i in np.flatnonzero(good):
                    good[i] = not bank.matches(*docs[i])
            return good

        return accepts

    return rows_kept(documents, text_col, judge)
