"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``radius`` bits are found by cutting the 64 bits into partitions with
thresholds t_1..t_m that sum to radius - m + 1: two fingerprints that differ in at most
``radius`` bits differ in at most t_i bits of some partition i (t_i = -1: the partition is
not probed).  Correlated bits go into one partition, and a dynamic program over
estimated candidate counts allots unequal widths and thresholds.  Fingerprints are probed by
partition value (every value within t_i bits) and verified on all 64 bits.

A partition value that more than ``crowd`` different fingerprints share is not compared pair
by pair.  There each fingerprint is probed by all the 64-bit values within ceil(radius / 2) bits:
two fingerprints within ``radius`` meet at some such value, and those that meet are within
2 * ceil(radius / 2), so a star per value links exactly the right ones without all pairs.
That is the radius if it is even.  If it is odd, the star's centre is a member within radius // 2
of the value: two fingerprints within ``radius`` also meet where one of them is that close.
The work is linear in the fingerprints however many of them crowd together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_words, raw_text, release, written

BITS = 64


def fingerprint(tokens: list[bytes], width: int, seed: int) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no tokens: 0."""
    import xxhash

    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= width:
        return digest(b" ".join(tokens), seed)
    text, ends, at = b" ".join(tokens), [], -1
    for w in tokens:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(tokens) - width])]
    n = len(starts)
    total = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], ends[i + width - 1 :])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, *, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` (the 64 bits as a signed long) of every document."""
    schema = f"id {documents.schema[id_col].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(lower_words(t.as_py()), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return documents.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text")).mapInArrow(run, schema)


# --- the plan -------------------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, how many have both set: 64 x 64 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 14):
                bits = np.unpackbits(fp[i : i + (1 << 14)].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(both.ravel(), n))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def order_bits(n: int, both: np.ndarray) -> list[int]:
    """The bits in a chain in which each follows the one that it correlates with most."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    chain, rest = [0], set(range(1, BITS))
    while rest:
        best = max(sorted(rest), key=lambda b: r[chain[-1], b])
        chain.append(best), rest.discard(best)
    return chain


def allot(n: int, both: np.ndarray, chain: list[int], radius: int, most: int = 4) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, by dynamic programming on estimated candidates.

    A partition's estimate is n^2 / 2 times the chance that two fingerprints come within its
    threshold, with bits taken in pairs of neighbours in the chain (their joint distribution
    gives what correlation costs), plus the n * (values probed) probes.  Widths are multiples of 4.
    """
    p = np.diag(both) / max(n, 1)
    agree1 = p * p + (1 - p) ** 2
    given = np.empty(BITS)  # chance to agree in a bit, given agreement in the one before
    for k, b in enumerate(chain):
        if k == 0:
            given[k] = agree1[b]
            continue
        a = chain[k - 1]
        j11 = both[a, b] / max(n, 1)
        cells = np.array([j11, p[a] - j11, p[b] - j11, 1 - p[a] - p[b] + j11])
        given[k] = (cells**2).sum() / max(agree1[a], 1e-9)
    given = np.clip(given, 0.5, 1.0)

    def cost(a: int, b: int, t: int) -> float:
        if t < 0:
            return 0.0
        near = np.zeros(t + 1)
        near[0] = 1.0
        for q in given[a:b]:
            near = near * q + np.append(0.0, near[:-1]) * (1 - q)
        return n * n / 2 * near.sum() + n * sum(comb(b - a, k) for k in range(t + 1))

    best = None
    for m in range(1, most + 1):
        total = radius - m + 1
        # state: (end, thresholds so far) -> (cost, cuts)
        states = {(0, 0): (0.0, [])}
        for i in range(m):
            after: dict = {}
            for (at, used), (c, cuts) in states.items():
                ends = [BITS] if i == m - 1 else range(at + 4, BITS - 4 * (m - 1 - i) + 1, 4)
                for end in ends:
                    for t in range(-1, radius + 1):
                        if i == m - 1 and used + t != total:
                            continue
                        new = c + cost(at, end, t)
                        if (k := (end, used + t)) not in after or new < after[k][0]:
                            after[k] = (new, [*cuts, (at, end, t)])
            states = after
        for c, cuts in states.values():
            if best is None or c < best[0]:
                best = (c, cuts)
    return [(chain[a:b], t) for a, b, t in best[1] if t >= 0]


# --- probing --------------------------------------------------------------------------------


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _within(value: Column, bits: list[int], t: int) -> Column:
    """All values that differ from ``value`` in at most ``t`` of ``bits``."""
    masks = [_mask(list(c)) for k in range(t + 1) for c in combinations(bits, k)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: value.bitwiseXOR(m))


def links(distinct: DataFrame, parts: list[tuple[list[int], int]], radius: int, crowd: int) -> DataFrame:
    """``a``, ``b``: enough pairs of fingerprints within ``radius`` to connect all that are linked."""
    none = None
    keyed = none
    for k, (bits, t) in enumerate(parts):
        own = distinct.select("fp", F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("home"), F.lit(bits and t).alias("t"))
        keyed = own if keyed is none else keyed.unionByName(own)
    sizes = keyed.groupBy("part", "home").agg(F.count("*").alias("n"))
    out = none
    crowded = none
    for k, (bits, t) in enumerate(parts):
        own = keyed.where(F.col("part") == k).select("fp", "home")
        size = sizes.where(F.col("part") == k).select("home", "n")
        big = size.where(F.col("n") > crowd).select("home")
        small = size.where((F.col("n") > 1 if t == 0 else F.col("n") > 0) & (F.col("n") <= crowd)).select("home")
        kept = own.join(small, "home")
        probes = own.select(F.col("fp").alias("a"), F.explode(_within(F.col("home"), bits, t)).alias("home")) if t else kept.select(F.col("fp").alias("a"), "home")
        pairs = probes.join(kept.select(F.col("fp").alias("b"), "home"), "home")
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        pairs = pairs.where((F.col("a") != F.col("b") if t else F.col("a") < F.col("b")) & (apart <= radius)).select("a", "b")
        dense = own.join(big, "home").select("fp")
        if t:  # whoever can meet a crowded value
            dense = dense.union(own.select("fp", F.explode(_within(F.col("home"), bits, t)).alias("home")).join(big, "home").select("fp"))
        out = pairs if out is none else out.union(pairs)
        crowded = dense if crowded is none else crowded.union(dense)
    reach = (radius + 1) // 2
    met = crowded.distinct().select("fp", F.explode(_within(F.col("fp"), list(range(BITS)), reach)).alias("at"))
    stars = met.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("n > 1")
    # of a star's members only those other than its least need a link; most values have two members
    if radius % 2 == 0:
        two = stars.where("n = 2").select("a", F.col("z").alias("b"))
        more = met.join(stars.where("n > 2").select("at", "a"), "at").where("fp <> a").select("a", F.col("fp").alias("b"))
        return out.union(two).union(more)
    # odd: a value's members within radius // 2 are within radius of all its members, others maybe not of each other
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("at"))) <= radius // 2
    centres = met.groupBy("at").agg(F.min(F.when(close, F.col("fp"))).alias("a")).where("a IS NOT NULL")
    return out.union(met.join(centres, "at").where("fp <> a").select("a", F.col("fp").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root``: the least node of its component, of every node that has an edge.

    Alternates large-star and small-star rounds until nothing changes.  Each round is written to the
    shared folder; a node's neighbours meet only in aggregates, never in a list.
    """
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (now["n"], now["s"]):
            break
        state = (now["n"], now["s"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def grouped(docs: DataFrame, best: Column, radius: int, crowd: int) -> DataFrame:
    """For each ``fp`` of ``docs``: ``chosen``, the least ``best`` of its component, and ``n``, its rows."""
    distinct = written(docs.groupBy("fp").agg(F.min(best).alias("best"), F.count("*").alias("n")), "distinct")
    n, both = bit_statistics(distinct)
    parts = allot(n, both, order_bits(n, both), radius)
    edges = written(links(distinct.select("fp"), parts, radius, crowd), "links")
    groups = components(edges).join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "best")
    linked = groups.select("fp", "root").join(groups.groupBy("root").agg(F.min("best").alias("chosen")), "root").select("fp", "chosen")
    return written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("chosen", "best").alias("chosen"), "n"), "groups")


def near_duplicates(documents: DataFrame, *, radius: int = 2, width: int = 3, seed: int = 42, crowd: int = 256, frequent: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing
    bits.  Null and empty texts have fingerprint zero and link like any other; texts shorter than
    ``width`` words hash as one shingle; rows with a null id take part in linking and cannot be a
    smallest id (a component of null ids only has a null id); repeated rows stay.  Other columns are
    not read.  An empty table gives no rows.

    Rows of fingerprints that more than ``frequent`` rows share get theirs by broadcast: there are at
    most rows / ``frequent`` such fingerprints.  So no task holds all rows of one.
    """
    docs = written(fingerprints(documents, width=width, seed=seed, id_col=id_col, text_col=text_col), "fingerprints")
    groups = grouped(docs, F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")), radius, crowd)
    groups = groups.select("fp", F.col("chosen.id").alias("component_id"), "n")
    often = F.broadcast(groups.where(F.col("n") > frequent).drop("n"))
    named = docs.join(often, "fp").unionByName(docs.join(often.select("fp"), "fp", "left_anti").join(groups.where(F.col("n") <= frequent).drop("n"), "fp"))
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame, *, radius: int = 2, width: int = 3, seed: int = 42, crowd: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns.

    Links as in ``near_duplicates``.  A row with a null id is kept only where its component has no other.
    Of several rows with the smallest id, the one with the least fingerprint stays, of these the one whose
    text has the least hash, and of rows with one text the first as they were read.  An empty table gives no rows.

    Rows are numbered and written once; fingerprints and numbers decide, and texts move at most once, when
    the chosen numbers are joined back.
    """
    at = documents.columns.index(text_col)
    fp, digest, row = (f"tidemark_{x}" for x in ("fp", "digest", "row"))
    schema = T.StructType([*documents.schema.fields, T.StructField(fp, T.LongType()), T.StructField(digest, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release()
        for batch in batches:
            raws = [raw.as_py() or b"" for raw in batch.column(at).cast(pa.binary())]
            own = (np.fromiter(x, np.uint64, batch.num_rows).view(np.int64) for x in ((fingerprint(lower_words(r), width, seed) for r in raws), map(xxhash.xxh3_64_intdigest, raws)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, own)], names=[*batch.schema.names, fp, digest])

    marked = written(documents.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "marked")
    ids = marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(digest).alias("digest"), F.col(row).alias("row"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "digest", "row")
    kept = grouped(ids, order, radius, crowd).select(F.col("chosen.row").alias(row)).distinct()
    return marked.join(kept, row, "left_semi").select(*documents.columns)
