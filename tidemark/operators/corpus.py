"""Corpus operators: contamination against calibration text, panels, partitions, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidemark.functions import lexical as L
from tidemark.functions import text as T

SENT_KEYS = 4_000_000  # a calibration text's keys are sent to the tasks if there are no more: 32 MB


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores where the scan has fewer parts than two a core: a small input, often of one row group."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores, "doc_id") if docs.rdd.getNumPartitions() < 2 * cores else docs


def gram_set(d: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """``key``: each n-gram of the texts once."""
    return d.select(F.explode(L.keys_of(F.col(text_col), n, distinct=True)).alias("key")).distinct()


def sent(keys: DataFrame, most: int) -> np.ndarray | None:
    """The keys in order, or None if there are more than ``most``."""
    found = keys.limit(most + 1).toArrow().column(0).to_numpy()
    return np.sort(found) if len(found) <= most else None


def inside(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def calibration_overlap(docs: DataFrame, calibration: DataFrame, n: int, most: float = 0.05, sent_keys: int = SENT_KEYS) -> DataFrame:
    """Distinct n-grams shared with the calibration text.

    A document with fewer than ``n`` tokens can't be scanned: it is excluded with a reason, its
    fraction is null and never 0.  Calibration keys are sent to the tasks if there are at most ``sent_keys``, and nothing
    is shuffled; more are joined.
    """
    keys = gram_set(calibration, n)
    known = sent(keys, sent_keys)
    if known is not None:

        @F.pandas_udf(S.StructType().add("distinct_ngrams", "long").add("shared_ngrams", "long"))
        def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in L.slices(batches):
                own = [np.unique(L.gram_keys(L.digests(L.word_tokens(t)), n)) for t in batch]
                yield pd.DataFrame({"distinct_ngrams": [len(k) for k in own], "shared_ngrams": [inside(k, known).sum() for k in own]}, dtype=np.int64)

        d = spread(docs.select("doc_id", "text")).select("doc_id", counts("text").alias("c")).select("doc_id", "c.*")
    else:
        long = docs.select("doc_id", F.explode_outer(L.keys_of(F.col("text"), n, distinct=True)).alias("key"))
        d = long.join(keys.withColumn("hit", F.lit(1)), "key", "left").groupBy("doc_id").agg(F.count("key").alias("distinct_ngrams"), F.count("hit").alias("shared_ngrams"))
    fraction = F.when(F.col("distinct_ngrams") > 0, F.round(F.col("shared_ngrams") / F.col("distinct_ngrams"), 6))
    reason = F.when(F.col("distinct_ngrams") == 0, "unscannable").when(fraction > most, "overlap")
    return d.select("doc_id", "distinct_ngrams", "shared_ngrams", fraction.alias("fraction"), reason.alias("excluded"))


def hits(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``doc_id``, ``pos`` (from 0), ``hit`` (0 or 1) for every n-gram position."""
    long = docs.select("doc_id", F.posexplode(L.keys_of(F.col("text"), n)).alias("pos", "key"))
    return long.join(keys.withColumn("hit", F.lit(1)), "key", "left").select("doc_id", "pos", F.coalesce("hit", F.lit(0)).alias("hit"))


def longest_runs(h: DataFrame) -> DataFrame:
    """The hits of each document, and the longest run of consecutive ones."""
    only = h.where("hit = 1").withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return only.groupBy("doc_id", "island").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("hits"), F.max("n").alias("longest"))


def window_containment(h: DataFrame, n: int, window: int, stride: int) -> DataFrame:
    """The largest share of hits in any window of ``window`` tokens, by prefix sums.

    Windows start at every multiple of ``stride`` and once so that one ends with the text.
    """
    width = window - n + 1
    sums = h.withColumn("upto", F.sum("hit").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).select("doc_id", "pos", "upto")
    tokens = h.groupBy("doc_id").agg((F.max("pos") + n).alias("nt"))
    last = F.greatest(F.lit(0), F.col("nt") - window)
    starts = tokens.select("doc_id", "nt", F.explode(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))).alias("start"))
    ends = starts.withColumn("stop", F.least(F.col("start") + width, F.col("nt") - (n - 1)) - 1).withColumn("before", F.col("start") - 1)
    a = ends.join(sums.select("doc_id", F.col("pos").alias("stop"), F.col("upto").alias("to")), ["doc_id", "stop"])
    b = a.join(sums.select("doc_id", F.col("pos").alias("before"), F.col("upto").alias("from")), ["doc_id", "before"], "left")
    share = (F.col("to") - F.coalesce("from", F.lit(0))) / (F.col("stop") - F.col("start") + 1)
    return b.select("doc_id", share.alias("share")).groupBy("doc_id").agg(F.max("share").alias("containment"))


def near_duplicate_audit(docs: DataFrame, calibration: DataFrame, *, exact: int = 12, near: int = 5, window: int = 50, stride: int = 25, sent_keys: int = SENT_KEYS) -> DataFrame:
    """How much of each document stands in the calibration text: its ``words``, ``exact_hits`` (positions of shared
    ``exact``-grams), ``longest_run_words`` and ``containment``, the largest share of shared ``near``-grams in a window.

    Calibration keys are sent to the tasks if there are at most ``sent_keys``: a document is then judged where it is
    read.  Else positions are joined to them and summed in windows.
    """
    sets = [gram_set(calibration, n) for n in (exact, near)]
    known = [sent(k, sent_keys) for k in sets]
    if any(k is None for k in known):
        runs, close = longest_runs(hits(docs, sets[0], exact)), window_containment(hits(docs, sets[1], near), near, window, stride)
        d = docs.select("doc_id", F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0)).cast("long").alias("words")).join(runs, "doc_id", "left").join(close, "doc_id", "left")
        longest = F.when(F.col("longest") > 0, F.col("longest") + exact - 1).otherwise(0)
        return d.select("doc_id", "words", F.coalesce("hits", F.lit(0)).alias("exact_hits"), longest.alias("longest_run_words"), F.coalesce("containment", F.lit(0.0)).alias("containment"))

    def judged(text: str | None) -> tuple[int, int, int, float]:
        tokens = L.digests(L.word_tokens(text))
        whole = inside(L.gram_keys(tokens, exact), known[0])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], whole, [0]])))
        longest = int((edges[1::2] - edges[::2]).max(initial=0))
        sums = np.concatenate([[0], np.cumsum(inside(L.gram_keys(tokens, near), known[1]))])
        containment = 0.0
        if len(sums) > 1:
            start = np.append(np.arange(0, max(0, len(tokens) - window) + 1, stride), max(0, len(tokens) - window))
            stop = np.minimum(start + window - near + 1, len(sums) - 1)
            containment = float(((sums[stop] - sums[start]) / (stop - start)).max())
        return len(tokens), int(whole.sum()), longest and longest + exact - 1, containment

    @F.pandas_udf(S.StructType().add("words", "long").add("exact_hits", "long").add("longest_run_words", "long").add("containment", "double"))
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in L.slices(batches):
            yield pd.DataFrame([judged(t) for t in batch], columns=["words", "exact_hits", "longest_run_words", "containment"])

    return spread(docs.select("doc_id", "text")).select("doc_id", judge("text").alias("j")).select("doc_id", "j.*")


def token_windows(docs: DataFrame, size: int) -> DataFrame:
    """Adjacent windows of ``size`` lexical tokens; what is left at a text's end is dropped, as a window is a unit."""
    return spread(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", F.posexplode(L.windows_of(F.col("text"), size)).alias("window_index", "text"))


def round_robin(windows: DataFrame, stratum: str, quota: int, eligible: Column | None = None) -> DataFrame:
    """One window of each document per round, until the stratum's quota of ``eligible`` ones (default: all).

    A window that isn't eligible uses up its document's turn and is not replaced in that round.  A row's place
    in its stratum is its position in (round, document) order among the eligible; only the first ``quota`` are
    kept, so Spark limits each group before the rows are gathered.
    """
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("window_index", "doc_id"))
    return (windows if eligible is None else windows.where(eligible)).withColumn("place", place).where(F.col("place") <= quota)


def take_until(clusters: DataFrame, stratum: str, target: int) -> DataFrame:
    """Whole clusters in order of their hash while fewer than ``target`` rows are taken; the last one stays out."""
    w = Window.partitionBy(stratum).orderBy("order_key")
    taken = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(w) == F.count("*").over(Window.partitionBy(stratum))
    return clusters.withColumn("partition", F.when((taken < target) & ~last, "selection").otherwise("analysis"))


def first_occurrence(d: DataFrame, digest: Column, order: str) -> DataFrame:
    """The first row of each digest in ``order``, by an aggregate that combines before the shuffle."""
    return d.groupBy(digest.alias("digest")).agg(F.min(order).alias(order), F.count("*").alias("copies"))
