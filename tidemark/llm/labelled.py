"""A bounded, repeatable sample of labelled texts, for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_text, written


def labelled_sample(documents: DataFrame, labels: DataFrame, label_col: str, learn: Column, *, per_class: dict[int, int], max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """At most ``per_class[label]`` texts with each label, and how many ids there are with each.

    Only rows for which ``learn`` holds (a condition on the id) are used; an id with different labels is
    left out, a repeated label counts once, null ids and null labels don't count.  Candidates are the
    ids with the smallest hashes, twice as many as asked for; texts that are null, empty or
    longer than ``max_bytes`` bytes are left out, and of several texts with one id the least is taken.  The
    order is that of (hash of the id, id), so the same rows give the same sample however they are laid
    out.  ``documents`` is read once; the driver holds at most sum(per_class) * max_bytes bytes.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(learn & F.col("id").isNotNull() & F.col("label").isin(list(per_class)))
    rows = rows.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label")
    totals = dict.fromkeys(per_class, 0) | {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64("id")
    chosen = None
    for label, most in per_class.items():
        part = rows.where(F.col("label") == label).orderBy(rank, "id").limit(2 * most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text")).where(F.octet_length("text").between(1, max_bytes))
    # an id may have any number of rows: they meet in a partial aggregate, not in a list
    joined = written(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "sample")
    best = None
    for label, most in per_class.items():
        part = joined.where(F.col("label") == label).orderBy(rank, "id").limit(most).select("text", "label")
        best = part if best is None else best.unionByName(part)
    return [(bytes(r["text"]), r["label"]) for r in best.collect()], totals
