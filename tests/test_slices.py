"""Texts of an Arrow batch are worked on in slices."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import lexical as L


def test_slices_hold_a_few_texts_each_and_leave_none_out():
    out = list(L.slices(iter([pd.Series(range(150)), pd.Series([], dtype=int), pd.Series(range(150, 153))])))
    assert max(map(len, out)) <= L.TEXTS_HELD and [x for s in out for x in s] == list(range(153))


def test_what_comes_out_of_slices_stays_with_its_row(spark):
    d = spark.range(1000).coalesce(1).select("id", F.concat_ws(" ", F.lit("w"), F.col("id").cast("string"), F.lit("z")).alias("t"))
    rows = d.select("id", L.windows_of(F.col("t"), 3).alias("w"), L.window_spans(F.col("t"), 3).alias("s"), L.keys_of(F.col("t"), 3).alias("k")).collect()
    assert len(rows) == 1000
    assert all(r["w"] == [f"w {r['id']} z"] and r["s"][0]["text"] == f"w {r['id']} z" and len(r["k"]) == 1 for r in rows)
