"""Tables that operators write once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 100_000  # rows that may be sent to every task


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def many(df: DataFrame) -> bool:
    """Whether ``df`` has more rows than may be sent to every task.  Files don't tell: ids of 5 million rows take 3 MB in them and 0.7 GB as a broadcast."""
    return df.count() > FEW


def bounded(df: DataFrame) -> DataFrame:
    """``df``, to be joined: the hint keeps Spark from a broadcast that file sizes suggest where it has many rows."""
    return df.hint("merge") if many(df) else df


def sought(target: DataFrame, rows: DataFrame, ref: Column, large: bool, few: bool) -> DataFrame:
    """``target`` (id, ...), to be joined with ``rows`` where id = ``ref``; if it is ``large`` no task gets all of it.

    For ``few`` rows those that they refer to are taken; else both sides are shuffled.
    """
    if not large:
        return target
    if not few:
        return target.hint("merge")
    return target.join(F.broadcast(rows.select(ref.alias("id")).where("id IS NOT NULL").distinct()), "id", "left_semi")
