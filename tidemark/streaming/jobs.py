"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import sketch


def tail_histogram(values: DataFrame, value: str) -> DataFrame:
    """The mergeable histogram as a running aggregate (update or complete mode): counts only ever add."""
    return sketch.histogram(values, value)


def shard_rows(rows: DataFrame, key: str, event_time: str, late: str) -> DataFrame:
    """Rows of arriving shards, each index once within the watermark."""
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, event_time: str, width: str, late: str) -> DataFrame:
    w = events.withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def lease_machine(events: DataFrame, allowed: list[tuple[str | None, str]], *, key: str = "user_id", state: str = "state", expires_ms: int = 3_600_000) -> DataFrame:
    """Latest state per key, refused transitions counted, and a lease that hears nothing for ``expires_ms`` reaped.

    ``events``: key, event_id, state.  Within a batch a key's events are taken in order of their ids.
    """
    legal = set(allowed)
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            was, refused = held.get
            held.remove()
            yield pd.DataFrame([(k[0], was, refused, True)], columns=[key, "state", "refused", "expired"])
            return
        was, refused = held.get if held.exists else ("", 0)
        for now in pd.concat(list(batches)).sort_values("event_id")[state]:
            if (was or None, now) in legal:
                was = now
            else:
                refused += 1
        held.update((was, refused))
        held.setTimeoutDuration(expires_ms)
        yield pd.DataFrame([(k[0], was, refused, False)], columns=[key, "state", "refused", "expired"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, refused long, expired boolean", "state string, refused long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def ladder(shards: DataFrame, folder: str, *, index: str = "idx", value: str = "m", weight: str = "n") -> DataStreamWriter:
    """Shards of scored contexts as they arrive, and after each batch the figures over all so far.

    A batch's rows go to ``folder/rows/batch=<id>``, what they add up to to ``folder/sums/batch=<id>``, and the checkpoint
    (``contexts``, ``positions``, ``token_mean``, ``macro_mean``) to ``folder/ladder/batch=<id>``.  An index that was there
    before, in this batch or an earlier one, refuses the batch: the stream fails and nothing of it is written.  Of earlier rows only
    indices within the batch's range are looked at, which the files' statistics narrow down, and figures come from the sums, a row a batch.  A
    batch that is replayed after a failure overwrites what it left.  Start the writer with a checkpoint location of its own.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, f"{folder}/rows"
        schema = f"{batch.schema.toDDL()}, batch long"
        own = batch.withColumn("batch", F.lit(number).cast("long"))
        try:
            before = spark.read.schema(schema).parquet(rows).where(F.col("batch") != number)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = spark.createDataFrame([], schema)
        ends = own.agg(F.min(index).alias("low"), F.max(index).alias("high")).first()
        before = before.where(F.col(index).between(ends["low"], ends["high"]))
        twice = own.groupBy(index).count().where("count > 1").select(index).unionByName(own.select(index).join(before.select(index), index, "left_semi"))
        found = twice.distinct().orderBy(index).limit(8).collect()
        if found:
            raise ValueError(f"contexts arrive twice: {[r[0] for r in found]}")
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")
        own.agg(F.count("*").alias("contexts"), F.sum(weight).alias("positions"), F.sum(F.col(value) * F.col(weight)).alias("weighted"), F.sum(value).alias("plain")).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")
        every = spark.read.parquet(f"{folder}/sums").where(F.col("batch") <= number).agg(*(F.sum(c).alias(c) for c in ("contexts", "positions", "weighted", "plain")))
        every.select("contexts", "positions", (F.col("weighted") / F.col("positions")).alias("token_mean"), (F.col("plain") / F.col("contexts")).alias("macro_mean")).write.mode("overwrite").parquet(f"{folder}/ladder/batch={number}")

    return shards.writeStream.foreachBatch(add)
