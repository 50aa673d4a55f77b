"""Long work in parts that survives being stopped: sealed parts are checked and kept, the others computed.

``folder`` holds the output by run and part, and a manifest a run.  An entry of the manifest seals a part: digests of its
input rows, of the parameters and of the rows that were written.  Work goes through the missing parts in groups; a group's rows
are written first and its manifest after them, in one job each, so what a stopped run leaves is either sealed or not seen.

A part is kept if the last entry that seals it agrees with today's inputs and parameters, and if the
rows that are there still have the digest that was sealed.  Digests don't depend on the order of rows: they are sums of
256-bit row digests and the number of rows, so they are computed where the rows are and merged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, inputs string, params string, content string, n long, run string, at timestamp"


def digest(*columns: str) -> Column:
    """An aggregate: the digest of a group's rows in these columns, however they are ordered."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    quarter = lambda i: F.sum(F.conv(F.substring(row, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)"))
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(quarter(i).cast("string") for i in range(4))), 256)


def digests(rows: DataFrame, part: str, name: str) -> DataFrame:
    """``part``, the digest of its rows as ``name``, and ``n``."""
    return rows.groupBy(F.col(part).cast("string").alias("part")).agg(digest(*sorted(c for c in rows.columns if c != part)).alias(name), F.count("*").alias("n"))


def seal_of(params: dict[str, Any]) -> str:
    """The parameters as they are sealed: keys in order, numbers that aren't finite refused."""
    return json.dumps(params, sort_keys=True, separators=(",", ":"), allow_nan=False)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The last entry of each part; empty where nothing was sealed."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    own = F.struct(*(F.col(c) for c in ("at", "run", "inputs", "params", "content", "n")))
    return entries.groupBy("part").agg(F.max(own).alias("e")).select("part", *(f"e.{c}" for c in ("inputs", "params", "content", "n", "run", "at")))


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows that were ever written, with ``run`` and ``part``."""
    try:
        return spark.read.schema(f"{schema}, run string, part string").option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, run string, part string")


def sealed(spark: SparkSession, folder: str, schema: str, inputs: DataFrame, params: str) -> DataFrame:
    """The manifest's entries that still hold: same inputs (part, inputs), same parameters, and rows as they were sealed."""
    said = manifest(spark, folder).where(F.col("params") == params).join(inputs.select("part", "inputs"), ["part", "inputs"])
    rows = stored(spark, folder, schema)
    columns = sorted(c for c in rows.columns if c not in ("run", "part"))
    seen = rows.join(said.select("run", "part"), ["run", "part"], "left_semi").groupBy("run", "part").agg(digest(*columns).alias("seen"), F.count("*").alias("m"))
    both = said.join(seen, ["run", "part"], "left")
    return both.where((F.coalesce("m", F.lit(0)) == F.col("n")) & ((F.col("n") == 0) | (F.col("seen") == F.col("content")))).select("part", "run", "inputs", "content", "n")


def resumed(rows: DataFrame, part: str, compute: Callable[[DataFrame], DataFrame], schema: str, folder: str, params: dict[str, Any], *, groups: int = 8) -> DataFrame:
    """``compute`` of every part of ``rows``, with ``part`` and ``reused``; sealed parts of earlier calls aren't computed again.

    ``compute`` gets the rows of some parts and returns rows of ``schema`` and ``part`` (as a string); a part's result must
    depend on its own rows and on ``params`` alone.  Missing parts are computed in ``groups`` groups by a hash of their name.  A null or empty
    part is refused.  A part without rows in the result is sealed as empty.
    """
    spark, given = rows.sparkSession, seal_of(params)
    inputs = digests(rows, part, "inputs").withColumn("part", F.when(F.coalesce("part", F.lit("")) == "", F.raise_error(F.lit("a row belongs to no part"))).otherwise(F.col("part")))
    own = uuid.uuid4().hex
    kept = sealed(spark, folder, schema, inputs, given)
    kept.write.parquet(f"{folder}/kept/{own}")  # decided once: what follows writes to what it was read from
    kept = spark.read.schema(kept.schema).parquet(f"{folder}/kept/{own}")
    inputs.join(kept.select("part"), "part", "left_anti").write.parquet(f"{folder}/wanted/{own}")
    wanted = spark.read.schema(inputs.schema).parquet(f"{folder}/wanted/{own}")
    group = F.pmod(F.xxhash64("part"), F.lit(groups))
    runs = []
    for k in sorted(r[0] for r in wanted.select(group).distinct().collect()):  # ``groups`` values at most
        some, run = wanted.where(group == k), f"{own}-{k:04d}"
        mine = rows.join(some.select(F.col("part").alias("_part")), F.col(part).cast("string") == F.col("_part"), "left_semi")
        compute(mine).select(*(f.strip().split(" ")[0] for f in schema.split(",")), "part").write.partitionBy("part").parquet(f"{folder}/rows/run={run}")
        done = stored(spark, folder, schema).where(F.col("run") == run)
        columns = sorted(c for c in done.columns if c not in ("run", "part"))
        content = done.groupBy("part").agg(digest(*columns).alias("content"), F.count("*").alias("m"))
        entry = some.join(content, "part", "left").select("part", "inputs", F.lit(given).alias("params"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("m", F.lit(0)).alias("n"), F.lit(run).alias("run"), F.current_timestamp().alias("at"))
        entry.write.parquet(f"{folder}/manifest/{run}")
        runs.append(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/{run}").select("part", "run").withColumn("reused", F.lit(False)))
    use = reduce(DataFrame.unionByName, [kept.select("part", "run").withColumn("reused", F.lit(True)), *runs])
    return stored(spark, folder, schema).join(use, ["run", "part"]).drop("run")
