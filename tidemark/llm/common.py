"""What the operators share: table access, the shared scratch folder, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(raw: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text.

    ``bytes.split()`` without arguments splits on exactly these six characters.
    """
    return raw.split() if raw else []


def lower_words(raw: bytes | None) -> list[bytes]:
    """As ``words``, with A-Z (and nothing else) in lower case."""
    return raw.lower().split() if raw else []


def raw_text(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null reads as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id is written as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session gets a folder of its own; a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def local_path(url: str) -> str:
    """The shared folder as the path that workers open; memory maps need a file system that is mounted."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"files are mapped into memory: spark.checkpoint.dir must be a mounted shared folder, not {url}")
    return url


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict[str, object] = {}


def held(kind: str, make: Callable[[], object]) -> object:
    """A store that a Python worker keeps from task to task; it gives up any other kind it holds."""
    if kind not in _held:
        _held.clear()
        _held[kind] = make()
    return _held[kind]


def release() -> None:
    """Give up what an earlier operator's tasks left in this worker."""
    _held.clear()


def task_id() -> int:
    """The partition of the running task; the same again when a task is retried."""
    return TaskContext.get().partitionId()


def rows_kept(df: DataFrame, text_col: str, judge: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text the judge accepts.

    ``judge`` is called once in a task and returns a function from texts (null: empty) to a mask.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = judge()
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                raws = [raw.as_py() or b"" for raw in batch.column(at).cast(pa.binary())]
                yield batch.filter(pa.array(np.asarray(accepts(raws), bool)))

    return df.mapInArrow(run, df.schema)
