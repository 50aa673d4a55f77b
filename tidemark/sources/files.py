"""Readers and writers of the formats around a capture, on Spark's own file access.

Binary files come through ``binaryFile``, so any path that Spark can read will do.
"""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.codecs import bf16_to_float32

NPY_TYPES = ("|i1", "<i2", "<u2", "<i4", "<u4", "<i8")
TENSOR_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": None}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped, a malformed line or a number that isn't finite fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)


def write_canonical_jsonl(d: DataFrame, path: str, id_col: str = "id") -> None:
    """One row a line, keys sorted, rows in order of their ids over the files of the folder."""
    cols = sorted(d.columns)
    d.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)


def unique_object(text: str) -> dict:
    """JSON whose objects may not name a key twice."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("an object names a key twice")
        return out

    def refuse(token: str) -> float:
        raise ValueError(f"{token} isn't a number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)


def read_unique_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_jsonl``, and a line in which any object names a key twice fails the read."""

    @F.pandas_udf(T.StringType())
    def checked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for line in batch:
                unique_object(line)
            yield batch

    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json(checked("value"), schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def npy_values(raw: bytes) -> np.ndarray:
    """A one-dimensional integer array in C order; anything else is refused."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    wide = raw[6] > 1
    (size,) = struct.unpack_from("<I" if wide else "<H", raw, 8)
    start = (12 if wide else 10) + size
    head = ast.literal_eval(raw[start - size : start].decode("latin-1"))
    if head["descr"] not in NPY_TYPES or head["fortran_order"] or len(head["shape"]) != 1:
        raise ValueError(f"refused npy header {head}")
    values = np.frombuffer(raw, head["descr"], offset=start)
    if len(values) != head["shape"][0]:
        raise ValueError("the npy file is cut short")
    return values.astype(np.int64)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``tokens``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "tokens": [npy_values(bytes(c)) for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, tokens array<long>")


def safetensors_header(raw: bytes) -> tuple[dict, int]:
    (n,) = struct.unpack_from("<Q", raw)
    if 8 + n > len(raw):
        raise ValueError("the header is longer than the file")
    head = unique_object(raw[8 : 8 + n].decode())
    head.pop("__metadata__", None)
    return head, 8 + n


def safetensors_rows(raw: bytes, key: str) -> np.ndarray:
    """One two-dimensional tensor in float32 or float64; bf16 is widened exactly."""
    head, base = safetensors_header(raw)
    if key not in head:
        raise ValueError(f"no tensor {key}")
    t = head[key]
    if t["dtype"] not in TENSOR_TYPES or len(t["shape"]) != 2:
        raise ValueError(f"refused tensor {t}")
    a, b = t["data_offsets"]
    kind = TENSOR_TYPES[t["dtype"]]
    flat = bf16_to_float32(raw[base + a : base + b]) if kind is None else np.frombuffer(raw[base + a : base + b], kind)
    if flat.size != t["shape"][0] * t["shape"][1]:
        raise ValueError("shape and size disagree")
    return flat.reshape(t["shape"])


def read_safetensors(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``path``, ``position``, ``vec``: a row per row of the tensor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                m = safetensors_rows(bytes(c), key).astype(np.float64)
                yield pd.DataFrame({"path": p, "position": np.arange(len(m)), "vec": list(m)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, position long, vec array<double>")


def gguf_header(raw: bytes) -> dict:
    """Version, number of tensors and of metadata entries of a GGUF container."""
    magic, version, tensors, entries = struct.unpack_from("<4sIQQ", raw)
    if magic != b"GGUF" or version not in (2, 3):
        raise ValueError("not a GGUF container of a known version")
    return {"version": version, "tensors": tensors, "entries": entries}


def write_checksums(files: DataFrame, path: str) -> None:
    """``files``: path, content.  Lines ``digest  path`` in order of the path."""
    files.select(F.concat(F.sha2("content", 256), F.lit("  "), F.col("path")).alias("value"), "path").repartitionByRange(F.col("path")).sortWithinPartitions("path").select("value").write.mode("overwrite").text(path)


def verify_checksums(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """``path``, ``problem``: declared and missing, there and undeclared, or of another digest."""
    said = spark.read.text(path).select(F.substring("value", 1, 64).alias("declared"), F.expr("substring(value, 67)").alias("path"))
    seen = files.select("path", F.sha2("content", 256).alias("seen"))
    problem = F.when(F.col("seen").isNull(), "missing").when(F.col("declared").isNull(), "undeclared").when(F.col("seen") != F.col("declared"), "mismatch")
    return said.join(seen, "path", "full_outer").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def read_corpus_tree(spark: SparkSession, root: str) -> DataFrame:
    """``<stratum>/*.txt`` as ``stratum``, ``stem``, ``text``; malformed UTF-8 is replaced."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    return d.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.txt$", 1).alias("stratum"), F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("stem"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
