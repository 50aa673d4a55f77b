"""Tensor containers as Spark data sources: headers are parsed once, and rows are read by seeking to them.

``register(spark)`` adds five formats, whose ``path`` is a file or a folder of files on any file system that pyarrow opens:

* ``tensor_directory``: file, tensor, dtype, shape, offset (from the file's beginning), bytes
* ``tensor_metadata``: file, key, value (as JSON)
* ``tensor_rows``: file, tensor, position, vec; a partition is a range of at most ``rows`` rows (an option) of one tensor, and
  reads just the bytes of that range.  The options ``tensors`` (names, as JSON), ``first`` and ``last`` (positions, the last
  excluded) reach the planning, so what they leave out is neither planned nor read; ``rows`` sets them.  They are options and not
  pushed filters, as Spark 4.1 keeps pushed filters of a Python source with the loaded frame: a self-join of it read
  one side with the other's filter.
* ``tensor_digests``: file, tensor, and sha256 of the file, of its data region and of the tensor's bytes
* ``kld_base``: file, chunk, position, token, scored; of a file of base log-probabilities, the panel that it carries

Files with ``.safetensors`` and ``.gguf`` are told by their first bytes.  Refused, with the file named: an unknown magic or version, a
header or tensor that ends behind the file's end, tensors that share bytes, a name that occurs twice, shapes and sizes that
disagree, and sets of split files that aren't whole.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions import codecs

# Fixed values of the formats: numbers of metadata types and their layouts; numbers of tensor types with name, elements and bytes a block.
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
STRING, ARRAY = 8, 9
BLOCKS = {
    0: ("F32", 1, 4), 1: ("F16", 1, 2), 30: ("BF16", 1, 2), 8: ("Q8_0", 32, 34), 11: ("Q3_K", 256, 110), 12: ("Q4_K", 256, 144), 13: ("Q5_K", 256, 176), 14: ("Q6_K", 256, 210), 18: ("IQ3_XXS", 256, 98), 21: ("IQ3_S", 256, 110), 23: ("IQ4_XS", 256, 136),
}
PLAIN = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1"}
BASE_MAGIC = b"_logits_"
READ_AHEAD = 1 << 16
STEP = 4 << 20


class Refused(ValueError):
    pass


def listed(path: str) -> tuple[pa.fs.FileSystem, list[str]]:
    """The files of a folder, in order, or the one file."""
    system, at = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    found = system.get_file_info(at)
    if found.type == pa.fs.FileType.File:
        return system, [at]
    if found.type != pa.fs.FileType.Directory:
        raise Refused(f"{path}: no such file or folder")
    inside = system.get_file_info(pa.fs.FileSelector(at, recursive=True))
    return system, sorted(f.path for f in inside if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", ".")))


class Bytes:
    """A file read forwards from where it is put; ``taken`` counts the bytes that were read."""

    def __init__(self, system: pa.fs.FileSystem, path: str):
        self.path, self.file = path, system.open_input_file(path)
        self.size, self.taken, self.at, self.held = self.file.size(), 0, 0, b""

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def range(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise Refused(f"{self.path}: bytes {start} to {start + length} of {self.size}: the file is cut short")
        self.taken += length
        return self.file.read_at(length, start)

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes of the header."""
        if n > len(self.held):
            if self.at + n > self.size:
                raise Refused(f"{self.path}: the header is cut short at byte {self.at} of {self.size}")
            more = min(max(n, READ_AHEAD), self.size - self.at) - len(self.held)
            self.held += self.range(self.at + len(self.held), more)
        out, self.held = self.held[:n], self.held[n:]
        self.at += n
        return out

    def number(self, layout: str) -> Any:
        return struct.unpack(layout, self.take(struct.calcsize(layout)))[0]

    def string(self) -> str:
        return self.take(self.number("<Q")).decode("utf-8", "replace")

    def value(self, kind: int) -> Any:
        if kind in SCALARS:
            return self.number(SCALARS[kind])
        if kind == STRING:
            return self.string()
        if kind == ARRAY:
            inner, n = self.number("<I"), self.number("<Q")
            if n > self.size:
                raise Refused(f"{self.path}: an array of {n} values")
            return [self.value(inner) for _ in range(n)]
        raise Refused(f"{self.path}: metadata of type {kind}")


@dataclass(frozen=True)
class Tensor:
    file: str
    name: str
    dtype: str
    shape: tuple[int, ...]
    offset: int
    bytes: int | None  # None: a type whose blocks aren't known

    @property
    def rows(self) -> int:
        return math.prod(self.shape[:-1]) if self.shape else 1

    @property
    def width(self) -> int:
        return self.shape[-1] if self.shape else 1


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a name occurs twice")
    return out


def _safetensors(b: Bytes) -> tuple[dict, list[Tensor]]:
    n = b.number("<Q")
    if 8 + n > b.size:
        raise Refused(f"{b.path}: a header of {n} bytes in a file of {b.size}: cut short or no container")
    try:
        head = json.loads(b.take(n), object_pairs_hook=_unique)
        meta = head.pop("__metadata__", {})
        tensors = [Tensor(b.path, name, t["dtype"], tuple(t["shape"]), 8 + n + t["data_offsets"][0], t["data_offsets"][1] - t["data_offsets"][0]) for name, t in head.items()]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise Refused(f"{b.path}: {e}") from e
    for t in tensors:
        size = {"BF16": 2}.get(t.dtype) or np.dtype(PLAIN[t.dtype]).itemsize if t.dtype in PLAIN or t.dtype == "BF16" else None
        if size is not None and t.bytes != size * math.prod(t.shape):
            raise Refused(f"{b.path}: {t.name}: shape {list(t.shape)} and {t.bytes} bytes disagree")
    return meta, tensors


def _gguf(b: Bytes) -> tuple[dict, list[Tensor]]:
    b.take(4)
    version, count, entries = b.number("<I"), b.number("<Q"), b.number("<Q")
    if version not in (2, 3):
        raise Refused(f"{b.path}: version {version}")
    meta, found = {}, []
    for _ in range(entries):
        key = b.string()
        if key in meta:
            raise Refused(f"{b.path}: {key} occurs twice")
        meta[key] = b.value(b.number("<I"))
    for _ in range(count):
        name, dims = b.string(), b.number("<I")
        shape = tuple(b.number("<Q") for _ in range(dims))[::-1]  # stored fastest first
        found.append((name, shape, b.number("<I"), b.number("<Q")))
    step = meta.get("general.alignment", 32)
    start = -(-b.at // step) * step
    tensors = []
    for name, shape, kind, offset in found:
        dtype, block, size = BLOCKS.get(kind, (f"type {kind}", 1, None))
        width = shape[-1] if shape else 1
        if size is not None and width % block:
            raise Refused(f"{b.path}: {name}: rows of {width} in blocks of {block}")
        tensors.append(Tensor(b.path, name, dtype, shape, start + offset, None if size is None else math.prod(shape) // block * size))
    return meta, tensors


def header(b: Bytes) -> tuple[dict, list[Tensor]]:
    """Metadata and tensors of a container; see the module for what is refused."""
    meta, tensors = _gguf(b) if b.size >= 4 and b.range(0, 4) == b"GGUF" else _safetensors(b)
    if len({t.name for t in tensors}) != len(tensors):
        raise Refused(f"{b.path}: a tensor's name occurs twice")
    end, before = 0, ""
    for t in sorted((t for t in tensors if t.bytes), key=lambda t: t.offset):
        if t.offset < end:
            raise Refused(f"{b.path}: {t.name} begins within {before}")
        end, before = t.offset + t.bytes, t.name
        if end > b.size:
            raise Refused(f"{b.path}: {t.name} ends at byte {end} of {b.size}: the file is cut short")
    return meta, tensors


def whole_sets(found: list[tuple[str, dict, list[Tensor]]]) -> None:
    """Files that say they are one of several must all be there, and no tensor in two of them."""
    sets: dict[tuple[str, int], list[tuple[int, str, list[Tensor]]]] = {}
    for path, meta, tensors in found:
        if meta.get("split.count") is not None and int(meta["split.count"]) > 1:
            stem = path.rsplit("-", 3)[0]
            sets.setdefault((stem, int(meta["split.count"])), []).append((int(meta.get("split.no", -1)), path, tensors))
    for (stem, count), files in sets.items():
        if sorted(n for n, _, _ in files) != list(range(count)):
            raise Refused(f"{stem}: of {count} files, numbers {sorted(n for n, _, _ in files)} are there")
        names = [t.name for _, _, tensors in files for t in tensors]
        if len(set(names)) != len(names):
            raise Refused(f"{stem}: a tensor is in two files")


def rows_of(t: Tensor, b: Bytes, first: int, last: int) -> np.ndarray:
    """Rows ``first`` to ``last`` of a tensor, in double precision; only their bytes are read."""
    if t.bytes is None:
        raise Refused(f"{t.file}: {t.name}: rows of {t.dtype} can't be decoded")
    each = t.bytes // max(t.rows, 1)
    raw = b.range(t.offset + first * each, (last - first) * each)
    if t.dtype == "BF16":
        flat = codecs.bf16_to_float32(raw)
    elif t.dtype in PLAIN:
        flat = np.frombuffer(raw, PLAIN[t.dtype])
    elif t.dtype in codecs.CODECS:
        flat = codecs.CODECS[t.dtype](raw)
    else:
        raise Refused(f"{t.file}: {t.name}: rows of {t.dtype} can't be decoded")
    return flat.astype(np.float64).reshape(last - first, t.width)


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Range(InputPartition):
    tensor: Tensor
    first: int
    last: int


class Directory(DataSource):
    kind = "tensor_directory"
    columns = "file string, tensor string, dtype string, shape array<long>, offset long, bytes long"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return DirectoryReader(self.options)


class DirectoryReader(DataSourceReader):
    """A partition a file; what a file must agree on with others is checked when reading is planned."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def headers(self) -> list[tuple[str, dict, list[Tensor]]]:
        system, files = listed(self.path)
        out = []
        for f in files:
            with Bytes(system, f) as b:
                out.append((f, *header(b)))
        whole_sets(out)
        return out

    def partitions(self) -> list[File]:
        return [File(f) for f, _, _ in self.headers()]

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = listed(self.path)
        with Bytes(system, partition.path) as b:
            for t in header(b)[1]:
                yield t.file, t.name, t.dtype, list(t.shape), t.offset, t.bytes


class Metadata(Directory):
    kind, columns = "tensor_metadata", "file string, key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return MetadataReader(self.options)


class MetadataReader(DirectoryReader):
    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = listed(self.path)
        with Bytes(system, partition.path) as b:
            for key, value in header(b)[0].items():
                yield partition.path, key, json.dumps(value)


class Rows(Directory):
    kind, columns = "tensor_rows", "file string, tensor string, position long, vec array<double>"

    def reader(self, schema) -> DataSourceReader:
        return RowsReader(self.options)


class RowsReader(DirectoryReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.step = int(options.get("rows", 4096))
        self.only = json.loads(options["tensors"]) if "tensors" in options else None
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def partitions(self) -> list[Range]:
        out = []
        for path, _, tensors in self.headers():
            for t in tensors:
                if self.only is None or t.name in self.only:
                    out += [Range(t, a, min(a + self.step, t.rows, self.last)) for a in range(max(self.first, 0), min(t.rows, self.last), self.step)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = listed(self.path)
        t = partition.tensor
        with Bytes(system, t.file) as b:
            yield from self.rows(t, b, partition.first, partition.last)

    @staticmethod
    def rows(t: Tensor, b: Bytes, first: int, last: int) -> Iterator[tuple]:
        for k, row in enumerate(rows_of(t, b, first, last)):
            yield t.file, t.name, first + k, row.tolist()


class Digests(Directory):
    kind, columns = "tensor_digests", "file string, tensor string, file_sha256 string, payload_sha256 string, content_sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return DigestReader(self.options)


class DigestReader(DirectoryReader):
    """Of the file, of what lies behind its header, and of each tensor's own bytes; a file is read once, forwards."""

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = listed(self.path)
        with Bytes(system, partition.path) as b:
            tensors = [t for t in header(b)[1] if t.bytes is not None]
            begin = min((t.offset for t in tensors), default=b.size)
            whole, payload, own = hashlib.sha256(), hashlib.sha256(), {t.name: hashlib.sha256() for t in tensors}
            for at in range(0, b.size, STEP):
                block = b.range(at, min(STEP, b.size - at))
                whole.update(block)
                payload.update(block[max(begin - at, 0) :])
                for t in tensors:
                    lo, hi = max(t.offset, at), min(t.offset + t.bytes, at + len(block))
                    if lo < hi:
                        own[t.name].update(block[lo - at : hi - at])
            for t in tensors:
                yield t.file, t.name, whole.hexdigest(), payload.hexdigest(), own[t.name].hexdigest()


class Base(Directory):
    kind, columns = "kld_base", "file string, chunk int, position int, token int, scored boolean"

    def reader(self, schema) -> DataSourceReader:
        return BaseReader(self.options)


class BaseReader(DirectoryReader):
    """The tokens of each chunk; the second half of a chunk is what such a file scores."""

    def partitions(self) -> list[File]:
        return [File(f) for f in listed(self.path)[1]]

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = listed(self.path)
        with Bytes(system, partition.path) as b:
            if b.size < len(BASE_MAGIC) or b.take(len(BASE_MAGIC)) != BASE_MAGIC:
                raise Refused(f"{partition.path}: no file of base log-probabilities")
            context, vocabulary, chunks = b.number("<I"), b.number("<i"), b.number("<i")
            if vocabulary <= 0 or chunks < 0:
                raise Refused(f"{partition.path}: {vocabulary} tokens, {chunks} chunks")
            for chunk in range(chunks):
                for position, token in enumerate(struct.unpack(f"<{context}i", b.take(4 * context))):
                    yield partition.path, chunk, position, token, position >= context // 2


def write_safetensors(rows: DataFrame, path: str, columns: dict[str, str]) -> None:
    """A file for each partition of ``rows`` that has any: a tensor a column, with a row for each row.

    ``columns`` gives a type (F32, F64, I64, …) for each column, of numbers or of lists of one length.  A file is
    written beside its place and then moved there, so a task that is tried again leaves one.
    """
    kinds = {c: np.dtype(PLAIN[k]) for c, k in columns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole, head, parts, at = pa.concat_batches(held), {}, [], 0
        for c, kind in kinds.items():
            column = whole.column(c)
            flat = column.flatten() if pa.types.is_list(column.type) else column
            m = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(whole.num_rows, -1)
            parts.append(m.tobytes())
            head[c] = {"dtype": columns[c], "shape": list(m.shape), "data_offsets": [at, at + m.nbytes]}
            at += m.nbytes
        text = json.dumps(head).encode()
        system, folder = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        task = TaskContext.get()
        name, own = f"{folder}/part-{task.partitionId():05d}.safetensors", f"{folder}/_{task.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(own) as out:
            for piece in (struct.pack("<Q", len(text)), text, *parts):
                out.write(piece)
        system.move(own, name)
        yield pa.RecordBatch.from_pydict({"file": [name]})

    rows.select(*columns).mapInArrow(run, "file string").count()


def register(spark: SparkSession) -> None:
    for source in (Directory, Metadata, Rows, Digests, Base):
        spark.dataSource.register(source)


def rows(spark: SparkSession, path: str, tensors: list[str] | None = None, first: int = 0, last: int | None = None, step: int = 4096) -> DataFrame:
    """``tensor_rows`` of the named tensors (all, if none are named), from position ``first`` to before ``last``."""
    register(spark)
    reader = spark.read.format("tensor_rows").option("path", path).option("rows", step).option("first", first)
    reader = reader if tensors is None else reader.option("tensors", json.dumps(tensors))
    return (reader if last is None else reader.option("last", last)).load()
