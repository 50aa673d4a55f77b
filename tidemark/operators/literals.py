"""Many literals in many texts, in one pass over the texts: Aho-Corasick automata that tasks build once and share as files.

Literals are dealt by their hash into automata of bounded size; a task builds each and puts it into the shared folder.  A worker
keeps the automata it reads, up to ``KEPT``, and takes a batch of texts through one after the other, so time is
that of the texts times the number of automata (one for every ``LITERALS`` literals), whatever the number of literals in one.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import REDACTED

from .shared import shared_path

LITERALS = 100_000  # in an automaton, on average
SHORTEST = 8
KEPT = 4
SPANS = "spans array<struct<start:int,stop:int>>"


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def registered(literals: DataFrame, column: str, *, shortest: int = SHORTEST, each: int = LITERALS) -> list[str]:
    """Writes the automata of the different literals of at least ``shortest`` characters; returns their files.

    Nulls and shorter literals are left out.
    """
    spark = literals.sparkSession
    words = literals.select(F.col(column).alias("w")).where(F.length("w") >= shortest).distinct()
    n = 1 + words.count() // each
    folder = shared_path(spark, "literals")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for batch in batches:
            for w in batch.column(0).to_pylist():
                found.add_word(w, len(w))
        if len(found):
            found.make_automaton()
            system, at = _opened(folder)
            system.create_dir(at, recursive=True)
            # named by its least literal, which no other has, so a task that is tried again writes the same file
            raw = pickle.dumps(found)
            name = hashlib.sha256(min(found.keys()).encode()).hexdigest()
            with system.open_output_stream(f"{at}/{name}") as out:
                out.write(raw)
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"]})

    return sorted(r["file"] for r in words.repartition(n, F.xxhash64("w")).mapInArrow(build, "file string").collect())  # a name an automaton


@lru_cache(maxsize=KEPT)
def _automaton(path: str):
    system, at = _opened(path)
    with system.open_input_file(at) as source:
        return pickle.loads(source.read())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that share a character become one; those that only touch stay apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _spans(texts: list[str | None], files: list[str]) -> list[list[tuple[int, int]]]:
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for f in files:
        automaton = _automaton(f)
        for own, text in zip(found, texts, strict=True):
            if text:
                own += [(end + 1 - size, end + 1) for end, size in automaton.iter(text)]
    return [merged(s) for s in found]


def without(text: str | None, spans: list[tuple[int, int]], marker: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], marker]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, column: str, files: list[str], *, marker: str = REDACTED) -> DataFrame:
    """``docs`` with ``spans``, the places of all literals in ``column`` (in code points, overlapping ones merged), and with these replaced.

    A null text has no spans and stays null.  All other columns stay as they are.
    """
    at = docs.columns.index(column)
    kind = docs.schema[column].dataType.simpleString()
    if kind != "string":
        raise ValueError(f"{column} is {kind}, not a string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                texts = batch.column(at).to_pylist()
                spans = _spans(texts, files)
                new = pa.array([without(t, s, marker) for t, s in zip(texts, spans, strict=True)], pa.string())
                sizes = np.cumsum([0, *map(len, spans)], dtype=np.int32)
                flat = np.array([p for s in spans for p in s], np.int32).reshape(-1, 2)
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "stop"])
                columns = [new if i == at else batch.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(sizes, pairs)], names=[*batch.schema.names, "spans"])

    if "spans" in docs.columns:
        raise ValueError("there is a column named spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {SPANS}")
