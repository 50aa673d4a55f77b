"""JSON documents: the canonical spelling, seals over it, and removal of what only the writing host knows."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields that may name a folder of the host.
HOST_FIELDS = frozenset(["packed_root", "output_root", "checkpoint_root", "capture_chunk_dir", "corpus", "path", "model_path", "weight_source"])

JSON, REFUSED = T.StructField("json", T.StringType()), T.StructField("refused", T.StringType())


def refuse(token: str) -> Any:
    raise ValueError(f"{token} is no number of JSON")


def parsed(text: str) -> Any:
    """Refuses NaN and the infinities."""
    return json.loads(text, parse_constant=refuse)


def spelled(value: Any) -> str:
    """Keys in order at every depth, no blanks, characters as they are, numbers as Python spells them; NaN is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sealed_by(value: dict, field: str) -> str:
    """The digest of a document in which the field for it is blank."""
    return hashlib.sha256(spelled({**value, field: ""}).encode()).hexdigest()


def without_host_paths(value: Any, at: str = "") -> tuple[Any, list[str]]:
    """The document with host paths made null, and where they were (``a.b``, ``a[].b``), in order of the document."""
    if isinstance(value, dict):
        out, gone = {}, []
        for key, own in value.items():
            if key in HOST_FIELDS and isinstance(own, str) and (own.startswith(("/", "~")) or "\\" in own):
                out[key], more = None, [at + key]
            else:
                out[key], more = without_host_paths(own, f"{at}{key}.")
            gone += more
        return out, gone
    if isinstance(value, list):
        both = [without_host_paths(x, at.rstrip(".") + "[].") for x in value]
        return [x for x, _ in both], [name for _, names in both for name in names]
    return value, []


def _each(texts: pd.Series, make, columns: list[str]) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            rows.append((*((None,) * (len(columns) - 1) if text is None else make(text)), None))
        except ValueError as e:
            rows.append((*(None,) * (len(columns) - 1), str(e)))
    return pd.DataFrame(rows, columns=columns)


@F.pandas_udf(T.StructType([JSON, REFUSED]))
def _canonical(texts: pd.Series) -> pd.DataFrame:
    return _each(texts, lambda t: (spelled(parsed(t)),), ["json", "refused"])


@F.pandas_udf(T.StructType([JSON, T.StructField("removed", T.ArrayType(T.StringType())), REFUSED]))
def _stripped(texts: pd.Series) -> pd.DataFrame:
    def one(text: str) -> tuple[str, list[str]]:
        value, gone = without_host_paths(parsed(text))
        return spelled(value), gone

    return _each(texts, one, ["json", "removed", "refused"])


def canonical(text: Column) -> Column:
    """A struct: ``json`` in the canonical spelling, or null and the reason in ``refused``; both are null for null."""
    return _canonical(text)


def stripped(text: Column) -> Column:
    """A struct: the canonical ``json`` without host paths, ``removed`` (where they were), ``refused``."""
    return _stripped(text)


def sealed(text: Column, field: str) -> Column:
    """Whether a document's ``field`` is the digest of the document with that field blank; null for what is no object."""

    @F.pandas_udf(T.BooleanType())
    def holds(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool | None:
            try:
                value = None if text is None else parsed(text)
                return value.get(field) == sealed_by(value, field) if isinstance(value, dict) else None
            except ValueError:
                return None

        return pd.Series([one(t) for t in texts], dtype="object")

    return holds(text)
