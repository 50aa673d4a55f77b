"""Lexical tokens and n-grams inside Arrow batches.

Spark has no Unicode normalisation, so texts beyond ASCII are folded (NFKC, then case folding) in Python.
A token is one Han or Kana character, or a run of letters, digits and underscores that combining marks may
continue.  An n-gram's key is 64 bits mixed from its tokens' digests.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ranges of Han and Kana characters.
CJK = "㐀-䶿一-鿿\U00020000-\U000323af぀-ヿㇰ-ㇿｦ-ﾝ"
WORDS_KEPT = 400_000
TEXTS_HELD = 64  # texts of a batch whose output a worker holds at once


def folded(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


@cache
def _run() -> re.Pattern:
    """A run that begins with a letter, digit or underscore; marks are those of the interpreter's Unicode tables."""
    marks, begin = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == "M"
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            marks.append(f"{re.escape(chr(begin))}-{re.escape(chr(c - 1))}")
            begin = None
    return re.compile(f"[{CJK}]|\\w[\\w{''.join(marks)}]*")


_ascii_run, _cjk = re.compile(r"\w+"), re.compile(f"([{CJK}])")


def word_tokens(text: str | None) -> list[str]:
    if not text:
        return []
    text = folded(text)
    return _ascii_run.findall(text) if text.isascii() else _run().findall(_cjk.sub(r" \1 ", text))


def slices(batches: Iterator[pd.Series], most: int | None = None) -> Iterator[pd.Series]:
    """The batches in slices: what is made of a batch of 10,000 texts, in Python's objects, needn't be held at once."""
    most = most or TEXTS_HELD
    for batch in batches:
        for k in range(0, len(batch), most):
            yield batch.iloc[k : k + most]


class _Digests(dict):
    """64-bit digest of a word, made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        out = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return out


_digests = _Digests()


def digests(tokens: list[str]) -> np.ndarray:
    """The digest of every token; a worker keeps those of words, and starts anew when it holds too many."""
    if len(_digests) > WORDS_KEPT:
        _digests.clear()
    return np.fromiter(map(_digests.__getitem__, tokens), np.uint64, len(tokens))


def gram_keys(tokens: np.ndarray, n: int) -> np.ndarray:
    """The key of every ``n``-gram by position, from token digests; none where there are fewer tokens."""
    out = np.zeros(max(0, len(tokens) - n + 1), np.uint64)
    if len(out):
        for k in range(n):
            out = (out ^ tokens[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out.view(np.int64)


def keys_of(text: Column, n: int, distinct: bool = False) -> Column:
    """The keys of a text's ``n``-grams, by position or each once."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slices(batches):
            own = (gram_keys(digests(word_tokens(t)), n) for t in batch)
            yield pd.Series([np.unique(k) if distinct else k for k in own], dtype=object)

    return keys(text)


def windows_of(text: Column, size: int) -> Column:
    """Adjacent windows of ``size`` tokens, joined by blanks; what is left at the end is no window."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slices(batches):
            own = map(word_tokens, batch)
            yield pd.Series([[" ".join(t[i : i + size]) for i in range(0, len(t) - size + 1, size)] for t in own], dtype=object)

    return windows(text)


@cache
def _joins_back() -> frozenset[str]:
    """Characters that may compose with the one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | {chr(c) for c in range(0x1161, 0x1176)} | {chr(c) for c in range(0x11A8, 0x11C3)})


@cache
def _begins(c: str) -> bool:
    """Whether a text can be cut before this character without changing how it is folded."""
    first = unicodedata.normalize("NFKC", c)[:1]
    return bool(first) and unicodedata.combining(first) == 0 and first not in _joins_back()


def folded_places(text: str) -> tuple[str, list[int], list[int]]:
    """The folded text, and for each of its characters where what it came from begins and ends in ``text``."""
    if text.isascii():
        return text.lower(), list(range(len(text))), list(range(1, len(text) + 1))
    cuts = [i for i, c in enumerate(text) if i == 0 or c.isascii() or _begins(c)]
    out, begins, ends = [], [], []
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        piece = folded(text[a:b])
        out.append(piece)
        begins += [a] * len(piece)
        ends += [b] * len(piece)
    return "".join(out), begins, ends


def token_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The tokens of ``word_tokens`` with the span of the original text that each comes from."""
    if not text:
        return []
    own, begins, ends = folded_places(text)
    if own.isascii():
        return [(m[0], begins[m.start()], ends[m.end() - 1]) for m in _ascii_run.finditer(own)]
    spaced, at = [], []
    for i, c in enumerate(own):
        wide = _cjk.match(c) is not None
        spaced += [" ", c, " "] if wide else [c]
        at += [i, i, i] if wide else [i]
    return [(m[0], begins[at[m.start()]], ends[at[m.end() - 1]]) for m in _run().finditer("".join(spaced))]


SPAN = T.StructType([T.StructField("window_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("gap", T.IntegerType())])


def window_spans(text: Column, size: int) -> Column:
    """As ``windows_of``, with the characters of the original text that a window spans, and the ``gap`` since the window before (or the beginning)."""

    @F.pandas_udf(T.ArrayType(SPAN))
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slices(batches):
            out = []
            for text in batch:
                t, own, upto = token_spans(text), [], 0
                for k in range(0, len(t) - size + 1, size):
                    start, stop = t[k][1], t[k + size - 1][2]
                    own.append({"window_index": k // size, "text": " ".join(x[0] for x in t[k : k + size]), "start": start, "stop": stop, "gap": max(0, start - upto)})
                    upto = stop
                out.append(own)
            yield pd.Series(out, dtype=object)

    return windows(text)


@F.pandas_udf(T.StringType())
def _fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(folded, na_action="ignore")


def folded_text(text: Column) -> Column:
    """NFKC and case folding; ASCII texts, where lower case is the same, don't leave the JVM."""
    return F.coalesce(_fold(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


@F.pandas_udf(T.StringType())
def _compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """NFC; ASCII texts don't leave the JVM."""
    return F.coalesce(_compose(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
