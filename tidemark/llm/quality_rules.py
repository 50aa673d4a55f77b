"""Quality rules by distribution divergence.

Every text gets two histograms: over character classes and over common words.  The median
histograms of a language's texts are its reference.  A text is rejected when its
Jensen-Shannon distance to every language's reference is too large in either histogram; a text too
short for a histogram to mean anything isn't judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, release, rows_kept, words

LANGUAGES = ("en", "de", "fr", "es")

# Common words of the four languages.
COMMON_WORDS = (
    "the of and to in a is that it for on was be with as by this are from or at which not have an but had they you were their one all we can her has there been if more when will would who so no"
    " der die das und in den von zu mit ist des im nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum"
    " le la les de des du et un une en est que qui dans pour par sur au ne pas plus avec se ce il sont elle mais ou été son cette aux"
    " el los las y que en un una del se por con no su para es al lo como más pero sus le ha o este sí porque esta entre"
).split()
VOCABULARY = {w.encode(): k + 1 for k, w in enumerate(dict.fromkeys(COMMON_WORDS))}
WORD_BINS = len(VOCABULARY) + 1  # bin 0: any other word

CLASSES = ("lower", "upper", "letter beyond ASCII", "digit", "blank", "line end", "stop or comma", "exclamation", "symbol", "other")
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
CONTINUED = len(CLASSES)  # bytes within a character


def _byte_classes() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"), np.uint8)
    for name, chars in (("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", bytes(range(48, 58))), ("blank", b" \t\x0b\x0c\r"), ("line end", b"\n"), ("stop or comma", b".,;:?"), ("exclamation", b"!"), ("symbol", SYMBOLS)):
        out[list(chars)] = CLASSES.index(name)
    out[0x80:0xC0] = CONTINUED
    out[0xC0:] = CLASSES.index("letter beyond ASCII")
    return out


BYTE_CLASS = _byte_classes()


def class_counts(raw: bytes) -> np.ndarray:
    """Characters of each class, and last the bytes within characters."""
    return np.bincount(BYTE_CLASS[np.frombuffer(raw, np.uint8)], minlength=CONTINUED + 1)


def word_counts(tokens: list[bytes]) -> np.ndarray:
    """Occurrences of each common word; bin 0: all other words.  ``tokens`` in lower case."""
    return np.bincount(np.fromiter(map(VOCABULARY.get, tokens, repeat(0)), np.int64, len(tokens)), minlength=WORD_BINS)


def repeated_words(tokens: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, first finds included."""
    n, names = len(tokens), set(tokens)
    if n < 4 or len(names) == n:
        return 0
    number = dict(zip(names, range(len(names)), strict=True))
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, n)
    pair = ids[:-1] * len(names) + ids[1:]
    if len(names) > 1 << 20:  # keep the product of three below 2^63
        pair = np.unique(pair, return_inverse=True)[1]
    three = pair[:-1] * len(names) + ids[2:]
    order = np.argsort(three, kind="stable")
    same = three[order[1:]] == three[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    tokens, classes = words(raw), class_counts(raw)
    white = classes[CLASSES.index("blank")] + classes[CLASSES.index("line end")]
    return len(tokens), int(classes[:CONTINUED].sum() - white), int(classes[CLASSES.index("symbol")]), duplicate_lines(raw), repeated_words(tokens)


def fails_base(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in [0, 1] along the last axis: the root of the divergence in bits."""
    m = (p + q) / 2
    half = lambda x: np.sum(x * np.log2(np.divide(x, m, out=np.ones_like(m), where=x > 0), where=x > 0, out=np.zeros_like(m)), axis=-1)
    p, q = np.broadcast_to(p, m.shape), np.broadcast_to(q, m.shape)
    return np.sqrt(np.maximum(0.0, (half(p) + half(q)) / 2))


def shares(raw: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Both histograms as shares, and how many characters and words they rest on."""
    tokens = words(raw.lower())
    classes, common = class_counts(raw)[:CONTINUED], word_counts(tokens)
    return classes / max(classes.sum(), 1), common / max(len(tokens), 1), int(classes.sum()), len(tokens)


LEVELS = 500  # shares are counted in steps of 1 / LEVELS


def references(documents: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, lang_col: str = "lang", text_col: str = "text", min_words: int = 50) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Median histograms of every language over all its texts of ``min_words`` words or more.

    Medians, as noisy texts would pull means towards themselves.  Tasks count texts by language, bin and
    level of the share; what comes to the driver is one number for each language and bin.
    """
    bins = CONTINUED + WORD_BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros((len(languages), bins, LEVELS + 1), np.int64)
        at, cells = {name: k for k, name in enumerate(languages)}, np.arange(bins)
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang in at:
                    classes, common, _, n = shares(raw.as_py())
                    if n >= min_words:
                        total[at[lang], cells, np.rint(np.concatenate([classes, common]) * LEVELS).astype(np.int64)] += 1
        lang, cell, level = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (lang, cell, level)), pa.array(total[lang, cell, level])], names=["lang", "bin", "level", "n"])

    counted = documents.select(F.col(lang_col).cast("string").alias("lang"), raw_text(text_col).alias("text")).mapInArrow(run, "lang int, bin int, level int, n long")
    summed = counted.groupBy("lang", "bin", "level").agg(F.sum("n").alias("n"))
    rows = summed.groupBy("lang", "bin").agg(F.percentile("level", 0.5, F.col("n")).alias("share")).collect()
    total = np.zeros((len(languages), bins))
    for r in rows:
        total[r["lang"], r["bin"]] = r["share"]
    out = {}
    for k, name in enumerate(languages):
        classes, common = total[k, :CONTINUED], total[k, CONTINUED:]
        if classes.sum() and common.sum():
            out[name] = classes / classes.sum(), common / common.sum()
    return out


class Judge:
    """The rule itself: near enough to one language's reference in both histograms."""

    def __init__(self, refs: dict, max_chars: float, max_words: float, min_chars: int, min_words: int):
        self.classes, self.common = (np.array([r[k] for r in refs.values()]) for k in range(2))
        self.max_chars, self.max_words, self.min_chars, self.min_words = max_chars, max_words, min_chars, min_words

    def distances(self, classes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the language that suits a text best: distance of characters, of words.  A row per text."""
        if not len(self.classes) or not len(classes):
            return np.zeros(len(classes)), np.zeros(len(classes))
        c, w = distance(classes[:, None, :], self.classes[None]), distance(common[:, None, :], self.common[None])
        best, rows = np.argmin(np.maximum(c / self.max_chars, w / self.max_words), axis=1), np.arange(len(c))
        return c[rows, best], w[rows, best]

    def accept(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verdicts and both distances."""
        all_shares = [shares(r) for r in raws]
        classes, common = (np.array([s[k] for s in all_shares]).reshape(len(raws), -1) for k in range(2))
        n_chars, n_words = (np.array([s[k] for s in all_shares], np.int64) for k in (2, 3))
        c, w = self.distances(classes, common)
        return ~((n_chars >= self.min_chars) & (c > self.max_chars) | (n_words >= self.min_words) & (w > self.max_words)), c, w


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(documents: DataFrame, *, max_chars: float = 0.185, max_words: float = 0.45, min_chars: int = 200, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: id, the base counts, ``base_failed``, ``kept`` and both distances.

    The references are learned from all ``documents``; ``lang`` only says which reference a text
    counts towards (null or unknown: none).  A null or empty text has no words and fails the base
    rules.  Repeated rows stay, null ids are kept, other columns are not read.  An empty table gives no
    rows; without any reference every text passes the method.
    """
    refs = references(documents, text_col=text_col, lang_col=lang_col, min_words=min_words)
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(refs, max_chars, max_words, min_chars, min_words)
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                raws = [raw.as_py() for raw in batch.column(1)]
                base = np.array([base_counts(raw) for raw in raws], np.int64).reshape(-1, 5)
                failed = np.array([fails_base(n, rep) for n, rep in base[:, [0, 4]].tolist()], bool)
                good, c, w = judge.accept(raws)
                cols = [*(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(good & ~failed), pa.array(c), pa.array(w)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, *(x.split()[0] for x in SCHEMA.split(", "))])

    return documents.select(F.col(id_col).alias("id"), raw_text(text_col).alias("text")).mapInArrow(run, f"{id_col} {id_type}, {SCHEMA}")


def accepted(documents: DataFrame, *, max_chars: float = 0.185, max_words: float = 0.45, min_chars: int = 200, min_words: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, with all their columns."""
    refs = references(documents, text_col=text_col, lang_col=lang_col, min_words=min_words)

    def judge():
        release()
        own = Judge(refs, max_chars, max_words, min_chars, min_words)

        def accepts(raws: list[bytes]) -> np.ndarray:
            counted = [words(raw) for raw in raws]
            base = np.array([not fails_base(len(t), repeated_words(t)) for t in counted], bool)
            return base & own.accept(raws)[0]

        return accepts

    return rows_kept(documents, text_col, judge)
