"""Lexical tokens as specified, and both routes of the contamination operators."""

import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexical as L
from tidemark.functions import text as T
from tidemark.operators import corpus as C
from tidemark.plans.text_queries import SQL_TOKENS

KNOWN = {
    "Hello_World 42": ["hello_world", "42"],
    "漢字かなカナ": list("漢字かなカナ"),
    "abc漢def": ["abc", "漢", "def"],
    "Ｆｕｌｌ ｗｉｄｔｈ ｱｲ": ["full", "width", "ア", "イ"],
    "Straße ﬁn ①": ["strasse", "fin", "1"],
    "été x̣y": ["été", "x̣y"],
    "̣abc": ["abc"],
    "\U00020000\U0002fb0a": ["\U00020000", "\U0002fb0a"],
    "": [],
    None: [],
}


def plain_tokens(text):
    """One character after the other."""
    out, run = [], ""
    for c in unicodedata.normalize("NFKC", text).casefold() + " ":
        cjk = any(a <= ord(c) <= b for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)))
        if not cjk and (c.isalnum() or c == "_" or run and unicodedata.category(c)[0] == "M"):
            run += c
        else:
            out, run = out + [x for x in (run, c if cjk else "") if x], ""
    return out


def test_known_tokens(spark):
    assert {t: L.word_tokens(t) for t in KNOWN} == KNOWN
    d = spark.createDataFrame([(k, t) for k, t in enumerate(KNOWN)], "k int, text string")
    got = [r["t"] or [] for r in d.select("k", T.tokens(F.col("text")).alias("t")).orderBy("k").collect()]
    assert got == list(KNOWN.values())


def test_tokens_equal_a_walk_over_characters():
    rng = random.Random(7)
    chars = "ab_ 1.,ßÄ漢ｱカﾊﾞ①½́̈ך" + "".join(chr(rng.randrange(0x80, 0xD800)) for _ in range(500))
    for _ in range(2000):
        t = "".join(rng.choice(chars) for _ in range(rng.randrange(30)))
        assert L.word_tokens(t) == plain_tokens(t)


def test_the_sql_has_the_branch_for_han_and_kana(spark):
    texts = ["Straße zu 漢字 und カナ", "日本語のテキスト abc", "plain words only"]
    c = duckdb.connect()
    got = [r[0] for r in c.execute(f"SELECT {SQL_TOKENS} FROM (SELECT unnest(?) AS text)", [texts]).fetchall()]
    assert got == [L.word_tokens(t) for t in texts]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("a b c d e f g h 漢 ß".split())
    cal = [" ".join(word() for _ in range(60)) for _ in range(20)] + [None, "", "a b"]
    docs = [" ".join(word() for _ in range(rng.randrange(120))) for _ in range(30)] + [x[20:90] for x in cal[:20]] + [None, "", "a"]
    docs += [f"{docs[0]} {cal[0]} {docs[1]}", cal[1] * 3]
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(t,) for t in cal], "text string")


@pytest.mark.parametrize("n", [3, 13])
def test_keys_sent_or_joined_give_the_same_overlap(tables, n):
    sent, joined = (sorted(map(tuple, C.calibration_overlap(*tables, n, sent_keys=k).collect()), key=str) for k in (1 << 20, 0))
    assert sent == joined and any(r[2] for r in sent)
    grams = lambda t: {tuple(x[i : i + n]) for x in [L.word_tokens(t)] for i in range(len(x) - n + 1)}
    known = set().union(*(grams(r["text"]) for r in tables[1].collect()))
    want = {r["doc_id"]: (len(grams(r["text"])), len(grams(r["text"]) & known)) for r in tables[0].collect()}
    assert {r[0]: r[1:3] for r in sent} == want


def test_keys_sent_or_joined_give_the_same_audit(tables):
    sent, joined = (sorted((r["doc_id"], r["words"], r["exact_hits"], r["longest_run_words"], round(r["containment"], 9)) for r in C.near_duplicate_audit(*tables, sent_keys=k).collect()) for k in (1 << 20, 0))
    assert sent == joined and max(r[3] for r in sent) >= 60


def test_no_calibration_text_overlaps_nothing(spark, tables):
    none = spark.createDataFrame([], "text string")
    assert all(r["shared_ngrams"] == 0 for r in C.calibration_overlap(tables[0], none, 3).collect())
    assert C.near_duplicate_audit(tables[0].limit(0), tables[1]).collect() == []


def test_cleaning_composes_and_trims(spark):
    from tidemark.functions import text

    rows = [(0, "e\u0301a\r\nb \t\rc\x07\n\n\n\nd  "), (1, "  x"), (2, None), (3, "")]
    got = spark.createDataFrame(rows, "i int, t string").orderBy("i").select(text.cleaned(F.col("t"))).collect()
    assert [r[0] for r in got] == ["\u00e9a\nb\nc\n\nd\n", "x\n", None, "\n"]
