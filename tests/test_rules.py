"""Rules as data against plain conditions; spans of windows in original texts."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexical
from tidemark.operators import rules


def holds(tree, row):
    ((op, x),) = tree.items()
    if op in ("all", "any"):
        return (all if op == "all" else any)(holds(t, row) for t in x)
    if op == "not":
        return not holds(x, row)
    if op == "null":
        return row[x] is None
    if op == "same":
        return row[x[0]] == row[x[1]]
    v = row[x[0]]
    if v is None:
        return False
    return {"eq": lambda: v == x[1], "ne": lambda: v != x[1], "lt": lambda: v < x[1], "ge": lambda: v >= x[1], "in": lambda: v in x[1], "icontains": lambda: x[1].lower() in v.lower(), "ieq": lambda: v.lower() == x[1].lower(), "begins": lambda: v.startswith(x[1])}[op]()


def tree(rng, depth=0):
    if depth < 3 and rng.random() < 0.6:
        op = rng.choice(["all", "any", "not"])
        return {op: tree(rng, depth + 1) if op == "not" else [tree(rng, depth + 1) for _ in range(rng.randrange(4))]}
    return rng.choice([{"eq": ["a", rng.randrange(3)]}, {"ne": ["a", 1]}, {"lt": ["a", 2]}, {"ge": ["b", 1]}, {"in": ["b", [0, 2]]}, {"null": "a"}, {"null": "s"}, {"same": ["a", "b"]}, {"icontains": ["s", "X"]}, {"ieq": ["s", "XY"]}, {"begins": ["s", "x"]}])


def test_trees_equal_plain_conditions(spark):
    rng = random.Random(6)
    rows = [{"a": a, "b": b, "s": s} for a in (None, 0, 1, 2) for b in (None, 0, 1, 2) for s in (None, "", "xy", "Xz", "y")]
    trees = [tree(rng) for _ in range(60)]
    d = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "i int, a int, b int, s string")
    for r in d.select("i", *(rules.compiled(t).alias(f"t{k}") for k, t in enumerate(trees))).collect():
        assert [r[f"t{k}"] for k in range(len(trees))] == [holds(t, rows[r["i"]]) for t in trees]


def test_the_first_gate_refuses_and_all_are_named(spark):
    given = rules.read(json.dumps([{"name": "x", "when": {"eq": ["a", 1]}}, {"name": "y", "when": {"any": [{"null": "a"}, {"ge": ["a", 1]}]}}]))
    got = rules.gated(spark.createDataFrame([(1,), (2,), (None,), (0,)], "a int"), given).collect()
    assert [(r["a"], r["gate"], r["refused"]) for r in got] == [(1, "x", ["x", "y"]), (2, "y", ["y"]), (None, "y", ["y"]), (0, None, [])]
    assert [r[0] for r in spark.range(1).select(rules.first([], "none")).collect()] == ["none"]
    assert rules.gated(spark.range(1), []).first()["gate"] is None


@pytest.mark.parametrize("bad", ['[{"name": "a", "when": {}}]', '[{"name": "a", "when": {"like": ["a", 1]}}]', '[{"name": "a", "when": {"null": "a"}}, {"name": "a", "when": {"null": "b"}}]', '[{"name": "a", "when": {"eq": ["a", 1], "ne": ["a", 2]}}]'])
def test_refused_rules(spark, bad):
    with pytest.raises(ValueError):
        rules.read(bad)


TEXTS = ["plain ASCII text, with_words 12", "ﬁne ﬂour ǆ ½ ①②", "漢字とカナ abc漢x", "été né", "한국어 한국", "ｶﾞｷﾞ ﾊﾟ x", "Straße İstanbul ΑΣ ς", "x̧́y ́z", "a b c ㈱ ﷺ", "̈́क़ q̣̇", "𝐀𝐛𝐜 𝟙𝟚", ""]


def test_places_of_folded_texts():
    rng = random.Random(4)
    mixed = ["".join(rng.choice("".join(TEXTS) + " ȩ́́ﾞ゙") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for text in [*TEXTS, *mixed]:
        own, begins, ends = lexical.folded_places(text)
        assert own == lexical.folded(text) and len(own) == len(begins) == len(ends)
        assert [t for t, _, _ in lexical.token_spans(text)] == lexical.word_tokens(text)
        for token, a, b in lexical.token_spans(text):
            assert 0 <= a < b <= len(text) and token in lexical.folded(text[a:b])
    assert unicodedata.unidata_version


def test_windows_span_their_tokens(spark):
    texts = [" ".join(TEXTS), *TEXTS, None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.explode(lexical.window_spans(F.col("t"), 3)).alias("w"))
    rows = d.select("i", "w.*").collect()
    assert len(rows) > 15
    for r in rows:
        piece = texts[r["i"]][r["start"] : r["stop"]]
        assert " ".join(lexical.word_tokens(piece)) == r["text"] or set(r["text"].split()) <= set(lexical.word_tokens(piece))
        assert r["gap"] >= 0
    plain = {(r["i"], r["window_index"]): r["text"] for r in rows}
    want = {(i, k): w for i, t in enumerate(texts) for k, w in enumerate(" ".join(x) for x in zip(*[iter(lexical.word_tokens(t))] * 3, strict=False))}
    assert plain == want
