"""op3, op4 and op10 against plain computations, and what they do with awkward labels and texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import quality_knn, quality_rules, toxicity
from tidemark.llm.labelled import labelled_sample

from .fixtures import documents, empty, prose

LABELS = "doc_id long, quality int, toxic int"


# --- op10 -----------------------------------------------------------------------------------


def corpus(n=260):
    words = [b" vile wretch", b" vile toad", b" wretch toad vile"]
    return [(prose(i, 60 + i % 50).encode() + (words[i * 7 // 5 % 3] * (1 + i % 3) if i % 4 == 0 else b""), int(i % 4 == 0)) for i in range(1, n)]


@pytest.fixture(scope="module")
def fitted():
    return toxicity.fit(corpus(), {0: 195, 1: 65})


def test_scores_equal_a_plain_computation(spark, fitted):
    def size(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(window))

    d = documents(spark).where("doc_id IS NULL OR doc_id NOT IN (8, 11)").union(documents(spark).limit(1).withColumns({"doc_id": F.lit(70).cast("long"), "text": F.lit("A VILE toad, you vile  wretch " * 9)}))
    want = Counter()
    for r in d.collect():
        text = "".join(c.lower() if c < "\x80" else c for c in r["text"] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        parts = [(" " + " ".join(w[i : i + 12]) + " ").encode() for i in range(0, len(w), 12)]
        gains = [size(p, fitted.ordinary) - size(p, fitted.toxic) for p in parts] or [0]
        x = [*(math.log(sum(max(g - t, 0) for g in gains) + 0.5) for t in (0, 2)), math.log(len(gains)), 1.0]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, fitted.weights, strict=True))))
        want[(r["doc_id"], round(p, 9), int(p >= 0.3))] += 1
    assert Counter((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in toxicity.score(d, fitted).collect()) == want
    assert any(k[0] == 70 and k[2] for k in want)


def test_the_toxic_dictionary_alone_tells_texts_apart(fitted):
    new = [(t, y) for t, y in corpus(520)[260:]]
    y = np.array([y for _, y in new])

    def auc(s):
        return np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])

    ordered = lambda gains: np.array([g.sum() / len(g) for g in gains])
    assert auc(ordered([fitted.gains(t) for t, _ in new])) > 0.95
    same = toxicity.Model(fitted.ordinary, fitted.ordinary, fitted.window, fitted.weights)
    assert auc(ordered([same.gains(t) for t, _ in new])) == 0.5


def test_rare_and_foreign_passages_are_learned():
    """A phrase of few toxic texts is learned, one that ordinary texts share is not."""
    rows = [(prose(i, 90), 0) for i in range(300)] + [(prose(1000 + i, 90) + (" schlimmwort " * 3 if i < 8 else " badword " * 3), 1) for i in range(80)]
    rows = [(f"{t} harmless footer".encode(), y) for t, y in rows]
    marked = toxicity.apart([t for t, y in rows if y], [t for t, y in rows if not y])
    found = b"".join(toxicity.telling_windows([t for t, y in rows if y], marked))
    assert b"schlimmwort" in found and b"badword" in found and b"footer" not in found


def test_accepted_keeps_every_column_of_awkward_rows(spark, fitted):
    d = documents(spark)
    kept = toxicity.accepted(d, fitted)
    scores = toxicity.score(d, fitted).collect()
    assert kept.schema == d.schema
    assert kept.count() == sum(not r["predicted"] for r in scores)
    assert toxicity.score(empty(spark), fitted).count() == 0 and toxicity.accepted(empty(spark), fitted).count() == 0


# --- the sample of op4 and op10 -------------------------------------------------------------


def test_conflicting_repeated_and_null_labels(spark):
    texts = [(1, "one"), (1, "a second text of one"), (2, "two"), (3, "three"), (4, "four"), (4, "four"), (None, "none"), (5, None), (6, ""), (7, "x" * 50), (8, "eight")]
    labels = [(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, 0, 0), (3, 0, 0), (4, 1, 0), (None, 1, 0), (5, 1, 0), (6, 1, 0), (7, 0, 0), (8, None, 0), (9, 0, 0)]
    d, y = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    want = {b"a second text of one": 1, b"three": 0, b"four": 1}
    for k in (1, 4):
        rows, totals = labelled_sample(d.repartition(k), y.repartition(k), "quality", F.lit(True), per_class={0: 5, 1: 5}, max_bytes=40)
        assert dict(rows) == want and len(rows) == 3
        assert totals == {0: 3, 1: 4}
    rows, totals = labelled_sample(d, y.limit(0), "quality", F.lit(True), per_class={0: 5, 1: 5}, max_bytes=40)
    assert (rows, totals) == ([], {0: 0, 1: 0})


def test_the_sample_is_the_same_however_rows_lie(spark):
    d = spark.createDataFrame([(i, prose(i, 5)) for i in range(200)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], LABELS)
    a, b = (labelled_sample(d.repartition(k), y.repartition(k + 1), "quality", F.lit(True), per_class={0: 20, 1: 30}, max_bytes=100) for k in (1, 5))
    assert a == b and Counter(label for _, label in a[0]) == {0: 20, 1: 30}


# --- op4 ------------------------------------------------------------------------------------


def plain_vote(space, row, k):
    cosine = [float(np.dot(row, v)) for v in space.vectors]
    near = sorted(range(len(cosine)), key=lambda i: (-cosine[i], i))[:k]
    vote = [max(cosine[i], 0.0) ** 4 for i in near]
    return sum(v * space.labels[i] for v, i in zip(vote, near, strict=True)) / sum(vote) if sum(vote) else space.prior


def test_votes_equal_a_plain_search_with_ties(spark):
    sample = [(prose(i % 9, 70).encode(), i % 2) for i in range(40)]  # copies with either label: ties
    space = quality_knn.fit(sample, {0: 20, 1: 20}, dimensions=6, neighbours=7)
    texts = [prose(i, 80).encode() for i in range(12)] + [b"", b"x", "äöü 日本".encode(), prose(3, 70).encode()]
    x = np.array([quality_knn.terms(t) for t in texts])
    got, rows = space.score(x), space.embed(x)
    for g, row in zip(got, rows, strict=True):
        assert abs(g - plain_vote(space, row, 7)) < 1e-5


def test_neighbours_at_the_edge_are_the_first_ones():
    space = quality_knn.Space(*[np.zeros(0)] * 4, 3, 0.5)
    assert space.nearest(np.array([[0.5, 0.9, 0.5, 0.5, 0.5], [1, 1, 1, 1, 1.0], [0.1, 0.2, 0.3, 0.4, 0.5]])).tolist() == [[True, True, True, False, False], [True, True, True, False, False], [False, False, True, True, True]]


# --- op3 ------------------------------------------------------------------------------------


def plain_shares(text):
    classes, common = [0] * len(quality_rules.CLASSES), [0] * quality_rules.WORD_BINS
    at = quality_rules.CLASSES.index
    for c in text:
        if "a" <= c <= "z":
            k = at("lower")
        elif "A" <= c <= "Z":
            k = at("upper")
        elif c > "\x7f":
            k = at("letter beyond ASCII")
        elif c.isdigit():
            k = at("digit")
        elif c in " \t\x0b\x0c\r":
            k = at("blank")
        elif c == "\n":
            k = at("line end")
        elif c in ".,;:?":
            k = at("stop or comma")
        elif c == "!":
            k = at("exclamation")
        elif c in "#*$%&|<>":
            k = at("symbol")
        else:
            k = at("other")
        classes[k] += 1
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text))
    for w in words:
        common[quality_rules.VOCABULARY.get(w.encode(), 0)] += 1
    return [x / max(len(text), 1) for x in classes], [x / max(len(words), 1) for x in common], len(text), len(words)


def plain_distance(p, q):
    half = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, (half(p, m) + half(q, m)) / 2))


def test_verdicts_and_distances_equal_a_plain_computation(spark):
    german = "der hund und die katze sind nicht in dem haus sondern auf dem feld bei einem alten baum am fluss über den wiesen"
    rows = [(i, prose(i, 90 + 7 * i), "en") for i in range(14)] + [(20 + i, " ".join((german.split() * 6)[i : i + 80]), "de") for i in range(9)]
    rows += [(40, " ".join(f"%%% w{i}###" for i in range(200)), "en"), (41, " ".join(f"zq{i}x" for i in range(120)), "en"), (42, None, "en"), (43, "", None), (44, prose(5, 80), "xx"), (45, "日本語 " * 90, "ja"), (None, prose(6, 70), None), (46, prose(7, 60) + " !?" * 300, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash")).repartition(3)
    refs = {}
    for lang in ("en", "de", "fr", "es"):
        own = [s for s in (plain_shares(t) for _, t, x in rows if x == lang and t) if s[3] >= 50]
        if own:
            refs[lang] = []
            for k in (0, 1):
                middle = [np.percentile([round(s[k][b] * quality_rules.LEVELS) for s in own], 50) for b in range(len(own[0][k]))]
                refs[lang].append([x / sum(middle) for x in middle])
    want = {}
    for i, t, _ in rows:
        c, w, n_chars, n_words = plain_shares(t or "")
        far = [(plain_distance(c, r[0]), plain_distance(w, r[1])) for r in refs.values()]
        best = min(far, key=lambda x: max(x[0] / 0.185, x[1] / 0.45))
        good = not (n_chars >= 200 and best[0] > 0.185 or n_words >= 50 and best[1] > 0.45)
        want[i] = (good, *best)
    got = quality_rules.judge(d).collect()
    assert len(got) == len(rows) and {r["kept"] for r in got} == {True, False}
    for r in got:
        good, c, w = want[r["doc_id"]]
        assert r["kept"] == (good and not r["base_failed"]), r["doc_id"]
        if r["n_words"]:
            assert abs(r["char_distance"] - c) < 1e-9 and abs(r["word_distance"] - w) < 1e-9
    kept = quality_rules.accepted(d)
    assert kept.schema == d.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
