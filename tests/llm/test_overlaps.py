"""op8 on tables: against a comparison of all alignments, in one pass, with awkward rows."""

import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D

from .fixtures import documents, empty, prose


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def overlaps(doc, item, least=13, share=0.75):
    """Some aligned stretch that is long and equal enough, by trying all of them."""
    for diagonal in range(1 - len(item), len(doc)):
        a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        equal = np.concatenate([[0], np.cumsum([item[i] == doc[i + diagonal] for i in range(a, b)])])
        n = min(least, len(item))
        for i in range(b - a):
            for j in range(i + n, b - a + 1):
                if equal[j] - equal[i] >= share * (j - i) - 1e-9:
                    return True
    return False


def test_tables_equal_a_search_of_all_alignments(spark):
    rng = np.random.default_rng(11)
    items = [(1, prose(51, 30)), (2, prose(52, 16)), (3, prose(53, 9)), (4, "one two"), (None, prose(54, 14)), (5, None), (6, ""), (2, prose(55, 20)), (7, "lone")]
    docs = []
    for k in range(60):
        source = items[k % len(items)][1] or ""
        part = [w if rng.random() < 0.82 else "other" for w in source.split()]
        docs.append((k if k % 7 else None, " ".join([prose(100 + k, int(rng.integers(0, 12))), *part[: int(rng.integers(1, 40))], prose(200 + k, int(rng.integers(0, 12)))])))
    docs += [(70, None), (71, ""), (72, " \n "), (3, docs[3][1]), (73, "ONE  two\n")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "position": F.lit("clash")}).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = sorted(((i, j) for i, t in docs for j, x in items if words(x) and overlaps(words(t), words(x))), key=str)
    hit = [t for _, t in docs if any(words(x) and overlaps(words(t), words(x)) for _, x in items)]
    assert 15 < len(hit) < len(docs) - 10
    for limits in ({}, {"block_items": 2}, {"block_bytes": 60}):
        assert sorted(((r["doc_id"], r["item_id"]) for r in D.contaminated(d, b, **limits).collect()), key=str) == want
        kept = D.clean(d, b, **limits)
        assert kept.schema == d.schema
        assert sorted(str(r["text"]) for r in kept.collect()) == sorted(str(t) for _, t in docs if t not in hit)


def test_documents_are_read_once_whatever_the_blocks(spark, capsys):
    d, b = documents(spark), spark.createDataFrame([(i, prose(i, 20)) for i in range(40)], "item_id long, text string")
    D.contaminated(d, b, block_items=3).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    d = documents(spark)
    assert D.contaminated(d, none).schema["item_id"].dataType.simpleString() == "string"
    assert D.contaminated(d, none).count() == 0 and D.clean(d, none).count() == d.count()
    assert D.clean(empty(spark), none).count() == 0
    assert D.clean(empty(spark), spark.createDataFrame([("a", "b c")], none.schema)).count() == 0


def test_long_limits_need_no_longer_masks():
    words_ = [b"w%d" % k for k in range(90)]
    bank = D.Bank([(1, b" ".join(words_))], None, 60, 1.0)
    (doc,) = D.token_hashes([[b"x", *words_[5:70], b"y"]])
    assert [m[1:] for m in bank.matches(doc)] == [(1, 65, 65)]
