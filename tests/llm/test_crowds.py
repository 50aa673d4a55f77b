"""Crowded partition values of op9 against all pairs."""

import numpy as np
import pytest

from tidemark.llm import simhash


def least_of_component(fps, radius):
    root = {f: f for f in fps}
    for _ in fps:
        root = {f: min(root[g] for g in fps if (f ^ g).bit_count() <= radius) for f in fps}
    return root


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_crowds_link_what_all_pairs_link(spark, radius):
    rng = np.random.default_rng(radius)
    bits = {1: 7, 2: 10, 3: 12}[radius]
    fps = sorted(int(x) << 20 for x in rng.choice(1 << bits, 48, replace=False))
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    parts = [(list(range(20)), 0)]
    root = {f: f for f in fps}
    edges = [(r["a"], r["b"]) for r in simhash.links(distinct, parts, radius, 4).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in edges)
    for _ in fps:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert root == least_of_component(fps, radius)


def near(spark):
    from .fixtures import documents, prose

    rows = [(100 + i, prose(9, 400).replace("river", f"river{i}", 1)) for i in range(5)] + [(100, prose(9, 400)), (100, prose(9, 400) + " "), (None, prose(9, 400))]
    return documents(spark).where("doc_id IS NULL OR doc_id < 11").select("doc_id", "text", "fp").union(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string"))


def test_frequent_fingerprints_are_named_alike(spark):
    from collections import Counter

    d = near(spark)
    want = Counter(map(tuple, simhash.near_duplicates(d).collect()))
    assert Counter(map(tuple, simhash.near_duplicates(d, frequent=1).collect())) == want
    assert sum(want.values()) == d.count()


def test_representatives_are_the_same_however_rows_lie(spark):
    d = near(spark)
    a, b = (sorted(map(str, simhash.representatives(d.repartition(k)).collect())) for k in (1, 5))
    assert a == b
    assert len(a) == len({r["component_id"] for r in simhash.near_duplicates(d).collect()})


def test_texts_move_at_most_once(spark, capsys):
    simhash.representatives(near(spark)).explain()
    plan = capsys.readouterr().out
    assert plan.count("ReadSchema") <= 2 and plan.count("Exchange") <= 3
