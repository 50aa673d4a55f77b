"""Ends of chains and cycles of any length, against a plain walk."""

import random

import pytest

from tidemark.operators import closure


def walk(edges, node):
    """Root and steps, or the cycle's least node."""
    path, seen = [node], {node: 0}
    while path[-1] in edges:
        up = edges[path[-1]]
        if up in seen:
            return None, None, min(path[seen[up] :])
        seen[up] = len(path)
        path.append(up)
    return path[-1], len(path) - 1, None


def shapes():
    chain = {i: i + 1 for i in range(1000)}
    cycle = {5000 + i: 5000 + (i + 1) % 1000 for i in range(1000)}
    out = {"chain of 1": {1: 2}, "chain of 1000": chain, "cycle of 1": {1: 1}, "cycle of 2": {1: 2, 2: 1}, "cycle of 9": {i: i % 9 + 1 for i in range(1, 10)}, "cycle of 12": {i: i % 12 + 1 for i in range(1, 13)}, "cycle of 1000": cycle}
    out["chain into a cycle"] = {**{i: i + 1 for i in range(300)}, **{300 + i: 300 + (i + 1) % 37 for i in range(37)}}
    out["star and its stem"] = {**{i: 9000 for i in range(400)}, **{9000 + i: 9001 + i for i in range(20)}}
    rng = random.Random(4)
    out["forest"] = {i: rng.randrange(i, i + 40) if rng.random() < 0.97 else rng.randrange(600) for i in range(600)}
    return out


@pytest.mark.parametrize("few", [None, 10])
@pytest.mark.parametrize("name", ["cycle of 1", "cycle of 12", "chain into a cycle", "star and its stem"])
def test_each_shape(spark, name, few):
    edges = shapes()[name]
    d = spark.createDataFrame(list(edges.items()), "node long, up long")
    got = {r["node"]: (r["root"], r["steps"], r["cycle"]) for r in closure.forest(d, few).ends.collect()}
    assert got == {n: walk(edges, n) for n in edges}


def test_all_shapes_at_once(spark):
    edges = {(k, n): (k, up) for k, e in shapes().items() for n, up in e.items()}
    name = lambda x: f"{x[0]}/{x[1]:05d}"
    plain = {name(a): name(b) for a, b in edges.items()}
    nodes = sorted(plain.keys() | plain.values() | {"alone"})
    d = spark.createDataFrame(list(plain.items()), "node string, up string")
    got = {r["node"]: (r["root"], r["steps"], r["cycle"]) for r in closure.roots(spark.createDataFrame([(n,) for n in nodes], "node string"), d).collect()}
    assert got == {n: walk(plain, n) for n in nodes}


def test_descends_equals_a_walk(spark):
    rng = random.Random(9)
    for name in ("chain of 1000", "chain into a cycle", "forest", "cycle of 12"):
        edges = shapes()[name]
        nodes = sorted(edges.keys() | edges.values())
        pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(300)} | {(nodes[0], nodes[0]), (nodes[0], nodes[-1])}

        def above(n):
            seen = []
            while n is not None and n not in seen:
                seen.append(n)
                n = edges.get(n)
            return set(seen)

        want = {(a, b) for a, b in pairs if b in above(a)}
        d = spark.createDataFrame(list(edges.items()), "node long, up long")
        got = {tuple(r) for r in closure.descends(spark.createDataFrame([*pairs, (None, 1), (1, None)], "lower long, upper long"), d).collect()}
        assert got == want and want


def test_nulls_repeats_and_nothing(spark):
    d = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (None, 4), (5, None)], "node long, up long")
    assert [tuple(r) for r in closure.forest(d).ends.collect()] == [(1, 2, 1, None)]
    assert closure.forest(d.limit(0)).ends.collect() == []
    assert closure.descends(spark.createDataFrame([(7, 7), (7, 8)], "lower long, upper long"), d.limit(0)).collect() == [(7, 7)]
