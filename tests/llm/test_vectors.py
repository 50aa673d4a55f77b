"""op11 to op13 against plain loops, on tables with every awkward row, and proof that each method's bound does the work."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ball_trees, hard_negatives, neighbours
from tidemark.llm import vectors as V

COLUMNS = "vec_id long, embedding array<float>, label int, id long, bucket int, band int, vec string, score double, n long"
NAN, INF = float("nan"), float("inf")


def rows_of(n=400, d=64, seed=5, spread=1.0):
    rng = np.random.default_rng(seed)
    out = [(i, (rng.normal(size=d) * 0.12 * math.exp(spread * rng.normal())).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]
    out += [(1000 + i, out[7][1], i % 4) for i in range(150)]  # a third of all rows are copies
    out += [(2000, None, 1), (2001, [0.0] * d, 1), (2002, [NAN] + [0.1] * (d - 1), 1), (2003, [INF] + [0.1] * (d - 1), 2), (2004, [None] + [0.1] * (d - 1), 2)]
    out += [(2100, [0.1, 0.2], 1), (2101, [0.3, -0.2], 1), (2200, [0.2, 0.2], 3), (2300, [], 0), (2400, [0.5] * d, None), (None, [0.5] * d, 1), (100, out[100][1], out[100][2]), (33, out[33][1], out[33][2])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 0.5, 9) for r in rows], COLUMNS)


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows):
    usable = [(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in rows if i is not None and label is not None and sound(v)]
    anchors = {i: (label, v) for i, v, label in sorted(usable, key=lambda r: (r[2], r[1]), reverse=True) if i % 100 == 0}
    out = []
    for a, (label, av) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=True)), i, other) for i, v, other in usable if i != a and len(v) == len(av))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            window = [(i, n) for n, i, other in scored if other != label and 80 * -s <= 100 * -n <= 100 * -s]
            out += [(a, p, k + 1, i, -s, -n) for k, (i, n) in enumerate(window[:5])]
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [1 << 16, 40])
def test_hard_negatives_equal_a_plain_loop(spark, bucket_rows):
    rows = rows_of()
    got = hard_negatives.mine(frame(spark, rows), F.col("id") % 100 == 0, bucket_rows=bucket_rows).collect()
    assert len(got) > 20 and sorted(tuple(r) for r in got) == plain_negatives(rows)


def test_hard_negatives_of_little(spark):
    assert hard_negatives.mine(frame(spark, []), F.col("id") % 100 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, [(100, [1.0], 1)]), F.col("id") % 100 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.7], 2)]), F.col("id") % 100 == 0).collect() == [(100, 1, 1, 2, 65536, 230 * 256)]


def questions(tmp_path, limit, length=10):
    vec = pa.array([[length, 0]], pa.list_(pa.int32()))
    one = lambda x: pa.array([[x]], pa.list_(pa.int64()))
    table = pa.table({"id": pa.array([0]), "label": pa.array([1]), "vec": vec, "length2": pa.array([length**2]), "low": one(hard_negatives.LOWEST), "high": one(hard_negatives.HIGHEST), "limit": one(limit)})
    pa.parquet.write_table(table, tmp_path / "q.parquet")
    return f"file://{tmp_path}"


@pytest.mark.parametrize(("limit", "reads"), [(1000, False), (400, True)])
def test_short_buckets_are_passed_over(tmp_path, monkeypatch, limit, reads):
    """An anchor of length 10 and rows of length 50: 500 and 1, by the bound's rounding, can be reached, 1,000 can't."""
    rows = pa.record_batch({"id": pa.array(range(1, 41)), "label": pa.array([1] * 40), "vec": pa.array([[50, 0]] * 40, pa.list_(pa.int32()))})
    compared = []
    monkeypatch.setattr(hard_negatives, "best", lambda *a: compared.append(len(a[0])) or V.best(*a))
    found = list(hard_negatives.searched(questions(tmp_path, limit), 5, True)(iter([rows])))
    assert bool(compared) == reads and bool(found) == reads


def test_the_scan_leaves_out_rows_too_short_for_every_anchor(spark, monkeypatch):
    """Two long rows and two short ones; the second band is read with the limit that the first one set."""
    seen = []
    monkeypatch.setattr(hard_negatives, "searched", lambda url, k, same, f=hard_negatives.searched: seen.append(url) or f(url, k, same))
    rows = [(i, [4.0, 0.01 * i], i % 2) for i in range(200)] + [(1000 + i, [0.01, 0.0], i % 2) for i in range(5000)]
    got = hard_negatives.mine(frame(spark, rows), F.col("id") % 100 == 0, bucket_rows=300).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows) and len(seen) >= 4


def plain_clusters(rows, d=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == d and sound(v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    out, inertia = [], defaultdict(int)
    for i, v in kept:
        far, n = near(v)
        inertia[n] += far
        out.append((i, n, far))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, far, inertia[n], sum(inertia.values()), digest[n]) for i, n, far in out), key=str)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_clusters_equal_a_plain_loop(spark, spread):
    rows = rows_of(300, spread=spread)
    got = sorted((tuple(r) for r in ball_trees.cluster(frame(spark, rows)).collect()), key=str)
    assert len(got) > 400 and got == plain_clusters(rows)


def test_clusters_of_little(spark):
    assert ball_trees.cluster(frame(spark, [])).collect() == []
    few = [(3, [0.5] * 64, 1), (4, [0.5] * 64, 1), (None, [0.25] * 64, 1), (5, [2.0**20] * 64, 1)]
    got = sorted((tuple(r) for r in ball_trees.cluster(frame(spark, few)).collect()), key=str)
    assert got == plain_clusters(few[:3])


def test_whole_balls_are_assigned_where_vectors_lie_in_groups():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (8, 16)).astype(float)
    vecs = np.rint(centres[rng.integers(8, size=3000)] + rng.normal(size=(3000, 16)))
    cluster, counts, totals, whole = ball_trees.assigned(ball_trees.grown(list(range(3000)), vecs), centres)
    tree = ball_trees.grown(list(range(3000)), vecs)
    want = ((vecs[tree["ids"]][:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert (cluster == want).all() and whole > 2000
    assert counts.tolist() == np.bincount(want, minlength=8).tolist()
    assert all((totals[c] == vecs[tree["ids"]][want == c].sum(axis=0)).all() for c in range(8))


def test_equal_distances_go_to_the_smaller_number():
    vecs = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 5.0]] * 50)
    centroids = np.array([[2.0, 0.0], [0.0, 0.0], [2.0, 0.0], [1.0, 100.0]])
    tree = ball_trees.grown(list(range(150)), vecs)
    cluster, counts, _, _ = ball_trees.assigned(tree, centroids)
    assert counts.tolist() == [100, 50, 0, 0]
    assert all(c == (1 if i % 3 == 0 else 0) for i, c in zip(tree["ids"], cluster.tolist(), strict=True))


def plain_nearest(rows, k=20):
    usable = [(i, v) for i, v, _ in rows if i is not None and sound(v) and any(v)]
    queries = {i: v for i, v in sorted(usable, key=lambda r: r[1], reverse=True) if i % 20 == 0}

    def product(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    out = []
    for q, a in queries.items():
        scored = sorted((-product(a, v), i) for i, v in usable if i != q and len(v) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("first_band", [4096, 20])
def test_neighbours_equal_a_plain_loop(spark, first_band):
    rows = rows_of()
    single = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = neighbours.search(frame(spark, rows), F.col("id") % 20 == 0, first_band=first_band).collect()
    assert sorted(tuple(r) for r in got) == plain_nearest(single)


def test_neighbours_of_little(spark):
    assert neighbours.search(frame(spark, []), F.col("id") % 20 == 0).collect() == []
    assert neighbours.search(frame(spark, [(20, [1.0], 1)]), F.col("id") % 20 == 0).collect() == []
    got = neighbours.search(frame(spark, [(20, [1.0], 1), (1, [-1.0], 1), (2, [0.5], None)]), F.col("id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 2, 0.5), (20, 2, 1, -1.0)]


@pytest.mark.parametrize("d", [3, 64, 1500])
def test_products_of_codes_bound_the_true_ones_and_few_pairs_survive(d, monkeypatch):
    rng = np.random.default_rng(d)
    a, b = neighbours.coded(rng.normal(size=(40, d))), neighbours.coded(rng.normal(size=(3000, d)) * np.exp(rng.normal(size=(3000, 1))))
    assert (neighbours.tile_products(a.codes, b.codes) == a.codes.astype(np.int64) @ b.codes.astype(np.int64).T).all()
    near = neighbours.tile_products(a.codes, b.codes) * a.scale[:, None] * b.scale
    slack = a.size[:, None] * b.error + a.error[:, None] * b.length
    assert (np.abs(a.vecs @ b.vecs.T - near) <= slack + 1e-9).all()
    pairs = []
    monkeypatch.setattr(neighbours, "exact", lambda x, y, i, j, f=neighbours.exact: pairs.append(len(i)) or f(x, y, i, j))
    found = sorted(neighbours.nearest(a, np.arange(40) + 10_000, np.full(40, -np.inf), b, np.arange(3000), 20))
    want = sorted((r, s, int(c)) for r, row in enumerate(neighbours.exact(a.vecs, b.vecs, *np.indices((40, 3000)).reshape(2, -1)).reshape(40, -1)) for s, c in sorted(zip(row.tolist(), range(3000), strict=True), key=lambda x: (-x[0], x[1]))[:20])
    assert found == want and pairs[0] < 40 * 3000 / 5


def test_bands_cover_everything_once():
    for first, n in [(1, 1), (1, 100), (5, 4), (4096, 0), (3, 3)]:
        got = V.bands(first, n)
        assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
