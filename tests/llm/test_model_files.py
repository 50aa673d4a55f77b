"""op6: files that are missing or short, and many shards."""

import glob
import os

import numpy as np
import pytest

from tidemark.llm import kneser_ney

from .fixtures import documents, empty


def test_absent_and_short_files_are_refused(spark):
    d = documents(spark)
    model = kneser_ney.train(d, shards=4)
    want = sorted(map(tuple, kneser_ney.score(d, model).collect()), key=str)
    for name, entries, kinds in (("pairs", model.pairs, kneser_ney.PAIRS), ("words", model.words, kneser_ney.WORDS)):
        shard = int(np.argmax(entries))
        path = f"{model.folder}/{name}-{shard}"
        raw = open(path, "rb").read()
        for broken in (None, raw[:-1], b""):
            os.remove(path)
            if broken is not None:
                with open(path, "wb") as f:
                    f.write(broken)
            reader = kneser_ney.Reader(model)
            with pytest.raises((OSError, ValueError)):
                reader.arrays(f"{name}-{shard}", int(entries[shard]), kinds)
            with open(path, "wb") as f:
                f.write(raw)
    os.remove(path)
    with pytest.raises(Exception, match="No such file"):
        kneser_ney._readers.clear()
        kneser_ney.score(d.where("doc_id = 8"), kneser_ney.Model(model.folder + "/", model.pairs, model.words, model.totals)).collect()
    assert len(want) == d.count()


def test_the_number_of_shards_and_maps_changes_nothing(spark, monkeypatch):
    d = documents(spark).repartition(3)
    texts = [[w.encode() for w in (r["text"] or "").lower().split()] for r in d.where("doc_id < 8").collect()]
    scores = []
    for shards in (1, 7, 200):
        model = kneser_ney.train(d, shards=shards)
        assert len(model.pairs) == shards and model.pairs.sum() == model.totals["pairs"]
        assert len(glob.glob(f"{model.folder}/pairs-*")) == (model.pairs > 0).sum()
        scores.append(kneser_ney.Reader(model).score(texts))
    monkeypatch.setattr(kneser_ney, "MAPS", 2)
    scores.append(kneser_ney.Reader(model).score(texts))
    for other in scores[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(scores[0], other, strict=True))


def test_edges_split_keys_of_any_number_of_shards():
    for n in (1, 2, 3, 65_537, 200_000):
        e = kneser_ney._edges(n)
        assert len(e) == n - 1 and (np.diff(e.astype(object)) > 0).all()


def test_no_documents(spark):
    model = kneser_ney.train(documents(spark))
    assert kneser_ney.score(empty(spark), model).count() == 0
    assert kneser_ney.train(empty(spark)).totals["tokens"] == 0


def test_slices_follow_the_leading_bits_of_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    keys = np.concatenate([np.array([0], np.uint64), keys, np.array([2**64 - 1], np.uint64)])
    for n in (1, 3, 7, 64, 100_003, 2**31 - 1):
        got = list(kneser_ney._slices(keys, n))
        want = [int(k) * n >> 64 for k in keys]
        assert [k for k, _, _ in got] == sorted(set(want))
        assert all(want[i] == k for k, a, b in got for i in range(a, b)) and got[0][1] == 0 and got[-1][2] == len(keys)
        if n < 10**6:
            edges = kneser_ney._edges(n)
            assert all(np.searchsorted(edges, keys[a], "right") == k for k, a, _ in got)
        assert all(x[2] == y[1] for x, y in zip(got, got[1:], strict=False))
    assert list(kneser_ney._slices(keys[:0], 5)) == []


def test_two_levels_write_the_same_model(spark):
    d = documents(spark).repartition(5)
    one, pairs, both = (kneser_ney.train(d, shards=16, fan=f) for f in (1000, 4, 3))  # one level; two for pairs; two for words too
    assert [kneser_ney.levels(n, f) for f in (4, 3) for n in (16, 4)] == [(16, 4), (4, 1), (16, 4), (4, 2)]
    for two in (pairs, both):
        assert one.totals == two.totals
        for name in ("pairs", "words"):
            assert getattr(one, name).tolist() == getattr(two, name).tolist()
            for k in np.flatnonzero(getattr(one, name)):
                assert open(f"{one.folder}/{name}-{k}", "rb").read() == open(f"{two.folder}/{name}-{k}", "rb").read()
    assert kneser_ney.train(empty(spark), shards=16, fan=3).totals["tokens"] == 0


def test_rows_of_two_levels_grow_with_the_power_one_and_a_half():
    for shards in (4096, 100_000, 1_600_000):
        found, ranges = kneser_ney.levels(shards, 2048)
        assert shards <= found < shards * 1.05 and ranges * ranges >= shards and found % ranges == 0
        assert max(ranges, found // ranges) <= 2 * shards**0.5
    assert kneser_ney.levels(2048, 2048) == (2048, 1)
