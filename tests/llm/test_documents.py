"""Operators on documents against plain Python, and their defined results in awkward cases."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import best_fit, decontaminate, kneser_ney, quality_knn, quality_rules, simhash, toxicity

from .fixtures import documents, empty, prose

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return "".join(c.lower() if c < "\x80" else c for c in x or "")


# --- quality rules --------------------------------------------------------------------------


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_base_counts_and_verdicts(spark):
    d = documents(spark).union(spark.createDataFrame([(50, "a b\na b\n\n \nc # * é", "en", "s", None, 1, "", None, 1), (51, " ".join(f"%%% w{i}###" for i in range(200)), "en", "s", None, 1, "", None, 1)], documents(spark).schema))
    got = quality_rules.judge(d).collect()
    rows = {(r["doc_id"], r["n_words"]) for r in got}
    assert len(got) == d.count()
    by = {}
    for r in d.collect():
        by.setdefault(r["doc_id"], base(r["text"]))
    for r in got:
        want = by[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[1] and kept[2] and not kept[51] and (4, 0) in rows


def test_distance_is_a_metric_of_shares():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert quality_rules.distance(p, p) == 0
    assert abs(float(quality_rules.distance(p, q)) - 0.5**0.5) < 1e-12
    assert abs(float(quality_rules.distance(np.array([1.0, 0]), np.array([0, 1.0]))) - 1) < 1e-12


def test_repeated_words_on_many_distinct_words_uses_the_wide_path():
    words = [str(i).encode() for i in range((1 << 20) + 10)]
    assert quality_rules.repeated_words([*words, b"0", b"1", b"2"]) == 6


# --- packing --------------------------------------------------------------------------------


def check_packing(rows, docs, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    want = Counter()
    for r in docs:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.asarray(ids[a : a + capacity], "<u4")
            want[(r["doc_id"], k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def best_fit_brute(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_matches_brute_force(spark, capacity):
    d = documents(spark).repartition(3)
    rows = best_fit.pack(d, TOKENIZER, capacity=capacity).collect()
    assert check_packing(rows, d.collect(), capacity) == best_fit_brute([r["length"] for r in rows], capacity)


def test_plan_equals_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for capacity in (10, 37, 100):
        for _ in range(30):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 200)).tolist()
            p = best_fit.plan(dict(Counter(lengths)), capacity)
            assert len({b for row, nxt in zip(p, [*p[1:], None], strict=True) for b in [row[2]]}) <= len(lengths)
            n = Counter(lengths)
            used = {}
            for i, (length, rank, first, offset) in enumerate(p):
                stop = p[i + 1][1] if i + 1 < len(p) and p[i + 1][0] == length else n[length]
                for k in range(stop - rank):
                    used.setdefault(int(first + k), []).append((int(offset), int(length)))
            for parts in used.values():
                at = 0
                for offset, size in sorted(parts):
                    assert offset == at
                    at += size
                assert at <= capacity
            assert len(used) == best_fit_brute(lengths, capacity)


def test_word_by_word_encoding_equals_whole_texts():
    e = best_fit.WordEncoder(TOKENIZER)
    texts = ["<|endoftext|> I'LL don't x\u00a0y \u0130\u0301 \u03a3\u03c3\u03a3 e\u0301 \u4e2d\u6587 12,5!! a\u0085b \x1c", "", "Ünï'S ß-ß ...", prose(3, 500)]
    split = [t.encode().split() for t in texts]
    e.learn(split)
    for t, s in zip(texts, split, strict=True):
        assert np.frombuffer(e.ids(s), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


# --- SimHash --------------------------------------------------------------------------------


def brute_fp(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("crowd", [1, 256])
def test_simhash_matches_brute_force(spark, crowd):
    near = [(100 + i, prose(9, 400).replace("river", f"river{i}", 1)) for i in range(6)]
    d = documents(spark).select("doc_id", "text").where("doc_id IS NULL OR doc_id < 11").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = d.collect()
    fps = [brute_fp(r["text"]) for r in rows]
    roots = components(fps, 2)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, roots, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(d, crowd=crowd).collect())) == want


def test_links_are_complete_for_any_allotment(spark):
    rng = np.random.default_rng(4)
    base_fps = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(x) for x in base_fps}
    for x in base_fps[:25]:
        for _ in range(4):
            a, b = rng.integers(0, 63, 2)
            fps.add(int(x) ^ (1 << int(a)) ^ (1 << int(b)))
    fps = sorted(fps)
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = components([f % (1 << 64) for f in fps], 2)
    bits = list(range(64))
    for parts in ([(bits[:21], 0), (bits[21:42], 0), (bits[42:], 0)], [(bits[:32], 1), (bits[32:], 0)], [(bits[:60], 2)][:0] or [(bits[:20], 1), (bits[20:], 0)]):
        for crowd in (2, 256):
            named = {r["node"]: r["root"] for r in simhash.components(simhash.links(d, parts, 2, crowd)).collect()}
            got = [named.get(f, f) for f in fps]
            assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_allotment_keeps_the_pigeonhole_sum():
    for n in (10, 10**6, 10**10):
        parts = simhash.allot(n, np.full((64, 64), n // 4) + np.diag([n // 4] * 64), list(range(64)), 2)
        dropped = 64 - sum(len(b) for b, _ in parts)
        assert sum(t for _, t in parts) >= 2 - len(parts) + 1 - (dropped > 0) and sum(t + 1 for _, t in parts) == 3


def test_one_representative_of_each_component(spark):
    d = documents(spark)
    near = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(d).collect()}
    got = simhash.representatives(d)
    assert got.columns == d.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(ids, key=str) == sorted({c for _, c in near}, key=str)


# --- decontamination ------------------------------------------------------------------------


def bench(spark):
    return spark.createDataFrame([(1, prose(21, 40)), (2, "short item of five words"), (3, None), (4, "")], "item_id long, text string")


def test_contamination_finds_whole_partial_and_substituted_passages(spark):
    w = prose(21, 40).split()
    swapped = [f"other{i}" if i % 6 == 5 else x for i, x in enumerate(w)]
    docs = [(1, prose(30, 50) + " " + " ".join(w) + " " + prose(31, 50)), (2, "zz yy " + " ".join(w[10:30]).upper()), (3, prose(32, 300)), (4, "a " + " ".join(swapped)), (5, None), (6, ""), (7, "Short item  of five\nwords indeed"), (8, "yy " + " ".join(w[:9]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (1, 20_000):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, bench(spark), block_items=block).collect()}
        assert set(got) == {(1, 1), (2, 1), (4, 1), (7, 2)}
        assert (got[1, 1]["position"], got[1, 1]["n_tokens"], got[1, 1]["n_equal"]) == (50, 40, 40)
        assert {r["doc_id"] for r in decontaminate.clean(d, bench(spark), block_items=block).collect()} == {3, 5, 6, 8}


# --- classifiers ----------------------------------------------------------------------------


def labelled(spark):
    rows = [(i, prose(i, 60 + i % 50) + (" vile wretch vile toad" * (1 + i % 3) if i % 4 == 0 else ""), 1 - int(i % 5 == 0), int(i % 4 == 0)) for i in range(1, 240)]
    rows = [(i, "### $$$ %%% " * 40 if not q else t, q, x) for i, t, q, x in rows]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")


def test_quality_votes_on_held_out_rows(spark):
    d, labels = labelled(spark)
    space = quality_knn.learn(d, labels, ~(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0))
    r = quality_knn.score(d, space).join(labels, "doc_id").where(quality_knn.held_out()).collect()
    assert len(r) > 20 and all(0 <= x["score"] <= 1 for x in r)
    assert np.mean([x["predicted"] == x["quality"] for x in r]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    d, labels = labelled(spark)
    clean = d.join(labels.where("quality = 1"), "doc_id", "left_semi")
    model = toxicity.learn(clean, labels, ~(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2))
    r = toxicity.score(clean, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert len(r) > 20 and np.mean([x["predicted"] == x["toxic"] for x in r]) > 0.9
    assert toxicity.accepted(clean, model).count() < clean.count()


def test_classifiers_without_labels_score_zero(spark):
    d, labels = documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_knn.score(d, quality_knn.learn(d, labels, F.lit(True))).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(d, toxicity.learn(d, labels, F.lit(True))).collect()} == {0.0}
    assert toxicity.accepted(d, None).count() == d.count()


def test_scores_of_awkward_texts_are_defined(spark):
    d, labels = labelled(spark)
    x = documents(spark)
    for module, col in ((quality_knn, "quality"), (toxicity, "toxic")):
        model = module.learn(d, labels, F.lit(True))
        got = module.score(x, model).collect()
        assert len(got) == x.count() and all(0 <= r["score"] <= 1 for r in got)


# --- language model -------------------------------------------------------------------------


def test_kneser_ney_matches_brute_force_and_sums_to_one(spark):
    import math

    d = documents(spark)
    train = d.where("doc_id IS NULL OR doc_id <> 2").repartition(3)
    model = kneser_ney.train(train, shards=5)
    toks = lambda t: WORD.findall(lower(t)) + ["\n"]
    uni, bi = Counter(), Counter()
    for r in train.collect():
        t = toks(r["text"])
        uni.update(t)
        bi.update(zip(["\t", *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    ctx, cont, follow = Counter(), Counter(), {}
    for (a, b), c in bi.items():
        ctx[a] += c
        cont[b] += 1
        follow.setdefault(a, [0, 0, 0])[min(c, 3) - 1] += 1
    nn, mm = Counter(bi.values()), Counter(cont.values())
    d2, d1 = (kneser_ney.discounts(*(x[k] for k in (1, 2, 3, 4))) for x in (nn, mm))
    g1 = sum(d1[min(c, 3)] for c in cont.values()) / len(bi)

    def p(a, b):
        low = max(cont[b] - d1[min(cont[b], 3)], 0) / len(bi) + g1 / (v + 1)
        if a not in ctx:
            return low
        c = bi[a, b]
        return max(c - d2[min(c, 3)], 0) / ctx[a] + sum(x * y for x, y in zip(d2[1:], follow[a], strict=True)) / ctx[a] * low

    for a in ("the", "\t", "nowhere"):
        assert abs(sum(p(a, b) for b in uni) + p(a, "an unknown word") - 1) < 1e-9
    texts = Counter(r["text"] for r in d.collect())
    want = Counter()
    for t, k in texts.items():
        x = toks(t)
        want[(len(x), sum(uni[b] > 0 for b in x), n, round(sum(math.log10((uni[b] + 0.1) / (n + 0.1 * (v + 1))) for b in x), 5), round(sum(math.log10(p(a, b)) for a, b in zip(["\t", *x[:-1]], x, strict=True)), 5))] += k
    got = Counter((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in kneser_ney.score(d, model).collect())
    assert got == want


def test_model_of_nothing(spark):
    model = kneser_ney.train(empty(spark))
    assert {(r["train_tokens"], r["base_score"], r["score"]) for r in kneser_ney.score(documents(spark).limit(2), model).collect()} == {(0, 0.0, 0.0)}


def test_empty_tables_give_no_rows(spark):
    e, labels = empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(e).count() == 0 and quality_rules.accepted(e).count() == 0
    assert best_fit.pack(e, TOKENIZER).count() == 0
    assert simhash.near_duplicates(e).count() == 0 and simhash.representatives(e).count() == 0
    assert decontaminate.contaminated(e, bench(spark)).count() == 0
    assert decontaminate.contaminated(documents(spark), bench(spark).limit(0)).count() == 0
    assert quality_knn.score(e, quality_knn.learn(e, labels, F.lit(True))).count() == 0
