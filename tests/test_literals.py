"""Literals against a plain search; documents against Python's own JSON."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import documents as J
from tidemark.functions import text as T
from tidemark.operators import literals as L


def plain(text, words):
    if text is None:
        return None, []
    spans = sorted((i, i + len(w)) for w in words for i in range(len(text)) if text.startswith(w, i))
    out = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    new, at = "", 0
    for a, b in out:
        new += text[at:a] + T.REDACTED
        at = b
    return new + text[at:], [tuple(s) for s in out]


@pytest.mark.parametrize("each", [100_000, 7])
def test_overlaps_nesting_and_unicode(spark, each):
    rng = random.Random(5)
    words = ["abababab", "babababa", "abababababab", "näive-Ünï", "💡secret💡key", "line\nbreak1", "short"] + ["".join(rng.choice("ab") for _ in range(9)) for _ in range(20)]
    texts = ["".join(rng.choice("ab") for _ in range(300)), "x näive-Ünï💡secret💡keyline\nbreak1 short", "", None, "abababab" * 50, "näive-Ünïnäive-Ünï"]
    d = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)] + [(0, texts[0], None)], "id long, text string, more array<long>")
    files = L.registered(spark.createDataFrame([(w,) for w in [*words, *words, None]], "w string"), "w", each=each)
    assert len(files) > 1 or each > 7
    for r in L.redacted(d, "text", files).collect():
        assert (r["text"], [tuple(s) for s in r["spans"]]) == plain(texts[r["id"]], [w for w in words if len(w) >= 8])
    assert L.redacted(d.limit(0), "text", files).collect() == []
    assert {len(r["spans"]) for r in L.redacted(d, "text", L.registered(spark.createDataFrame([], "w string"), "w")).collect()} == {0}


def test_a_hundred_thousand_literals_in_one_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = random.Random(1)
    real = [t[i : i + 30] for t in texts.values() if t and len(t) > 200 for i in [rng.randrange(len(t) - 30)]]
    made = spark.range(100_000).select(F.sha2(F.col("id").cast("string"), 256).alias("w"))
    files = L.registered(made.unionByName(spark.createDataFrame([(w,) for w in real], "w string")), "w")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in L.redacted(docs, "text", files).collect()}
    some = random.Random(2).sample(sorted(texts), 40)
    for k in some:
        t, spans = texts[k] or "", []
        for w in set(real):
            i = t.find(w)
            while i >= 0:
                spans.append((i, i + len(w)))
                i = t.find(w, i + 1)
        assert got[k] == L.merged(spans)
    assert sum(map(len, got.values())) >= len(set(real))


def test_paths_and_names(spark):
    names = ["a/.ssh/x", ".ssh", "x/id_rsa", "id_rsa.pub", "k.pem", "a.pem/b", ".git/config", "tokens/context.json", "tokenizer.json", ".env", "b.env", "pills"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(T.credential_name(F.col("n"))).collect()]
    assert got == [True, True, True, False, True, False, True, False, False, True, False, False]
    texts = ["see /home/me", "C:\\Users\\me", "c:\\\\Users\\\\me", '"\\/tmp\\/x"', "file:///x", "/homes", "a/tmp", "/var/tmp/x", None]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(texts)], "i int, n string").orderBy("i").select(T.private_path(F.col("n"))).collect()]
    assert got == [True, True, True, True, True, False, False, True, None]


def tree(rng, depth=0):
    kind = rng.randrange(8 if depth < 5 else 5)
    if kind < 5:
        return [None, True, rng.randrange(-(10**20), 10**20), rng.choice([1e-5, 1e22, 0.1, -0.0, 5e-324, 1.5]), rng.choice(["é\u2028", '"\\', "💡", "/abs", "~x", "a\\b", ""])][kind]
    if kind == 5:
        return [tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["b", "a", "ä", "path", "corpus", "Z", "model_path"]): tree(rng, depth + 1) for _ in range(rng.randrange(5))}


def test_canonical_equals_plain_json(spark):
    rng = random.Random(3)
    values = [tree(rng) for _ in range(300)]
    d = spark.createDataFrame([(i, json.dumps(v, indent=i % 3, ensure_ascii=bool(i % 2))) for i, v in enumerate(values)], "i int, t string")
    for r in d.select("i", J.canonical(F.col("t")).alias("c"), J.stripped(F.col("t")).alias("s")).collect():
        assert r["c"]["json"] == json.dumps(values[r["i"]], sort_keys=True, separators=(",", ":"), ensure_ascii=False) and r["c"]["refused"] is None
        assert "/abs" not in json.dumps([v for k, v in pairs(json.loads(r["s"]["json"])) if k in J.HOST_FIELDS])
    bad = spark.createDataFrame([(t,) for t in ['{"a": NaN}', "[-Infinity]", "{", None]], "t string").select(J.canonical(F.col("t")).alias("c")).collect()
    assert all(r["c"]["json"] is None for r in bad) and [r["c"]["refused"] is None for r in bad] == [False, False, False, True]


def pairs(v):
    if isinstance(v, dict):
        for k, x in v.items():
            yield k, x if not isinstance(x, (dict, list)) else None
            yield from pairs(x)
    elif isinstance(v, list):
        for x in v:
            yield from pairs(x)


def test_removed_paths_are_named_and_seals_hold(spark):
    value, gone = J.without_host_paths({"path": "/x", "a": [{"corpus": "~c"}, {"corpus": "c"}], "b": {"model_path": "d\\e", "name": "/kept"}})
    assert value == {"path": None, "a": [{"corpus": None}, {"corpus": "c"}], "b": {"model_path": None, "name": "/kept"}} and gone == ["path", "a[].corpus", "b.model_path"]
    doc = {"z": 1, "a": [0.5, "é"], "seal": ""}
    doc["seal"] = hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    texts = [json.dumps(doc), json.dumps(doc | {"z": 2}), "[1]", "{", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(J.sealed(F.col("t"), "seal")).collect()
    assert [r[0] for r in got] == [True, False, None, None, None]
