"""Guarded updates: batch against a plain loop, stream against batch."""

import random

import pytest

from tidemark.operators import guarded as G
from tidemark.streaming import guarded as S

EVENTS = "key string, seq long, kind string, expected long, amount long"
CAP = 100


def histories():
    rng = random.Random(8)
    out = []
    for k in ("a", "b", "c"):
        for seq in range(1, 61):
            kind = rng.choice(["reserve", "reserve", "release", "touch"])
            out.append((k, seq, kind, rng.choice([None, None, None, seq - 1, rng.randrange(40)]), rng.choice([None, -1, *range(0, 60, 7)])))
    return out


def loop(events, cap=CAP):
    out, records = [], {}
    for k, seq, kind, expected, amount in sorted(events, key=lambda e: e[:2]):
        g, r, upto = records.get(k, (0, 0, 0))
        if seq == upto:
            out.append((k, seq, "repeated", g, r))
            continue
        if expected is not None and expected != g:
            v = "stale"
        elif kind != "touch" and (amount is None or amount < 0):
            v = "invalid"
        elif kind == "reserve" and r + amount > cap:
            v = "over the cap"
        elif kind == "release" and amount > r:
            v = "over-release"
        else:
            v, g = "applied", g + 1
            r += {"reserve": 1, "release": -1, "touch": 0}[kind] * (amount or 0)
        records[k] = (g, r, seq)
        out.append((k, seq, v, g, r))
    return sorted(out)


def test_batch_equals_a_loop(spark):
    events = [*histories(), *histories()[:50]]
    random.Random(1).shuffle(events)
    got = sorted(tuple(r) for r in G.folded(spark.createDataFrame([*events, (None, 1, "touch", None, 1), ("a", None, "touch", None, 1)], EVENTS), CAP).collect())
    assert got == loop(events) and {v for _, _, v, _, _ in got} == {"applied", "stale", "invalid", "over the cap", "over-release", "repeated"}
    assert G.folded(spark.createDataFrame([], EVENTS), CAP).collect() == []


@pytest.mark.parametrize("gap", [False, True])
def test_stream_agrees_with_batch(spark, tmp_path, gap):
    events = [e for e in histories() if not (gap and e[:2] == ("b", 20))]
    shuffled = [*events, *events[::9]]
    random.Random(2).shuffle(shuffled)
    for n in range(3):
        spark.createDataFrame(shuffled[n::3], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STORE)
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = S.guarded(stream, CAP, patience_ms=1_500).writeStream.outputMode("append").format("memory").queryName(f"guarded{int(gap)}").option("checkpointLocation", str(tmp_path / "ck")).start()
        want = sorted(r for r in loop(events) if r[2] != "repeated")
        for _ in range(240):
            got = sorted(tuple(r) for r in spark.table(f"guarded{int(gap)}").collect())
            if len([r for r in got if r[2] != "repeated"]) >= len(want):
                break
            assert q.exception() is None
            q.awaitTermination(0.5)
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [r for r in got if r[2] != "repeated"] == want
    assert len(got) - len(want) == len(events[::9])
