"""Trellis decoding against a bit-by-bit reader and a plain transform."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from tidemark.operators import trellis


def slow_states(raw: bytes) -> list[int]:
    rate = len(raw) * 8 // 256
    bits = "".join(f"{int.from_bytes(raw[i : i + 4], 'little'):032b}" for i in range(0, len(raw), 4))
    return [int("".join(bits[(p - 16 + k) % len(bits)] for k in range(16)), 2) for p in range(rate, len(bits) + 1, rate)]


def slow_value(state: int, rule: str) -> float:
    product = state * trellis.MULTIPLIER[rule] % 2**32
    if rule == "mul1":
        h, scale, bias = (np.array([x], np.uint16).view(np.float16)[0] for x in (0x6400 + sum(product.to_bytes(4, "little")), 0x1EEE, 0xC931))
        return float(np.float16(float(h) * float(scale) + float(bias)))
    product = (product & 0x8FFF8FFF) ^ 0x3B603B60
    low, high = (np.array([x], np.uint16).view(np.float16)[0] for x in (product & 0xFFFF, product >> 16))
    return float(low + high)


def slow_matrix(tiles: dict, rule: str, inputs, outputs) -> np.ndarray:
    m = np.zeros((128, 128))
    for (a, b), raw in tiles.items():
        at = 0
        for lane in range(32):
            for column in (lane // 4, lane // 4 + 8):
                for row in (0, 1, 8, 9):
                    m[16 * a + 2 * (lane % 4) + row, 16 * b + column] = slow_value(slow_states(raw)[at], rule)
                    at += 1
    h = np.ones((1, 1))
    while len(h) < 128:
        h = np.kron([[1, 1], [1, -1]], h)
    h /= np.sqrt(128)
    return (np.diag(inputs) @ h @ m @ h @ np.diag(outputs)).T


@pytest.mark.parametrize("rate", range(1, 9))
def test_states_of_every_rate(rate):
    rng = np.random.default_rng(rate)
    tiles = [rng.bytes(32 * rate) for _ in range(5)]
    assert trellis.states(tiles).tolist() == [slow_states(t) for t in tiles]


@pytest.mark.parametrize("rule", ["mul1", "mcg"])
def test_values_of_every_state(rule):
    every = np.arange(65536, dtype=np.uint16)
    got = trellis.values(every, rule)
    assert got.dtype == np.float16 and np.isfinite(got).all()
    some = every[::37]
    assert trellis.values(some, rule).tolist() == [slow_value(int(s), rule) for s in some]


def test_lanes_fill_a_tile_once():
    assert sorted(trellis.PLACES.tolist()) == list(range(256))


def tables(spark, tiles, blocks=((0, 0),)):
    t = spark.createDataFrame([("w", a, b, bytearray(raw)) for (a, b), raw in tiles.items()], "tensor string, input_tile int, output_tile int, packed binary")
    rng = np.random.default_rng(5)
    scales = {side: {k: rng.normal(size=128).astype(np.float32) for k in sorted({b[i] for b in blocks})} for i, side in enumerate(("in", "out"))}
    frames = [spark.createDataFrame([("w", k, v.tolist()) for k, v in scales[s].items()], "tensor string, block int, scales array<float>") for s in ("in", "out")]
    return t, *frames, scales


@pytest.mark.parametrize(("rule", "rate"), [("mul1", 3), ("mcg", 2)])
def test_matrix_of_two_blocks(spark, rule, rate):
    rng = np.random.default_rng(rate)
    tiles = {(a, b): rng.bytes(32 * rate) for a in range(8) for b in range(16)}
    t, i, o, scales = tables(spark, tiles, ((0, 0), (0, 1)))
    rows = trellis.decode(t, i, o, rule=rule).collect()
    assert len(rows) == 256 and {r["input_from"] for r in rows} == {0}
    got = np.zeros((256, 128))
    for r in rows:
        got[r["output"]] = r["values"]
    for k in (0, 1):
        want = slow_matrix({(a, b - 8 * k): raw for (a, b), raw in tiles.items() if b // 8 == k}, rule, scales["in"][0], scales["out"][k])
        assert np.allclose(got[128 * k : 128 * k + 128], want, rtol=1e-4, atol=1e-4)


def full(rate=1):
    return {(a, b): np.random.default_rng(9).bytes(32 * rate) for a in range(8) for b in range(8)}


@pytest.mark.parametrize(("broken", "message"), [("absent", "each of its 64 tiles"), ("repeated", "each of its 64 tiles"), ("null", "null"), ("mixed", "differ in their rate"), ("long", "no rate"), ("scales", "no scales"), ("rule", "no trellis rule")])
def test_broken_blocks_are_refused(spark, broken, message):
    tiles = full()
    if broken == "absent":
        del tiles[3, 4]
    if broken in ("mixed", "long"):
        tiles[3, 4] = bytes(64 if broken == "mixed" else 33)
    if broken == "long":
        tiles = dict.fromkeys(tiles, bytes(33))
    t, i, o, _ = tables(spark, tiles)
    if broken == "repeated":
        t = t.union(t.limit(1))
    if broken == "null":
        t = t.selectExpr("tensor", "input_tile", "output_tile", "IF(input_tile = 1 AND output_tile = 1, NULL, packed) AS packed")
    if broken == "scales":
        o = o.where("false")
    with pytest.raises(PythonException, match=message):
        trellis.decode(t, i, o, rule="other" if broken == "rule" else "mcg").collect()


def test_no_tiles_and_null_states(spark):
    t, i, o, _ = tables(spark, full())
    assert trellis.decode(t.where("false"), i, o).collect() == []
    assert spark.sql("SELECT CAST(NULL AS BINARY) AS b").select(trellis.state_list("b")).first()[0] is None
