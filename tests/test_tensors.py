"""Tensor containers: what is read, how little of it, and what is refused; codecs against code by code loops."""

import hashlib
import json
import struct

import numpy as np
import pytest

from tidemark.functions import codecs
from tidemark.sources import tensors as T


def text(s):
    return struct.pack("<Q", len(s)) + s.encode()


def gguf(tensors, meta=(), version=3, offsets=None):
    """``tensors``: (name, shape, type, bytes); ``meta``: (key, type, packed value)."""
    head = b"GGUF" + struct.pack("<IQQ", version, len(tensors), len(meta)) + b"".join(text(k) + struct.pack("<I", t) + v for k, t, v in meta)
    at, data = 0, b""
    for n, (name, shape, kind, raw) in enumerate(tensors):
        head += text(name) + struct.pack("<I", len(shape)) + b"".join(struct.pack("<Q", x) for x in reversed(shape)) + struct.pack("<IQ", kind, at if offsets is None else offsets[n])
        data += raw + b"\0" * (-len(raw) % 32)
        at = len(data)
    return head + b"\0" * (-len(head) % 32) + data


def safetensors(head, data):
    raw = head if isinstance(head, bytes) else json.dumps(head).encode()
    return struct.pack("<Q", len(raw)) + raw + data


def opened(path):
    system, (f,) = T.listed(str(path))
    return T.Bytes(system, f)


VALUES = np.arange(4096 * 64, dtype="<f4").reshape(4096, 64)
META = [("general.name", 8, text("x")), ("general.alignment", 4, struct.pack("<I", 32)), ("list", 9, struct.pack("<IQ", 5, 3) + struct.pack("<3i", 1, -2, 3)), ("flag", 7, b"\1")]


@pytest.fixture
def folder(tmp_path):
    q8 = b"".join(np.float16(0.5).tobytes() + bytes(range(32)) for _ in range(4))
    (tmp_path / "a.gguf").write_bytes(gguf([("big", (4096, 64), 0, VALUES.tobytes()), ("q", (2, 64), 8, q8), ("odd", (3,), 99, b"12345678")], META))
    bf = (VALUES[:8].view("<u4") >> 16).astype("<u2")
    (tmp_path / "b.safetensors").write_bytes(safetensors({"__metadata__": {"k": "v"}, "h": {"dtype": "BF16", "shape": [8, 64], "data_offsets": [0, 1024]}, "none": {"dtype": "F32", "shape": [0, 4], "data_offsets": [1024, 1024]}}, bf.tobytes()))
    return tmp_path


def test_directory_and_metadata(spark, folder):
    T.register(spark)
    read = lambda kind: spark.read.format(kind).option("path", str(folder)).load()
    got = {r["tensor"]: (r["file"].rsplit("/", 1)[1], r["dtype"], r["shape"], r["bytes"]) for r in read("tensor_directory").collect()}
    assert got == {"big": ("a.gguf", "F32", [4096, 64], 1 << 20), "q": ("a.gguf", "Q8_0", [2, 64], 136), "odd": ("a.gguf", "type 99", [3], None), "h": ("b.safetensors", "BF16", [8, 64], 1024), "none": ("b.safetensors", "F32", [0, 4], 0)}
    meta = {r["key"]: json.loads(r["value"]) for r in read("tensor_metadata").collect()}
    assert meta == {"general.name": "x", "general.alignment": 32, "list": [1, -2, 3], "flag": True, "k": "v"}


def test_rows_through_spark(spark, folder):
    some = T.rows(spark, str(folder), ["big"], 250, 460, 100).orderBy("position").collect()
    assert [r["position"] for r in some] == list(range(250, 460)) and all(r["vec"] == VALUES[r["position"]].tolist() for r in some)
    q = T.rows(spark, str(folder), ["q"])
    assert q.count() == 2 and q.where("position = 1").first()["vec"] == [x / 2 for x in range(32)] * 2
    h = T.rows(spark, str(folder), ["h", "none"]).orderBy("position").collect()
    assert [r["vec"] for r in h] == codecs.bf16_to_float32((VALUES[:8].view("<u4") >> 16).astype("<u2").tobytes()).reshape(8, 64).tolist()
    with pytest.raises(Exception, match="can't be decoded"):
        T.rows(spark, str(folder)).collect()


def test_a_range_is_read_by_a_seek(folder):
    reader = T.RowsReader({"path": str(folder), "rows": "64", "tensors": '["big"]', "first": "1000", "last": "1100"})
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(1000, 1064), (1064, 1100)]
    with opened(folder / "a.gguf") as b:
        rows = list(reader.rows(parts[0].tensor, b, parts[0].first, parts[0].last))
        assert len(rows) == 64 and b.taken == 64 * 64 * 4
    with opened(folder / "a.gguf") as b:
        T.header(b)
        assert b.taken <= T.READ_AHEAD + 4 < b.size / 10


F32 = {"dtype": "F32", "shape": [1, 2], "data_offsets": [0, 8]}
BAD = {
    "magic": b"GGUX" + b"\0" * 40, "version": gguf([], version=1), "cut": gguf([("a", (4, 4), 0, b"\0" * 64)])[:-8], "header cut": gguf([("a", (4, 4), 0, b"\0" * 64)], META)[:60],
    "overlap": gguf([("a", (4, 4), 0, b"\0" * 64), ("b", (4, 4), 0, b"\0" * 64)], offsets=[0, 32]), "twice": gguf([("a", (2,), 0, b"\0" * 8), ("a", (2,), 0, b"\0" * 8)]), "key twice": gguf([], [META[0], META[0]]), "block": gguf([("a", (1, 33), 8, b"\0" * 34)]),
    "long header": struct.pack("<Q", 1000) + b"{}", "no json": safetensors(b"{x", b""), "name twice": safetensors(b'{"a": %s, "a": %s}' % ((json.dumps(F32).encode(),) * 2), b"\0" * 8), "shape": safetensors({"a": F32 | {"shape": [3, 2]}}, b"\0" * 8), "data cut": safetensors({"a": F32}, b"\0" * 7),
    "shared": safetensors({"a": F32, "b": F32 | {"data_offsets": [4, 12]}}, b"\0" * 12), "no offsets": safetensors({"a": {"dtype": "F32"}}, b""), "empty": b"",
}


@pytest.mark.parametrize("name", BAD)
def test_refused(tmp_path, name):
    (tmp_path / "x").write_bytes(BAD[name])
    with opened(tmp_path / "x") as b, pytest.raises(T.Refused, match="x"):
        T.header(b)


def test_split_sets_must_be_whole(tmp_path):
    part = lambda n, name: gguf([(name, (2,), 0, b"\0" * 8)], [("split.no", 2, struct.pack("<H", n)), ("split.count", 2, struct.pack("<H", 2))])
    (tmp_path / "m-00001-of-00002.gguf").write_bytes(part(0, "a"))
    with pytest.raises(T.Refused, match="of 2 files"):
        T.DirectoryReader({"path": str(tmp_path)}).partitions()
    (tmp_path / "m-00002-of-00002.gguf").write_bytes(part(1, "b"))
    assert len(T.DirectoryReader({"path": str(tmp_path)}).partitions()) == 2
    (tmp_path / "m-00002-of-00002.gguf").write_bytes(part(1, "a"))
    with pytest.raises(T.Refused, match="in two files"):
        T.DirectoryReader({"path": str(tmp_path)}).partitions()
    with pytest.raises(T.Refused, match="no such"):
        T.DirectoryReader({"path": str(tmp_path / "none")}).partitions()


def test_base_of_log_probabilities(spark, tmp_path):
    (tmp_path / "k").write_bytes(b"_logits_" + struct.pack("<Iii", 4, 10, 2) + struct.pack("<8i", *range(8)) + b"\0" * 64)
    T.register(spark)
    rows = spark.read.format("kld_base").option("path", str(tmp_path / "k")).load().orderBy("chunk", "position").collect()
    assert [tuple(r)[1:] for r in rows] == [(k // 4, k % 4, k, k % 4 >= 2) for k in range(8)]
    (tmp_path / "k").write_bytes(b"_logits_" + struct.pack("<Iii", 4, 10, 2) + b"\0" * 20)
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("kld_base").option("path", str(tmp_path / "k")).load().collect()


def test_digests_of_file_payload_and_tensor(spark, folder, monkeypatch):
    T.register(spark)
    got = {r["tensor"]: tuple(r)[2:] for r in spark.read.format("tensor_digests").option("path", str(folder)).load().collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for name in ("a.gguf", "b.safetensors"):
        raw = (folder / name).read_bytes()
        with opened(folder / name) as b:
            tensors = [t for t in T.header(b)[1] if t.bytes is not None]
        begin = min(t.offset for t in tensors)
        for t in tensors:
            assert got[t.name] == (sha(raw), sha(raw[begin:]), sha(raw[t.offset : t.offset + t.bytes]))
    monkeypatch.setattr(T, "STEP", 1000)
    (path,) = T.listed(str(folder / "a.gguf"))[1]
    assert {r[1]: r[2:] for r in T.DigestReader({"path": str(folder)}).read(T.File(path))} == {k: got[k] for k in ("big", "q")}


def half(raw, at):
    return np.float64(np.frombuffer(raw[at : at + 2], np.float16)[0])


def slow_q3(raw):
    out = []
    for b in (raw[i : i + 110] for i in range(0, len(raw), 110)):
        for e in range(256):
            n, j, lane = e // 128, e // 32 % 4, e % 32
            code = (b[32 + 32 * n + lane] >> 2 * j & 3) - (0 if b[lane] >> (4 * n + j) & 1 else 4)
            g = e // 16
            s = (b[96 + g] & 15 if g < 8 else b[96 + g - 8] >> 4) | (b[104 + g % 4] >> 2 * (g // 4) & 3) << 4
            out.append(half(b, 108) * (s - 32) * code)
    return out


def six_bits(s, g):
    return (s[g] & 63, s[g + 4] & 63) if g < 4 else (s[g + 4] & 15 | s[g - 4] >> 6 << 4, s[g + 4] >> 4 | s[g] >> 6 << 4)


def slow_q5(raw):
    out = []
    for b in (raw[i : i + 176] for i in range(0, len(raw), 176)):
        for e in range(256):
            g, lane = e // 32, e % 32
            scale, least = six_bits(b[4:16], g)
            code = (b[48 + 32 * (g // 2) + lane] >> 4 * (g % 2) & 15) + (b[16 + lane] >> g & 1) * 16
            out.append(half(b, 0) * scale * code - half(b, 2) * least)
    return out


def slow_iq4(raw):
    out = []
    for b in (raw[i : i + 136] for i in range(0, len(raw), 136)):
        high = b[2] | b[3] << 8
        for e in range(256):
            g, lane = e // 32, e % 32
            s = (b[4 + g // 2] >> 4 * (g % 2) & 15) | (high >> 2 * g & 3) << 4
            code = b[8 + 16 * g + lane % 16] >> 4 * (lane // 16) & 15
            out.append(half(b, 0) * (s - 32) * float(codecs.NONLINEAR_4BIT[code]))
    return out


@pytest.mark.parametrize(("kind", "size", "halves", "slow"), [("Q3_K", 110, [108], slow_q3), ("Q5_K", 176, [0, 2], slow_q5), ("IQ4_XS", 136, [0], slow_iq4)])
def test_codecs_equal_loops(kind, size, halves, slow):
    blocks = np.random.default_rng(size).integers(0, 256, (5, size), dtype=np.uint8)
    for at in halves:
        blocks[:, at : at + 2] = np.frombuffer(np.float16([0.25, 0.5, 0.125, 1, 2]).tobytes(), np.uint8).reshape(5, 2)
    raw = blocks.tobytes()
    assert np.allclose(codecs.CODECS[kind](raw), slow(raw), rtol=1e-6, atol=1e-6)


def test_fp8_blocks_with_partial_edges():
    raw = bytes(np.random.default_rng(3).integers(0, 120, 6 * 5, dtype=np.uint8))
    scales = np.array([[2.0, 3.0], [0.5, 1.0]], np.float32)
    got = codecs.fp8_blocks(raw, (6, 5), scales, block=4).reshape(6, 5)
    assert all(got[i, j] == codecs.E4M3[raw[i * 5 + j]] * scales[i // 4, j // 4] for i in range(6) for j in range(5))


def test_power_of_two_scales_round_to_bfloat16():
    raw, scales = bytes(range(0, 64)), bytes([130, 120])
    got = codecs.mx_blocks(raw, scales)
    want = [float(codecs.E4M3[c]) * 2.0 ** (scales[i // 32] - 127) for i, c in enumerate(raw)]
    assert codecs.bf16_to_float32(got.tobytes()).tolist() == want
    assert codecs.bf16_to_float32(codecs.mx_blocks(bytes([0x38] * 32), bytes([255])).tobytes()).tolist() != [1.0] * 32
