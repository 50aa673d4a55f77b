"""Unpacking of quantised tensors: numpy kernels, and Arrow UDFs over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The eight magnitudes of e2m1, and the sixteen levels of the non-linear 4-bit code.
E2M1 = np.array([0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0], np.float32)
NONLINEAR_4BIT = np.array([-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113], np.float32)
E2M1_TABLE = np.concatenate([E2M1, -E2M1])


def bf16_to_float32(raw: bytes) -> np.ndarray:
    """Exact: the 16 bits are the upper half of a float32."""
    return (np.frombuffer(raw, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)


def float32_to_bf16(x: np.ndarray) -> np.ndarray:
    """Round to nearest, half to even, on the bits."""
    b = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return ((b + np.uint32(0x7FFF) + ((b >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)).astype(np.uint16)


def unpack_bits(raw: bytes, bits: int, count: int) -> np.ndarray:
    """``count`` codes of ``bits`` bits each, from a little-endian bit stream."""
    stream = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    if len(stream) < bits * count:
        raise ValueError(f"{len(raw)} bytes hold fewer than {count} codes of {bits} bits")
    return (stream[: bits * count].reshape(count, bits) @ (1 << np.arange(bits))).astype(np.int64)


def affine(codes: np.ndarray, scales: np.ndarray, biases: np.ndarray, group: int) -> np.ndarray:
    """code * scale + bias, one scale and bias per group of neighbours."""
    g = codes.reshape(-1, group).astype(np.float32)
    return (g * scales[:, None].astype(np.float32) + biases[:, None].astype(np.float32)).ravel()


def e2m1(raw: bytes, scales: np.ndarray, group: int = 16, global_scale: float = 1.0, inverse: bool = False) -> np.ndarray:
    """Two codes a byte, low nibble first; the global scale multiplies, or divides where it is stored inverted."""
    b = np.frombuffer(raw, np.uint8)
    values = E2M1_TABLE[np.stack([b & 15, b >> 4], axis=1).ravel()]
    whole = np.float32(1.0 / global_scale if inverse else global_scale)
    return (values.reshape(-1, group) * (scales[:, None].astype(np.float32) * whole)).ravel()


def _small_float(exponent: int, mantissa: int, bias: int, finite: bool) -> np.ndarray:
    """All 256 values of a one-byte float with a sign bit."""
    code = np.arange(256)
    e, m = (code >> mantissa) & ((1 << exponent) - 1), code & ((1 << mantissa) - 1)
    value = np.where(e == 0, m * 2.0 ** (1 - bias - mantissa), (1 + m / 2.0**mantissa) * 2.0 ** (e - bias))
    if finite:
        value = np.where((code & 0x7F) == 0x7F, np.nan, value)
    return np.where(code >> 7, -value, value).astype(np.float32)


E4M3 = _small_float(4, 3, 7, True)
E8M0 = np.where(np.arange(256) == 255, np.nan, 2.0 ** (np.arange(256) - 127.0))


def fp8_blocks(raw: bytes, shape: tuple[int, int], scales: np.ndarray, block: int = 128) -> np.ndarray:
    """e4m3 codes times their block's scale, one float32 product each; blocks at the edges may be partial."""
    w = E4M3[np.frombuffer(raw, np.uint8).reshape(shape)]
    full = np.repeat(np.repeat(scales.astype(np.float32), block, 0), block, 1)[: shape[0], : shape[1]]
    if full.shape != w.shape:
        raise ValueError("the scales don't cover the tensor")
    return w * full


def mx_blocks(raw: bytes, scales: bytes, block: int = 32) -> np.ndarray:
    """One-byte floats times a power of two for each block, rounded to bfloat16; the bits."""
    own = E8M0[np.frombuffer(scales, np.uint8)]
    values = E4M3[np.frombuffer(raw, np.uint8)].reshape(-1, block).astype(np.float64) * own[:, None]
    return float32_to_bf16(values.ravel().astype(np.float32))


def q8_0(raw: bytes) -> np.ndarray:
    """Blocks of 32: a half-precision scale and 32 signed bytes."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, 34)
    d = b[:, :2].copy().view(np.float16).astype(np.float32)
    return (d * b[:, 2:].copy().view(np.int8).astype(np.float32)).ravel()


def _sixbit_pairs(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight scales and eight minimums of six bits each, from twelve bytes."""
    p = packed.astype(np.int64)
    low_s, low_m, mixed = p[:, 0:4], p[:, 4:8], p[:, 8:12]
    scales = np.concatenate([low_s & 63, (mixed & 15) | (low_s >> 6) << 4], axis=1)
    mins = np.concatenate([low_m & 63, (mixed >> 4) | (low_m >> 6) << 4], axis=1)
    return scales, mins


def q4_k(raw: bytes) -> np.ndarray:
    """Superblocks of 256: scale and minimum in half precision, eight six-bit pairs, 4-bit codes."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, 144)
    d, dmin = (b[:, i : i + 2].copy().view(np.float16).astype(np.float32) for i in (0, 2))
    s, m = _sixbit_pairs(b[:, 4:16])
    q = b[:, 16:].reshape(-1, 4, 32)
    codes = np.stack([q & 15, q >> 4], axis=2).reshape(-1, 8, 32).astype(np.float32)
    return ((d * s)[:, :, None].astype(np.float32) * codes - (dmin * m)[:, :, None].astype(np.float32)).ravel()


def q5_k(raw: bytes) -> np.ndarray:
    """As the 4-bit superblock, with a fifth bit of every code in a plane of 32 bytes."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, 176)
    d, dmin = (b[:, i : i + 2].copy().view(np.float16).astype(np.float32) for i in (0, 2))
    s, m = _sixbit_pairs(b[:, 4:16])
    high = (b[:, None, 16:48] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1
    q = b[:, 48:].reshape(-1, 4, 32)
    codes = (np.stack([q & 15, q >> 4], axis=2).reshape(-1, 8, 32) + 16 * high).astype(np.float32)
    return ((d * s)[:, :, None].astype(np.float32) * codes - (dmin * m)[:, :, None].astype(np.float32)).ravel()


def q3_k(raw: bytes) -> np.ndarray:
    """Superblocks of 256: two low bits a code, a plane of third bits that are stored inverted, sixteen six-bit scales around 32."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, 110)
    high, low, packed = b[:, :32], b[:, 32:96].reshape(-1, 2, 1, 32), b[:, 96:108].astype(np.int64)
    fourth = np.concatenate([packed[:, :8] & 15, packed[:, :8] >> 4], axis=1)
    top = (np.tile(packed[:, 8:], 4) >> np.repeat([0, 2, 4, 6], 4)) & 3
    s = (fourth | top << 4) - 32
    codes = ((low >> np.array([0, 2, 4, 6], np.uint8)[None, None, :, None]) & 3).reshape(-1, 8, 32).astype(np.float32)
    codes -= 4 * (((high[:, None, :] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1) == 0)
    d = b[:, 108:].copy().view(np.float16).astype(np.float32)
    return ((d * s)[:, :, None].astype(np.float32) * codes.reshape(-1, 16, 16)).ravel()


def q6_k(raw: bytes) -> np.ndarray:
    """Superblocks of 256: four low and two high bits a code, sixteen signed scales, one half-precision scale."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, 210)
    low, high = b[:, :128].reshape(-1, 2, 2, 32), b[:, 128:192].reshape(-1, 2, 1, 32)
    low = np.concatenate([low & 15, low >> 4], axis=2)
    high = (high >> np.array([0, 2, 4, 6], np.uint8)[None, None, :, None]) & 3
    codes = (low | high << 4).astype(np.float32).reshape(-1, 16, 16) - 32
    s = b[:, 192:208].copy().view(np.int8).astype(np.float32)
    d = b[:, 208:].copy().view(np.float16).astype(np.float32)
    return ((d * s)[:, :, None] * codes).ravel()


def iq4_xs(raw: bytes) -> np.ndarray:
    """Superblocks of 256 with non-linear levels: eight six-bit scales around 32."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, 136)
    d = b[:, :2].copy().view(np.float16).astype(np.float32)
    high = b[:, 2:4].copy().view(np.uint16).astype(np.int64)
    low = np.stack([b[:, 4:8] & 15, b[:, 4:8] >> 4], axis=2).reshape(-1, 8).astype(np.int64)
    s = (low | ((high >> (2 * np.arange(8))) & 3) << 4) - 32
    q = b[:, 8:].reshape(-1, 8, 16)
    codes = NONLINEAR_4BIT[np.concatenate([q & 15, q >> 4], axis=2)]
    return ((d * s)[:, :, None].astype(np.float32) * codes).ravel()


CODECS = {"F32": lambda r: np.frombuffer(r, "<f4"), "F16": lambda r: np.frombuffer(r, "<f2").astype(np.float32), "BF16": bf16_to_float32, "Q8_0": q8_0, "Q3_K": q3_k, "Q4_K": q4_k, "Q5_K": q5_k, "Q6_K": q6_k, "IQ4_XS": iq4_xs}


def decode(kind: str, raw: bytes) -> np.ndarray:
    if kind not in CODECS:
        raise ValueError(f"no decoder for tensor type {kind}")
    return CODECS[kind](raw)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decoded(kind: pd.Series, raw: pd.Series) -> pd.Series:
    """Values of packed tensors; a type without a decoder is refused."""
    return pd.Series([None if r is None else decode(k, r) for k, r in zip(kind, raw, strict=True)])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def affine_decoded(raw: pd.Series, bits: pd.Series, scales: pd.Series, biases: pd.Series, group: pd.Series) -> pd.Series:
    return pd.Series([affine(unpack_bits(r, int(b), len(s) * int(g)), np.asarray(s), np.asarray(z), int(g)) for r, b, s, z, g in zip(raw, bits, scales, biases, group, strict=True)])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def e2m1_decoded(raw: pd.Series, scales: pd.Series, whole: pd.Series, inverse: pd.Series) -> pd.Series:
    return pd.Series([e2m1(r, np.asarray(s), global_scale=float(w), inverse=bool(i)) for r, s, w, i in zip(raw, scales, whole, inverse, strict=True)])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def fp8_decoded(raw: pd.Series, rows: pd.Series, columns: pd.Series, scales: pd.Series, block: pd.Series) -> pd.Series:
    """A matrix of one-byte floats with a scale for each square block, row by row; blocks at the edges may be partial."""

    def one(r: bytes, n: int, m: int, s: list, b: int) -> np.ndarray:
        return np.asarray(fp8_blocks(r, (int(n), int(m)), np.asarray(s, np.float32).reshape(-(-int(n) // int(b)), -1), int(b))).ravel()

    return pd.Series([one(*x) for x in zip(raw, rows, columns, scales, block, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def mx_decoded(raw: pd.Series, scales: pd.Series) -> pd.Series:
    return pd.Series([mx_blocks(r, s).astype(np.int32) for r, s in zip(raw, scales, strict=True)])
