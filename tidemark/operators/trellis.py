"""Trellis-coded tensors: tiles of 256 values whose states are overlapping windows of one cyclic bit stream.

A tile covers 16 x 16 values at a rate of 1 to 8 bits.  Value j's state is the 16 bits of the stream that
end where its own bits end, so neighbours share all but ``rate`` bits.  A rule turns states into values, a
lane order puts them in place, and blocks of 8 x 8 tiles are turned by 128-point Hadamard transforms on both
sides, with a scale for each input and output.  A block needs nothing outside of itself, so the job is one
shuffle by block, and no task holds more than a block's 64 tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE, SIDE, BLOCK = 256, 16, 128
PER_BLOCK = BLOCK // SIDE

# Fixed values of the two rules: multipliers; mask and pattern of the second; scale and bias of the first as half-floats.
MULTIPLIER = {"mul1": 0x83DCD12D, "mcg": 0xCBAC1FED}
MCG_MASK, MCG_PATTERN = 0x8FFF8FFF, 0x3B603B60
MUL1_SCALE, MUL1_BIAS = 0x1EEE, 0xC931


def rate_of(raw: bytes) -> int:
    """Bits a value of a packed tile."""
    rate, rest = divmod(len(raw) * 8, TILE)
    if rest or not 1 <= rate <= 8:
        raise ValueError(f"a tile of {len(raw)} bytes has no rate from 1 to 8")
    return rate


def states(tiles: list[bytes]) -> np.ndarray:
    """The 256 states of each of ``tiles``, which share one rate: 16 bits cut from two neighbouring 32-bit words."""
    rate = rate_of(tiles[0])
    if any(len(t) != len(tiles[0]) for t in tiles):
        raise ValueError("tiles of one tensor differ in their rate")
    words = np.frombuffer(b"".join(tiles), "<u4").reshape(len(tiles), -1).astype(np.uint64)
    two = (np.roll(words, 1, axis=1) << np.uint64(32)) | words
    end = rate * np.arange(1, TILE + 1)
    at = (end - 1) // 32
    return ((two[:, at] >> (32 * (at + 1) - end).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def _half(bits) -> np.ndarray:
    return np.asarray(bits, np.uint16).view(np.float16)


def values(state: np.ndarray, rule: str) -> np.ndarray:
    """Half-float values of 16-bit states: ``mul1`` sums a product's bytes, ``mcg`` adds its two halves as floats."""
    if rule not in MULTIPLIER:
        raise ValueError(f"no trellis rule {rule!r}")
    product = state.astype(np.uint32) * np.uint32(MULTIPLIER[rule])
    if rule == "mul1":
        total = product.reshape(*state.shape, 1).view(np.uint8).sum(axis=-1, dtype=np.int64)
        scale, bias = _half([MUL1_SCALE, MUL1_BIAS]).astype(np.float64)
        return ((1024 + total) * scale + bias).astype(np.float16)
    lanes = ((product & np.uint32(MCG_MASK)) ^ np.uint32(MCG_PATTERN)).reshape(*state.shape, 1).view(np.float16)
    return lanes[..., 0] + lanes[..., 1]


def _places() -> np.ndarray:
    """Row * 16 + column of the tile's i-th value: eight values a lane, 32 lanes, as matrix units hold them."""
    i = np.arange(TILE)
    lane, own = i // 8, i % 8
    return (2 * (lane % 4) + own % 2 + 8 * (own // 2 % 2)) * SIDE + lane // 4 + 8 * (own // 4)


def _hadamard() -> np.ndarray:
    k = np.arange(BLOCK)
    return np.where(np.bitwise_count(k[:, None] & k) % 2, -1, 1) / np.sqrt(BLOCK)


PLACES, HADAMARD = _places(), _hadamard()


def block(tiles: list[bytes], places: np.ndarray, rule: str, inputs: np.ndarray, outputs: np.ndarray) -> np.ndarray:
    """128 x 128 values, outputs by inputs, of the 64 tiles of a block at ``places`` (input tile * 8 + output tile).

    Sums are in double precision and rounded once.
    """
    if sorted(places.tolist()) != list(range(PER_BLOCK**2)):
        raise ValueError(f"a block takes each of its {PER_BLOCK**2} tiles once, and got {len(places)}")
    if len(inputs) != BLOCK or len(outputs) != BLOCK:
        raise ValueError(f"a block takes {BLOCK} scales a side")
    grid = np.empty((PER_BLOCK**2, TILE))
    grid[np.asarray(places)[:, None], PLACES] = values(states(tiles), rule)
    whole = grid.reshape(PER_BLOCK, PER_BLOCK, SIDE, SIDE).transpose(0, 2, 1, 3).reshape(BLOCK, BLOCK)
    turned = ((HADAMARD @ whole) * inputs[:, None]) @ HADAMARD
    return (turned * outputs).T.astype(np.float32)


def decode(tiles: DataFrame, inputs: DataFrame, outputs: DataFrame, *, rule: str = "mcg") -> DataFrame:
    """``tensor``, ``output``, ``input_from``, ``values`` (128 floats): the decoded rows, outputs by inputs.

    ``tiles``: ``tensor``, ``input_tile``, ``output_tile``, ``packed``.  ``inputs`` and ``outputs``: ``tensor``,
    ``block``, ``scales``, the 128 factors of that block.  A block with an absent, repeated or null tile, without
    its scales or of mixed rates is refused when it is decoded; a table of no tiles gives no rows.
    """
    place = (F.col("input_tile") % PER_BLOCK * PER_BLOCK + F.col("output_tile") % PER_BLOCK).cast("int")
    of = lambda side: F.floor(F.col(side) / PER_BLOCK).cast("long").alias(side.replace("tile", "block"))
    blocks = tiles.groupBy("tensor", of("input_tile"), of("output_tile")).agg(F.collect_list(F.struct(place.alias("place"), "packed")).alias("tiles"))
    for side, scales in (("input", inputs), ("output", outputs)):
        blocks = blocks.join(scales.select("tensor", F.col("block").cast("long").alias(f"{side}_block"), F.col("scales").cast("array<float>").alias(f"{side}_scales")), ["tensor", f"{side}_block"], "left")
    schema = T.StructType([tiles.schema["tensor"], *(T.StructField(n, k) for n, k in (("output", T.LongType()), ("input_from", T.LongType()), ("values", T.ArrayType(T.FloatType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = {c: row.column(c)[0].as_py() for c in ("input_block", "output_block", "tiles", "input_scales", "output_scales")}
                if own["input_scales"] is None or own["output_scales"] is None:
                    raise ValueError(f"no scales for input block {own['input_block']} or output block {own['output_block']}")
                if any(t["place"] is None or t["packed"] is None for t in own["tiles"]):
                    raise ValueError("a tile is null")
                out = block([t["packed"] for t in own["tiles"]], np.array([t["place"] for t in own["tiles"]]), rule, np.array(own["input_scales"]), np.array(own["output_scales"]))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, BLOCK * BLOCK + 1, BLOCK), pa.int32()), pa.array(out.ravel(), pa.float32()))
                outputs_at = own["output_block"] * BLOCK + np.arange(BLOCK)
                tensor = row.column("tensor").take(pa.array([0] * BLOCK))
                yield pa.RecordBatch.from_arrays([tensor, pa.array(outputs_at), pa.array(np.full(BLOCK, own["input_block"] * BLOCK)), rows], names=schema.names)

    return blocks.mapInArrow(run, schema)


def state_list(packed: Column) -> Column:
    """The 256 states of a packed tile; null for null."""

    @F.pandas_udf("array<int>")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else states([bytes(x)])[0].astype(np.int32))

    return read(packed)
