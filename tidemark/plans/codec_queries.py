"""Decoding packed rows; the SQL states what the packed bytes must decode to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codecs, special
from tidemark.functions import vector as V
from tidemark.operators import trellis
from tidemark.operators.shared import shared_path
from tidemark.sources import tensors

from .catalog import query, table

HEX_BYTE = "array_to_string([substr('0123456789ABCDEF', x // 16 + 1, 1) || substr('0123456789ABCDEF', x % 16 + 1, 1) FOR x IN b], '')"


@query("decode_q8_0", "SELECT vec_id, round(list_sum([CAST((vec_id * 7 + k * 3) % 128 AS DOUBLE) * 0.5 FOR k IN range(0, 32)]), 6) AS total FROM embeddings")
def decode_q8_0(spark: SparkSession, sf: str) -> DataFrame:
    """A block with scale one half (0x3800) and 32 codes made from the id."""
    codes = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.lpad(F.hex((F.col("vec_id") * 7 + k * 3) % 128), 2, "0"))
    raw = F.unhex(F.concat(F.lit("0038"), F.array_join(codes, "")))
    return table(spark, sf, "embeddings").select("vec_id", codecs.decoded(F.lit("Q8_0"), raw).alias("v")).select("vec_id", F.round(V.total(F.transform("v", lambda x: x.cast("double"))), 6).alias("total"))


@query("decode_affine_4bit", "SELECT vec_id, round(list_sum([((vec_id + k) % 16) * CAST(0.25 AS DOUBLE) - 2 FOR k IN range(0, 32)]), 6) AS total FROM embeddings")
def decode_affine_4bit(spark: SparkSession, sf: str) -> DataFrame:
    """32 four-bit codes, low nibble first, one scale and bias."""
    code = lambda k: (F.col("vec_id") + k) % 16
    raw = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.lpad(F.hex(code(j * 2 + 1) * 16 + code(j * 2)), 2, "0")), ""))
    one = lambda x: F.array(F.lit(x).cast("float"))
    d = table(spark, sf, "embeddings").select("vec_id", codecs.affine_decoded(raw, F.lit(4), one(0.25), one(-2.0), F.lit(32)).alias("v"))
    return d.select("vec_id", F.round(V.total(F.transform("v", lambda x: x.cast("double"))), 6).alias("total"))


@query("ulp_distance")
def ulp_distance(spark: SparkSession, sf: str) -> DataFrame:
    x = F.get("embedding", F.lit(0))
    d = table(spark, sf, "embeddings").select("vec_id", x.alias("a"), (x * F.lit(1.000001).cast("float")).alias("b"))
    return d.select("vec_id", special.ulp_distance("a", "b").alias("ulps"))


@query("tensor_rows", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS head, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64")
def tensor_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as tensors in container files, a file a task, and read back row by row."""
    at = shared_path(spark, "tensors")
    tensors.write_safetensors(table(spark, sf, "embeddings").where("vec_id IS NOT NULL AND size(embedding) = 64"), at, {"vec_id": "I64", "embedding": "F32"})
    ids, vecs = (tensors.rows(spark, at, [t], step=65536).select("file", "position", F.col("vec").alias(t)) for t in ("vec_id", "embedding"))
    return ids.join(vecs, ["file", "position"]).select(F.get("vec_id", F.lit(0)).cast("long").alias("vec_id"), F.get("embedding", F.lit(0)).alias("head"), F.round(V.total(F.col("embedding")), 6).alias("total"))


@query("tensor_directory", "SELECT tensor, dtype, CAST(sum(n) AS BIGINT) AS rows, CAST(max(w) AS BIGINT) AS width, CAST(sum(n * w * s) AS BIGINT) AS bytes FROM (SELECT count(*) AS n, 64 AS w, 4 AS s, 'embedding' AS tensor, 'F32' AS dtype FROM embeddings UNION ALL SELECT count(*), 1, 8, 'vec_id', 'I64' FROM embeddings) GROUP BY tensor, dtype")
def tensor_directory(spark: SparkSession, sf: str) -> DataFrame:
    """What the same files say they hold, from their headers."""
    at = shared_path(spark, "tensors")
    tensors.write_safetensors(table(spark, sf, "embeddings"), at, {"vec_id": "I64", "embedding": "F32"})
    tensors.register(spark)
    d = spark.read.format("tensor_directory").option("path", at).load()
    return d.groupBy("tensor", "dtype").agg(F.sum(F.get("shape", F.lit(0))).alias("rows"), F.max(F.get("shape", F.lit(1))).alias("width"), F.sum("bytes").alias("bytes"))


def _bytes(n: int, code) -> Column:
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lpad(F.hex(code(k)), 2, "0")), ""))


FOURS = "[0, 0.5, 1, 1.5, 2, 3, 4, 6, 0, -0.5, -1, -1.5, -2, -3, -4, -6]"


@query("decode_nvfp4", f"SELECT vec_id, round(list_sum([CAST({FOURS}[(vec_id * 5 + k * 3) % 16 + 1] AS DOUBLE) * CASE WHEN k < 16 THEN 1.5 ELSE 0.25 END FOR k IN range(0, 32)]) * 2, 6) AS total, round(list_sum([CAST({FOURS}[(vec_id * 5 + k * 3) % 16 + 1] AS DOUBLE) * CASE WHEN k < 16 THEN 1.5 ELSE 0.25 END FOR k IN range(0, 32)]) / 2, 6) AS inverse_total FROM embeddings")
def decode_nvfp4(spark: SparkSession, sf: str) -> DataFrame:
    """32 codes of four bits in two groups, with a whole scale that multiplies, or divides where it is stored inverted."""
    code = lambda k: (F.col("vec_id") * 5 + k * 3) % 16
    raw = _bytes(16, lambda j: code(j * 2 + 1) * 16 + code(j * 2))
    scales = F.array(F.lit(1.5).cast("float"), F.lit(0.25).cast("float"))
    total = lambda inverse: F.round(V.total(F.transform(codecs.e2m1_decoded(raw, scales, F.lit(2.0), F.lit(inverse)), lambda x: x.cast("double"))), 6)
    return table(spark, sf, "embeddings").select("vec_id", total(False).alias("total"), total(True).alias("inverse_total"))


EIGHTS = "(1 + c % 8 / CAST(8 AS DOUBLE)) * pow(CAST(2 AS DOUBLE), c // 8 - 7)"


@query("decode_fp8", f"WITH c AS (SELECT vec_id, k, 8 + (vec_id * 7 + k * 11) % 112 AS c FROM embeddings CROSS JOIN range(0, 30) AS t(k)) SELECT vec_id, round(sum({EIGHTS} * CASE WHEN k // 6 < 4 THEN CASE WHEN k % 6 < 4 THEN 2 ELSE 3 END ELSE CASE WHEN k % 6 < 4 THEN 0.5 ELSE 1 END END), 6) AS total FROM c GROUP BY vec_id")
def decode_fp8(spark: SparkSession, sf: str) -> DataFrame:
    """Matrices of five rows and six columns in blocks of four, partial at both edges."""
    raw = _bytes(30, lambda k: 8 + (F.col("vec_id") * 7 + k * 11) % 112)
    scales = F.array(*(F.lit(x).cast("float") for x in (2.0, 3.0, 0.5, 1.0)))
    v = codecs.fp8_decoded(raw, F.lit(5), F.lit(6), scales, F.lit(4))
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.total(F.transform(v, lambda x: x.cast("double"))), 6).alias("total"))


@query("decode_mx", "WITH c AS (SELECT vec_id, k, 8 + (vec_id * 7 + k * 11) % 112 AS c, CASE WHEN k < 32 THEN 127 + vec_id % 5 ELSE 126 END AS s FROM embeddings CROSS JOIN range(0, 64) AS t(k)) SELECT vec_id, CAST(sum((c // 8 - 7 + s) * 128 + c % 8 * 16) AS BIGINT) AS bits FROM c GROUP BY vec_id")
def decode_mx(spark: SparkSession, sf: str) -> DataFrame:
    """One-byte floats in two blocks with power-of-two scales, as bits of bfloat16."""
    raw = _bytes(64, lambda k: 8 + (F.col("vec_id") * 7 + k * 11) % 112)
    scales = F.unhex(F.concat(F.lpad(F.hex(127 + F.col("vec_id") % 5), 2, "0"), F.lit("7E")))
    return table(spark, sf, "embeddings").select("vec_id", F.aggregate(codecs.mx_decoded(raw, scales), F.lit(0).cast("long"), lambda a, x: a + x).alias("bits"))


# A vector's components as bytes make a tile of two bits a value; byte i of the stream is that of its 32-bit word from the end.
STREAM = "[CAST(floor(CAST(embedding[(m // 4) * 4 + 4 - m % 4] AS DOUBLE) * 256) AS BIGINT) & 255 FOR m IN range(0, 64)]"
STATES = f"""bytes AS (SELECT vec_id, {STREAM} AS s FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
ends AS (SELECT vec_id, j, 2 * (j + 1) AS e, (2 * (j + 1) - 1) // 8 AS q, s FROM bytes CROSS JOIN range(0, 256) AS t(j)),
states AS (SELECT vec_id, j, ((s[(q + 62) % 64 + 1] * 65536 + s[(q + 63) % 64 + 1] * 256 + s[q + 1]) >> CAST(8 * (q + 1) - e AS INTEGER)) & 65535 AS state FROM ends)"""


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "embeddings").where("vec_id IS NOT NULL AND size(embedding) = 64")
    code = lambda x: F.lpad(F.hex(F.pmod(F.floor(x.cast("double") * 256), F.lit(256))), 2, "0")
    return d.select("vec_id", F.unhex(F.array_join(F.transform("embedding", code), "")).alias("packed"))


@query("trellis_states", f"WITH {STATES} SELECT vec_id, CAST(sum(state * (j + 1)) AS BIGINT) AS weighted, CAST(sum(state % 251) AS BIGINT) AS rest FROM states GROUP BY vec_id")
def trellis_states(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's bytes as a packed tile; its 256 overlapping states."""
    d = _tiles(spark, sf).select("vec_id", trellis.state_list(F.col("packed")).alias("s"))
    zero = F.lit(0).cast("long")
    weighted = F.aggregate(F.transform("s", lambda x, j: x.cast("long") * (j + 1)), zero, lambda a, x: a + x)
    return d.select("vec_id", weighted.alias("weighted"), F.aggregate("s", zero, lambda a, x: a + x % 251).alias("rest"))


@query("trellis_energy", f"""WITH {STATES},
sums AS (SELECT vec_id // 64 AS tensor, vec_id, (1024 + (state * 2212286765 & 255) + ((state * 2212286765 >> 8) & 255) + ((state * 2212286765 >> 16) & 255) + ((state * 2212286765 >> 24) & 255)) * (CAST(887 AS DOUBLE) / 131072) - CAST(1329 AS DOUBLE) / 128 AS x FROM states),
halves AS (SELECT tensor, vec_id, x, pow(CAST(2 AS DOUBLE), 10 - floor(log2(abs(nullif(x, 0))))) AS unit FROM sums)
SELECT tensor, CAST(count(*) AS BIGINT) AS n, round(sum(pow(round_even(x * unit, 0) / unit, 2)) * 4, 1) AS energy FROM halves GROUP BY tensor HAVING count(DISTINCT vec_id) = 64 AND count(*) = 64 * 256""")
def trellis_energy(spark: SparkSession, sf: str) -> DataFrame:
    """64 vectors a tensor, decoded with scales of 1 and 2 in turn signs: the transforms keep the sum of squares."""
    d = _tiles(spark, sf).withColumn("tensor", F.floor(F.col("vec_id") / 64))
    whole = d.groupBy("tensor").agg(F.countDistinct("vec_id").alias("k"), F.count("*").alias("n")).where("k = 64 AND n = 64").select("tensor")
    tiles = d.join(whole, "tensor").selectExpr("tensor", "CAST(vec_id % 64 DIV 8 AS INT) AS input_tile", "CAST(vec_id % 8 AS INT) AS output_tile", "packed")
    signs = lambda size: F.transform(F.sequence(F.lit(0), F.lit(trellis.BLOCK - 1)), lambda k: F.when(k % 3 == 0, -size).otherwise(size).cast("float"))
    side = lambda size: whole.select("tensor", F.lit(0).alias("block"), signs(size).alias("scales"))
    rows = trellis.decode(tiles, side(1.0), side(2.0), rule="mul1")
    squares = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.groupBy("tensor").agg(F.sum(F.size("values")).alias("n"), F.round(F.sum(squares), 1).alias("energy"))
