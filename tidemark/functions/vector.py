"""Vector expressions over ``array<double>`` columns, all inside the JVM.

Logits are widened to double before any exp or log, shapes must agree, and nothing is clamped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row: inside a lambda it would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def widened(v: Column, scale: float = 1.0) -> Column:
    return F.transform(v, lambda x: x.cast("double") * F.lit(scale))


def log_softmax(v: Column) -> Column:
    """x - max - ln(sum(exp(x - max)))."""
    return let(
        v,
        lambda w: let(
            F.array_max(w),
            lambda top: let(top + F.log(total(F.transform(w, lambda x: F.exp(x - top)))), lambda norm: F.transform(w, lambda x: x - norm)),
        ),
    )


def kl(lp: Column, lq: Column) -> Column:
    """KL divergence in nats of two log-probability rows."""
    return total(F.zip_with(lp, lq, lambda p, q: F.exp(p) * (p - q)))


def checked_kl(lp: Column, lq: Column) -> Column:
    """``kl``, refusing rows of unequal width and values that aren't finite or lie below -1e-9."""
    value = kl(lp, lq)
    bad = (F.size(lp) != F.size(lq)) | value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))) | (value < -1e-9)
    return F.when(bad, F.raise_error(F.concat(F.lit("refused divergence "), F.coalesce(value.cast("string"), F.lit("null")))).cast("double")).otherwise(value)


def entropy(lp: Column) -> Column:
    return -total(F.transform(lp, lambda p: F.exp(p) * p))


def jsd_bits(lp: Column, lq: Column, floor: float = 1e-30) -> Column:
    """Jensen-Shannon divergence in bits; the mixture is floored before its logarithm."""
    mid = F.zip_with(lp, lq, lambda p, q: F.log(F.greatest((F.exp(p) + F.exp(q)) * 0.5, F.lit(floor))))
    return let(mid, lambda m: (kl(lp, m) + kl(lq, m)) * 0.5 / F.log(F.lit(2.0)))


def first_argmax(v: Column) -> Column:
    """0-based position of the largest value, the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def masked(v: Column, limit: int) -> Column:
    return F.slice(v, 1, limit)


def rtn_symmetric(v: Column, bits: int, top: Column | None = None) -> Column:
    """Round to nearest, half to even, on one scale: that of the row, or of ``top`` (a largest magnitude)."""
    q = 2 ** (bits - 1) - 1
    scale = (F.array_max(F.transform(v, F.abs)) if top is None else top) / F.lit(float(q))
    return let(
        F.when(scale == 0, F.lit(1.0)).otherwise(scale),
        lambda s: F.transform(v, lambda x: F.least(F.greatest(F.rint(x / s), F.lit(float(-q - 1))), F.lit(float(q))) * s),
    )


def rtn_group_affine(v: Column, bits: int, group: int) -> Column:
    """Affine codes per group of neighbours: scale from the range, offset the minimum."""
    q = float(2**bits - 1)

    def coded(g: Column, low: Column) -> Column:
        s0 = (F.array_max(g) - low) / F.lit(q)
        return let(F.when(s0 == 0, F.lit(1.0)).otherwise(s0), lambda s: F.transform(g, lambda x: F.least(F.greatest(F.rint((x - low) / s), F.lit(0.0)), F.lit(q)) * s + low))

    def one(i: Column) -> Column:
        return let(F.slice(v, i, group), lambda g: let(F.array_min(g), lambda low: coded(g, low)))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(v), F.lit(group)), one))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dense_row(entries: Column, width: int) -> Column:
    """``map<int,double>`` as a row of ``width``; absent ids are minus infinity, ids beyond the width are dropped."""
    return let(entries, lambda m: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(float("-inf")))))
