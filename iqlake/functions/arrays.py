"""Scalar functions on array columns: validity, normalisation, transforms, scores. Ids P09-P29, F03-F04 of the survey."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def all_finite(a: Column) -> Column:
    """F03 on a whole array."""
    return F.forall(a, lambda x: x.isNotNull() & is_finite(x))


def all_zero(*channels: Column) -> Column:
    """Finite and zero throughout. F04."""
    ok = F.lit(True)
    for a in channels:
        ok = ok & F.forall(a, lambda x: x == 0)
    return ok


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    """Sum of an array in double, in its order."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def power(i: Column, q: Column) -> Column:
    """I^2 + Q^2 at each place, in double."""
    return F.zip_with(i, q, lambda x, y: x.cast("double") * x.cast("double") + y.cast("double") * y.cast("double"))


def max_amplitude(i: Column, q: Column) -> Column:
    return F.sqrt(F.array_max(power(i, q)))


def divided(a: Column, by: Column) -> Column:
    """Null where the divisor isn't positive."""
    return F.when(by > 0, F.transform(a, lambda x: x.cast("double") / by))


def centred(a: Column) -> Column:
    m = mean(a)
    return F.transform(a, lambda x: x.cast("double") - m)


def rms(i: Column, q: Column) -> Column:
    """Root of the mean complex power. P10, P15."""
    return F.sqrt(mean(power(i, q)))


def zscored(a: Column, mu: Column, sigma: Column) -> Column:
    """P12."""
    return F.transform(a, lambda x: (x.cast("double") - mu) / sigma)


def rotated(i: Column, q: Column, theta: Column) -> tuple[Column, Column]:
    """Both channels after a phase rotation. P13."""
    c, s = F.cos(theta), F.sin(theta)
    return F.zip_with(i, q, lambda x, y: x * c - y * s), F.zip_with(i, q, lambda x, y: x * s + y * c)


def rolled(a: Column, k: Column) -> Column:
    """Circular shift to the right by k, 0 <= k < size. P14."""
    n = F.size(a)
    return F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k))


def argmax(a: Column) -> Column:
    """Place of the first maximum, from 0. P16."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(a: Column) -> Column:
    """P17."""
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a)))
    return e


def one_hot(k: Column, n: int) -> Column:
    """P19."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(j == k, 1).otherwise(0))


def from_one_hot(a: Column) -> Column:
    """The class of a strict one-hot row, else null. P18."""
    strict = F.forall(a, lambda x: x.isin(0, 1)) & (total(a) == 1)
    return F.when(strict, argmax(a))


def entropy(w: Column) -> Column:
    """In bits, with the floor 1e-12 inside the logarithm. P23."""
    return F.aggregate(w, F.lit(0.0), lambda s, x: s - x * F.log2(x + 1e-12))


def collapsed(w: Column, least: float = 0.9) -> Column:
    """P24."""
    return F.array_max(w) >= least


def mean_abs_diff(a: Column, b: Column) -> Column:
    """P25."""
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def floor12(x: Column) -> Column:
    """P27."""
    return F.floor(x * 1e12) / 1e12


def smooth_l1(d: Column) -> Column:
    """P22's second term."""
    return F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)


def close(a: Column, b: Column, tolerance: float = 3e-5) -> Column:
    """Within a relative or absolute tolerance. P38."""
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def raw(a: Column) -> Column:
    """The array itself; values that aren't finite raise. P09."""
    return F.when(all_finite(a), a).otherwise(F.raise_error(F.lit("a window holds values that aren't finite")))


def counter_samples(label: Column, n: int) -> Column:
    """n values in [-1, 1] from SHA-256 of ``label:block``: 8 little-endian 32-bit words a block. P28."""

    def value(j: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", label, F.floor(j / 8).cast("long").cast("string")), 256)
        at = (j % 8 * 8).cast("int")
        byte = [F.substr(digest, at + 2 * b + 1, F.lit(2)) for b in (3, 2, 1, 0)]
        return F.conv(F.concat(*byte), 16, 10).cast("double") / 4294967295.0 * 2.0 - 1.0

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)


def circular_correlation(ai: Column, aq: Column, bi: Column, bq: Column, n: int) -> Column:
    """Largest absolute circular cross-correlation of two complex windows, over their norms, at most 1. H09."""
    lags = F.sequence(F.lit(0), F.lit(n - 1))

    def at(k: Column) -> Column:
        ri, rq = rolled(bi, k), rolled(bq, k)
        re = total(F.zip_with(ai, ri, lambda x, y: x.cast("double") * y)) + total(F.zip_with(aq, rq, lambda x, y: x.cast("double") * y))
        im = total(F.zip_with(ai, rq, lambda x, y: x.cast("double") * y)) - total(F.zip_with(aq, ri, lambda x, y: x.cast("double") * y))
        return F.sqrt(re * re + im * im)

    norm = F.sqrt(total(power(ai, aq))) * F.sqrt(total(power(bi, bq)))
    return F.least(F.array_max(F.transform(lags, at)) / norm, F.lit(1.0))


TAU = 2 * math.pi
