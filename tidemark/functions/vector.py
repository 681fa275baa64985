"""Vectors as arrays: all sums in double, by built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far the squared norm of a unit vector may be from 1.
UNIT_BUDGET = 1e-4


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def is_finite(a: Column) -> Column:
    """No null, NaN or infinite element."""
    return F.forall(doubles(a), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def fits_half(a: Column) -> Column:
    """Whether every element is within the range of a 16-bit float."""
    return F.forall(doubles(a), lambda x: F.abs(x) <= 65504.0)


def normalized(a: Column, dim: int | None = None) -> Column:
    """a over its norm; null where a is zero, not finite, or not of dim elements."""
    n = norm(a)
    ok = is_finite(a) & (n > 0)
    if dim is not None:
        ok = ok & (F.size(a) == dim)
    return F.when(ok, F.transform(doubles(a), lambda x: x / n))


def checked(a: Column, dim: int, what: str = "vector") -> Column:
    """normalized(), raising where it would be null."""
    bad = F.when(F.size(a) != dim, f"{what}: wrong dimension").when(~is_finite(a), f"{what}: not finite").when(norm(a) == 0, f"{what}: zero")
    return F.when(bad.isNotNull(), F.raise_error(bad).cast("array<double>")).otherwise(normalized(a))


def is_unit(a: Column) -> Column:
    return F.abs(squared_norm(a) - 1) <= UNIT_BUDGET


def unit(a: Column, renormalize: bool = False) -> Column:
    """a where it is a unit vector within the budget, else null."""
    return F.when(is_finite(a) & is_unit(a), normalized(a) if renormalize else doubles(a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def largest_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def is_close(a: Column, b: Column, tolerance: float) -> Column:
    return largest_difference(a, b) <= tolerance


def half_squared_distance(a: Column, b: Column) -> Column:
    """1 - cosine, for unit vectors, without cancellation."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / 2


def is_close_cosine(a: Column, b: Column, tolerance: float) -> Column:
    return half_squared_distance(a, b) <= tolerance


def fingerprint(a: Column) -> Column:
    """A 64-bit hash of a vector's elements."""
    return F.xxhash64(a)


def sha256_hex(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)
