"""Dense tensors as flat arrays with a shape, row-major."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n if isinstance(n, Column) else F.lit(n))


def element_count(shape: Column) -> Column:
    """The product of the dimensions; overflow raises, as arithmetic does in ANSI mode."""
    return F.aggregate(shape.cast("array<bigint>"), F.lit(1).cast("bigint"), lambda n, d: n * d)


def fits(data: Column, shape: Column) -> Column:
    return F.size(data) == element_count(shape)


def tensor(data: Column, shape: Column) -> Column:
    """(data, shape); raises where the shape asks for another number of elements."""
    return F.when(~fits(data, shape), F.raise_error(F.lit("data does not fit its shape")).cast("struct<data:array<double>,shape:array<int>>")).otherwise(
        F.struct(data.cast("array<double>").alias("data"), shape.cast("array<int>").alias("shape"))
    )


def strides(shape: Column) -> Column:
    n = F.size(shape)
    return F.transform(shape, lambda _, i: element_count(F.slice(shape, i + 2, n)))


def offset(index: Column, shape: Column) -> Column:
    """The place of an index from 0; null if it is out of bounds or of another rank."""
    inside = (F.size(index) == F.size(shape)) & F.forall(F.zip_with(index, shape, lambda i, d: (i >= 0) & (i < d)), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.when(inside, F.aggregate(F.zip_with(index.cast("array<bigint>"), strides(shape), lambda i, s: i * s), F.lit(0).cast("bigint"), lambda a, b: a + b))


def read_at(data: Column, index: Column, shape: Column) -> Column:
    return F.get(data, offset(index, shape).cast("int"))


def filled_at(data: Column, at: Column, value: Column) -> Column:
    return F.transform(data, lambda x, i: F.when(i == at, value).otherwise(x))


def filled_at_all(data: Column, positions: Column, value: Column) -> Column:
    """value at every position; null if any position is out of bounds."""
    ok = F.forall(positions, lambda p: (p >= 0) & (p < F.size(data)))
    return F.when(ok, F.transform(data, lambda x, i: F.when(F.array_contains(positions, i), value).otherwise(x)))


def without_row_padding(data: Column, rows: int, width: int, stride: int) -> Column:
    """Rows of `width` elements, each `stride` apart, put together."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(data, r * stride + 1, F.lit(width))))


def scalar(record: Column, name: str) -> Column:
    """The single finite element of a named output; else null."""
    a = record[name].cast("array<double>")
    return F.when((F.size(a) == 1) & ~F.isnan(F.get(a, F.lit(0))) & (F.abs(F.get(a, F.lit(0))) < float("inf")), F.get(a, F.lit(0)))


def prefix_mask_count(mask: Column) -> Column:
    """The number of ones of a mask 1...1 0...0 with at least one; null for any other."""
    ones = F.aggregate(mask.cast("array<int>"), F.lit(0), lambda n, x: n + x)
    return F.when((ones > 0) & F.forall(F.transform(mask.cast("array<int>"), lambda x, i: x == F.when(i < ones, 1).otherwise(0)), lambda ok: ok), ones)


def padding_is_zero(data: Column, real: Column) -> Column:
    return F.forall(F.slice(data, real + 1, F.greatest(F.size(data) - real, F.lit(0))), lambda x: x == 0)
