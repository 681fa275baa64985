"""Aggregates over vectors, facts, spans and timings. All combine partially, so hot groups reduce before they move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _packed(by: list[str], parts: DataFrame, normalize: bool) -> DataFrame:
    """(by, embedding) of (by, pos, v)."""
    rows = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("embedding"))
    if not normalize:
        return rows
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("embedding", F.when(n > 0, F.transform("embedding", lambda x: x / n)))


def pooled(df: DataFrame, by: list[str], vector: str, how: str = "mean", normalize: bool = True, weight: Column | None = None) -> DataFrame:
    """(by, embedding): the element-wise mean, max or weighted mean of the vectors of a group; over its norm if asked.

    One row for each place of a vector moves from each task, however many vectors a group has. A zero result is
    null when it is to be normalised; an empty group gives no row.
    """
    rows = df.select(*by, (weight if weight is not None else F.lit(1.0)).alias("__w"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(*by, "pos")
    if how == "max":
        parts = rows.agg(F.max("x").alias("v"))
    else:
        parts = rows.agg(F.try_divide(F.sum(F.col("x") * F.col("__w")), F.sum("__w")).alias("v"))
    return _packed(by, parts, normalize)


def ema(df: DataFrame, by: list[str], order: str, vector: str, alpha: float) -> DataFrame:
    """(by, embedding): alpha x + (1 - alpha) before, from the first vector on, over its norm.

    In closed form each vector has a weight by how many follow it, so it is a plain weighted sum.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(order)
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) - 1
    first = F.row_number().over(w) == 1
    decay = F.when(back == 0, 1.0).otherwise(F.pow(F.lit(1 - alpha), back))
    weight = F.when(first, decay).otherwise(alpha * decay)
    weighted = df.select(*by, weight.alias("__w"), F.col(vector).alias("__v"))
    rows = weighted.select(*by, "__w", F.posexplode(F.col("__v").cast("array<double>")).alias("pos", "x")).groupBy(*by, "pos")
    return _packed(by, rows.agg(F.sum(F.col("x") * F.col("__w")).alias("v")), True)


def kleene_or(x: Column) -> Column:
    """True if any is true, else unknown if any is unknown, else false."""
    return F.when(F.bool_or(x), F.lit(True)).when(F.count(x) < F.count(F.lit(1)), F.lit(None).cast("boolean")).otherwise(F.lit(False))


def unanimous(x: Column) -> Column:
    """The value if all are equal and none is null, else null."""
    return F.when((F.min(x) == F.max(x)) & (F.count(x) == F.count(F.lit(1))), F.min(x))


def merged_span(bound: Column, exact: Column) -> Column:
    """(bound, exact) of a group: bounds add up, at most to the largest long, and are exact if all are."""
    total = F.sum(bound.cast("decimal(38,0)"))
    most = 2**63 - 1
    return F.struct(F.least(total, F.lit(most).cast("decimal(38,0)")).cast("long").alias("bound"), (F.bool_and(exact) & (total <= most)).alias("exact"))


def effective_span(carried: Column, exact: Column, local: Column) -> Column:
    """A carried bound against what was seen: the larger, exact only if both agree."""
    bound = F.greatest(F.coalesce(carried, F.lit(0)), local)
    return F.struct(bound.cast("long").alias("bound"), (F.coalesce(exact, F.lit(False)) & (bound == carried) & (bound == local)).alias("exact"))


def first_known(x: Column, order: Column) -> Column:
    """The first value that isn't null, by order."""
    return F.min_by(F.when(x.isNotNull(), x), F.when(x.isNotNull(), order))


def all_known_list(x: Column, order: Column) -> Column:
    """The values by order; null if any is null."""
    every = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda s: s["x"])
    return F.when(F.count(x) == F.count(F.lit(1)), every)


def upper_median(x: Column, cap: float | None = None) -> Column:
    """The element at index n / 2 of the sorted positive values, at most cap; 0 for none."""
    own = F.array_sort(F.collect_list(F.when(x > 0, x)))
    m = F.coalesce(F.get(own, F.floor(F.size(own) / 2).cast("int")), F.lit(0.0))
    return F.least(m, F.lit(cap)) if cap is not None else m


def nearest_rank(x: Column, p: float) -> Column:
    """The element at rank ceil(p n) of the sorted values."""
    own = F.array_sort(F.collect_list(x))
    return F.get(own, F.greatest(F.ceil(p * F.size(own)) - 1, F.lit(0)).cast("int"))


def pipeline_time(start: Column, duration: Column) -> Column:
    """The wall time of overlapping runs, but never more than their sum."""
    return F.coalesce(F.least(F.max(start + duration) - F.min(start), F.sum(duration)), F.lit(0.0))


def folded(x: Column, how: str) -> Column:
    return F.coalesce({"sum": F.sum, "max": F.max, "min": F.min}[how](x), F.lit(0.0))


def per_second(amount: Column, seconds: Column) -> Column:
    """0 where there are no seconds."""
    return F.coalesce(F.try_divide(amount, F.when(seconds != 0, seconds)), F.lit(0.0))
