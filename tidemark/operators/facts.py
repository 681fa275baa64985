"""Facts of tasks: three-valued truths, spans and provenance, merged in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A


def merged_facts(df: DataFrame, by: list[str], order: str, truths: list[str], language: str, schedule: str, bound: str, exact: str) -> DataFrame:
    """(by, truths..., language, schedule, span): Kleene or of each truth, the first known language, the schedules
    in order (null if one is unknown), the sum of the spans."""
    aggs = [A.kleene_or(F.col(c)).alias(c) for c in truths]
    aggs += [A.first_known(F.col(language), F.col(order)).alias(language), A.all_known_list(F.col(schedule), F.col(order)).alias(schedule)]
    aggs.append(A.merged_span(F.col(bound), F.col(exact)).alias("span"))
    return df.groupBy(*by).agg(*aggs)


def reproducible(temperature: Column, seeded: Column, complete: Column) -> Column:
    """Whether a result can be had again: unknown facts count as no."""
    return F.coalesce(((temperature == 0) | seeded) & complete, F.lit(False))


def provenance(**facts: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in facts.items()])
