"""Event-time streams: windows, sessions, duplicates and the latest state. The same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(df: DataFrame, ts: str, late: str | None = None) -> DataFrame:
    """ts as a time stamp, with a watermark if `late` says how late rows may be."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if late else df


def _told(df: DataFrame, at: object, by: list[str], value: str) -> DataFrame:
    rows = df.groupBy(at.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def tumbling(df: DataFrame, ts: str, by: list[str], value: str, length: str) -> DataFrame:
    return _told(df, F.window(ts, length), by, value)


def sliding(df: DataFrame, ts: str, by: list[str], value: str, length: str, step: str) -> DataFrame:
    return _told(df, F.window(ts, length, step), by, value)


def sessions(df: DataFrame, ts: str, by: list[str], value: str, gap: str) -> DataFrame:
    return _told(df, F.session_window(ts, gap), by, value)


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, while its watermark lasts."""
    return df.dropDuplicatesWithinWatermark(keys)
