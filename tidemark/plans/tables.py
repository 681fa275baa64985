"""Tables of a folder, and how the driver's tables stand for signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, pos, total, value, event_type, ts): the events of a user in order are a signal."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")
    rows = rows.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy("user_id")))
    return rows.select("user_id", "pos", "total", "value", "event_type", "ts")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("total"))


#: The same in SQL.
SIGNAL = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS total, value, event_type, ts FROM events)"
TOTALS = "t AS (SELECT user_id, count(*) AS total FROM events GROUP BY user_id)"


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return put

    return queries, sql, query
