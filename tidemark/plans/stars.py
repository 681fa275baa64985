"""The relational floor over the star schema: what any engine needs beside the sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.tables import registry, table

QUERIES, SQL, query = registry()

#: Name -> (tables, SQL that Spark and DuckDB read alike).
_STARS = {
    "star_pricing_summary": (
        ["lineitem"],
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    ),
    "star_revenue_by_nation": (
        ["lineitem", "orders", "customer", "supplier", "nation", "region"],
        """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR r_regionkey < 3 GROUP BY n_name""",
    ),
    "star_customers_without_orders": (["customer", "orders"], "SELECT c_custkey, c_mktsegment FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey"),
    "star_customers_with_urgent_orders": (["customer", "orders"], "SELECT c_custkey, c_nationkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'"),
    "star_segment_rollup": (["customer"], "SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)"),
    "star_status_cube": (["orders"], "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "star_part_sets": (["part"], "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())"),
    "star_top_orders": (
        ["orders"],
        "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank FROM orders) x WHERE rank <= 2",
    ),
    "star_running_balance": (["orders"], "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders"),
    "star_keys_only_supplied": (["supplier", "customer"], "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer"),
    "star_keys_except": (["part", "lineitem"], "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem"),
    "star_union": (["supplier", "customer"], "SELECT nationkey, count(*) AS n FROM (SELECT s_nationkey AS nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer) u GROUP BY nationkey"),
    "star_distinct_parts": (["lineitem"], "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey"),
}


def _run(names: list[str], sql: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        # Tables by parameter: no view is registered, so queries never clash.
        return spark.sql(_placed(sql, names), **{n: table(spark, folder, n) for n in names})

    return run


def _placed(sql: str, names: list[str]) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2} AS \2", sql)


for _name, (_tables, _sql) in _STARS.items():
    QUERIES[_name] = _run(_tables, _sql)
    SQL[_name] = _sql.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")


@query(
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events"""
)
def as_of_last_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """The latest purchase up to each event: an as-of join as one ordered pass, without a join of ranges."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, folder, "events").select("event_id", "user_id", F.last(own, ignorenulls=True).over(w).alias("last_purchase"))


@query(
    """WITH o AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS a, date_trunc('month', o_orderdate) + INTERVAL 10 DAY AS z FROM orders)
    SELECT a AS month, count(*) AS n FROM (SELECT DISTINCT a, z FROM o) w JOIN orders ON o_orderdate >= a AND o_orderdate < z GROUP BY a"""
)
def range_join_month_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in the first ten days of a month: intervals cut into days, joined by equality, then by range."""
    from pyspark.sql import functions as F

    orders = table(spark, folder, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    spans = orders.select(F.date_trunc("month", "at").alias("a")).distinct().withColumn("z", F.expr("a + INTERVAL 10 DAYS"))
    days = spans.withColumn("day", F.explode(F.sequence(F.to_date("a"), F.to_date("z"))))
    both = orders.withColumn("day", F.to_date("at")).join(days, "day").filter("at >= a AND at < z")
    return both.groupBy(F.col("a").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))
