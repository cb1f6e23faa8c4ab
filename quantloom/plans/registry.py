"""The registered queries of the panel engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Panels over the driver's tables, as SQL: supplier days from line items, user days from events, and a dense grid of the latter.
SUP = """sup AS (SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey AS e, avg(l_extendedprice * 1.00037291) AS close, avg(l_extendedprice * 1.00037291 * (1 + l_discount)) AS high,
 avg(l_extendedprice * 1.00037291 * (1 - l_tax)) AS low, avg(l_quantity) AS volume, avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS sparse FROM lineitem GROUP BY 1, 2)"""
USR = "usr AS (SELECT CAST(ts AS DATE) AS d, user_id AS e, avg(value) AS v, count(*) AS k FROM events GROUP BY 1, 2)"
GRID = f"""{USR}, grid AS (SELECT a.d, b.e, u.v, (u.v - 50) / 50 AS score, (u.v * 7.0 % 100) / 2000 - 0.0245 AS ret, 0.0001 AS rf
 FROM (SELECT DISTINCT d FROM usr) a CROSS JOIN (SELECT DISTINCT e FROM usr) b LEFT JOIN usr u ON u.d = a.d AND u.e = b.e)"""
WE = "(PARTITION BY e ORDER BY d)"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sup(spark: SparkSession, folder: str, together: bool = False) -> DataFrame:
    """``together``: all days of a supplier lie in one partition, so windows over them move no row again."""
    price = F.col("l_extendedprice") * 1.00037291
    items = table(spark, folder, "lineitem")
    return (items.repartition("l_suppkey") if together else items).groupBy(F.to_date("l_shipdate").alias("d"), F.col("l_suppkey").alias("e")).agg(
        F.avg(price).alias("close"), F.avg(price * (1 + F.col("l_discount"))).alias("high"), F.avg(price * (1 - F.col("l_tax"))).alias("low"),
        F.avg("l_quantity").alias("volume"), F.avg(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("sparse"),
    )


def usr(spark: SparkSession, folder: str) -> DataFrame:
    """Means add values up in the order of events: a sum of doubles depends on its order, and ranks and distinct scores on its last bit."""
    events = table(spark, folder, "events").select(F.to_date("ts").alias("d"), F.col("user_id").alias("e"), "event_id", "value")
    own = Window.partitionBy("d", "e").orderBy("event_id", "value")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = events.select("d", "e", F.avg("value").over(every).alias("v"), F.count("*").over(every).alias("k"), F.row_number().over(own).alias("_i"))
    return days.where("_i = 1").drop("_i")


def grid(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.align import dense_grid

    g = dense_grid(usr(spark, folder).select("d", "e", "v"), "d", "e")
    return g.select("d", "e", "v", ((F.col("v") - 50) / 50).alias("score"), (F.col("v") * 7.0 % 100 / 2000 - 0.0245).alias("ret"), F.lit(0.0001).alias("rf"))


def shown(df: DataFrame) -> DataFrame:
    """Doubles rounded, whole numbers as long: the same in both engines."""
    whole = ("int", "smallint", "tinyint")
    return df.select(*[rounded(F.col(c)).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in whole else F.col(c) for c, k in df.dtypes])


def r(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name}"


from . import alignment, cleaning, feature_queries, inference_queries, portfolios, signal_queries, time_queries  # noqa: E402, F401
