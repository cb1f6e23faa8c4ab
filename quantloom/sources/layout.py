"""Panels stored in the order that they are read in: an entity's rows in one bucket, sorted by time.

The planner knows the layout of such a table, so windows by entity, joins and groups on it need no exchange, and no sort
where the session trusts a bucket's order.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..panel import Panel

#: Lets the planner take a bucket's one sorted file as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Where false, a join by entity and time may meet in the buckets of the entity.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Rows of a bucket, about.
ROWS_A_BUCKET = 5_000_000


def buckets_for(rows: int, least: int = 1) -> int:
    """Buckets of a table of so many rows; joins need none anew where both sides have the same number, so powers of two."""
    return max(least, 1 << max(0, -(-rows // ROWS_A_BUCKET) - 1).bit_length())


def write_sorted(panel: Panel, name: str, buckets: int | None = None, replace_it: bool = False) -> Panel:
    """Save a panel as the table ``name`` in the warehouse, sorted by entity and time, and read it back.

    Duplicate keys keep their rows; rows without an entity or a time are an error, for no index has them. Without ``buckets`` their number
    follows from a count of the rows. A bucket is one file, written by one task, so its order is whole.
    """
    entity = panel.require_entity()
    many = panel.df.agg(F.count("*").alias("n"), F.count_if(F.col(panel.time).isNull() | F.col(entity).isNull()).alias("odd")).first()
    if many.odd:
        raise ValueError(f"{many.odd} rows have no time or no entity")
    n = buckets or buckets_for(many.n)
    rows = panel.df.repartition(n, entity).sortWithinPartitions(entity, panel.time, *panel.extra_keys)
    keys = [panel.time, *panel.extra_keys]
    writer = rows.write.format("parquet").bucketBy(n, entity).sortBy(entity, *keys)
    writer.mode("overwrite" if replace_it else "errorifexists").saveAsTable(name)
    return read_sorted(panel.df.sparkSession, name, panel)


def read_sorted(spark: SparkSession, name: str, like: Panel) -> Panel:
    """The table as a panel with the roles of ``like``; the session then trusts the order of one-file buckets, and joins by entity and time inside them."""
    spark.conf.set(ORDERED, "true")
    spark.conf.set(ALL_KEYS, "false")
    return replace(like, df=spark.table(name))


def sort_by_index(panel: Panel) -> Panel:
    """Rows in order of entity, time and further keys; a date-only panel in order of time. For results that are shown or written, not for windows."""
    order = [*([panel.entity] if panel.entity else []), panel.time, *panel.extra_keys]
    return panel.with_df(panel.df.orderBy(*order))


def exchanges(df: DataFrame) -> int:
    """How many exchanges the physical plan has, before anything runs."""
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange") + df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange")
