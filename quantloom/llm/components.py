"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def _to_least(edges: DataFrame) -> DataFrame:
    """Link each ``v`` beside ``u`` to the least of them."""
    # the least neighbour is combined before the shuffle; the join back is split where a hub is hot
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node in ``links`` (``u``, ``v``; long); ``root`` is the least node reachable.

    Loops and repeated links don't matter; an empty table gives an empty result. Every round is written to the shared folder.
    """
    edges = durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # after the large star every edge points from the greater node to the smaller
        joined = _to_least(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
        row = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(edges)
        edges = after
        if (row.n, row.h) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (row.n, row.h)
    raise RuntimeError(f"no stable components after {most_rounds} rounds")
