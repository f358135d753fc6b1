"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.session import drop_round, save_round, staging_path


def _contract(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over ``u > v``: hang neighbours of a node on the smallest node around it.

    The large step moves only larger neighbours, the small step only smaller ones and the node itself; both keep the
    components. Minima are aggregated before the join, so a node of very many links is no single task's group.
    """
    if small:
        around = edges
    else:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(lowest, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v"))
        )
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``u``, ``v``); the root is the smallest node reachable.

    Rounds go on until the links no longer change, about log n of them; each is saved to the shared folder, and the
    one before it removed.
    """
    spark = links.sparkSession
    folder, rounds = staging_path(spark, "components"), 0
    distinct = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = save_round(distinct, folder, rounds)
    mark = None
    while True:
        row = edges.select(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(row) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(row)
        rounds += 1
        edges = save_round(_contract(_contract(edges, small=False), small=True), folder, rounds)
        drop_round(spark, folder, rounds - 1)
