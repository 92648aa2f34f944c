"""Connected components over links; cutting lineage with tables in the cluster's shared folder is that of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricedex.sources.stored import release, shared_dir, stored, stored_counted  # noqa: F401


def _is_stars(edges: DataFrame) -> bool:
    """Whether each u of the distinct edges (u, v), u > v, has one edge and is no edge's v, so that v is the least id of its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("upper")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("upper")))
    return ends.groupBy("id").agg(F.sum("upper").alias("n"), F.min("upper").alias("least")).where("n > 1 or n = 1 and least = 0").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    Alternating large-star and small-star rounds; every round is one shuffle of the remaining links,
    hubs are pre-aggregated, and nothing is collected but whether the links are stars yet.  That is looked at before each round,
    so links that are stars from the start take none.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(
            edges.join(least, "u").select(
                F.col("v").alias("u"), F.col("m").alias("v")
            ).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).distinct()
