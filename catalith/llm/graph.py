"""Connected components of an edge table, on executors only, and joins with frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import cut


def join_keys(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with a sum of them by ``key``, in a way that lets frequent keys be split.

    The sum is dealt by its key already, so Spark would join in the task that sums up,
    and adaptive execution can't split that. With the key's hash as another key both
    sides are dealt anew for the join alone, and a skewed partition of it is split.
    """
    same = F.xxhash64(key).alias("_key")
    return rows.select("*", same).join(table.select("*", same), [key, "_key"]).drop("_key")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v to rows (node, component): the smallest node reachable.

    Alternates two contractions until neither changes an edge: every larger
    neighbour of a node is tied to the node's least neighbour, then every smaller
    one is. Rounds grow with the logarithm of the longest path. Only a count and
    a checksum of each round reach the driver. The least neighbour of a hub is found
    by partial sums, and its edges can be split over tasks. Nodes without an edge are
    absent; no edges give no rows.
    """
    edges, before = cut(edges.select("u", "v").distinct()), None
    while True:
        edges = cut(_small(_large(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    tied = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tied.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return join_keys(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = join_keys(edges, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.withColumnRenamed("m", "v")).distinct()
