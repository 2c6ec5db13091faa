"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges never leave the cluster. Every step writes its edges to the shared folder and joins written tables directly, so that
Spark can split the partition of a node with very many edges while the query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _lowest(edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """The smallest of each node u and its neighbours v in edges(u, v): as written, and with u named `at`."""
    written = common.materialise(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), tag)
    return written, written.withColumnRenamed("u", "at")


def _count(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum((F.xxhash64("u", "v") % 1000003).cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges(u, v) that isn't its component's smallest; u and v of one ordered type, no nulls.

    A round's tables are deleted as soon as the next round's edges are written."""
    now = common.materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    was = None
    while (sign := _count(now)) != was:
        was = sign
        both = common.materialise(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
        low, low_named = _lowest(both, "cc-low")
        large = both.where("v > u").join(low_named, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = common.materialise(large.where("u <> v").distinct(), "cc-large")
        least, least_named = _lowest(large, "cc-least")
        small = large.join(least_named, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.unionByName(least_named.select(F.col("at").alias("u"), F.col("low").alias("v")))
        before, now = now, common.materialise(small.where("u <> v").distinct(), "cc-small")
        common.discard(before, both, low, large, least)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
