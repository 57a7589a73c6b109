"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.staging import stage


def _toward_min(pairs: DataFrame) -> DataFrame:
    """Every (u, v) with the smallest of u and all its v.

    The minima are stored first, so both sides of the join are plain exchanges that Spark
    can split where one node has a large share of the edges.
    """
    least = stage(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star-minima")
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (columns a, b); component is the smallest node.

    Large-star and small-star steps alternate until the edges stop changing, which takes a number of
    rounds that grows with the logarithm of the longest chain.  Every step is an aggregate and a join;
    the edges of a round are stored.  Null ends, loops and repeated edges are dropped: a node that has
    only such edges is not in the result.  An empty table gives an empty table.
    """
    kind = edges.schema["a"].dataType
    current = stage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_min(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        met = _toward_min(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        following = stage(small.where("u <> v").distinct(), "small-star")
        now = mark(following)
        current = following
        if now == seen:
            break
        seen = now
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(heads).select(F.col("node").cast(kind), F.col("component").cast(kind))
