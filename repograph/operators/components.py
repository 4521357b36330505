"""Connected components of an undirected edge list."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.session import store


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list; root is the smallest node.

    Alternating large-star and small-star rounds until the edges are stars: each round is two
    aggregates and joins on the node, logarithmically many rounds even on long chains, and
    nothing is gathered per component. Self-loops and null ends are ignored. Each round's
    edges are written to the shared folder.
    """
    cur = store(edges.where(F.col(a) != F.col(b))
                 .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
                 "edges")
    while not _all_stars(cur):
        both = cur.union(cur.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every edge points from the larger node to the smaller one already
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = store(large.join(low2, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), "edges")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select("v", "v").distinct())


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u: then v is the root of all its edges."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("into") == 1))).isEmpty()
