"""Connected components by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import large, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node that it can reach.

    Each round writes its edges to the shared folder; only a count and a sum reach the driver. Edges always point to a
    smaller node, a large-star round hangs the larger neighbours of a node under its smallest one, a small-star round
    the smaller ones, and when neither changes an edge, every edge points to its root."""
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("u", F.col("v").alias("n")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("n")))
        least = both.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(large(least), "u").where("n > u").select(F.col("n").alias("u"), F.col("m").alias("v")).distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(large(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        if mark == (mark := _mark(edges)):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
