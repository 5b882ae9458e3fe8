"""Connected components of an edge table by alternating star contractions.

A large star links each node's larger neighbours to its smallest neighbour, a small star its smaller ones;
both keep the components and shorten every path, until each node points straight at the smallest node of
its component. Each contraction is a grouped minimum (combined before the shuffle) and a join, written to
the shared folder, so the plan stays short and a lost executor costs one step. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if large:
        pairs = pairs.union(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    else:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    out = joined.filter("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")) if large else joined.select(F.col("v").alias("src"), F.col("m").alias("dst")).union(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    return out.filter("src <> dst").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges(src long, dst long)`` can reach.

    Directions don't matter; loops and edges with a null end are left out, and nodes without another edge
    don't appear. An empty table gives an empty table.
    """
    edges = written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = written(_star(_star(edges, True), False), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
