"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parapet.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: greater neighbours move to the least neighbour. Small: lesser ones and the node do."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (long): the least node it can reach.

    Null ends and loops are left out. Every round is written to the shared folder; rounds grow with the logarithm of the
    longest path. Nodes with very many links are summed before the shuffle and their joins can be split.
    """
    links = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    state = None
    while True:
        links = written(_stars(_stars(links, True), False), "links")
        row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state or not row["n"]:
            break
        state = (row["n"], row["h"])
    # every link now leads from a node to its root
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
