"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.session import ScratchTable


def connected_components(links: DataFrame) -> ScratchTable:
    """(node, comp) for every node of the links (a, b): comp is the smallest node of its component.

    Each step joins edges with a minimum per node (pre-aggregated); no node's
    neighbours are ever gathered, and nothing but two numbers reaches the driver.
    """

    def edges_of(both: DataFrame, name: str) -> ScratchTable:
        return ScratchTable(both.where("a > b").distinct(), name)

    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = edges_of(ordered, "edges")
    before = None
    while True:
        state = current.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        # large star: every neighbour larger than the node goes to the smallest neighbour
        both = current.df.unionByName(current.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = edges_of(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")), "large-star")
        current.drop()
        # small star: the node and its smaller neighbours go to the smallest of them
        least = large.df.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.df.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = edges_of(moved.unionByName(least.select("a", F.col("m").alias("b"))), "small-star")
        large.drop()
    labels = current.df.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    roots = current.df.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    out = ScratchTable(labels.unionByName(roots), "components")
    current.drop()
    return out
