"""Connected components of a graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.session import shared_dir


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node of the connected component of every other node in ``pairs`` (a, b), of any type with
    an order; roots themselves have no row. The edges are cut from their lineage by checkpoint() each round; the rounds grow with the logarithm of the
    longest path."""
    shared_dir(pairs.sparkSession)
    edges = pairs.where("a <> b").distinct().checkpoint()
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = (
            large.join(least, "u").select(F.col("v").alias("u"), "m").where("u <> m").unionByName(least.select("u", "m")).distinct().select(F.col("m").alias("a"), F.col("u").alias("b")).checkpoint()
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        last = state
