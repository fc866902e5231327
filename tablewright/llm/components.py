"""Connected components of a large graph."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.scratch import written


def connected_components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``: the smallest node) for all nodes of ``links`` (``a``, ``b``).

    Large-star and small-star steps alternate until the edges stay the same; each
    round is written to the shared folder. Neighbourhoods are only ever reduced to their smallest
    node, never gathered.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # Every neighbour that is larger than a node goes to the smallest node about it.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Every smaller neighbour of a node, and the node itself, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
