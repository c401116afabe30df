"""Connected components of a table of links, by alternating stars.

Each round joins every node's links to its least neighbour (large star), then to the least among
its smaller neighbours (small star), until nothing changes. Links stay a distributed table that is
written to the shared folder after each round; the number of rounds grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptwell.sources.workspace import write_once


def components(links: DataFrame) -> DataFrame:
    """Links u, v to node, root for every node of a link; root is the least node of its component.

    Links to oneself and links with a null end are no links. Repeated links count once.
    """
    edges = write_once(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"),
                                                         F.col("u").alias("v")))
        # Stored before the join, so that Spark can split a task with a hot node.
        least = write_once(both.groupBy("u").agg(F.min("v").alias("m"))
                           .select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"),
                                                                     F.col("m").alias("v"))
        large = write_once(large.distinct(), "large-star")
        floor = write_once(large.groupBy("u").agg(F.min("v").alias("m")), "floor")
        small = large.join(floor, "u")
        edges = write_once(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        state = edges.agg(F.count("*").alias("n"),
                          F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
