"""Connected components of a large graph, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.session import settle


def components(links: DataFrame) -> DataFrame:
    """The smallest reachable node for each node with a link, from links (x, y) in any direction.

    Large-star and small-star steps: every node hands its smallest neighbour to its larger neighbours, then to the
    smaller ones, until nothing changes. The number of rounds grows with the logarithm of the longest path, and
    the number of links never grows. Each round is checkpointed, so the plan stays short. A node alone, in links
    to itself only, is its own component. Nulls link nothing.
    """
    pairs = links.filter("x is not null and y is not null")
    pairs = settle(pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.unionByName(least.select("x", F.col("m").alias("y"))).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y")))
        pairs = settle(small.filter("x >= y").distinct())
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return pairs.groupBy("x").agg(F.min("y").alias("y"))
        before = state
