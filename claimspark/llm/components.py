"""Connected components of a graph of long ids, by alternating large and small stars.

Each step is a group-wise minimum and a join, written to the shared folder; no link or component
ever reaches the driver, and the number of steps grows with the logarithm of the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """``links``: columns a, b. Result: node, root (its component's smallest node); nodes without links aren't in it."""
    spark = links.sparkSession
    now = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        # Large star: the larger neighbours of u go to the smallest of u and its neighbours.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        # Small star: u and its smaller neighbours go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        small = materialise(small, "stars")
        after = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (now, large):
            discard(spark, old)
        now = small
        if tuple(after) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(after)
