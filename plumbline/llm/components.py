"""Connected components by alternating large and small stars, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.pinning import pin

#: Rows that a pinned file is meant to hold.
FILE_ROWS = 20_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` pinned, at most ``rows`` small rows, in as many files as they need.

    Each file costs its executor a process (local file systems set permissions by one), and
    what a round holds would lie in as many files as a shuffle has partitions.
    """
    return pin(df.coalesce(1 + rows // FILE_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b).

    Large star: every node hands its smallest neighbour (or itself) to its larger
    neighbours. Small star: every node hands the smallest of its smaller neighbours to
    the others and to itself. Both keep the components; when nothing changes, every
    component is a star around its smallest node. The number of rounds grows with the
    logarithm of the longest path. Neither makes more edges than there are nodes or edges.
    """
    edges = pin(edges.select("a", "b"))
    rows = edges.count()
    now = packed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct(), rows)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        # large star: v > u is tied to the smallest of u's surroundings
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        large = packed(large, rows)
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        now = packed(small, rows)
        seen = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)
        ).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
