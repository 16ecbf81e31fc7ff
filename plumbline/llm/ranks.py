"""Global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.pinning import pin


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with a column ``__at``: 0, 1, 2 ... in the given order.

    The rows are range partitioned, sorted and pinned; only the number of rows of each
    partition goes through one window. Ties should be broken by the order given: tied
    rows may take each other's place on another run.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = pin(placed.withColumn("__local", F.monotonically_increasing_id()))
    part = F.shiftright("__local", 33)
    sizes = local.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    # one row per partition, so as many as the shuffle has partitions
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    low = F.col("__local").bitwiseAND((1 << 33) - 1)
    return (
        local.join(F.broadcast(starts), part == F.col("__part"))
        .withColumn("__at", F.col("__start") + low)
        .drop("__part", "__start", "__local")
    )
