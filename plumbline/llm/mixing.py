"""Mixing sources to target weights by systematic sampling.

A mix takes ``share`` times all words. Every source has a weight; its target is its share
of the mix by weight, but at most ``most`` times its own size, and what a source cannot
take is shared among the others by weight until no target is above.

Every document of a source is expected ``target / source size`` times. The expected
copies are summed up along the documents of the source, one offset between 0 and 1 is
added, and a document is emitted once for every whole number that the running sum
passes within it. The sum over equal terms is a position times that term, so it is exact
and does not depend on how Spark splits the rows. The documents run by size, then id:
the words taken miss the target by no more than about one document, whatever the sizes.

Positions come from one range partitioned sort, which splits a source of any size over
as many tasks as it needs. The water level of the targets is found by a few aggregates
over the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rows
from plumbline.llm.ranks import numbered
from plumbline.sources.pinning import pin

SHARE = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)
SEED = 20240501
#: Rows of the order that share a block.
BLOCK = 1 << 16


def offset(source: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the source and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to rows of source_size and weight.

    Weights are positive. Without words every target is 0.
    """
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None
    full = None
    while True:
        above = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        taken, left, count = sources.agg(
            F.sum(F.when(above, cap).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))),
            F.count_if(above),
        ).first()
        if count == full or not left:
            break
        full = count
        level = (share * total - taken) / left
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    wanted = F.lit(float(level)) * F.col("weight")
    capped = F.when(cap < wanted, cap.cast("double")).otherwise(wanted)
    return sources.withColumn("target", capped)


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    share: float = SHARE,
    most: int = MOST,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    The weights go to the sources by code point, NULL last, and repeat. NULL and blank
    texts have size 0 and are taken as 0 words, though they may be copied. Documents of
    the same size are ordered by id, NULL first, then by their place in the files, so
    repeated rows are counted one by one. An empty table gives no rows. Extra columns
    are ignored.
    """
    known = rows.identified(docs)
    sized = rows.pick(
        known, doc_id=id_column, text=text_column, source=source_column,
        __file="__file", __row="__row",
    ).select("doc_id", "source", rows.word_count(F.col("text")).alias("size"), "__file", "__row")
    order = [F.asc_nulls_last("source"), F.asc("size"), F.asc_nulls_first("doc_id")]
    placed = numbered(sized, *order, F.asc("__file"), F.asc("__row"))
    by_source = placed.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("__at").alias("first")
    )
    ordered = numbered(by_source, F.asc_nulls_last("source"))
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.col("__at") % len(weights) + 1).cast("int"))
    plan = targets(pin(ordered.withColumn("weight", choice).drop("__at")), share, most)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select(
        F.col("source").alias("name"), "source_size", "target", "first",
        expected.alias("expected"), offset(F.col("source"), seed).alias("offset"),
    )
    # A source meets the blocks of rows it spans, so that no task gets a whole source.
    blocked = placed.withColumn("block", F.floor(F.col("__at") / BLOCK))
    spans = (
        blocked.select("source", "block").distinct()
        .join(plan, F.col("source").eqNullSafe(F.col("name")))
        .drop("source")
        .withColumnRenamed("block", "span")
    )
    same = F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("span"))
    place = F.col("__at") - F.col("first")

    def passed(documents: Column) -> Column:
        return F.floor(documents * F.col("expected") + F.col("offset"))

    return (
        blocked.join(spans, same)
        .withColumn("copies", passed(place + 1) - passed(place))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"), "__file", "__row",
        )
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; all columns stay."""
    known = rows.identified(docs)
    names = known.columns[:-2]
    chosen = mix(known).where("copies > 0").select("__file", "__row", "copies")
    flat = known.toDF(*[f"_{i}" for i in range(len(names))], "__file", "__row")
    out = flat.join(chosen, ["__file", "__row"]).drop("__file", "__row")
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return out.withColumn("__again", again).drop("__again", "copies").toDF(*names)
