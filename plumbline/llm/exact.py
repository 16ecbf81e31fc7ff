"""Exact dedup: heavy hitters by broadcast, the rest by an ordinary shuffle.

Texts are equal when they are identical after all white space ``[\\x20\\x09-\\x0D]`` is
deleted. Every row is reduced to the SHA-256 of that text once; the digests are pinned
and the texts are not read again.

1. A Misra-Gries style summary (Spark's frequent-items sketch: counters that are
   decremented together when they run out) proposes the digests that occur often. It is
   built per input task, merged in groups of tasks and then once more. Each summary
   holds at most ``tracked`` counters, whatever the input.
2. The proposals are verified: rows with a proposed digest are grouped, which map-side
   combining reduces to one row per digest and task. The verified winners, at most
   ``heavy`` rows, are broadcast, so copies of a frequent text are decided where they
   lie and are never shuffled.
3. The remaining digests are grouped and joined back by shuffle. None of their groups
   is larger than the sketch's error allows (3.5 / ``tracked`` of all rows), or it would
   have been proposed, unless more than ``heavy`` digests are that frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rows
from plumbline.sources.pinning import pin

#: Counters per summary; a power of two times 3/4 is what the sketch can fill.
TRACKED = 8192
#: Digests that may be treated as heavy, which bounds the broadcast (about 100 KB).
HEAVY = 1000
_BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeezed(text):
    """The text without white space; NULL counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in _BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, chars, sha, and the row's identity."""
    known = rows.identified(docs)
    text = rows.pick(known, doc_id=id_column, text=text_column, __file="__file", __row="__row")
    return text.select(
        "doc_id",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("chars"),
        F.unhex(F.sha2(squeezed(F.col("text")), 256)).alias("sha"),
        "__file",
        "__row",
    )


def frequent(marked: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """At most ``heavy`` 64-bit keys of digests that may be frequent."""
    summaries = (
        marked.select(F.xxhash64("sha").alias("item"))
        .groupBy(F.expr("pmod(spark_partition_id(), 64)").alias("part"))
        .agg(F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("summary"))
    )
    # grouped by a constant: an empty partition must not add an empty summary
    whole = summaries.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
    return whole.select(
        F.inline(F.expr(f"approx_top_k_estimate(summary, {heavy})"))
    ).select("item")


def _winners(marked: DataFrame) -> DataFrame:
    best = F.min(F.struct(-F.col("chars"), "doc_id", "__file", "__row"))
    return marked.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tracked: int = TRACKED,
    heavy: int = HEAVY,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, identity.

    The row with the most code points stays, then the one with the smallest id (NULL
    ids come first), then the one that comes first in the files, so exactly one row of
    every group is kept, also among repeated rows. NULL, empty and blank texts form one
    group. An empty table gives no rows. Extra columns are ignored.
    """
    marked = pin(digests(docs, id_column, text_column))
    items = frequent(marked, tracked, heavy)
    verified = pin(
        _winners(marked.join(F.broadcast(items), F.xxhash64("sha") == F.col("item"), "left_semi"))
    )
    chosen = F.broadcast(verified)
    decided = marked.join(chosen, "sha")
    rest = marked.join(F.broadcast(verified.select("sha")), "sha", "left_anti")
    settled = rest.join(_winners(rest), "sha")
    kept = (F.col("__file") == F.col("best.__file")) & (F.col("__row") == F.col("best.__row"))
    return decided.unionByName(settled).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "__file",
        "__row",
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; all columns stay."""
    known = rows.identified(docs)
    lost = exact_groups(known, id_column, text_column).where(~F.col("kept"))
    return rows.without(known, lost)
