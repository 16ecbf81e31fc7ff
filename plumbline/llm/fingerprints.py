"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how often they occur. For every sample and
term three numbers depend on the two alone: r and c with a Gamma(2, 1) distribution, and
b, uniform. A term of weight s has the step ``t = floor(ln s / r + b)`` and the value
``ln c - r (t - b + 1)``; the term with the smallest value is the sample, known by itself
and its step. Two documents have the same sample with a probability equal to their
generalised Jaccard similarity (shared weight over joint weight), so the share of equal
samples estimates it, with a standard deviation of at most 1 / (2 sqrt(SAMPLES)).

The edited text of a document needs the text of the next one by id. Documents get their
position in the order of ids from a sort of ids alone, and are then dealt into *shards* of
neighbours; the first document of a shard also goes to the shard before. From there on
nothing is shuffled: all groups lie within a shard. A text and its edited text begin alike;
the words they share are cut and counted once, and a term with the same weight in both is
sampled once. Everything is built from Spark's own expressions.

The smallest of a text's values, as a power of e, is exponential with the text's weight W
as its rate, so it hardly ever lies above ``REACH / W``. Most of a term's values are known
to lie above that limit without a logarithm; the others are worked out, and where one lies
below, they go on to the text's smallest ones. Whether every sample of a text was found
below its limit is checked; a shard where one was not (e^-REACH a sample) is worked out
again without limits. So the samples are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import rows
from plumbline.llm.ranks import numbered
from plumbline.sources.pinning import pin

SAMPLES = 64
#: Bytes of text in a shard and in a partition of shards, about.
SHARD = 2 << 20
PARTITION = 3 << 20
#: Samples worked out in one row: few enough for the JVM to compile their code.
CHUNK = 4
#: Rows (of seven numbers) that may be broadcast; more are joined by shuffle.
BROADCAST = 300_000
#: Bits kept of a sample's identity.
NAME = 20
#: Values above this share of a text's weight are looked for in a second go only.
REACH = 16.0
#: Added to the values of a text's closing mark, which is no term; above all others.
ABSENT = 1 << 62


def _uniform(bits: Column, low: int) -> Column:
    """24 bits from ``low`` on as a number within (0, 1)."""
    part = F.shiftrightunsigned(bits, low).bitwiseAND((1 << 24) - 1)
    return (part + F.lit(0.5)) * F.lit(1 / (1 << 24))


def _placed(value: Column) -> Column:
    # values lie well within -120 and 120; 2^34 steps for each
    return F.shiftleft(F.floor((value + F.lit(120.0)) * F.lit(float(1 << 34))), NAME)


def likeness(one: Column, other: Column) -> Column:
    """Share of equal samples; two empty texts are alike, an empty and another are not."""
    same = F.aggregate(
        F.zip_with(one, other, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x
    )
    return (
        F.when(one.isNull() & other.isNull(), F.lit(1.0))
        .when(one.isNull() | other.isNull(), F.lit(0.0))
        .otherwise(same / F.size(one))
    )


def spelled(samples: Column) -> Column:
    digits = F.transform(samples, lambda v: F.lpad(F.lower(F.hex(v)), NAME // 4, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def _pieces(text: Column) -> Column:
    return F.split(text, f"{rows.SPACE}+")


def _count(pieces: Column) -> Column:
    """Number of words among the pieces of a text; only the first and the last can be empty."""
    first = (F.get(pieces, F.lit(0)) == "").cast("int")
    last = ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return F.size(pieces) - first - last


def _limit(total: Column, reach: float | None) -> Column:
    if reach is None:
        return F.lit(ABSENT - 1)
    return F.coalesce(_placed(F.log(F.lit(reach) / F.nullif(total, F.lit(0)))), F.lit(ABSENT - 1))


def _weights(docs: DataFrame) -> DataFrame:
    """shard, ord, fact, total0, total1, term, which, weight: the terms of ``text`` and ``edited``.

    ``which`` tells the text a weight holds for: 1 for the plain one, 2 for the edited one, 3
    for both; ``total0`` and ``total1`` are their words. Both begin alike, and the words up to
    the last white space of ``kept`` are cut once. Every document ends with a mark
    (``which`` 4) without a term, so that none is lost; the mark has its ``fact``.
    """
    # a text that is no UTF-8 has no code points to cut at
    shared = F.when(
        F.col("fact").isNotNull() & F.is_valid_utf8("kept"),
        F.regexp_extract("kept", f"(?s)^.*{rows.SPACE}", 0),
    ).otherwise(F.lit(""))
    docs = docs.select("shard", "ord", "fact", "text", "edited", shared.alias("shared"))
    rest = lambda name: F.substring(name, F.char_length("shared") + 1, F.char_length(name))
    edited = F.when(F.col("fact").isNotNull(), rest("edited")).otherwise(F.lit(""))
    cut = docs.select(
        "shard", "ord", "fact", _pieces(F.col("shared")).alias("both"),
        _pieces(rest("text")).alias("plain"), _pieces(edited).alias("edited"),
    )
    totals = [_count(F.col("both")) + _count(F.col(c)) for c in ("plain", "edited")]
    # one number counts in both texts: the plain one low, the edited one high
    none = F.lit(None).cast("string")
    segments = F.array(
        F.struct(F.lit(1 + (1 << 32)).alias("step"), none.alias("fact"), F.col("both").alias("words")),
        F.struct(F.lit(1).cast("bigint").alias("step"), none.alias("fact"), F.col("plain").alias("words")),
        F.struct(F.lit(1 << 32).alias("step"), none.alias("fact"), F.col("edited").alias("words")),
        F.struct(F.lit(0).cast("bigint").alias("step"), F.col("fact"), F.array(none).alias("words")),
    )
    cut = cut.select(
        "shard", "ord", *[t.alias(f"total{i}") for i, t in enumerate(totals)], F.explode(segments).alias("s")
    )
    words = cut.select("shard", "ord", "total0", "total1", "s.fact", "s.step", F.explode("s.words").alias("word"))
    words = words.where("word IS NULL OR word <> ''")
    terms = words.select(
        "shard", "ord", "fact", "total0", "total1", "step",
        F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"),
    )
    keys = ["shard", "ord", "fact", "total0", "total1", "term"]
    counted = terms.groupBy(*keys).agg(F.sum("step").alias("steps"))
    counted = counted.select(
        *keys, F.col("steps").bitwiseAND((1 << 32) - 1).alias("in0"), F.shiftright("steps", 32).alias("in1")
    )

    def uses(*found: tuple[int, str]) -> Column:
        return F.array(*[F.struct(F.lit(w).alias("which"), F.col(c).alias("weight")) for w, c in found])

    use = (
        F.when(F.col("term").isNull(), uses((4, "in0")))
        .when(F.col("in0") == F.col("in1"), uses((3, "in0")))
        .when(F.col("in1") == 0, uses((1, "in0")))
        .when(F.col("in0") == 0, uses((2, "in1")))
        .otherwise(uses((1, "in0"), (2, "in1")))
    )
    return counted.select(*keys, F.explode(use).alias("use")).select(*keys, "use.which", "use.weight")


def _valued(weighted: DataFrame, samples: int, reach: float | None) -> DataFrame:
    """``weighted`` by ``chunk`` with the values v0, v1 ... of its samples, each above its name.

    With ``reach`` rows without a value below their limit are left out, and other values
    above it may be NULL.
    """
    keys = ["shard", "ord", "fact", "total0", "total1", "which"]
    total = F.expr("CASE which WHEN 1 THEN total0 WHEN 2 THEN total1 ELSE least(total0, total1) END")
    if reach is None:
        share = F.lit(float("inf"))
    else:  # the share of the weight, with room for rounding
        share = F.col("weight") * F.lit(reach * (1 + 1e-6)) / F.nullif(total, F.lit(0))
    last = F.when(F.col("term").isNull(), 0).otherwise(-(-samples // CHUNK) - 1)
    each = weighted.select(
        *keys, "term", F.log(F.nullif("weight", F.lit(0)).cast("double")).alias("log_weight"),
        share.alias("share"), _limit(total, reach).alias("limit"),
        F.explode(F.sequence(F.lit(0), last)).alias("chunk"),
    )
    keys += ["chunk"]
    rest = ["term", "log_weight", "limit"]
    # Each step is a projection of its own: within a condition Spark works out common parts
    # again and again.
    span = range(CHUNK)
    named = lambda make, name: [make(i).alias(f"{name}{i}") for i in span]
    several = lambda *names: [f"{n}{i}" for n in names for i in span]
    nth = lambda i: F.col("chunk") * CHUNK + i
    each = each.select(*keys, *rest, "share", *named(lambda i: F.xxhash64("term", nth(i)), "one"))
    each = each.select(
        *keys, *rest, "share", *several("one"), *named(lambda i: F.xxhash64(f"one{i}", nth(i)), "two")
    )

    def gamma(bits: str) -> Column:
        """e to the power of minus a number with a Gamma(2, 1) distribution."""
        return _uniform(F.col(bits), 0) * _uniform(F.col(bits), 24)

    def left(i: int) -> Column:
        """Uniform, from the bits that r and c leave over."""
        high = F.shiftleft(F.shiftrightunsigned(f"one{i}", 48), 8)
        return _uniform(high.bitwiseOR(F.shiftrightunsigned(f"two{i}", 56)), 0)

    each = each.select(
        *keys, *rest, "share", *named(lambda i: gamma(f"one{i}"), "y"),
        *named(lambda i: gamma(f"two{i}"), "x"), *named(left, "b"),
    )

    def r(i: int) -> Column:
        # The value is at least ln c - ln s - r, and c = -ln x at least 2 (1 - x) / (1 + x).
        # What this puts above the limit needs no logarithm.
        x, y = F.col(f"x{i}"), F.col(f"y{i}")
        low = (F.lit(2.0) - x - x) * y <= F.col("share") * (F.lit(1.0) + x)
        return F.when(low, -F.log(y))

    each = each.select(*keys, *rest, *several("x", "b"), *named(r, "r"))
    step = lambda i: F.floor(F.col("log_weight") / F.col(f"r{i}") + F.col(f"b{i}"))
    each = each.select(*keys, *rest, *several("x", "b", "r"), *named(step, "step"))

    def value(i: int) -> Column:
        # the part that may be NULL comes first, and spares the other
        found = -(F.col(f"r{i}") * (F.col(f"step{i}") - F.col(f"b{i}") + 1)) + F.log(-F.log(f"x{i}"))
        name = F.xxhash64("term", f"step{i}").bitwiseAND((1 << NAME) - 1)
        return _placed(found).bitwiseOR(name)

    each = each.select(*keys, "limit", *named(value, "v"))
    fits = (F.col("which") == 4) | (F.least(*several("v")) <= F.col("limit"))
    texts = F.expr(
        "CASE which WHEN 1 THEN array(0) WHEN 2 THEN array(1) WHEN 3 THEN array(0, 1) "
        "ELSE if(fact IS NULL, array(0), array(0, 1, 2)) END"
    )
    # not a filter, nor explode, below which Spark would work out all samples to filter by them
    dealt = each.select(*keys, *several("v"), F.explode_outer(F.when(fits, texts)).alias("nth"))
    return dealt.where(F.col("nth").isNotNull()).select(
        "shard", (F.col("ord") * 3 + F.col("nth")).alias("who"),
        F.when(F.col("nth") == 2, F.col("fact")).alias("fact"),
        F.expr("CASE nth WHEN 0 THEN total0 WHEN 1 THEN total1 ELSE 0 END").alias("total"),
        "chunk", *several("v"),
    )


def signatures(docs: DataFrame, samples: int = SAMPLES, reach: float | None = None) -> DataFrame:
    """shard, who, fact, the samples of a text (NULL for a text without words) and ``whole``.

    ``docs`` has shard, ord, fact, text, kept and edited. A document has three texts: ``text``
    as ``who`` 3 * ord, ``edited``, which begins with ``kept``, as the next one, and an empty one
    that carries ``fact``; without a fact only the first. Rows of a shard must already lie
    together, so that the groupings below need no shuffle. With ``reach`` samples are looked for
    below a limit; ``whole`` is false where one was not found there.
    """
    chunks = -(-samples // CHUNK)
    columns = [f"v{i}" for i in range(CHUNK)]
    valued = _valued(_weights(docs), samples, reach)
    keys = ["shard", "who", "fact", "total"]
    least = valued.groupBy(*keys, "chunk").agg(
        *[F.coalesce(F.min(v), F.lit(ABSENT)).alias(v) for v in columns]
    )
    names = F.array(*[F.col(v).bitwiseAND((1 << NAME) - 1).cast("int") for v in columns])
    parts = least.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("chunk", names.alias("names")))).alias("parts"),
        F.max(F.greatest(*columns)).alias("most"),
    )
    joined = F.slice(F.flatten(F.col("parts.names")), 1, samples)
    no_words = F.col("total") == 0
    found = (F.size("parts") == chunks) & (F.col("most") <= _limit(F.col("total"), reach))
    return parts.select(
        "shard", "who", "fact", F.when(~no_words, joined).alias("samples"), (no_words | found).alias("whole")
    )


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next row is the next by id, NULL ids first and repeated ids in the order of the
    files; after the last comes the first, and a single row is followed by itself. NULL
    counts as the empty text, whose fingerprint is the empty string. An empty table gives
    no rows. Extra columns are ignored.
    """
    known = rows.pick(
        rows.identified(docs), doc_id=id_column, text=text_column, __file="__file", __row="__row"
    ).withColumn("text", F.coalesce("text", F.lit("")))
    sizes = known.select("doc_id", "__file", "__row", F.octet_length("text").alias("size"))
    placed = numbered(sizes, F.asc_nulls_first("doc_id"), F.asc("__file"), F.asc("__row"))
    count, size = placed.agg(F.count(F.lit(1)), F.sum("size")).first()
    count = max(count, 1)
    shards = min(count, -(-(size or 0) // SHARD) or 1)

    def shard_of(at: Column) -> Column:
        return F.floor(at * shards / count).cast("bigint")

    at = F.col("__at")
    here = F.struct(shard_of(at).alias("shard"), at.alias("ord"), F.lit(True).alias("own"))
    before = F.struct(
        F.when(at == 0, shards - 1).otherwise(shard_of(at) - 1).cast("bigint").alias("shard"),
        F.when(at == 0, count).otherwise(at).cast("bigint").alias("ord"),
        F.lit(False).alias("own"),
    )
    leads = (at == 0) | (shard_of(at - 1) < shard_of(at))
    places = F.when(leads, F.array(here, before)).otherwise(F.array(here))
    seats = placed.select("__file", "__row", F.explode(places).alias("seat"))
    seats = seats.select("__file", "__row", "seat.*")
    found = pin(_compared(known, seats, count, size, samples, REACH))
    open_shards = found.where(~F.col("whole")).select("shard").distinct()
    if not open_shards.isEmpty():
        again = seats.join(open_shards, "shard", "left_semi")
        redone = _compared(known, again, count, size, samples, None)
        found = found.join(open_shards, "shard", "left_anti").unionByName(redone)
    return found.drop("shard", "whole")


def _compared(
    known: DataFrame, seats: DataFrame, count: int, size: int | None, samples: int, reach: float | None
) -> DataFrame:
    """Result of the documents that have a seat, with ``shard`` and ``whole``."""
    if count <= BROADCAST:
        seats = F.broadcast(seats)
    seated = known.join(seats, ["__file", "__row"]).select("shard", "ord", "own", "doc_id", "text")
    seated = seated.repartition(max(1, -(-(size or 0) // PARTITION)), "shard")

    order = Window.partitionBy("shard").orderBy("ord")
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    kept = F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) AS int))")
    edited = F.concat(kept, F.substring(F.lead("text").over(order), F.lit(1), half))
    both = seated.select("shard", "ord", "own", "doc_id", "text", kept.alias("kept"), edited.alias("edited"))
    # what else the result tells of a document travels with it as a third text
    facts = F.concat_ws(
        "|", F.char_length("text").cast("string"), F.sha2("edited", 256), F.col("doc_id").cast("string")
    )
    texts = both.select("shard", "ord", F.when(F.col("own"), facts).alias("fact"), "text", "kept", "edited")
    found = signatures(texts, samples, reach)
    # a document, its edited text, its facts, the next document
    after = Window.partitionBy("shard").orderBy("who")
    nearby = after.rowsBetween(Window.currentRow, 3)
    found = found.select(
        "shard", "who", "samples", F.min("whole").over(nearby).alias("whole"),
        F.lead("samples", 1).over(after).alias("edited"),
        F.split(F.lead("fact", 2).over(after), "\\|", 3).alias("facts"),
        F.lead("samples", 3).over(after).alias("next"),
    ).where("who % 3 = 0 AND facts IS NOT NULL")
    kind = known.schema["doc_id"].dataType
    return found.select(
        "shard", "whole",
        F.get("facts", F.lit(2)).cast(kind).alias("doc_id"),
        F.get("facts", F.lit(0)).cast("bigint").alias("n_chars"),
        F.get("facts", F.lit(1)).alias("edited_sha256"),
        spelled(F.col("samples")).alias("fingerprint"),
        spelled(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited")).alias("near_edited"),
        likeness(F.col("samples"), F.col("next")).alias("near_next"),
    )
