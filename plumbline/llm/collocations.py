"""Phrases whose words come together more often than their parts suggest.

1. Every task numbers the words of a slice of texts, hashes all n-grams of one to
   ``longest`` words, and sends sorted keys with their counts to hash partitions.
2. Each hash partition merges what it gets into a Misra-Gries summary of more counters than
   its mass divided by the least count, so every n-gram that is frequent enough keeps one:
   the merges take away at most mass / (capacity + 1) < ``least`` from any count. What may
   still be frequent becomes a set bit in a bitmap of a fixed size.
3. A second pass counts, by their words, the n-grams whose bit is set. Equal hashes and
   crowded bits only let more n-grams be counted; none is lost and every count is exact.

Shuffles carry keys of a few bytes and counts. Number and content of the hash partitions
follow the size of the texts: ``FAN`` bits are dealt at a time, so that no task writes more
than ``2 ** FAN`` rows per batch; larger tables are dealt in further rounds. What the driver
collects and broadcasts is the bitmap, ``2 ** BITMAP`` bits whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import rows
from plumbline.llm.words import mixed, text_bytes
from plumbline.sources.pinning import pin

#: Words of a phrase at most, occurrences at least, phrases per language.
LONGEST, LEAST, TOP = 3, 10, 2000
#: Percent of its occurrences a phrase may have inside a longer one.
COVERED = 50
#: Bytes of text worked on at a time, and n-grams a task holds before it sends them.
SLICE, HELD = 1 << 22, 3_000_000
#: Occurrences of n-grams per hash partition, about.
MASS = 1 << 23
#: Bits of a key dealt at a time, bits of a key sent, bits of the bitmap as a power of two.
FAN, KEY, BITMAP = 10, 48, 27
#: Copies of a part's count, so that a part of very many phrases is looked up in many tasks.
SALT = 16

RUN = "bucket bigint, n bigint, data binary"
COUNTS = "lang string, n int, phrase string, f bigint"

#: What separates words, and what separates pieces.
_GAPS, _BREAKS = [0x20, 0x09], [*b".,;:!?", *range(0x0A, 0x0E)]
_CLASS = np.zeros(256, np.int8)
_CLASS[_GAPS], _CLASS[_BREAKS] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The words of a slice of texts, numbered, with the piece and language of each."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        raw, bounds = text_bytes(texts)
        n = len(bounds) - 1
        data = np.full(len(raw) + n, 10, np.uint8)  # a line feed between two texts
        keep = np.ones(len(data), bool)
        keep[bounds[1:] + np.arange(n)] = False
        data[keep] = raw
        kind = _CLASS[data]
        solid = kind == 0
        begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        pieces = np.cumsum(kind == 2, dtype=np.int64)
        self.piece = pieces[begins]
        lengths = np.add.reduceat(solid, begins) if len(begins) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begins),
            [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[solid]])],
        ).dictionary_encode()
        self.words, self.id = words.dictionary, words.indices.to_numpy().astype(np.int64)
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary
        doc = np.searchsorted(bounds + np.arange(n + 1), begins, "right") - 1
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]

    def places(self, n: int) -> np.ndarray:
        """First words of all n-grams within pieces."""
        if n > len(self.id):
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :])

    def keys(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first words, hashes) for every length."""
        def hashes(values: pa.Array) -> np.ndarray:
            return np.fromiter((xxhash.xxh64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))

        word, lang = hashes(self.words)[self.id], hashes(self.langs)[self.lang]
        key = mixed(word + lang * _STEP)
        for n in range(1, longest + 1):
            at = self.places(n)
            if n > 1:
                key = mixed(key[: len(key) - 1] * _STEP + word[n - 1 :]) if len(key) else key
            yield n, at, key[at]

    def phrases(self, n: int, at: np.ndarray) -> pa.RecordBatch:
        """Language, words and number of the n-grams at ``at``, told apart by their words."""
        code, size = self.lang[at], len(self.words)
        for k in range(n):
            code = code * size + self.id[at + k]
            if k + 1 < n:
                code = np.unique(code, return_inverse=True)[1]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        first = at[first]
        parts = [self.words.take(pa.array(self.id[first + k])) for k in range(n)]
        phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return counted(self.langs.take(pa.array(self.lang[first])), n, phrase, counts)


def counted(langs: pa.Array, n: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            langs.cast(pa.string()), pa.array(np.full(len(counts), n), pa.int32()),
            phrases.cast(pa.string()), pa.array(counts, pa.int64()),
        ],
        ["lang", "n", "phrase", "f"],
    )


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    """Whole texts, as many together as ``SLICE`` bytes hold, one at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
            part = batch.slice(at, end - at)
            yield Grams(part.column("lang"), part.column("text"))
            at = end


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    return (keys[first], np.add.reduceat(counts, first)) if len(keys) else (keys, counts)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters, mergeable.

    A count is too low by ``lost`` at most, and lost * (capacity + 1) never passes the mass.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = summed(np.append(self.keys, keys), np.append(self.counts, counts))
        if len(self.keys) > self.capacity:
            # every counter loses what the first one beyond the capacity has
            least = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            left = self.counts > least
            self.keys, self.counts = self.keys[left], self.counts[left] - least
            self.lost += least

    def at_least(self, f: int) -> np.ndarray:
        """Keys that may occur ``f`` times."""
        return self.keys[self.counts + self.lost >= f]


def written(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys byte by byte, counts below 255 as a byte, the rest behind."""
    planes = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY // 8].T
    large = np.flatnonzero(counts >= 255)
    return b"".join(
        [planes.tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()]
    )


def read(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, : KEY // 8] = raw[: n * (KEY // 8)].reshape(KEY // 8, n).T
    end = n * (KEY // 8 + 1)
    counts = raw[end - n : end].astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[end:].tobytes(), "<i8")
    return keys.view("<u8").ravel().astype(np.uint64), counts


def dealt(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys as one row per bucket, the first ``bits`` of a key."""
    bucket = (keys >> np.uint64(KEY - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = [*first[1:].tolist(), len(keys)]
    for at, end in zip(first.tolist(), ends):
        data = pa.array([written(keys[at:end], counts[at:end])], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[at])], pa.int64()), pa.array([end - at], pa.int64()), data],
            ["bucket", "n", "data"],
        )


def _sent(longest: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summary(1 << 62)
        for grams in slices(batches):
            keys = np.concatenate([k for _, _, k in grams.keys(longest)]) >> np.uint64(64 - KEY)
            keys, counts = np.unique(keys, return_counts=True)
            held.merge(keys, counts.astype(np.int64))
            if len(held.keys) >= HELD:
                yield from dealt(held.keys, held.counts, bits)
                held = Summary(1 << 62)
        if len(held.keys):
            yield from dealt(held.keys, held.counts, bits)

    return run


def _dealt_on(bits: int) -> Callable:
    """Deals runs of few buckets to the buckets of ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Summary(1 << 62), None
        for batch in batches:
            for row in batch.to_pylist():
                if len(held.keys) and (row["bucket"] != now or len(held.keys) >= HELD):
                    yield from dealt(held.keys, held.counts, bits)
                    held = Summary(1 << 62)
                now = row["bucket"]
                held.merge(*read(row["n"], row["data"]))
        if len(held.keys):
            yield from dealt(held.keys, held.counts, bits)

    return run


def _frequent(least: int, bits: int, bitmap: int) -> Callable:
    """A hash partition's slice of the bitmap."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        runs = list(zip(table.column("n").to_pylist(), table.column("data")))
        mass = sum(int(read(n, data.as_py())[1].sum()) for n, data in runs)
        found = Summary(mass // least + 1)
        for n, data in runs:
            found.merge(*read(n, data.as_py()))
        place = found.at_least(least) >> np.uint64(KEY - bitmap)
        marks = np.zeros(1 << (bitmap - bits), bool)
        marks[(place & np.uint64(len(marks) - 1)).astype(np.int64)] = True
        bucket = key[0].as_py()
        return pa.table(
            {"bucket": pa.array([bucket], pa.int64()), "data": pa.array([np.packbits(marks).tobytes()], pa.binary())}
        )

    return run


def frequent_bits(text: DataFrame, longest: int, least: int, mass: int = MASS, fan: int = FAN,
                  bitmap: int = BITMAP) -> bytes:
    """A bitmap over the first bits of keys; set for all n-grams that occur ``least`` times."""
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about an n-gram of each length per five or six bytes
    bits = min(max(0, int(size * longest / 6 / mass)).bit_length(), bitmap - 3)
    runs = text.mapInArrow(_sent(longest, min(fan, bits)), RUN)
    done = min(fan, bits)
    while done < bits:
        done = min(done + fan, bits)
        spread = F.expr("pmod(xxhash64(data), 64)")
        runs = runs.repartition("bucket", spread).sortWithinPartitions("bucket").mapInArrow(_dealt_on(done), RUN)
    marked = runs.groupBy("bucket").applyInArrow(_frequent(least, bits, bitmap), "bucket bigint, data binary")
    width = (1 << (bitmap - bits)) // 8
    out = bytearray((1 << bitmap) // 8)
    part = F.shiftright("bucket", max(0, bits - 10))
    gathered = marked.groupBy(part.alias("part")).agg(F.collect_list(F.struct("bucket", "data")).alias("all"))
    for row in gathered.toLocalIterator():
        for bucket, data in row["all"]:
            out[bucket * width : (bucket + 1) * width] = data
    return bytes(out)


def _exact(longest: int, marks, bitmap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marks.value, np.uint8)
        for grams in slices(batches):
            words = np.bincount(grams.lang, minlength=len(grams.langs))
            yield counted(grams.langs, 0, pa.array([""] * len(words)), words)
            for n, at, keys in grams.keys(longest):
                place = keys >> np.uint64(64 - bitmap)
                byte = bits[(place >> np.uint64(3)).astype(np.int64)]
                found = (byte >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1
                at = at[found == 1]
                if len(at):
                    yield grams.phrases(n, at)

    return run


def counts(text: DataFrame, longest: int, least: int, **sizes: int) -> DataFrame:
    """lang, n, phrase, f of all n-grams with f >= ``least``; n = 0 holds a language's words."""
    marks = frequent_bits(text, longest, least, **sizes)
    bitmap = sizes.get("bitmap", BITMAP)
    shared = text.sparkSession.sparkContext.broadcast(marks)
    found = text.mapInArrow(_exact(longest, shared, bitmap), COUNTS)
    found = found.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return found.where(f"n = 0 OR f >= {least}")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED,
    text_column: str = "text", lang_column: str = "lang", **sizes: int,
) -> DataFrame:
    """Per language the ``top`` phrases of two to ``longest`` words by score, then count,
    then the phrase's bytes: lang, rank, phrase, a, l, r, n, score.

    A phrase occurs ``least`` times or more (a). Cut in two it has counts l and r; the score
    is floor(1000000 a a / (l r)) of the cut that scores lowest, the first of those that
    score equally. A phrase that a longer frequent one holds in ``covered`` percent of its
    occurrences or more is left out.

    NULL and empty texts have no words, NULL languages are ``und``, repeated rows count as
    often as they are there, an empty table gives no rows, extra columns are ignored.
    """
    text = rows.pick(docs, text=text_column, lang=lang_column)
    text = text.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    known = pin(counts(text, longest, least, **sizes))
    parts = known.where(f"n BETWEEN 1 AND {longest - 1}").select(
        "lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    )
    phrases = known.where("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"))
    cuts = (
        phrases.withColumn("words", F.split("phrase", " "))
        .withColumn("k", F.expr("explode(sequence(1, n - 1))"))
        .select(
            "lang", "phrase", "a", "k",
            F.expr("array_join(slice(words, 1, k), ' ')").alias("first"),
            F.expr("array_join(slice(words, k + 1, n - k), ' ')").alias("rest"),
            F.expr(f"CAST(pmod(xxhash64(phrase), {SALT}) AS INT)").alias("salt"),
        )
    )
    for side, name in (("first", "l"), ("rest", "r")):
        looked = parts.select("lang", F.col("part").alias(side), F.col("f").alias(name), "salt")
        cuts = cuts.join(looked, ["lang", side, "salt"])
    product = "CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))"
    scored = cuts.withColumn(
        "score", F.expr(f"({product}) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    )
    lowest = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    inner = (
        phrases.where("n >= 3").withColumn("words", F.split("phrase", " "))
        .select("lang", "a", "words", "n", F.expr("explode(sequence(2, n - 1))").alias("size"))
        .withColumn("at", F.expr("explode(sequence(1, n - size + 1))"))
        .select("lang", F.expr("array_join(slice(words, at, size), ' ')").alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    left = lowest.join(inner, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(20,0)) < {covered} * CAST(a AS DECIMAL(20,0))"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    best = left.withColumn("rank", F.row_number().over(order)).where(f"rank <= {top}")
    totals = known.where("n = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a",
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
    )
