"""Removing long repeated passages: a sharded logarithmic index of suffix arrays.

Every byte that is covered by a string of ``length`` bytes which also starts anywhere else
is removed. Strings that start at two places are found by sorted arrays of suffixes, but
not of all suffixes, and not by comparing bytes:

*Batches.* Documents are gathered into batches of a few MB, which are stored once
(compressed) and read again by every step.

*Sampled suffixes.* Every window of ``length`` bytes is represented by the smallest hash
among its grams of ``GRAM`` bytes, leftmost first: its anchor. Equal windows have their
anchor at the same place, and windows next to each other mostly share it, so a batch has
about one anchor in 120 bytes. The suffix array of a batch holds its anchors ordered by
the hash of what follows (order by fingerprint instead of by bytes; all that is asked of
the order is that equal strings meet). A second kind of entry is the block between two
anchors plus a window, ordered likewise.

*Index family.* Arrays are split by range into shards. A shard takes the arrays of the
batches one after the other: each is merge-scanned against the existing levels, which
tells the entries that occur there, and becomes a level itself; levels of about equal
size are merged, so their sizes grow geometrically and every entry is moved a
logarithmic number of times. Every batch gets back which of its entries are repeated.

*Exact ends.* If a block is repeated, all windows in it are. A window whose anchor is
not repeated is not repeated. What is left are windows at the ends of long matches. Their
anchors are *open* at those distances, wherever they occur (a second index of the same
kind tells the other batches), and the fingerprints of the windows that lie at an open
distance from an open anchor go through a third one.

Nothing is capped, and an entry that occurs in a third of all texts is sent once per
batch. Fingerprints that decide have 96 bits (two independent polynomials modulo 2^64, of
which one is cut to 32 bits); the chance that any two different windows of 100 TB meet is
a few per cent. Memory holds one batch, or one shard: shards are as many as it takes to
keep them at about ``SHARD`` entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rows
from plumbline.llm.words import mixed, text_bytes
from plumbline.sources.pinning import pin

LENGTH = 400
GRAM = 160
#: Distances from a window to its anchor are told apart in steps of so many bytes.
STEP = 30
#: Bytes of a batch; a longer document is a batch of its own.
BATCH = 4 << 20
#: Window starts that are worked on together.
SLICE = 1 << 20
#: Entries of a shard, about.
SHARD = 1 << 20

_rng = np.random.default_rng(11)
_FIRST = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 22) - 1)


def _powers(which: int, n: int, kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if which not in kept or len(kept[which][0]) < n:
        out = []
        for base in (_STEPS[which], pow(_STEPS[which], -1, 2**64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        kept[which] = tuple(out)
    return kept[which]


class Prints:
    """Fingerprints of any stretches of some bytes."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        up, self.down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FIRST, _SECOND)[which][data] * up[: len(data)], out=self.sums[1:])

    def runs(self, length: int) -> np.ndarray:
        """Of every stretch of this length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Scan:
    """Anchors and blocks of a batch: a function of its bytes and document bounds.

    ``windows`` tells whether a window that starts at a byte lies within one document.
    Anchor i (at ``at[i]``) represents the windows from ``first[i]`` up to ``first[i + 1]``
    that are within documents. Block j spans ``left[j]`` to ``right[j]`` plus a window.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data = data
        n = len(data)
        self.windows = np.zeros(n, bool)
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - start >= LENGTH:
                self.windows[start : end - LENGTH + 1] = True
        at, first, grams, left, right, prints = [], [], [], [], [], []
        for start in range(0, max(0, n - LENGTH + 1), SLICE):
            # blocks reach into the next slice by at most a window's worth of anchors
            end = min(n, start + SLICE + 3 * LENGTH)
            if not self.windows[start : start + SLICE].any():
                continue
            part = data[start:end]
            one = Prints(part, 0)
            gram = one.runs(GRAM)
            places = np.arange(len(gram), dtype=np.uint64)
            least = _least((gram & ~_PLACE) | places, LENGTH - GRAM + 1) & _PLACE
            inside = self.windows[start : start + len(least)]
            here = np.flatnonzero(inside)
            anchor = least[here].astype(np.int64)
            fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            begin, anchor = here[fresh], anchor[fresh]
            mine = begin < SLICE
            at.append(anchor[mine] + start)
            first.append(begin[mine] + start)
            grams.append(gram[anchor[mine]])
            # a block needs all windows between two anchors to be within the document
            a, b = anchor[:-1], anchor[1:]
            # an anchor belongs to the slice its first window starts in
            fits = mine[:-1] & (b + LENGTH <= len(part)) & (b - a < LENGTH)
            a, b = a[fits], b[fits]
            valid = np.concatenate([[0], np.cumsum(inside)])
            whole = (b < len(inside)) & (valid[np.minimum(b + 1, len(inside))] - valid[a] == b - a + 1)
            a, b = a[whole], b[whole]
            left.append(a + start)
            right.append(b + start)
            prints.append(self._both(one, Prints(part, 1), a, b + LENGTH))
        none = np.zeros(0, np.int64)
        self.at, self.first = (np.concatenate(x or [none]) for x in (at, first))
        self.grams = mixed(np.concatenate(grams or [none.astype(np.uint64)]))
        left, right = (np.concatenate(x or [none]) for x in (left, right))
        keys = [np.concatenate([p[i] for p in prints] or [none.astype(t)])
                for i, t in ((0, np.uint64), (1, np.uint32))]
        # two slices may both see a block
        _, kept = np.unique(left, return_index=True)
        self.left, self.right = left[kept], right[kept]
        self.block_keys, self.block_tags = keys[0][kept], keys[1][kept]

    @staticmethod
    def _both(one: Prints, two: Prints, start: np.ndarray, end: np.ndarray):
        size = (end - start).astype(np.uint64)
        return mixed(one.of(start, end) ^ mixed(size)), (two.of(start, end) >> np.uint64(32)).astype(np.uint32)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors (tag 0) and blocks."""
        tags = np.concatenate([np.zeros(len(self.grams), np.uint32), self.block_tags | np.uint32(1)])
        return np.concatenate([self.grams, self.block_keys]), tags

    def open(self, repeated: tuple[np.ndarray, np.ndarray]):
        """Windows that are repeated for sure, those that may be, and the anchors hit."""
        n = len(self.data)
        sure = np.zeros(n + 1, np.int32)
        hit = contained(self.block_keys, self.block_tags | np.uint32(1), *repeated)
        np.add.at(sure, self.left[hit], 1)
        np.add.at(sure, self.right[hit] + 1, -1)
        sure = np.cumsum(sure[:-1], dtype=np.int32) > 0
        hit = contained(self.grams, np.zeros(len(self.grams), np.uint32), *repeated)
        ends = np.append(self.first[1:], n)[: len(self.first)]
        may = self.within(self.first[hit], ends[hit]) & ~sure
        return sure, may, hit

    def stretches(self, chosen: np.ndarray):
        """The windows of the chosen anchors by their distance to the anchor.

        Returns a key per anchor hash and distance class, and where its windows start
        and end. Equal windows lie at the same distance, so they share a key.
        """
        i = np.flatnonzero(chosen)
        at, low = self.at[i], self.first[i]
        high = np.minimum(np.append(self.first[1:], len(self.data))[i], at + 1)
        near, far = (at - high + 1) // STEP, (at - low) // STEP
        times = far - near + 1
        which = np.repeat(np.arange(len(i)), times)
        step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + near[which]
        start = np.maximum(low[which], at[which] - (step + 1) * STEP + 1)
        end = np.minimum(high[which], at[which] - step * STEP + 1)
        keys = mixed(self.grams[i][which] + step.astype(np.uint64) * np.uint64(_STEPS[1]))
        return keys, start, end

    def within(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The windows that start in any of the stretches."""
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        return (np.cumsum(change[:-1], dtype=np.int32) > 0) & self.windows

    def fingerprints(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows that start at the given places, in rising order."""
        keys, tags = [], []
        for start in range(0, len(self.data), SLICE):
            lo, hi = np.searchsorted(starts, [start, start + SLICE])
            if lo < hi:
                part = self.data[start : start + SLICE + LENGTH]
                p = starts[lo:hi] - start
                key, tag = self._both(Prints(part, 0), Prints(part, 1), p, p + LENGTH)
                keys.append(key)
                tags.append(tag)
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return np.concatenate(keys), np.concatenate(tags)


# ---------------------------------------------------------------- sorted arrays


def ordered(keys: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, tags = keys[order], tags[order]
    same = keys[1:] == keys[:-1]
    if (same & (tags[1:] != tags[:-1])).any():  # rare: equal keys of different tags
        order = np.lexsort((tags, keys))
        keys, tags = keys[order], tags[order]
    return keys, tags


def once(keys: np.ndarray, tags: np.ndarray):
    """Distinct entries of sorted ones, and which of them came more than once."""
    if not len(keys):
        return keys, tags, np.zeros(0, bool)
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (tags[1:] != tags[:-1])])
    at = np.flatnonzero(fresh)
    return keys[at], tags[at], np.diff(np.append(at, len(keys))) > 1


def contained(keys, tags, inside_keys, inside_tags) -> np.ndarray:
    """Which entries are among some sorted distinct ones."""
    low = np.searchsorted(inside_keys, keys, "left")
    found = np.zeros(len(keys), bool)
    open_ = low < len(inside_keys)
    while open_.any():
        i = np.flatnonzero(open_)
        same = inside_keys[low[i]] == keys[i]
        found[i] |= same & (inside_tags[low[i]] == tags[i])
        low[i] += 1
        open_[i] = same & ~found[i] & (low[i] < len(inside_keys))
    return found


class Levels:
    """A logarithmic family of sorted arrays, with the entries found more than once."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, tags: np.ndarray, twice: np.ndarray) -> None:
        """Merge-scans sorted distinct entries against all levels and adds them."""
        hit = twice.copy()
        for level in self.levels:
            hit |= contained(keys, tags, *level)
        if hit.any():
            self.found.append((keys[hit], tags[hit]))
        self.levels.append((keys, tags))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            both = ordered(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
            self.levels.append(once(*both)[:2])

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.found:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return once(*ordered(*[np.concatenate([f[i] for f in self.found]) for i in (0, 1)]))[:2]


# ---------------------------------------------------------------- on Spark

_STORE = "batch bigint, ids array<bigint>, sizes binary, data binary"
_RUN = "shard int, batch bigint, keys binary, tags binary, twice binary"
_BACK = "batch bigint, keys binary, tags binary"
_BITS = "batch bigint, shard int, bits binary"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in batches of about ``BATCH`` bytes."""
    import zstandard
    from pyspark import TaskContext

    name = TaskContext.get().partitionId() << 33
    ids: list = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], "<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([sizes.tobytes()]), pa.array([zstandard.compress(b"".join(texts), 3)])],
            ["batch", "ids", "sizes", "data"],
        )

    for part in batches:
        for at in range(0, part.num_rows, 256):
            some = part.slice(at, 256)
            raw, bounds = text_bytes(some.column("text"))
            for i, doc in enumerate(some.column("doc_id").to_pylist()):
                data = raw[bounds[i] : bounds[i + 1]].tobytes()
                if texts and held + len(data) > BATCH:
                    yield flush()
                    name += 1
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(data)
                held += len(data)
    if texts:
        yield flush()


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    sizes = np.frombuffer(row["sizes"], "<i8")
    data = np.frombuffer(zstandard.decompress(row["data"], max_output_size=int(sizes.sum()) + 1), "u1")
    return data, np.concatenate([[0], np.cumsum(sizes)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _runs(batch: int, keys: np.ndarray, tags: np.ndarray, shards: int) -> list[tuple]:
    keys, tags, twice = once(*ordered(keys, tags))
    bits = shards.bit_length() - 1
    shard = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else []
    return [
        (int(shard[a]), batch, keys[a:z].tobytes(), tags[a:z].tobytes(),
         np.packbits(twice[a:z]).tobytes())
        for a, z in zip(list(cut[:-1]), list(cut[1:]))
    ]


def _table(found: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*found)) if found else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields]
    )


def _arrays(found: pa.Table) -> list[tuple]:
    out = []
    for row in found.sort_by("batch").to_pylist():
        keys, tags = np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["tags"], "<u4")
        twice = np.unpackbits(np.frombuffer(row["twice"], "u1"), count=len(keys)).astype(bool)
        out.append((row["batch"], keys, tags, twice))
    return out


def _merged(found: pa.Table) -> pa.Table:
    """A shard: all arrays through the index, then to every batch what is repeated of it."""
    levels = Levels()
    runs = _arrays(found)
    for _, keys, tags, twice in runs:
        levels.add(keys, tags, twice)
    return _told(runs, levels.repeated())


def _merged_to_bits(found: pa.Table) -> pa.Table:
    """As ``_merged``, but a batch gets one bit for each of its entries, in their order."""
    shard = found.column("shard")[0].as_py() if found.num_rows else 0
    levels = Levels()
    runs = _arrays(found)
    for _, keys, tags, twice in runs:
        levels.add(keys, tags, twice)
    repeated = levels.repeated()
    out = []
    for batch, keys, tags, _ in runs:
        hit = contained(keys, tags, *repeated)
        if hit.any():
            out.append((batch, shard, np.packbits(hit).tobytes()))
    return pa.Table.from_batches([_table(out, _BITS)])


def _marked(found: pa.Table) -> pa.Table:
    """A shard: to every batch which of its entries any batch has marked."""
    runs = _arrays(found)
    marks = [np.concatenate([r[i][r[3]] for r in runs]) for i in (1, 2)]
    return _told(runs, once(*ordered(*marks))[:2])


def _told(runs: list[tuple], repeated: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    out = []
    for batch, keys, tags, _ in runs:
        hit = contained(keys, tags, *repeated)
        if hit.any():
            out.append((batch, keys[hit].tobytes(), tags[hit].tobytes()))
    return pa.Table.from_batches([_table(out, _BACK)])


def _answered(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    parts = row[name] or []
    keys = np.frombuffer(b"".join(p["keys"] for p in parts), "<u8")
    tags = np.frombuffer(b"".join(p["tags"] for p in parts), "<u4")
    return ordered(keys, tags)


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _first_entries(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            scan = Scan(*_opened(row))
            yield _table(_runs(row["batch"], *scan.entries(), shards), _RUN)

    return run


def _open_anchors(shards: int):
    """The repeated anchors of every batch, marked if windows of theirs are unsettled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if row["one"]:
                scan = Scan(*_opened(row))
                _, may, hit = scan.open(_answered(row, "one"))
                keys, start, end = scan.stretches(hit)
                total = np.concatenate([[0], np.cumsum(may)])
                marked = np.unique(keys[total[end] > total[start]])
                # a marked one comes twice, any other once
                keys = np.concatenate([np.unique(keys), marked])
                yield _table(_runs(row["batch"], keys, np.zeros(len(keys), np.uint32), shards), _RUN)

    return run


def _sent(scan: Scan, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the windows at open distances from open anchors."""
    _, _, hit = scan.open(_answered(row, "one"))
    keys, start, end = scan.stretches(hit)
    told = contained(keys, np.zeros(len(keys), np.uint32), *_answered(row, "open"))
    return scan.fingerprints(np.flatnonzero(scan.within(start[told], end[told])))


def _second_entries(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if row["open"]:
                scan = Scan(*_opened(row))
                yield _table(_runs(row["batch"], *_sent(scan, row), shards), _RUN)

    return run


def _cut(shards: int):
    bits = shards.bit_length() - 1

    def settled(scan: Scan, row: dict) -> np.ndarray:
        """The windows of a batch that are repeated."""
        sure, may, _ = scan.open(_answered(row, "one"))
        if not row["two"]:
            return sure
        keys, tags, _ = once(*ordered(*_sent(scan, row)))
        hit = np.zeros(len(keys), bool)
        shard = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
        for part in row["two"]:
            lo, hi = np.searchsorted(shard, np.array([part["shard"], part["shard"] + 1], np.uint64))
            hit[lo:hi] = np.unpackbits(np.frombuffer(part["bits"], "u1"), count=int(hi - lo))
        starts = np.flatnonzero(may)
        sure[starts[contained(*scan.fingerprints(starts), keys[hit], tags[hit])]] = True
        return sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, bounds = _opened(row)
            covered = np.zeros(len(data), bool)
            if row["one"]:
                sure = settled(Scan(data, bounds), row)
                change = np.zeros(len(data) + 1, np.int32)
                change[:-1] += sure
                change[LENGTH:] -= sure[: max(0, len(data) + 1 - LENGTH)]
                covered = np.cumsum(change[:-1], dtype=np.int32) > 0
            out = []
            for doc, start, end in zip(row["ids"], bounds[:-1].tolist(), bounds[1:].tolist()):
                gone = covered[start:end]
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                kept = data[start:end][~gone] if spans else data[start:end]
                out.append((doc, end - start, int(gone.sum()), spans,
                            hashlib.sha256(kept.tobytes()).hexdigest()))
            yield _table(out, _OUT)

    return run


def _index(runs: DataFrame, name: str, settle=_merged, back: str = _BACK) -> DataFrame:
    """A row per batch: what all shards tell it."""
    told = runs.groupBy("shard").applyInArrow(settle, back)
    parts = F.struct(*[c for c in told.columns if c != "batch"])
    return told.groupBy("batch").agg(F.collect_list(parts).alias(name))


def _shards(entries: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, entries / SHARD)))))


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are taken as UTF-8 bytes, NULL as empty; matches never cross documents, and
    texts shorter than ``LENGTH`` are left alone. Repeated rows are repeats of each
    other, so all of their long strings go. NULL ids stay NULL. An empty table gives no
    rows. Extra columns are ignored.
    """
    text = rows.pick(docs, doc_id=id_column, text=text_column)
    text = text.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Stored once, and shuffled once: Spark reuses the exchange of the store by batch.
    store = pin(text.mapInArrow(_stored, _STORE))
    # about two entries in 120 bytes
    runs = store.mapInArrow(_first_entries(_shards(size / 60)), _RUN)
    first = store.join(pin(_index(runs, "one")), "batch", "left")
    runs = first.mapInArrow(_open_anchors(_shards(size / 120)), _RUN)
    second = first.join(_index(runs, "open", _marked), "batch", "left")
    # windows of open anchors: assumed to be no more than one in thirty bytes
    shards = _shards(size / 30)
    runs = second.mapInArrow(_second_entries(shards), _RUN)
    two = _index(runs, "two", _merged_to_bits, _BITS)
    return second.join(two, "batch", "left").mapInArrow(_cut(shards), _OUT)
