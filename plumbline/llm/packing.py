"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest. Rests are packed by differencing:
every piece starts as a partial partition that puts it into one of ``k`` windows; the two
partitions with the largest spread are merged, the fullest window of one with the
emptiest of the other, until one partition is left. It gives near-equal windows; ``k``
starts at the fewest windows that can hold the ids and rises whenever one is over
capacity.

Differencing needs small pieces to even out what the large ones leave. Ids may be cut
freely, so one rest in ``FINE`` is halved again and again into pieces down to ``LEAST``
ids; all other rests stay whole.

Everything happens in one pass over the partitions of the table, without a shuffle. A
task collects rests of ``GROUP`` windows, packs them and goes on, so its memory holds one
group and one batch of texts, whatever the partition holds. Ids are a function of the
text, windows a function of the partition: a lost task repeats them exactly.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from plumbline.llm import rows

WINDOW = 4096
#: Windows packed together.
GROUP = 128
#: One rest in so many is cut finely, down to so many ids.
FINE = 6
LEAST = 4
END_ID = 2
#: Words, and pieces of words, remembered by a task, and the longest of them in characters.
REMEMBERED = 600_000
LONGEST = 48
#: First code point that always goes through the whole tokenizer.
LATIN_END = "\u0250"
#: The one before it that Python lower-cases in another way than the tokenizer.
DOTTED = "\u0130"
#: Marks that stand together as one piece behind a word.
MARKS = ".,;:!?*%&#$)"
BYTES = ByteLevel(add_prefix_space=False, use_regex=False)

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


class Memory(dict):
    """Remembers what ``find`` gives for short keys.

    Half of them are those met last; when that half is full it takes the place of the
    other, from which keys come back when they are met again.
    """

    def __init__(self, find: Callable) -> None:
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, by the tokenizer's file.

    The tokenizer drops white space and never joins across it, so a text's ids are the
    ids of its words. A printable Latin word is lower-cased, split by the tokenizer's own
    pattern (letters with marks behind them need no pattern) and given to its model piece
    by piece; any other word goes through the whole tokenizer (tests compare both with
    whole texts). Short words and pieces are remembered, ``REMEMBERED`` of each at most,
    until the task ends.
    """

    def __init__(self, file: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        with open(file, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.words, self.parts = Memory(self._word), Memory(self._part)

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else BYTES.pre_tokenize_str(part)[0][0]
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def _word(self, word: str) -> bytes:
        if DOTTED in word:
            return self._whole(word)
        core = word.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or max(core) < LATIN_END):
            ids = self.parts[core.lower()]
            return ids + self.parts[word[len(core) :]] if len(core) < len(word) else ids
        if word and max(word) < LATIN_END and word.isprintable() and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, self.split(word.lower())))
        return self._whole(word)

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").replace("\n", " ").split(" ")
        return b"".join(map(self.words.__getitem__, words))

    def forget(self) -> None:
        """Gives the memory back, which later stages of a worker process need."""
        self.words.forget()
        self.parts.forget()
        pa.default_memory_pool().release_unused()


#: The tokenizer's tables, one per file and worker process.
_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``k`` near-equal windows.

    A partial partition is a list of windows by falling sum; only windows that hold
    something are written down. The heap is ordered by the spread.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    # entry: (-spread, tie, sums falling, members); absent windows are empty
    heap = [(-size, i, [size], [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, sums, members = heapq.heappop(heap)
        _, _, others, theirs = heapq.heappop(heap)
        free = k - len(sums)
        joined = []
        # the emptiest windows of one take the fullest of the other
        fit = min(len(others), free)
        for i in range(fit):
            joined.append((others[i], theirs[i]))
        clash = len(others) - fit
        keep = len(sums) - clash
        for i in range(keep):
            joined.append((sums[i], members[i]))
        for i in range(clash):
            # fullest left of the others with the emptiest left here
            mine = len(sums) - 1 - i
            joined.append((sums[mine] + others[fit + i], members[mine] + theirs[fit + i]))
        joined.sort(key=lambda w: -w[0])
        sums = [s for s, _ in joined]
        least = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (least - sums[0], tie, sums, [m for _, m in joined]))
        tie += 1
    return heap[0][3]


def packed(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """``differenced`` with as few windows as hold the sizes (each at most ``window``)."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        found = differenced(sizes, k)
        if all(sum(sizes[i] for i in w) <= window for w in found):
            return found
        k += 1


def cuts(length: int, fine: bool) -> list[int]:
    """Lengths of the pieces that a rest is packed in."""
    out = []
    while fine and length >= 2 * LEAST:
        out.append(length - length // 2)
        length //= 2
    return out + [length]


class Packer:
    """Takes documents one by one and yields the pieces of every finished group."""

    def __init__(self, window: int, group: int, first_id: int) -> None:
        self.window, self.limit, self.next_id = window, group * window, first_id
        self.seen = 0
        self._clear()

    def _clear(self) -> None:
        self.rests: list[tuple] = []
        self.held = 0

    def _piece(self, doc, data: bytes, start: int, length: int, sequence: int, offset: int):
        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
        return (doc, start, length, crc, len(data) // 4, sequence, offset)

    def add(self, doc, data: bytes) -> Iterator[tuple]:
        total = len(data) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            yield self._piece(doc, data, start, self.window, self.next_id, 0)
            self.next_id += 1
        if whole < total:
            self.seen += 1
            at = whole
            for length in cuts(total - whole, self.seen % FINE == 0):
                self.rests.append((doc, data, at, length))
                at += length
            self.held += total - whole
        if self.held >= self.limit:
            yield from self.finish()

    def finish(self) -> Iterator[tuple]:
        if self.rests:
            for members in packed([r[3] for r in self.rests], self.window):
                offset = 0
                for i in members:
                    doc, data, start, length = self.rests[i]
                    yield self._piece(doc, data, start, length, self.next_id, offset)
                    offset += length
                self.next_id += bool(members)
        self._clear()


def _packer(file: str, window: int, group: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(file)
        end = np.array([END_ID], "<u4").tobytes()
        packer = Packer(window, group, TaskContext.get().partitionId() << 33)
        types = [pa.int64()] * 7
        names = [c.split()[0] for c in PIECES.split(", ")]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        try:
            for part in batches:
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    found = []
                    texts = some.column("text").to_pylist()
                    for doc, text in zip(some.column("doc_id").to_pylist(), texts):
                        found.extend(packer.add(doc, encode(text) + end))
                    if found:
                        yield batch(found)
            if found := list(packer.finish()):
                yield batch(found)
        finally:
            encode.forget()

    return run


def pack(
    docs: DataFrame,
    file: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``file`` is the path of the tokenizer's file. Every document's ids end with id 2, so
    a NULL or empty text is one piece of one id. A text of any length is cut into full
    windows and at most one rest. Repeated rows are packed each for itself, NULL ids stay
    NULL. Sequence ids are unique, not dense. An empty table gives no rows. Extra columns
    are ignored.
    """
    text = rows.pick(docs, doc_id=id_column, text=text_column)
    text = text.withColumn("doc_id", text["doc_id"].cast("bigint"))
    return text.mapInArrow(_packer(file, window, group), PIECES)
