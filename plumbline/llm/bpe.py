"""Byte-level BPE by prefix dynamic programming, and back to bytes.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the
encoding of theirs. So each prefix of a byte string has one valid last token: the token
``t`` that ends the prefix, is its own encoding, and follows the last token of the prefix
without ``t`` as a valid pair. ``Prefix`` stores that token per prefix. From the store

* the encoding is read backwards, one token after another;
* bytes are appended by going on from the stored tokens;
* after an edit only the prefixes behind it are worked out again, until as many of them in
  a row as the longest token has bytes hold the token they held before: a prefix looks no
  further back than that.

All tokens that end at a place come from one Aho-Corasick pass, so the work grows with the
bytes, also for a word of megabytes; short words are worked out many at a time. Stretches
between spaces are encoded once per task and remembered up to ``CHUNKS`` of them, validity
of pairs in a table of 8 MB. Both memories end with the task.

One pass over the table, no shuffle. ``encode`` and ``decode`` are functions of a row, so a
lost task repeats them exactly.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rows

#: Stretches of text, and their characters, remembered per task.
CHUNKS, HELD = 800_000, 16_000_000
#: Answers about pairs of tokens remembered per task, as a power of two.
PAIRS = 20
#: A match is its size and its token in one number.
SHIFT, LOW = 32, (1 << 32) - 1
#: Words of more bytes are encoded one by one.
LONGEST = 64
#: Rows handed back at a time.
STEP = 256
#: White space next to a space.
ODD = re.compile(r" \s|\s |^ | $")
#: Patterns that begin a match at every space between two other characters.
SINGLE = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
)


class Vocabulary:
    """Tokens of a file of ranks: ``base64 rank`` per line."""

    def __init__(self, file: str) -> None:
        import ahocorasick

        with open(file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.never = max(self.tokens) + 1
        self.ends = ahocorasick.Automaton()
        halves: dict[int, tuple[int, int]] = {}
        for token, rank in self.ranks.items():
            *_, last = ([], *self.merges(token))
            if len(token) == 1 or (len(last) == 2 and last[0] + last[1] == token):
                self.ends.add_word(token.decode("latin-1"), len(token) << SHIFT | rank)
            if len(token) > 1 and len(last) == 2:
                halves[rank] = self.ranks[last[0]], self.ranks[last[1]]
        self.ends.make_automaton()
        self.joins = {
            self.ranks[a] * self.never + self.ranks[b]: rank
            for rank, token in self.tokens.items()
            for a, b in ((token[:i], token[i:]) for i in range(1, len(token)))
            if a in self.ranks and b in self.ranks
        }
        self.sizes = np.zeros(self.never, np.int64)
        self.sizes[list(self.tokens)] = list(map(len, self.tokens.values()))
        self.rights = {t: self._edge(t, halves, 1) for t in self.tokens}
        self.lefts = {t: self._edge(t, halves, 0) for t in self.tokens}

    def merges(self, data: bytes) -> Iterator[list[bytes]]:
        """The parts before each merge: always the first pair of lowest rank is merged."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, self.never) for a, b in zip(parts, parts[1:])]
            least = min(found)
            if least == self.never:
                break
            yield parts
            at = found.index(least)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]

    def _edge(self, token: int, halves: dict, side: int) -> list[tuple[int, int, int]]:
        """The parts a token has at one of its edges while it is merged.

        Each with the rank that makes it and the rank that takes it up.
        """
        found, taken = [], self.never
        while True:
            found.append((token, token if len(self.tokens[token]) > 1 else -1, taken))
            if token not in halves:
                return found
            token, taken = halves[token][side], token

    def follows(self, token: int, before: int) -> bool:
        """Whether both are the encoding of their bytes: no merge crosses their boundary.

        A merge across takes a part at either edge. It happens if its turn comes while both
        are there; of two merges of one rank the left one goes first.
        """
        never, joins, edge = self.never, self.joins, self.lefts[token]
        for left, made, taken in self.rights[before]:
            for right, born, used in edge:
                rank = joins.get(left * never + right, never)
                if rank < taken and rank <= used and rank < never:
                    turn = max(rank, made, born)
                    if turn < taken and turn <= used:
                        return False
        return True


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(file: str) -> Vocabulary:
    """One per file and worker process; its size is that of the file."""
    if file not in _VOCABULARIES:
        _VOCABULARIES[file] = Vocabulary(file)
    return _VOCABULARIES[file]


class Pairs:
    """Whether a token follows another; a pair is ``before * never + token``.

    Answers are remembered in a table of fixed size, a later pair in place of an earlier one.
    """

    def __init__(self, known: Vocabulary) -> None:
        self.known = known
        self.held = np.full(1 << PAIRS, -1, np.int64)  # 2 * pair + answer

    def valid(self, pairs: np.ndarray) -> np.ndarray:
        place = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS)
        held = self.held[place]
        missing = np.flatnonzero(held >> 1 != pairs)
        if len(missing):
            asked, back = np.unique(pairs[missing], return_inverse=True)
            answers = np.fromiter((self(p) for p in asked.tolist()), np.int64, len(asked))
            held[missing] = (2 * asked + answers)[back]
            self.held[place[missing]] = held[missing]
        return held & 1 == 1

    def __call__(self, pair: int) -> bool:
        before, token = divmod(pair, self.known.never)
        return self.known.follows(token, before)


class Prefix:
    """Bytes with the last token of each of their prefixes."""

    def __init__(self, pairs: Pairs, data: bytes = b"") -> None:
        self.pairs, self.known = pairs, pairs.known
        self.data, self.last, self.answers = b"", [], {}
        self.append(data)

    def _lasts(self, start: int) -> Iterator[int]:
        """Last tokens of the prefixes longer than ``start``, given those before in ``last``.

        Each is in ``last`` when it is handed out. Tokens of one end come longest first.
        """
        last, known, never, answers = self.last, self.known, self.known.never, self.answers
        text = self.data.decode("latin-1")
        for end, match in known.ends.iter(text, max(0, start - known.longest + 1)):
            if end != len(last):
                if end > len(last):
                    break
                continue
            before, token = end - (match >> SHIFT), match & LOW
            if before >= 0:
                pair = last[before] * never + token
                valid = answers.get(pair)
                if valid is None:
                    valid = answers[pair] = self.pairs(pair)
            if before == -1 or before >= 0 and valid:
                last.append(token)
                yield token
        if len(last) < len(text):
            raise ValueError(f"no token ends with byte {self.data[len(last)]} here")

    def append(self, data: bytes) -> None:
        """Adds bytes at the end; nothing before them is worked out again."""
        start = len(self.data)
        self.data += data
        for _ in self._lasts(start):
            pass

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replaces ``removed`` bytes at ``at``; returns how many prefixes were worked out."""
        old, tail = self.last, at + removed
        self.data = self.data[:at] + inserted + self.data[tail:]
        self.last = old[:at]
        shift, same = len(inserted) - removed, 0
        for token in self._lasts(at):
            place = len(self.last) - 1
            before = place - shift
            # an old prefix of the same ending, none of whose tokens reaches the edit
            same = same + 1 if before >= tail and token == old[before] else 0
            if same >= self.known.longest:
                self.last.extend(old[before + 1 :])
                return place + 1 - at
        return len(self.last) - at

    def tokens(self) -> list[int]:
        """The encoding of all bytes."""
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.known.tokens[found[-1]])
        return found[::-1]


class Chunks(dict):
    """Numbers of stretches of text; those not seen before are listed in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class Encoder:
    """Tokens of texts, each match of ``pattern`` encoded for itself.

    ``SINGLE`` holds the patterns that always begin a match at a space between two
    characters that are no white space. There texts are cut before the pattern is asked,
    so that it sees a stretch once; with other patterns it runs over whole texts.
    """

    def __init__(self, file: str, pattern: str) -> None:
        import regex

        self.known, self.pattern, self.single = vocabulary(file), regex.compile(pattern), pattern in SINGLE
        self.pairs = Pairs(self.known)
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.held = Chunks(), 0
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _cut(self, text: str) -> Iterable[str]:
        if self.single and not ODD.search(text):
            first, *others = text.split(" ")
            return [first, *[" " + other for other in others]]
        return [m.group() for m in self.pattern.finditer(text)]

    def _learn(self) -> None:
        """Encodes the new stretches and remembers their tokens."""
        new, self.chunks.new = self.chunks.new, []
        cut = list(map(self.pattern.findall, new))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        words = Chunks()
        at = np.fromiter(map(words.__getitem__, chain.from_iterable(cut)), np.int64, sizes.sum())
        found, bounds = self.words([w.encode() for w in words.new])
        tokens = np.diff(bounds)[at]
        ends = np.concatenate([[0], np.cumsum(tokens)])[np.concatenate([[0], np.cumsum(sizes)])]
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + ends[1:]])
        self.ids = np.concatenate([self.ids, gathered(found, bounds, at)])
        self.held += sum(map(len, new))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, joined, and where each word's begin (and the last end)."""
        ranks = self.known.ranks
        whole = [ranks.get(w, -1) for w in words]  # a word that is a token is that token
        short = [i for i, rank in enumerate(whole) if rank < 0 and len(words[i]) <= LONGEST]
        found, sizes = self._short([words[i] for i in short])
        long = [i for i, rank in enumerate(whole) if rank < 0 and len(words[i]) > LONGEST]
        apart = [Prefix(self.pairs, words[i]).tokens() for i in long]
        # three kinds of words, put in the order of the words
        order = np.argsort(np.array([i for i, r in enumerate(whole) if r >= 0] + short + long, np.int64))
        single = [rank for rank in whole if rank >= 0]
        joined = np.concatenate([single, found, list(chain.from_iterable(apart))]).astype(np.int32)
        counts = np.concatenate([np.ones(len(single)), sizes, list(map(len, apart))]).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return gathered(joined, bounds, order), np.concatenate([[0], np.cumsum(counts[order])])

    def _short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words, joined, and how many each has.

        Last tokens are worked out a place of all words at a time.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = "\u0100".join([w.decode("latin-1") for w in words])  # in no token
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        places = (np.arange(len(text)) - np.repeat(starts, sizes + 1)[: len(text)]).astype(np.uint8)
        found = np.fromiter(chain.from_iterable(self.known.ends.iter(text)), np.int64).reshape(-1, 2)
        place = places[found[:, 0]]
        found = found[np.argsort(place, kind="stable")]
        upto = np.cumsum(np.bincount(place)).tolist()
        last, never = np.full(len(text), -1), self.known.never
        for at, until in zip([0, *upto], upto):
            end, match = found[at:until].T
            token, before = match & LOW, end - (match >> SHIFT)
            begins = before < end - places[end]
            inner = np.flatnonzero(~begins)
            begins[inner] = self.pairs.valid(last[before[inner]] * never + token[inner])
            last[end[begins]] = token[begins]
        # read backwards, the last token of all words first
        words_at, at = np.arange(len(words)), starts + sizes - 1
        owners, tokens = [], []
        while len(at):
            owners.append(words_at)
            tokens.append(last[at])
            at = at - self.known.sizes[tokens[-1]]
            words_at, at = (x[at >= starts[words_at]] for x in (words_at, at))
        owner, token = np.concatenate(owners)[::-1], np.concatenate(tokens)[::-1]
        order = np.argsort(owner, kind="stable")
        return token[order], np.bincount(owner, minlength=len(words))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, joined, and where each text's begin (and the last end)."""
        cut = [self._cut(text or "") for text in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(cut)), np.int64, sizes.sum())
        if self.chunks.new:
            self._learn()
        ids = gathered(self.ids, self.bounds, at)
        ends = np.concatenate([[0], np.cumsum(np.diff(self.bounds)[at])])
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
        if len(self.chunks) > CHUNKS or self.held > HELD:
            self._forget()
        return ids, bounds


def gathered(values: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists number ``at`` of the joined lists ``values``, joined."""
    sizes = np.diff(bounds)[at]
    skip = bounds[at] - (np.cumsum(sizes) - sizes)
    return values[np.repeat(skip, sizes) + np.arange(sizes.sum())]


def _encoder(file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                ids, bounds = encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def encode(
    docs: DataFrame, file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id and ids, the tokens of its whole text.

    ``file`` holds the ranks; each match of ``pattern`` is encoded for itself. NULL and
    empty texts have no ids. NULL ids of documents stay NULL, repeated rows are encoded
    each for itself, an empty table gives no rows, extra columns are ignored.
    """
    text = rows.pick(docs, doc_id=id_column, text=text_column)
    text = text.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return text.mapInArrow(_encoder(file, pattern), "doc_id bigint, ids array<int>")


def _decoder(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(file).tokens
        listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        spelled = np.frombuffer(b"".join(listed), "u1")
        starts = np.concatenate([[0], np.cumsum(list(map(len, listed)))])
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                lists = part.column("ids").fill_null([])
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(listed) or not np.diff(starts)[ids].all()):
                    raise ValueError("an id that is no token")
                ends = np.concatenate([[0], np.cumsum(np.diff(starts)[ids])])
                bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(lists),
                    [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(gathered(spelled, starts, ids))],
                )
                data = pc.if_else(part.column("ids").is_null(), None, data.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, data], [*part.schema.names, "bytes"])

    return run


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """The rows of ``encode`` with one more column: the bytes their ids stand for.

    No ids give no bytes, NULL gives NULL; an id that the file does not hold is an error.
    """
    picked = rows.pick(encoded, doc_id="doc_id", ids="ids")
    return picked.mapInArrow(_decoder(file), "doc_id bigint, ids array<int>, bytes binary")


def digests(
    docs: DataFrame, file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of texts encoded and decoded."""
    both = decode(encode(docs, file, pattern, id_column, text_column), file)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
