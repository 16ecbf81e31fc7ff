"""Hashes of words and of word shingles, whole batches of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words of a shingle.
SHINGLE = 5
#: Bytes hashed at a time, which bounds the temporary arrays.
SLICE = 1 << 21

_SPACES = [9, 10, 11, 12, 13, 32]
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BYTE[_SPACES] = 0
_GAP = np.zeros(256, bool)
_GAP[_SPACES] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Most powers kept for later; longer tables are made for one use.
_KEPT = 1 << 16
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * _A
    x = x ^ (x >> np.uint64(33))
    x = x * _B
    return x ^ (x >> np.uint64(33))


def _powers(n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    """1, m, m^2 ... modulo 2^64, for places in a word."""
    if len(kept.get("powers", ())) >= n:
        return kept["powers"]
    steps = np.full(max(n, 1024), _STEP, np.uint64)
    steps[0] = 1
    powers = np.cumprod(steps, dtype=np.uint64)
    if n <= _KEPT:
        kept["powers"] = powers
    return powers


def _slice(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words in a stretch of bytes that cuts none."""
    solid = ~_GAP[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(
        np.concatenate([[0], starts[1:]]), np.diff(np.concatenate([[0], starts[1:], [len(data)]]))
    )
    place[: starts[0]] = 0
    place[starts[0] : starts[1] if len(starts) > 1 else None] -= starts[0]
    # places behind a word are multiplied by 0, so they need not be exact
    longest = int(place[solid].max()) + 1
    powers = _powers(longest)
    value = _BYTE[data] * powers[np.minimum(place, longest - 1)]
    return starts, mixed(np.add.reduceat(value, starts))


def hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all words in UTF-8 bytes, a slice at a time."""
    if len(data) <= SLICE:
        return _slice(data)
    places, values, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):  # up to white space, however long the word
            gap = np.flatnonzero(_GAP[data[end : end + SLICE]])
            end = end + int(gap[0]) if len(gap) else min(end + SLICE, len(data))
            if len(gap):
                break
        found, value = _slice(data[at:end])
        places.append(found + at)
        values.append(value)
        at = end
    return np.concatenate(places), np.concatenate(values)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts (and the last one ends).

    NULL counts as empty.
    """
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data or b"", "u1")[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the first word of each text (and the end).

    Texts are joined by a line feed, so that no word spans two of them.
    """
    raw, bounds = text_bytes(column)
    n = len(bounds) - 1
    apart = np.full(len(raw) + n, 10, "u1")
    keep = np.ones(len(apart), bool)
    keep[bounds[1:] + np.arange(n)] = False
    apart[keep] = raw
    places, values = hashed(apart)
    return values, np.searchsorted(places, bounds + np.arange(n + 1))


def shingles(values: np.ndarray, first: np.ndarray, size: int = SHINGLE):
    """Sorted distinct shingle hashes per text, joined, and where each text starts.

    A text with fewer words than a shingle is one shingle; one without words has none.
    """
    n = len(values)
    rolled = np.zeros(n, np.uint64)
    count = np.diff(first)
    for k in range(size):
        rolled *= _STEP
        rolled[: max(0, n - k)] += values[k:]
    rolled = mixed(rolled)
    out, starts = [], [0]
    total = 0
    for at, end, words in zip(first[:-1].tolist(), first[1:].tolist(), count.tolist()):
        if words >= size:
            part = np.sort(rolled[at : end - size + 1])
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        elif words:
            short = words
            for value in values[at:end].tolist():
                short = (short * int(_STEP) + value) % 2**64
            part = mixed(np.array([short], np.uint64) ^ _A)
        else:
            part = rolled[:0]
        total += len(part)
        out.append(part)
        starts.append(total)
    joined = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return joined, np.array(starts, np.int64)
