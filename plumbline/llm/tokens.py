"""Token counts per section from one encoding of the whole document.

A document is encoded once, as a whole, so its sections' counts add up to its own. Every
token covers a span of the text's bytes (byte-level tokens are exactly that); the spans
are joined to the sections by interval. A token that crosses a boundary is allocated to
the section that holds most of its bytes, the first of those that hold equally many.

Sections are lines with their line feeds. One pass over the table, in Arrow batches,
without a shuffle; memory holds one slice of a batch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rows

SECTIONS = (
    "doc_id bigint, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint, "
    "doc_tokens bigint"
)
STEP = 128


class Ranked:
    """A byte-level tokenizer from a file of ranks, with the length of each token."""

    def __init__(self, file: str, pattern: str) -> None:
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


_RANKED: dict[str, Ranked] = {}


def allocated(ends: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them cross a boundary.

    ``ends``: where tokens end; ``starts``: where sections start, the first at 0.
    """
    begin = np.concatenate([[0], ends])[:-1].astype(np.int64)
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    bounds = np.append(starts, size)
    for i in crossing.tolist():
        held = range(first[i], last[i] + 1)
        share = [min(ends[i], bounds[s + 1]) - max(begin[i], bounds[s]) for s in held]
        first[i] += int(np.argmax(share))
    n = len(starts)
    return np.bincount(first, minlength=n), np.bincount(first[crossing], minlength=n)


def _counter(file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _RANKED:
            _RANKED[file] = Ranked(file, pattern)
        ranked = _RANKED[file]
        names = [c.split()[0] for c in SECTIONS.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                parts: list[list] = [[] for _ in names]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    raw = np.frombuffer((text or "").encode(), "u1")
                    ends = ranked.ends(text or "")
                    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                    if len(starts) > 1 and starts[-1] == len(raw):
                        starts = starts[:-1]
                    tokens, crossing = allocated(ends, starts, len(raw))
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    places = chars[np.append(starts, len(raw))]
                    n = len(starts)
                    for out, values in zip(
                        parts,
                        (np.full(n, doc if doc is not None else 0), np.arange(n), places[:-1], places[1:],
                         tokens, crossing, np.full(n, len(ends))),
                    ):
                        out.append(values)
                    if doc is None:
                        parts[0][-1] = np.ma.masked_all(n, np.int64)
                arrays = []
                for found in parts:
                    whole = np.ma.concatenate(found)
                    arrays.append(pa.array(whole.data, pa.int64(), mask=np.ma.getmaskarray(whole)))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def token_counts(
    docs: DataFrame, file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per section: doc_id, section, start, end, n_tokens, n_crossing, doc_tokens.

    Sections are numbered from 0; start and end (exclusive) are code points. NULL and
    empty texts have one empty section without tokens. NULL ids stay NULL, repeated rows
    are counted each for itself, an empty table gives no rows, extra columns are ignored.
    """
    text = rows.pick(docs, doc_id=id_column, text=text_column)
    text = text.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return text.mapInArrow(_counter(file, pattern), SECTIONS)
