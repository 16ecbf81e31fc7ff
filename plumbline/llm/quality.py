"""A quality score learned from pairs: Bradley-Terry on feature differences.

Of a good and a bad document the good one should win with probability
``sigmoid(w . (x_good - x_bad))``. The weights minimise the logistic loss of such pairs;
they are fitted on at most ``LABELLED`` labelled rows (chosen by a hash of the id, one
row per id), each good one against ``RIVALS`` bad ones. A document's worth is ``w . x``.
The threshold is a quantile of the worths of the labelled rows: the one that sets the
two labels apart best. The score is the logistic function of the distance to it, shifted
so that the threshold lies at ``CUT``.

Features are shares and lengths read off the whole text. Labels, language, source and id
are never among them. Every text gets its features in one pass over the table, in Arrow
batches, without a shuffle; only the features of the labelled sample reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rows

#: Bound of the labelled sample.
LABELLED = 20_000
#: Bad documents that each good one is compared with.
RIVALS = 16
#: The score from which a document is predicted good.
CUT = 0.7
#: Rows with this remainder of crc32(id) modulo 4 are never learned from.
FOLDS, HELD = 4, 2

_KIND = np.zeros(256, "u1")  # 0 mark, 1 space, 2 digit, 3 small, 4 capital, 5 beyond ASCII
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[97:123] = 3
_KIND[65:91] = 4
_KIND[128:] = 5

FEATURES = 14


def features(text: str | None) -> list[float]:
    """Shares and lengths of a text; NULL counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * FEATURES
    kinds = _KIND[np.frombuffer(data, "u1")]
    mark, _, digit, small, capital, far = np.bincount(kinds, minlength=6).tolist()
    seen = mark + digit + small + capital + far
    letters = small + capital + far
    count = len(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    lengths = np.fromiter(map(len, words), np.int64, count)
    runs = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    marks = kinds == 0
    doubled = int(np.count_nonzero(marks[1:] & marks[:-1]))
    return [
        float(np.log1p(count)),
        mark / seen,
        digit / seen,
        capital / max(1, letters),
        letters / seen,
        doubled / seen,
        float(lengths.mean()) / 10,
        float(lengths.std()) / 10,
        len(set(words)) / count,
        pairs / max(1, count - 1),
        runs / count,
        len(set(lines)) / len(lines),
        float((lengths <= 3).mean()),
        float(np.log1p(lengths.max())),
    ]


def widened(x: np.ndarray) -> np.ndarray:
    """Scaled features and their squares, bounded so that no text is off the scale."""
    x = np.clip(x, -6, 6)
    return np.hstack([x, x * x / 6])


class Ranker:
    """Bradley-Terry weights, the scaling of the features, and the score's shift."""

    def __init__(self, x: np.ndarray, good: np.ndarray, strength: float = 1e-3) -> None:
        wide = FEATURES * 2
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights, self.cut, self.slope = np.zeros(wide), 0.0, 1.0
        if not good.any() or good.all():
            return  # nothing to prefer: every text scores CUT
        self.mean = x.mean(0)
        self.scale = np.maximum(x.std(0), 1e-3)
        z = self._wide(x)
        self.weights = self._fit(z[good], z[~good], strength)
        worth = z @ self.weights
        self.cut = self._quantile(worth, good)
        spread = abs(worth - self.cut)
        self.slope = 4 / max(1e-9, float(np.median(spread)))

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return widened((x - self.mean) / self.scale)

    @staticmethod
    def _fit(good: np.ndarray, bad: np.ndarray, strength: float) -> np.ndarray:
        order = np.arange(len(good))
        step = max(1, len(bad) // RIVALS)
        diffs = np.vstack([good - bad[(order + k * step) % len(bad)] for k in range(RIVALS)])
        w = np.zeros(diffs.shape[1])
        for _ in range(30):  # Newton's method on the logistic loss
            p = 1 / (1 + np.exp(-np.clip(diffs @ w, -40, 40)))
            slope = diffs.T @ (p - 1) / len(diffs) + strength * w
            bend = (diffs * (p * (1 - p))[:, None]).T @ diffs / len(diffs)
            step_by = np.linalg.solve(bend + strength * np.eye(len(w)), slope)
            w -= step_by
            if abs(step_by).max() < 1e-8:
                break
        return w

    @staticmethod
    def _quantile(worth: np.ndarray, good: np.ndarray) -> float:
        """The quantile that errs least; amid several, the middle one."""
        order = np.argsort(worth, kind="stable")
        worth, good = worth[order], good[order]
        lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
        let_in = 1 - np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
        error = 4 * lost + let_in  # losing a good document is the worse mistake
        best = np.flatnonzero(error <= error.min() + 1e-12)
        at = int(best[len(best) // 2])
        low = worth[max(0, at - 1)]
        high = worth[min(len(worth) - 1, at)]
        return float((low + high) / 2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        reach = self.slope * (self._wide(x) @ self.weights - self.cut)
        return 1 / (1 + np.exp(-np.clip(reach + np.log(CUT / (1 - CUT)), -40, 40)))


def held_out(doc_id) -> F.Column:
    """Whether a row is kept out of learning; NULL ids are not (they have no labels)."""
    remainder = F.crc32(doc_id.cast("string")) % FOLDS
    return F.coalesce(remainder == HELD, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Ranker:
    """Fits a ranker on labelled rows outside the held-out fold.

    Rows without an id, a label or a text are left out; an id with several labels counts
    as good only if all say so; an id with several texts is learned from once for each.
    """
    known = (
        rows.pick(labels, key="doc_id", quality="quality")
        .where("key IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("key")))
        .groupBy("key")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(limit)
    )
    text = rows.pick(docs, key="doc_id", text="text")
    found = text.join(F.broadcast(known), "key").where("text IS NOT NULL")

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                {"key": frame["key"], "good": frame["quality"] == 1,
                 "x": [features(t) for t in frame["text"]]}
            )

    sample = found.mapInPandas(measured, "key bigint, good boolean, x array<double>")
    taken = sample.orderBy("key", "x").limit(2 * limit).collect()
    if not taken:
        return Ranker(np.zeros((0, FEATURES)), np.zeros(0, bool))
    return Ranker(np.array([r.x for r in taken]), np.array([r.good for r in taken]))


def scored(docs: DataFrame, ranker: Ranker, text_column: str = "text"):
    """``docs`` under positional names, with a last column ``__score``."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 2048):
            some = texts.iloc[at : at + 2048]
            out[at : at + len(some)] = ranker(np.array([features(t) for t in some]))
        return pd.Series(out)

    flat = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return flat.withColumn("__score", score(F.col(f"_{rows.positions(docs.columns, text_column)}")))


def quality(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    NULL, empty and blank texts have all features 0. Without labels of both kinds every
    score is ``CUT``. Repeated rows are scored each for itself, an empty table gives no
    rows, extra columns are ignored.
    """
    text = rows.pick(docs, doc_id="doc_id", text="text")
    out = scored(text, learn(docs, labels, limit)).toDF("doc_id", "text", "score")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``docs`` without the rows that are predicted bad; all columns stay."""
    found = scored(docs, learn(docs, labels, limit))
    return found.where(F.col("__score") >= CUT).drop("__score").toDF(*docs.columns)
