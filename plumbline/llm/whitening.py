"""Whitening of embeddings by an incremental eigendecomposition.

1. Every task keeps the eigenvalues and eigenvectors of the scatter of the vectors it has
   seen and updates them by one centred rank-one term per vector: the roots of the secular
   equation are the new eigenvalues; entries that a term does not move, and eigenvalues that
   are equal, are deflated first. Column sums are kept as whole numbers.
2. Two summaries are combined by successive rank-one updates, one per eigenvector of the
   smaller one and one for the distance of the means. Summaries are merged ``FAN`` at a
   time until one is left, so a task holds one summary and the one it takes in.
3. The basis found this way is refined by one distributed Rayleigh-Ritz step: the exact
   covariance of the rows in that basis, a sum over tasks, is diagonalised, and the basis is
   turned by its eigenvectors. Rounding of the many updates ends there.

What reaches the driver is a square matrix of the dimension, never a row of the table.
A task is a function of its rows, so a lost one repeats its part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rows
from plumbline.sources.pinning import pin

#: Scale and offset that make whole numbers of entries.
SCALE, OFFSET = 1024.0, 100_000
#: Components returned.
COMPONENTS = 8
#: Summaries and matrices merged by one task.
FAN = 16
#: Rows worked on at a time.
SLICE = 8192
#: Share of the largest eigenvalue below which one counts as zero.
ZERO = 1e-12

SUMMARY = "part bigint, n bigint, sums array<bigint>, values array<double>, vectors array<double>"
MATRIX = "part bigint, matrix array<double>"


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(d) + z z'`` for rising, distinct ``d`` and no zero in ``z``.

    Root i lies between d[i] and d[i + 1], the last one at most ``z'z`` behind d[-1]. Each is
    given as a pole (the nearer end) and the distance from it, so that differences of roots
    and poles keep their digits. A step fits the poles on either side by one pole each; a
    step that leaves the bracket is replaced by its middle.
    """
    n, z2 = len(d), z * z
    gap = np.append(np.diff(d), z2.sum())
    own = np.arange(n)
    middle = d + gap / 2
    behind = 1 + (z2 / (d - middle[:, None])).sum(1) < 0  # the root lies in the second half
    pole = own + behind
    pole[-1] = n - 1
    delta = d - d[pole][:, None]  # [root, pole]: where the poles lie, seen from the root's own
    low, high = np.where(behind, -gap / 2, 0.0), np.where(behind, 0.0, gap / 2)
    if behind[-1]:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    left_pole, right_pole = delta[own, own], np.append(delta[own[:-1], own[1:]], gap[-1])
    below = own <= own[:, None]
    x = (low + high) / 2
    for _ in range(100):
        apart = delta - x[:, None]
        shares = z2 / apart
        value = 1 + shares.sum(1)
        if np.all(np.abs(value) <= 4e-16 * (1 + np.abs(shares).sum(1))):
            break
        np.copyto(low, x, where=value < 0)
        np.copyto(high, x, where=value >= 0)
        slopes = shares / apart
        first = np.where(below, slopes, 0.0).sum(1)
        other = slopes.sum(1) - first
        left, right = left_pole - x, right_pole - x
        a = (left + right) * value - left * right * (first + other)
        b = left * right * value
        c = value - left * first - right * other
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(all="ignore"):
            moved = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = np.where((moved >= low) & (moved <= high), moved, (low + high) / 2)
        if np.all((moved == x) | (high - low <= 4e-16 * np.abs(x))):
            break
        x = moved
    return pole, x


def updated(values: np.ndarray, vectors: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``V diag(values) V' + term term'``.

    Deflation: entries of the term that move nothing stay as they are, and of eigenvalues
    that are equal to rounding, one takes the whole entry by a reflection.
    """
    z = vectors.T @ term
    size = float(z @ z)
    if size == 0.0:
        return values, vectors
    scale = max(abs(float(values[-1])), size)
    tiny = 8 * np.finfo(float).eps * scale
    # equal eigenvalues: turn their vectors so that one entry holds all
    close = np.flatnonzero(np.diff(values) <= tiny)
    if len(close):
        vectors, z = vectors.copy(), z.copy()
        runs = np.split(close, np.flatnonzero(np.diff(close) > 1) + 1)
        for run in runs:
            held = np.arange(run[0], run[-1] + 2)
            part = z[held]
            norm = float(np.linalg.norm(part))
            if norm * norm <= tiny * tiny / scale or len(held) < 2:
                continue
            w = part.copy()
            w[-1] += np.copysign(norm, part[-1])
            w /= np.linalg.norm(w)
            vectors[:, held] -= 2 * np.outer(vectors[:, held] @ w, w)
            z[held] = 0.0
            z[held[-1]] = -np.copysign(norm, part[-1])
    live = np.abs(z) * np.sqrt(size) > tiny
    live[np.flatnonzero(np.diff(values) <= tiny)] = False  # all but the last of a run
    if not live.any():
        return values, vectors
    d, v = values[live], z[live]
    pole, distance = secular_roots(d, v)
    delta = (d - d[pole][:, None]) - distance[:, None]  # [root, pole]: d - root
    roots = d[pole] + distance
    # entries that have exactly these roots, so that the vectors are orthogonal
    n = len(d)
    others = d[None, :] - d[:, None]  # [i, j]: d_j - d_i
    np.fill_diagonal(others, 1.0)
    ratio = -delta.T / np.where(others == 0, 1.0, others)  # [i, root]: (root - d_i) / (d_j - d_i)
    entries = np.sqrt(np.abs(np.prod(ratio, 1)))
    entries = np.copysign(entries, v)
    new = entries[:, None] / delta.T
    new /= np.linalg.norm(new, axis=0)
    found, basis = values.copy(), vectors.copy()
    found[live] = roots
    basis[:, live] = vectors[:, live] @ new
    order = np.argsort(found, kind="stable")
    return found[order], basis[:, order]


class Spectrum:
    """Number, column sums and scatter of vectors, the scatter as its eigenvectors."""

    def __init__(self, dimension: int) -> None:
        self.n, self.sums = 0, [0] * dimension
        self.values, self.vectors = np.zeros(dimension), np.eye(dimension)

    def add(self, x: np.ndarray) -> None:
        """Takes in whole-number vectors, one centred rank-one term after the other."""
        total = np.array([float(s) for s in self.sums])
        for row in x.astype(np.float64):
            if self.n:
                term = (row - total / self.n) * np.sqrt(self.n / (self.n + 1))
                self.values, self.vectors = updated(self.values, self.vectors, term)
            self.n += 1
            total += row
        self.sums = [s + int(c) for s, c in zip(self.sums, x.sum(0))]

    def merge(self, other: Spectrum) -> None:
        """Takes in the vectors of another spectrum."""
        if not other.n:
            return
        if not self.n:
            self.__dict__.update(other.__dict__)
            return
        apart = np.array([float(b * self.n - a * other.n) for a, b in zip(self.sums, other.sums)])
        apart /= float(self.n) * other.n
        terms = other.vectors * np.sqrt(np.maximum(other.values, 0.0))
        weight = np.sqrt(float(self.n) * other.n / (self.n + other.n))
        for term in [*terms.T, apart * weight]:
            self.values, self.vectors = updated(self.values, self.vectors, term)
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]

    def row(self, part: int) -> dict:
        return {
            "part": [part], "n": [self.n], "sums": [self.sums],
            "values": [self.values], "vectors": [self.vectors.ravel()],
        }

    @classmethod
    def of(cls, n: int, sums: list[int], values: list, vectors: list) -> Spectrum:
        found = cls(len(sums))
        found.n, found.sums, found.values = n, list(sums), np.array(values)
        found.vectors = np.array(vectors).reshape(len(sums), len(sums))
        return found


def matrix_of(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dimension)


def _slices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, matrix_of(part.column("x"), dimension)


def _table(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in names], [n for n, _ in names])


def _task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _spectra(dimension: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum(dimension)
        for _, x in _slices(batches, dimension):
            found.add(x)
        if found.n:
            yield _table(found.row(_task_number()), SUMMARY)

    return run


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    found = None
    for row in table.sort_by("part").to_pylist():
        other = Spectrum.of(row["n"], row["sums"], row["values"], row["vectors"])
        if found is None:
            found = other
        else:
            found.merge(other)
    return pa.Table.from_batches([_table(found.row(key[0].as_py()), SUMMARY)])


def _added(key: tuple, table: pa.Table) -> pa.Table:
    whole = sum(np.array(m) for m in table.sort_by("part").column("matrix").to_pylist())
    return pa.Table.from_batches([_table({"part": [key[0].as_py()], "matrix": [whole]}, MATRIX)])


def _reduced(parts: DataFrame, merge: Callable, schema: str) -> dict | None:
    """The one row that all rows are merged to, ``FAN`` neighbours at a time."""
    while True:
        parts = pin(parts)
        last = parts.agg(F.max("part")).first()[0]
        if last is None:
            return None
        if last == 0:
            break
        parts = (
            parts.withColumn("group", F.expr(f"part div {FAN}"))
            .groupBy("group").applyInArrow(merge, schema)
        )
    row = parts.first()
    return row.asDict()


def _products(dimension: int, centre: np.ndarray, basis: np.ndarray) -> Callable:
    """Sums of products of the rows in a basis, one matrix per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((basis.shape[1], basis.shape[1])), False
        for _, x in _slices(batches, dimension):
            y = (x - centre) @ basis
            total, seen = total + y.T @ y, True
        if seen:
            yield _table({"part": [_task_number()], "matrix": [total.ravel()]}, MATRIX)

    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where it is beyond 63 bits."""
    most = int(np.abs(x).max(initial=0)) * n + max((abs(s) for s in sums), default=0)
    if most < 2**62:
        apart = n * x - np.array(sums, np.int64)
        far = int(np.abs(apart).max(initial=0))
        if far * far * max(1, x.shape[1]) < 2**63:
            return (apart * apart).sum(1).tolist()
        wide = apart.astype(object)
    else:
        wide = n * x.astype(object) - np.array(sums, object)
    found = (wide * wide).sum(1).tolist()
    return [v if v < 2**63 else None for v in found]


def whole_numbers(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and x: the entries of complete vectors as whole numbers."""
    picked = rows.pick(df, vec_id=id_column, v=vector_column)
    complete = F.expr(
        "v IS NOT NULL AND size(v) > 0 AND "
        "forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    )
    entry = f"CAST(floor({SCALE:.0f}D * CAST(c AS DOUBLE)) AS BIGINT) + {OFFSET}L"
    return picked.where(complete).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.expr(f"transform(v, c -> {entry})").alias("x")
    )


def whitened(
    df: DataFrame, components: int = COMPONENTS,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened,
    explained and identity_error.

    Vectors that are NULL, empty or hold a NULL, NaN or infinite entry are dropped; so are
    those of another length than most (of the longest of the most frequent lengths). A
    component whose eigenvalue is nothing but rounding is left out, so a table of equal
    vectors gives no rows, as an empty one does. NULL ids stay, repeated rows and vectors
    count as often as they are there, extra columns are ignored. Signs: the entry of
    largest size of a component is positive. ``deviation`` is NULL where it does not fit.
    """
    fit = whole_numbers(df, id_column, vector_column)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    nothing = df.sparkSession.createDataFrame([], schema)
    usual = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return nothing
    d = usual["d"]
    fit = fit.where(F.size("x") == d)
    summary = _reduced(fit.select("x").mapInArrow(_spectra(d), SUMMARY), _merged, SUMMARY)
    n, sums = summary["n"], summary["sums"]
    centre = np.array(sums, np.float64) / n
    found = Spectrum.of(n, sums, summary["values"], summary["vectors"])
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]
    products = _reduced(fit.select("x").mapInArrow(_products(d, centre, basis), MATRIX), _added, MATRIX)
    inside = np.array(products["matrix"]).reshape(d, d) / n
    values, turn = np.linalg.eigh((inside + inside.T) / 2)
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    keep = min(components, int((values > ZERO * max(values[0], 0.0)).sum()) if values[0] > 0 else 0)
    if not keep:
        return nothing
    shares = (values / values.sum())[:keep]
    vectors = vectors[:, :keep]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(keep)])
    scaled = vectors / np.sqrt(values[:keep])
    seen = _reduced(fit.select("x").mapInArrow(_products(d, centre, scaled), MATRIX), _added, MATRIX)
    error = float(np.abs(np.array(seen["matrix"]).reshape(keep, keep) / n - np.eye(keep)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, d):
            y = (x - centre) @ scaled
            far = pa.array(deviations(x, n, sums), pa.int64())
            number = np.repeat(np.arange(len(x)), keep)
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(part.column("vec_id"), pa.array(number)),
                    pa.array(np.tile(np.arange(1, keep + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(number), n), pa.int64()),
                    pc.take(far, pa.array(number)),
                    pa.array(y.ravel()),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(number), error)),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    return fit.mapInArrow(run, schema)
