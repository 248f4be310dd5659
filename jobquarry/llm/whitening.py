"""Whitening of embeddings by shifted Cholesky QR.

1. Vectors become integer vectors x = floor(256 * c). Each distinct x counts once: the *fit
   list* of n rows, a stored table, with exact sums S per dimension.
2. The centred rows A (x - S / n) are orthogonalised by distributed *Gram passes*. A pass
   solves the rows of every task against the triangular factors so far and returns the sum
   of their outer products, G = Q'Q, d x d numbers. The driver takes its Cholesky factor
   and goes on until G is the identity to rounding. The first pass shifts G by a few units
   of rounding of its size, so that it has a factor however badly conditioned A is; the
   passes after it win the accuracy back, which a single Gram matrix would lose by squaring
   the condition.
3. The composed factor R has A = QR, so the SVD of R (with what the last G still differs
   from the identity by) gives the singular values s of A and its right singular vectors:
   eigenvalues e = s**2 / n and components of the covariance.
4. Every row is projected on the first components and divided by sqrt(e). One more pass
   over the fit list measures how far the covariance of the result is from the identity.

The driver and the tasks hold d x d numbers (d: dimension of the vectors), never vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.frames import arrow_map, stored

SCALE = 256
#: A Gram matrix this near to the identity, per dimension, ends the passes.
NEAR = 1e-14
MAX_PASSES = 8
#: Singular values below this share of the largest are rounding, not directions of the data.
NOTHING = 1e-13
#: The largest number of which sums and products stay exact as 64-bit integers here.
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """``n`` and ``sums`` of the fit list; components as columns, with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    largest: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integer_vectors(rows: DataFrame, vector: str) -> Column:
    """``floor(256 * c)`` of each entry; entries beyond the range of a long saturate."""
    return F.transform(F.col(f"`{vector}`"), lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vector: str) -> Column:
    """Not null, not empty, and all entries finite numbers."""
    v = F.col(f"`{vector}`")
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int):
    """Number of rows, exact sums and largest magnitude per task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, largest = 0, [0] * d, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), d)
            top = max(int(x.max()), -int(x.min()))
            n, largest = n + len(x), max(largest, top)
            exact = x.sum(0) if top * len(x) <= LONG else x.astype(object).sum(0)
            total = [t + int(s) for t, s in zip(total, exact, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "largest": [str(largest)], "sums": [[str(t) for t in total]]})

    return sums


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    parts = arrow_map(fit, _sums(d), "n long, largest string, sums array<string>")
    big = "decimal(38,0)"
    whole = parts.select("n", F.col("largest").cast(big).alias("largest"), F.posexplode("sums")).groupBy("pos").agg(
        F.sum("n").alias("n"), F.max("largest").alias("largest"), F.sum(F.col("col").cast(big)).alias("s")
    )
    found = sorted(whole.collect(), key=lambda r: r.pos)
    return (found[0].n, [int(r.s) for r in found], int(found[0].largest)) if found else (0, [0] * d, 0)


def _outer(of: Callable[[np.ndarray], np.ndarray], d: int):
    """Sum of the outer products of a task's rows after ``of``, a row of the matrix each."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = of(_matrix(batch.column("x"), d))
                total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    return outer


def _gram(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int, width: int) -> np.ndarray:
    parts = arrow_map(fit, _outer(of, d), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("g"))
    gram = np.zeros((width, width))
    for cell in cells.collect():
        gram[cell.i, cell.pos] = cell.g
    return (gram + gram.T) / 2


def _upper(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of the matrix, shifted further while it has none."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * max(np.trace(gram), np.finfo(float).tiny))


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverses of upper triangular factors, by forward substitution."""
    for factor in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
        rows = out
    return rows


def fit_whitening(vectors: DataFrame, keep: int) -> tuple[Whitening, DataFrame] | None:
    """The whitening of ``x`` (arrays of longs of one length) and the stored fit list.

    None for no rows. Of ``keep`` components, those without variance are left out.
    """
    fit = stored(vectors.select("x").distinct(), "fit")
    first = fit.first()
    if first is None:
        return None
    d = len(first.x)
    n, sums, largest = _totals(fit, d)
    mean = np.array([s / n for s in sums])
    factors: list[np.ndarray] = []
    while True:
        step = list(factors)
        gram = _gram(fit, lambda x: solved(x - mean, step), d, d)  # noqa: B023
        if not factors:
            trace = float(np.trace(gram)) / n
            if trace == 0:
                return Whitening(n, tuple(sums), np.zeros((d, 0)), np.zeros(0), 0.0, largest), fit
            # Eleven units of rounding per row and column: enough for a factor to exist.
            scale = np.linalg.norm(gram, 2)
            factors.append(_upper(gram, 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * scale))
            continue
        if np.abs(gram - np.eye(d)).max() <= NEAR * d or len(factors) >= MAX_PASSES:
            break
        factors.append(_upper(gram, 0.0))
    composed = np.eye(d)
    for factor in factors:
        composed = factor @ composed
    values, turned = np.linalg.eigh(gram)
    composed = (np.sqrt(np.maximum(values, 0))[:, None] * turned.T) @ composed
    _, singular, right = np.linalg.svd(composed)
    real = int((singular > NOTHING * singular[0]).sum())
    real = min(keep, real)
    return Whitening(n, tuple(sums), right[:real].T.copy(), singular[:real] ** 2 / n, trace, largest), fit


def _projection(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    mean, axes = model.mean, model.components / np.sqrt(model.eigenvalues)
    return lambda x: (x - mean) @ axes


def identity_error(model: Whitening, fit: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    width = model.components.shape[1]
    project = _projection(model)
    with_one = lambda x: np.column_stack([project(x), np.ones(len(x))])
    gram = _gram(fit, with_one, len(model.sums), width + 1) / model.n
    covariance = gram[:width, :width] - np.outer(gram[width, :width], gram[width, :width])
    return float(np.abs(covariance - np.eye(width)).max())


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; None beyond the range of a long."""
    reach = model.n * model.largest + max(abs(s) for s in model.sums)
    kind = np.int64 if reach * reach * len(model.sums) <= LONG else object
    apart = model.n * x.astype(kind) - np.array(model.sums, dtype=kind)
    return [int(v) if v <= LONG else None for v in (apart * apart).sum(1).tolist()]


def _whiten(model: Whitening):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _projection(model)
        width = model.components.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), len(model.sums))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(_deviations(x, model), pa.int64()),
                    pa.array(project(x).reshape(len(x), width).tolist(), pa.list_(pa.float64())),
                ],
                ["row", "deviation", "whitened"],
            )

    return whiten


def whitened(rows: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """The rows with ``n, deviation, whitened`` (array), ``explained`` (array), ``identity_error``.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, and so
    are vectors of another length than most have (ties: the longest). Repeated rows and ids,
    null ids and other columns go through; columns of the new names are replaced. The arrays
    have an entry for each of the first ``components`` components with a variance above
    rounding: fewer, or none, where the vectors span fewer dimensions. ``deviation`` is null
    where it exceeds a long. An empty table gives an empty one.
    """
    new = ("n", "deviation", "whitened", "explained", "identity_error")
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in new), F.lit(0).alias("__"))
    vectors = rows.where(usable(vector)).select(whole.alias("row"), integer_vectors(rows, vector).alias("x"))
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    most = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    vectors = vectors.where(F.size("x") == (most.d if most else 0))
    fitted = fit_whitening(vectors, components)
    if fitted is None:
        width, n, explained, error, model = 0, 0, [], None, None
    else:
        model, fit = fitted
        width, n = model.components.shape[1], model.n
        explained = [float(e / model.trace) for e in model.eigenvalues]
        error = identity_error(model, fit) if width else None
    kept = vectors.schema["row"].dataType
    out = f"row {kept.simpleString()}, deviation long, whitened array<double>"
    done = arrow_map(vectors, _whiten(model), out) if model else vectors.select("row", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    return done.select(
        *(F.col("row").getField(c).alias(c) for c in kept.names if c != "__"),
        F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*(F.lit(e) for e in explained)).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
