"""Least squares from additive sums: only small matrices ever reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantab.functions.formula import formula_column
from spantab.functions.scalars import clean_double
from spantab.operators.cleaning import _quoted
from spantab.operators.features import exponents, monomial_names, monomials
from spantab.staging import held

SQL_SUM_COLUMNS = 20  # up to here sums of products stay in one code-generated aggregate
SQL_PREDICT_COLUMNS = 50  # up to here a prediction is a plain expression
GROUPS = 64  # groups of tasks whose vectors are merged before the driver sees one of each
RANK_TOLERANCE = 1e-11
# Singular values below this share of the largest one span no direction.
TRIANGLE_TOLERANCE = 1e-12
BLOCK_ROWS = 4096

Kernel = Callable[[np.ndarray], np.ndarray]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float, copy=False)


def task_vector(vector: np.ndarray) -> pa.RecordBatch:
    """One task's result, under its partition number."""
    values = pa.ListArray.from_arrays(pa.array([0, len(vector)], pa.int32()), pa.array(vector))
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), values], ["task", "v"])


def combined(vectors: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The vectors of all tasks (task, v), merged two at a time: within groups of tasks, then over the groups.

    Groups share partitions while they are small, so the second level is one
    short task for a small cluster's vectors and up to ``GROUPS`` for many.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for vector in batch.column("v"):
                found = vector.values.to_numpy()
                total = found if total is None else merge(total, found)
        if total is not None:
            yield task_vector(total)

    grouped = vectors.repartition(F.pmod("task", F.lit(GROUPS))).mapInArrow(fold, "task int, v array<double>")
    rows = sorted(grouped.collect(), key=lambda r: r["task"])
    return reduce(merge, (np.asarray(r["v"]) for r in rows)) if rows else None


def partial_sums(df: DataFrame, inputs: Sequence[Column], kernel: Kernel, length: int) -> np.ndarray:
    """Sum over all rows of an additive kernel that maps a row block to ``length`` numbers.

    Each task streams its rows and emits one vector; these are added up in two
    levels, and the driver gets at most ``GROUPS`` of them.
    """

    def over_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += kernel(_matrix(batch))
        yield task_vector(total)

    named = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(inputs)))
    found = combined(named.mapInArrow(over_rows, "task int, v array<double>"), np.add)
    return np.zeros(length) if found is None else found


def product_sums(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """Symmetric matrix of sums of products of the columns and a leading 1.

    A missing cell is NaN at any width, and so is every sum that it would be part of.
    """
    columns = [F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in columns]
    width = len(columns) + 1
    if len(columns) <= SQL_SUM_COLUMNS:
        named = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
        terms = [F.lit(1.0), *(F.col(f"c{i}") for i in range(len(columns)))]
        cells = [(i, j) for i in range(width) for j in range(i, width)]
        (row,) = named.agg(*(F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in cells)).collect()
        out = np.zeros((width, width))
        for i, j in cells:
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
        return out
    return partial_sums(df, columns, lambda m: _products(m).ravel(), width * width).reshape(width, width)


def _products(matrix: np.ndarray) -> np.ndarray:
    with_one = np.column_stack([np.ones(len(matrix)), matrix])
    return with_one.T @ with_one


def gram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, value): sums of products of every pair of columns, ``1`` being the constant."""
    names = ["1", *columns]
    sums = product_sums(df, [_quoted(c) for c in columns])
    cells = [(names[i], names[j], float(sums[i, j])) for i in range(len(names)) for j in range(i, len(names))]
    return df.sparkSession.createDataFrame(cells, "a string, b string, value double")


@dataclass(frozen=True)
class Moments:
    """Rows, means, scales and the covariance of the scaled columns."""

    n: float
    mean: np.ndarray
    scale: np.ndarray
    cov: np.ndarray

    @property
    def finite(self) -> np.ndarray:
        return np.isfinite(self.mean) & np.isfinite(self.scale)


def moments_from(count: float, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(invalid="ignore", over="ignore"):
        mean = sums / max(count, 1.0)
        spread = np.sqrt(np.maximum(squares / max(count, 1.0) - mean**2, 0.0))
    # Below rounding level the column is constant; keep it at scale 1.
    return mean, np.where(spread > 1e-9 * np.maximum(np.abs(mean), 1e-300), spread, 1.0)


def _finish(mean: np.ndarray, scale: np.ndarray, sums: np.ndarray) -> Moments:
    n = sums[0, 0]
    shift = sums[0, 1:] / max(n, 1.0)
    return Moments(n, mean + shift * scale, scale, sums[1:, 1:] / max(n, 1.0) - np.outer(shift, shift))


@dataclass(frozen=True)
class LinearModel:
    names: tuple[str, ...]
    coef: np.ndarray
    intercept: float


def solve(moments: Moments, x: Sequence[int], y: int) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of column ``y`` on columns ``x``.

    Solved through the eigenvectors of the scaled covariance. Directions below
    the tolerance are left out; of all equally good solutions the one of least
    norm in the unscaled coefficients is returned.
    """
    if not len(x):
        return np.zeros(0), float(moments.mean[y])
    index = np.asarray(x)
    c_xx, c_xy = moments.cov[np.ix_(index, index)], moments.cov[index, y]
    values, vectors = np.linalg.eigh(c_xx)
    kept = values > RANK_TOLERANCE * max(values.max(), 1e-300)
    used, unused = vectors[:, kept], vectors[:, ~kept]
    scaled = used @ ((used.T @ c_xy) / values[kept])
    scale = moments.scale[index]
    coef = scaled * moments.scale[y] / scale
    if unused.shape[1]:
        basis, _ = np.linalg.qr(unused / scale[:, None])
        coef = coef - basis @ (basis.T @ coef)
    return coef, float(moments.mean[y] - coef @ moments.mean[index])


def labelled(df: DataFrame, target: str) -> DataFrame:
    """The rows whose target is known; only these are fitted."""
    y = _quoted(target).cast("double")
    return df.filter(y.isNotNull() & ~F.isnan(y))


def _triangle(blocks: Sequence[np.ndarray], width: int) -> np.ndarray:
    """The square triangle of stacked blocks."""
    r = np.linalg.qr(np.concatenate(blocks), mode="r") if blocks else np.zeros((0, width))
    return np.concatenate([r, np.zeros((width - len(r), width))])


def tall_triangle(df: DataFrame, inputs: Sequence[Column], expand: Kernel, width: int) -> np.ndarray:
    """R of the matrix of ``width`` columns that ``expand`` makes of the inputs of all rows.

    A task turns its rows into one triangle with RᵀR = MᵀM by orthogonal steps,
    block by block; triangles are stacked and factored again, two at a time.
    Sums of products are never formed, so the condition of M is not squared.
    """

    def over_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                waiting.append(expand(np.column_stack(columns).astype(float, copy=False)))
                rows += batch.num_rows
                if rows >= max(BLOCK_ROWS, 4 * width):
                    waiting, rows = [_triangle(waiting, width)], 0
        yield task_vector(_triangle(waiting, width).ravel())

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _triangle([a.reshape(width, width), b.reshape(width, width)], width).ravel()

    named = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(inputs)))
    found = combined(named.mapInArrow(over_rows, "task int, v array<double>"), merge)
    return np.zeros((width, width)) if found is None else found.reshape(width, width)


def rough_moments(df: DataFrame, inputs: Sequence[Column], expand: Kernel, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and scales of the columns that ``expand`` makes of the inputs."""

    def sums(raw: np.ndarray) -> np.ndarray:
        x = expand(raw)
        return np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])

    found = partial_sums(df, inputs, sums, 2 * width + 1)
    mean, scale = moments_from(found[0], found[1 : width + 1], found[width + 1 :])
    return float(found[0]), mean, scale


def solve_triangle(r: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the last column on the others, from R of constant and standardised columns.

    Directions below the tolerance are left out; of all equally good solutions
    the one of least norm in the unscaled coefficients is returned.
    """
    p = len(mean) - 1
    if not p or not r[0, 0]:
        return np.zeros(p), float(mean[p])
    left, values, vectors = np.linalg.svd(r[1 : p + 1, 1 : p + 1])
    kept = values > TRIANGLE_TOLERANCE * max(values.max(initial=0.0), 1e-300)
    scaled = vectors[kept].T @ ((left[:, kept].T @ r[1 : p + 1, p + 1]) / values[kept])
    coef = scaled * scale[p] / scale[:p]
    if not kept.all():
        basis, _ = np.linalg.qr(vectors[~kept].T / scale[:p, None])
        coef = coef - basis @ (basis.T @ coef)
    # The means are rough; the constant's row of R holds what is left of them.
    shift = r[0, 1:] / r[0, 0] * scale
    exact = mean + shift
    return coef, float(exact[p] - coef @ exact[:p])


def ols_fit(df: DataFrame, features: Sequence[str], target: str) -> LinearModel:
    """Least squares with intercept over the rows with a target; a non-finite feature value gives the mean-only model.

    Two scans: rough moments, then the triangle of the standardised columns.
    """
    p = len(features)
    named = [_quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, target])]
    inputs = [F.col(f"c{i}") for i in range(p + 1)]
    with held(labelled(df, target), named) as data:
        _, mean, scale = rough_moments(data, inputs, lambda raw: raw, p + 1)
        if not (np.isfinite(mean[:p]).all() and np.isfinite(scale[:p]).all()):
            return LinearModel(tuple(features), np.zeros(p), float(mean[p]))
        r = tall_triangle(
            data, inputs, lambda raw: np.column_stack([np.ones(len(raw)), (raw - mean) / scale]), p + 2
        )
    coef, intercept = solve_triangle(r, mean, scale)
    return LinearModel(tuple(features), coef, intercept)


def weighted_sum(columns: Sequence[Column], coef: Sequence[float], intercept: float) -> Column:
    total = F.lit(float(intercept))
    for c, w in zip(columns, coef):
        total = total + F.lit(float(w)) * c
    return total


def ols_predict(df: DataFrame, model: LinearModel, name: str = "p") -> DataFrame:
    """Add the prediction; non-finite inputs count as 0, a non-finite result is 0 for that row."""
    cleaned = [clean_double(_quoted(c)) for c in model.names]
    return df.withColumn(name, clean_double(weighted_sum(cleaned, model.coef, model.intercept)))


@dataclass(frozen=True)
class Term:
    """A formula column of a design; ``fill`` replaces values beyond the magnitude limit."""

    name: str
    body: str
    fill: float | None = None


MAGNITUDE_LIMIT = 1e10


def term_column(term: Term, columns: Sequence[str]) -> Column:
    value = formula_column(term.body, columns)
    if term.fill is None:
        return value
    return F.when(F.abs(value) <= MAGNITUDE_LIMIT, value).otherwise(F.lit(float(term.fill)))


@dataclass(frozen=True)
class Design:
    """Feature matrix: monomials of the base columns, then formula columns."""

    base: tuple[str, ...]
    degree: int
    terms: tuple[Term, ...] = ()
    powers: tuple[tuple[int, ...], ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "powers", tuple(exponents(len(self.base), self.degree)))

    @property
    def names(self) -> list[str]:
        return [*monomial_names(self.base, self.degree), *(t.name for t in self.terms)]

    @property
    def width(self) -> int:
        return len(self.powers) + len(self.terms)

    def inputs(self, available: Sequence[str]) -> list[Column]:
        """What a task needs per row: base columns and computed formulas."""
        return [clean_double(_quoted(c)) for c in self.base] + [term_column(t, available) for t in self.terms]

    def expand(self, raw: np.ndarray) -> np.ndarray:
        """Design rows from the input columns."""
        base, rest = raw[:, : len(self.base)], raw[:, len(self.base) :]
        made: dict[tuple[int, ...], np.ndarray] = {}
        for power in self.powers:
            last = max(i for i, e in enumerate(power) if e)
            lower = power[:last] + (power[last] - 1,) + power[last + 1 :]
            made[power] = base[:, last] if not any(lower) else made[lower] * base[:, last]
        return np.column_stack([*(made[p] for p in self.powers), rest])

    def columns(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """The design as expressions over ``df`` with clean base columns added."""
        clean = {f"_x{i}": clean_double(_quoted(c)) for i, c in enumerate(self.base)}
        extra = {f"_t{i}": term_column(t, df.columns) for i, t in enumerate(self.terms)}
        ready = df.withColumns({**clean, **extra})
        return ready, [*monomials(list(clean), self.degree), *map(F.col, extra)]


def design_correlations(df: DataFrame, design: Design, other: Column) -> np.ndarray:
    """Correlation of every design column with ``other``, over the rows that have it; NaN for a constant one.

    Two scans: rough moments, then sums of the standardised columns.
    """
    width = design.width + 1
    named = [c.cast("double").alias(f"c{i}") for i, c in enumerate([*design.inputs(df.columns), other])]
    rows, inputs = df.select(*named).filter(F.col(f"c{len(named) - 1}").isNotNull()), [F.col(f"c{i}") for i in range(len(named))]

    def widen(raw: np.ndarray) -> np.ndarray:
        return np.column_stack([design.expand(raw[:, :-1]), raw[:, -1]])

    _, mean, scale = rough_moments(rows, inputs, widen, width)

    def sums(raw: np.ndarray) -> np.ndarray:
        s = (widen(raw) - mean) / scale
        return np.concatenate([[len(s)], s.sum(axis=0), (s * s).sum(axis=0), s.T @ s[:, -1]])

    found = partial_sums(rows, inputs, sums, 3 * width + 1)
    n, (total, square, joint) = max(found[0], 1.0), found[1:].reshape(3, width)
    centre = total / n
    spread = np.sqrt(np.maximum(square / n - centre**2, 0.0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return ((joint / n - centre * centre[-1]) / (spread * spread[-1]))[:-1]
