"""Embedding whitening by QDWH spectral divide-and-conquer.

1. Entries become integers. One pass sums them; a second one sums products of what is left after taking off
   the rounded mean, so the covariance is exact until its last division.
2. The driver splits the covariance (its size is that of a vector, squared). Shifted by a value inside its
   spectrum, its polar factor has eigenvalues -1 and 1 only, so half of the factor plus identity projects on the eigenvectors
   above the shift. QDWH (Nakatsukasa, Bai and Gygi 2010; Nakatsukasa and Higham 2013) finds the factor by dynamically
   weighted Halley steps, at most about six. Orthonormal bases of the two ranges block-diagonalise the matrix, and the
   blocks are split in turn until they are numbers.
3. The components, scaled by the root of their eigenvalue, go to all tasks, which project every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.vectors import scaled_entries, whole_rows

EPS = float(np.finfo(np.float64).eps)
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """Entries are ``floor(scale * c) + shift``; ``components`` are kept; vectors have at most ``max_entries``."""

    scale: int = 64
    shift: int = 1_000_000
    components: int = 32
    max_entries: int = 4_096


# --- the covariance -------------------------------------------------------------------------


@dataclass(frozen=True)
class Moments:
    """``n`` rows, the ``pivot`` (rounded mean), sums over ``x - pivot``, and the covariance."""

    n: int
    pivot: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray


def entry_sums(whole: DataFrame, column: str, settings: Settings) -> tuple[int, list[int]]:
    """Number of rows and the exact sum per entry of ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled_entries(batch.column(0), settings.scale)
            # An empty vector still counts; place -1 holds the rows.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(-1, x.shape[1])),
                    pa.array(np.full(x.shape[1] + 1, len(x))),
                    pa.array(np.concatenate(([0], x.sum(axis=0) + len(x) * settings.shift))),
                ],
                ["place", "n", "total"],
            )

    parts = whole.select(column).mapInArrow(run, "place long, n long, total long")
    totals = parts.groupBy("place").agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)")))
    rows = totals.orderBy("place").limit(settings.max_entries + 2).collect()  # one row per entry of a vector
    if len(rows) > settings.max_entries + 1:
        raise ValueError(f"vectors of more than {settings.max_entries} entries")
    if len({r[1] for r in rows}) > 1:
        raise ValueError("vectors of different lengths in one table")
    return (rows[0][1] if rows else 0), [int(r[2]) for r in rows[1:]]


def summed_products(rows: DataFrame, products: Callable[[pa.RecordBatch], np.ndarray], kind: str) -> list:
    """Sums over all batches of a square matrix, as ``(i, j, sum)`` with ``i <= j``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = products(batch)
            fits = total is None or part.dtype.kind == "f" or max(abs(int(m)) for a in (total, part) for m in (a.min(), a.max())) < 1 << 61
            if total is not None and not fits:
                yield cells(total)
            total = part if total is None or not fits else total + part
        if total is not None:
            yield cells(total)

    def cells(total: np.ndarray) -> pa.RecordBatch:
        i, j = np.triu_indices(len(total))
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "part"])

    found = rows.mapInArrow(run, f"i long, j long, part {kind}")
    part = F.col("part").cast("decimal(38,0)") if kind == "long" else F.col("part")
    return found.groupBy("i", "j").agg(F.sum(part)).collect()  # the square of a vector's length


def moments(whole: DataFrame, column: str, settings: Settings) -> Moments | None:
    """The covariance with divisor n over all rows of ``whole``; None without rows or entries."""
    n, sums = entry_sums(whole, column, settings)
    if not n or not sums:
        return None
    pivot = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - n * int(p) for s, p in zip(sums, pivot)]

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = scaled_entries(batch.column(0), settings.scale) + settings.shift - pivot
        largest = int(np.abs(y).max(initial=0))
        if largest * largest * len(y) >= 1 << 61:
            raise ValueError("entries too far apart for exact products")
        if largest * largest * len(y) < 1 << 53:
            y = y.astype(np.float64)  # still exact, and fast
        return np.rint(y.T @ y).astype(np.int64)

    size = len(sums)
    covariance = np.zeros((size, size))
    for i, j, total in summed_products(whole.select(column), products, "long"):
        covariance[i, j] = covariance[j, i] = (n * int(total) - rest[i] * rest[j]) / (n * n)
    return Moments(n, pivot, np.array(rest, np.int64), covariance)


# --- spectral divide-and-conquer --------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix by QR- and Cholesky-based weighted Halley steps."""
    size = len(a)
    x = a / np.linalg.norm(a)
    low = EPS  # a lower bound of the singular values, whatever they are
    for _ in range(20):
        before = x
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.concatenate((np.sqrt(wc) * x, np.eye(size))))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:size] @ q[size:].T
        else:
            lower = np.linalg.cholesky(np.eye(size) + wc * x.T @ x)
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if 1 - low < 1e-15 and np.linalg.norm(x - before) < 1e-5:
            break
    return x


def shifts(a: np.ndarray) -> Iterator[float]:
    """Values inside the spectrum: diagonal entries are, and so is their mean unless all eigenvalues are equal."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    width = np.linalg.norm(a - diagonal.mean() * np.eye(len(a)))
    for k in range(1, 40):
        yield float(diagonal.mean() + width / np.sqrt(len(a)) * 0.05 * k * (-1) ** k)


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if no shift separates any."""
    size = len(a)
    for shift in shifts(a):
        moved = a - shift * np.eye(size)
        if not np.linalg.norm(moved):
            return None
        projector = (polar_factor(moved) + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        # An eigenvalue at the shift itself leaves the factor undecided; so does a shift outside.
        if not 0 < rank < size or np.linalg.norm(projector @ projector - projector) > 1e-10 * size:
            continue
        basis = rng.standard_normal((size, rank))
        for _ in range(3):
            basis, _ = np.linalg.qr(projector @ basis)
        whole, _ = np.linalg.qr(np.concatenate((basis, rng.standard_normal((size, size - rank))), axis=1))
        below = whole[:, rank:]
        for _ in range(2):
            below, _ = np.linalg.qr(below - basis @ (basis.T @ below) - projector @ below)
        return basis, below
    return None


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    size, scale, rng = len(a), float(np.linalg.norm(a)), np.random.default_rng(12)
    values, vectors, stack = [], [], [(a, np.eye(size))]
    while stack:
        block, basis = stack.pop()
        off = np.linalg.norm(block - np.diag(np.diag(block)))
        halves = split(block, rng) if len(block) > 1 and off > 4 * EPS * scale else None
        if halves is None:
            # A number, or diagonal to rounding: the basis is one of eigenvectors.
            values.append(np.diag(block))
            vectors.append(basis)
            continue
        for part in halves:
            inner = part.T @ block @ part
            stack.append(((inner + inner.T) / 2, basis @ part))
    vectors = np.concatenate(vectors, axis=1)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    return values, vectors * np.where(signs == 0, 1, signs)


# --- whitening --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: rows of ``matrix`` are components over the root of their eigenvalue."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    components: int
    column: str
    settings: Settings

    @property
    def explained(self) -> list[float | None]:
        """Share of the trace of each component; null where nothing varies."""
        trace = float(np.trace(self.moments.covariance))
        return [float(v) / trace if trace > 0 else None for v in self.values[: self.components]]

    @property
    def usable(self) -> np.ndarray:
        """Whether a component varies beyond rounding; the others cannot be whitened."""
        kept = self.values[: self.components]
        return kept > len(self.values) * EPS * max(float(self.values[0]), 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of rows ``x``, NaN for components without variance."""
        m, ok = self.moments, self.usable
        out = np.full((len(x), ok.size), np.nan)
        centred = (x - m.pivot) - m.rest / m.n
        out[:, ok] = centred @ (self.vectors[:, : ok.size][:, ok] / np.sqrt(self.values[: ok.size][ok]))
        return out

    def entries(self, column: pa.Array) -> np.ndarray:
        x = scaled_entries(column, self.settings.scale) + self.settings.shift
        if x.shape[1] != len(self.values):
            raise ValueError(f"vectors of {x.shape[1]} entries, fitted on {len(self.values)}")
        return x


def fit_whitening(vectors: DataFrame, column: str = "embedding", settings: Settings = Settings()) -> Whitening | None:
    """Components of the covariance of all whole rows of ``vectors``; None without any entry."""
    found = moments(whole_rows(vectors, column), column, settings)
    if found is None:
        return None
    values, components = spectrum(found.covariance)
    return Whitening(found, values, components, min(settings.components, len(values)), column, settings)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; 0 without components."""
    ok = model.usable

    def products(batch: pa.RecordBatch) -> np.ndarray:
        w = model.project(model.entries(batch.column(0)))[:, ok]
        w = np.concatenate((w, np.ones((len(w), 1))), axis=1)
        return w.T @ w

    size = int(ok.sum())
    total = np.zeros((size + 1, size + 1))
    for i, j, value in summed_products(whole_rows(vectors, model.column).select(model.column), products, "double"):
        total[i, j] = total[j, i] = value
    mean = total[:-1, -1] / model.moments.n
    covariance = total[:-1, :-1] / model.moments.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(size)).max(initial=0.0))


def whiten(vectors: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """``(record, whitened, deviation)`` of every whole row of ``vectors``.

    Rows with a null vector or a null or non-finite entry are left out. ``whitened`` is an array, its entry
    null where a component has no variance (a constant table, more entries than rows). ``deviation`` is the sum of
    ``(n x - S) ** 2``, exact, and null beyond 64 bits. Equal vectors get equal values; other columns may have any names.
    All vectors have one length, or ``ValueError`` is raised. Without vectors the result is empty, and
    vectors without entries have no components.
    """
    out = whole_rows(vectors, column).select(
        F.struct(*vectors.columns).alias("record"),
        F.array().cast("array<double>").alias("whitened"),
        F.lit(0).cast("long").alias("deviation"),
        column,
    )
    schema = T.StructType([out.schema[0], out.schema[1], T.StructField("deviation", T.LongType())])
    if model is None:
        return out.select(*schema.names)
    m, k = model.moments, model.components

    def deviations(x: np.ndarray) -> pa.Array:
        y = x - m.pivot
        reach = m.n * int(np.abs(y).max(initial=0)) + int(np.abs(m.rest).max(initial=0))
        if reach * reach * x.shape[1] <= LONG:
            return pa.array(((m.n * y - m.rest) ** 2).sum(axis=1))
        exact = ((m.n * y.astype(object) - m.rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([int(v) if v <= LONG else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.entries(batch.column(3))
            values = model.project(x).ravel()
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(values, mask=np.isnan(values))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, deviations(x)], schema.names)

    return out.mapInArrow(run, schema)


def whitened_components(vectors: DataFrame, column: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component."""
    slim = vectors.select("vec_id", column)
    model = fit_whitening(slim, column, settings)
    rows = whiten(slim, model, column).select("record.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = model.explained if model else []
    shares = F.array(*[F.lit(v).cast("double") for v in explained]) if explained else F.array().cast("array<double>")
    error = identity_error(slim, model) if model else None
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.moments.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, "at").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
