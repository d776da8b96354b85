"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are put on an integer lattice, ``floor(scale * c) + offset``, so that their number,
sums and squared deviations are exact integers. The leading eigenvectors of the covariance
V (divisor n, centred before multiplying) come from passes over the rows: a pass computes
XᵀXQ of the centred rows for a block Q of more columns than are wanted, and the covariance
itself is never formed. A Chebyshev recurrence over such passes damps the unwanted part of
the spectrum, QR makes the block orthonormal, and Rayleigh-Ritz takes eigenpairs out of it.
Pairs whose residual ``|Vq - eq|`` is down to rounding are locked, so that the polynomial's
degree can follow the rest. The fit ends when all wanted pairs are certified that way;
``Whitening.residual`` has the largest residual over the largest eigenvalue.

The unwanted interval ends below the smallest Ritz value of the block. Where it begins is
estimated by a Lanczos vector that rides along in the passes of the first filter; a Ritz
value below that estimate puts it back to zero, which is always safe.

What moves: a task sends one block (dimensions x columns, whatever its number of rows), and
blocks of many tasks are added in a tree, so neither a task nor the driver gathers more
than ``FAN_IN`` of them. Lattice rows are written once in the shared folder; every pass
reads that table, so a lost executor costs the rows of its tasks.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped.
Repeated rows and ids of any kind, null included, are kept row by row; other columns pass
through, those named like new ones are replaced. Lattice values beyond ±2^52 are cut to
that. An empty vector has no components; vectors of different lengths are an error that
names them. Components without variance (up to rounding) are left out, so one vector, or
equal ones, give none. Equal eigenvalues: any orthonormal basis of their space. Signs are
set by each eigenvector's largest entry. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import stage
from .batches import byte_slices, with_columns

SCALE, OFFSET = 64, 1_000_000
COMPONENTS, GUARD = 32, 16
FAN_IN = 64
SLICE_BYTES = 4 << 20
MOST_DEGREE, LEAST_DEGREE = 24, 4
# Amplification of the first over the last wanted pair that one filter may have: beyond
# it, QR would lose the small directions of the block to rounding.
SPREAD = 18.0
MOST_ROUNDS = 60
X = "_lattice"


@dataclass(frozen=True)
class Centre:
    """Exact number and sums of the lattice vectors, with the trace of their covariance."""

    n: int
    sums: tuple[int, ...]
    squares: int

    @property
    def trace(self) -> float:
        """Sum over dimensions of (n x - S)^2 over all rows is n^2 squares - n S^2."""
        whole = self.n * self.squares - sum(s * s for s in self.sums)
        return whole / self.n**2 if self.n else 0.0

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``x`` less the whole part of the mean, exact, and the numerators of what is left of the mean."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        return x - base, rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        near, rest = self.apart(x)
        return near - rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        near, rest = self.apart(x)
        top = int(np.abs(near).max(initial=0)) + 1
        if (self.n * top) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * near - rest) ** 2).sum(1).tolist()
        exact = ((self.n * near.astype(object) - rest.astype(object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact.tolist()]


@dataclass(frozen=True)
class Whitening:
    """Eigenvectors (dimensions x components), eigenvalues, and what certifies them."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    residual: float
    passes: int
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.centre.trace if len(self.values) else self.values

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def lattice(df: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Rows with a finite vector, its lattice values as little-endian 64-bit integers in ``X``; written once."""
    rest = [c for c in df.columns if c != vector and c != X]
    schema = StructType([*df.select(*rest).schema.fields, *StructType.fromDDL(f"`{X}` binary").fields])
    limit = float(1 << 52)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("_vector")))
            lists = batch.column("_vector")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(size)), size)
            good = np.bincount(row, ~np.isfinite(values), minlength=len(size)) == 0
            x = np.clip(np.floor(scale * values[good[row]]), -limit, limit).astype("<i8") + offset
            ends = np.concatenate([[0], np.cumsum(8 * size[good])]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in rest), packed], names=[*rest, X])

    source = df.select(*rest, F.col(vector).cast("array<double>").alias("_vector"))
    return stage(source.mapInArrow(run, schema), "lattice")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal lengths as one matrix."""
    n = len(column)
    if not n:
        return np.empty((0, 0), np.int64)
    size = np.unique(pc.binary_length(column).to_numpy(zero_copy_only=False))
    if len(size) > 1:
        raise ValueError(f"vectors of different lengths: {(size // 8).tolist()}")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    if not size[0]:
        return np.empty((n, 0), np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<i8").reshape(n, -1)


def _added(parts: list):
    total = parts[0]
    for part in parts[1:]:
        if len(total) != len(part) or any(np.shape(a) != np.shape(b) for a, b in zip(total, part, strict=True)):
            raise ValueError(f"vectors of different lengths: {sorted({len(total), len(part)})}")
        total = [a + b for a, b in zip(total, part, strict=True)]
    return total


def over_rows(rows: DataFrame, tasks: int, compute: Callable[[np.ndarray], list]) -> list | None:
    """The sum over all rows of what ``compute`` makes of a matrix of some of them.

    ``compute`` returns a list of arrays or numbers. Tasks add up their own rows; the sums
    of tasks are added in a tree and in the order of the tasks. None without rows.
    """

    def part(batches: Iterator[pa.RecordBatch]):
        total = None
        for run in byte_slices(batches, X, SLICE_BYTES):
            got = compute(matrix(run.column(0)))
            total = got if total is None else _added([total, got])
        if total is not None:
            slot = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["slot", "value"])

    def merged(key, table: pa.Table) -> pa.Table:
        ordered = table.sort_by("slot").column("value").to_pylist()
        value = pickle.dumps(_added([pickle.loads(v) for v in ordered]))
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([value], pa.binary())})

    parts = rows.select(X).mapInArrow(part, "slot long, value binary")
    while tasks > FAN_IN:
        up = parts.withColumn("_up", F.expr(f"slot div {FAN_IN}"))
        parts = up.groupBy("_up").applyInArrow(lambda key, t: merged(key, t.drop_columns(["_up"])), "slot long, value binary")
        tasks = -(-tasks // FAN_IN)
    found = sorted(parts.collect())
    return _added([pickle.loads(r.value) for r in found]) if found else None


def _exact(x: np.ndarray) -> list:
    """Rows, sums per dimension and sum of squares as Python integers."""
    top = int(np.abs(x).max(initial=0))
    wide = top * top * max(1, x.size) >= 1 << 63
    y = x.astype(object) if wide else x
    sums = [int(v) for v in y.sum(0)] if x.shape[1] else []
    return [len(x), np.array(sums, object), int((y * y).sum()) if x.size else 0]


def fit(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD, seed: int = 29) -> Whitening:
    """Leading eigenpairs of the covariance of all rows of ``lattice``."""
    context = rows.sparkSession.sparkContext
    tasks = rows.select(X).rdd.getNumPartitions()
    found = over_rows(rows, tasks, _exact)
    n, sums, squares = found if found else (0, [], 0)
    centre = Centre(n, tuple(int(s) for s in sums), int(squares))
    d = len(centre.sums)
    if not d or not centre.trace:
        return Whitening(centre, np.empty((d, 0)), np.empty(0), 0.0, 0)
    passes = 0

    def product(q: np.ndarray) -> np.ndarray:
        """V q by one pass over the rows."""
        nonlocal passes
        passes += 1
        sent = context.broadcast(q)
        try:
            (total,) = over_rows(rows, tasks, lambda x: [_gram(centre, x, sent.value)])
        finally:
            sent.destroy()
        return total / n

    rng = np.random.default_rng(seed)
    block = min(d, components + guard)
    wanted = min(d, components)
    q = np.linalg.qr(rng.standard_normal((d, block)))[0]
    q, values, apart = _ritz(q, product(q))
    low, begun, before = 0.0, False, np.inf
    for _ in range(MOST_ROUNDS):
        bound = 8 * np.finfo(float).eps * max(values[0], 0.0) * np.sqrt(d)
        # Pairs without variance up to rounding cannot be told apart, nor are they returned.
        real = int((values[:wanted] > d * np.finfo(float).eps * values[0] * 4).sum())
        worst = apart[:real].max(initial=0.0)
        if block == d or worst <= bound or (worst <= 100 * bound and worst > before / 2):
            break
        before = worst
        locked = int(np.argmax(apart[:wanted] > bound)) if (apart[:wanted] > bound).any() else wanted
        if values[-1] < low:
            low = 0.0
        q, seen = _filtered(q, values, locked, wanted, low, product, None if begun else rng.standard_normal(d))
        low, begun = (seen if not begun else low), True
        q, values, apart = _ritz(q, product(q))
    keep = values[:wanted] > d * np.finfo(float).eps * values[0] * 4
    vectors, values, apart = q[:, :wanted][:, keep], values[:wanted][keep], apart[:wanted][keep]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    held = Whitening(centre, vectors, values, float(apart.max(initial=0.0) / values[0]), passes)
    sent = context.broadcast(held.projection)
    mean, gram = over_rows(rows, tasks, lambda x: _moments(centre.centred(x) @ sent.value))
    sent.destroy()
    error = np.abs(gram / n - np.outer(mean / n, mean / n) - np.eye(len(values))).max()
    return Whitening(centre, vectors, values, held.residual, passes, float(error))


def _gram(centre: Centre, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    c = centre.centred(x)
    return c.T @ (c @ q)


def _moments(w: np.ndarray) -> list:
    return [w.sum(0), w.T @ w]


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz vectors and values of an orthonormal block, falling, with their residuals."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return vectors, values, np.linalg.norm(vq @ turn - vectors * values, axis=0)


def _growth(value: float, middle: float, half: float) -> float:
    """What one more degree multiplies a component by, as a logarithm."""
    return float(np.arccosh(max(1.0, (value - middle) / half)))


def _filtered(q, values, locked, wanted, low, product, lanczos):
    """The block after a Chebyshev filter of its columns from ``locked`` on, orthonormal.

    With a vector ``lanczos``, also a lower bound of the spectrum: the smallest Ritz value of
    its Krylov space less the residual.
    """
    high = max(values[-1], 1e-10 * values[0])
    low = min(low, 0.95 * high)
    middle, half = (high + low) / 2, (high - low) / 2
    first, last = _growth(values[locked], middle, half), _growth(values[wanted - 1], middle, half)
    degree = int(np.clip(SPREAD / max(first - last, SPREAD / MOST_DEGREE), LEAST_DEGREE, MOST_DEGREE))
    fixed, x = q[:, :locked], q[:, locked:]
    basis, alpha, beta = [], [], []
    if lanczos is not None:
        basis.append(lanczos / np.linalg.norm(lanczos))
    sigma = first_sigma = half / (values[locked] - middle)
    y = None
    for step in range(degree):
        riding = bool(basis) and len(basis) == step + 1
        now = x if y is None else y
        vx = product(np.column_stack([now, basis[-1]]) if riding else now)
        if riding:
            w, vx = vx[:, -1], vx[:, :-1]
            alpha.append(float(basis[-1] @ w))
            for _ in range(2):
                for b in basis:
                    w = w - (b @ w) * b
            beta.append(float(np.linalg.norm(w)))
            if beta[-1] > 1e-10 * values[0] and len(basis) < len(w):
                basis.append(w / beta[-1])
        if y is None:
            y, x = (vx - middle * now) * (sigma / half), now
        else:
            new = 1 / (2 / first_sigma - sigma)
            y, x = (vx - middle * now) * (2 * new / half) - (sigma * new) * x, now
            sigma = new
        y = y - fixed @ (fixed.T @ y)
    seen = 0.0
    if alpha:
        t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
        ritz, turn = np.linalg.eigh(t)
        seen = max(0.0, float(ritz[0] - abs(beta[-1] * turn[-1, 0])))
    return np.linalg.qr(np.column_stack([fixed, y]))[0], seen


def transform(rows: DataFrame, model: Whitening, out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Replace the lattice column by the whitened vector and the row's exact squared deviation."""
    # A worker without this package gets plain values.
    sent = rows.sparkSession.sparkContext.broadcast({"centre": (model.centre.n, model.centre.sums, model.centre.squares), "to": model.projection})

    def apply(column: pa.Array):
        held = sent.value
        centre, x = Centre(*held["centre"]), matrix(column)
        w = centre.centred(x) @ held["to"] if x.size else np.empty((len(x), 0))
        ends = np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel())), pa.array(centre.deviations(x) if len(x) else [], pa.int64())]

    return with_columns(rows, X, f"`{out}` array<double>, `{deviation}` bigint", apply).drop(X)
