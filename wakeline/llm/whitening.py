"""Embedding whitening by Chebyshev-filtered subspace iteration (operator 13).

The top eigenpairs of the vectors' covariance V are found without forming V. A pass over the vectors adds up X'(XQ) for a block Q of directions,
X being the centred vectors; all else are small matrices (dimensions times block) on the driver.

* Filter. A Chebyshev polynomial of V, by its three-term recurrence, one pass a degree, damps all of the spectrum between a and b and lets what lies
  above grow. b is the smallest Ritz value of the block. a comes from Lanczos steps on one more column, which rides along in the same passes.
* Rayleigh-Ritz. The filtered block is made orthonormal (QR), V is projected on it, and the small eigenproblem gives new directions.
* Certificate. Each wanted pair must leave a residual |Vq - eq| of at most 1e-12 of the largest eigenvalue, and residuals must have come to the
  floor of rounding: below 1e-14, or falling no longer. Lanczos must not have seen an eigenvalue above the first. Else the fit fails.

Entries become whole numbers x = floor(64 * c) + 1000000, so sums S and the centred n * x - S are exact; only then are they divided. Sums of a pass
are added up by part number, in two steps, so that the driver gets about the square root of the number of partitions of small matrices.

Defined results: null vectors and vectors with null or non-finite entries are left out; so are vectors of another length than most have (the longer on a
tie), since they have no covariance with them; components whose eigenvalue is below 1e-12 of the first are no components (one vector, equal vectors,
flat dimensions), so rows may have fewer than 32, and none if all vectors are equal; of equal eigenvalues, any basis; null and repeated ids are
rows of their own; an empty table gives no rows; further columns are ignored, whatever their names. A deviation above 2^63 - 1 fails the job.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

STEP, SHIFT = 64, 1_000_000
#: A component's least share of the first eigenvalue.
LEAST = 1e-12
_STATE = "part int, state binary"


@dataclass
class Fit:
    """vectors: dimensions times components, unit columns; values: their eigenvalues; n and sums: of the fit list; trace: of the covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residual: float


def whole_numbers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x: the vectors that take part, in whole numbers."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    x = F.transform(vector, lambda c: (F.floor(c.cast("double") * STEP) + SHIFT).cast("long"))
    rows = materialize(embeddings.filter(vector.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), x.alias("x")), "whiten-x")
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.filter(F.size("x") == (lengths["length"] if lengths else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _added(states: Iterator) -> list | None:
    total = None
    for state in states:
        total = state if total is None else [a + b for a, b in zip(total, state, strict=True)]
    return total


def _state_batch(part: int, state: list | None) -> Iterator[pa.RecordBatch]:
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "state"])


def fold(rows: DataFrame, of: Callable[[np.ndarray], list]) -> list | None:
    """The sum of of(matrix) over all batches of rows: by task, by group of tasks, and then here."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _state_batch(TaskContext.get().partitionId(), _added(of(_matrix(b)) for b in batches if len(b)))

    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((p, pickle.loads(s)) for b in batches for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        first = next(found, None)
        if first is not None:
            yield from _state_batch(first[0], _added([first[1], *(s for _, s in found)]))

    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    grouped = rows.select("x").mapInArrow(of_task, _STATE).withColumn("fan", F.col("part") % fan).repartition(fan, "fan").sortWithinPartitions("part")
    found = grouped.select("part", "state").mapInArrow(of_group, _STATE).collect()
    return _added(pickle.loads(r["state"]) for r in sorted(found, key=lambda r: r["part"]))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    return n * x - sums


class Lanczos:
    """Bounds of the spectrum from one column that is multiplied along with the block."""

    def __init__(self, start: np.ndarray, most: int) -> None:
        self.basis, self.alpha, self.beta, self.most = [start / np.linalg.norm(start)], [], [], most

    @property
    def vector(self) -> np.ndarray | None:
        return self.basis[-1] if len(self.alpha) < len(self.basis) and len(self.alpha) < self.most else None

    def took(self, product: np.ndarray) -> None:
        v = self.basis[-1]
        self.alpha.append(float(v @ product))
        rest = product
        for _ in range(2):
            rest = rest - np.array(self.basis).T @ (np.array(self.basis) @ rest)
        self.beta.append(float(np.linalg.norm(rest)))
        if self.beta[-1] > 1e-10 * abs(self.alpha[0]) and len(self.basis) < len(v):
            self.basis.append(rest / self.beta[-1])

    def bounds(self) -> tuple[float, float]:
        """A guess from below for the smallest eigenvalue, and the largest one seen."""
        if not self.alpha:
            return 0.0, 0.0
        inner = self.beta[: len(self.alpha) - 1]
        values, vectors = np.linalg.eigh(np.diag(self.alpha) + np.diag(inner, 1) + np.diag(inner, -1))
        return max(0.0, float(values[0] - self.beta[-1] * abs(vectors[-1, 0]))), float(values[-1])


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of V, of a degree, times q; vq is V times q. [low, high] is damped, top stays about 1."""
    half, mid = (high - low) / 2, (high + low) / 2
    first = half / (top - mid)
    sigma, last, now = first, q, (vq - mid * q) * (first / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        last, now = now, (times(now) - mid * now) * (2 * new / half) - sigma * new * last
        sigma = new
    return now


def top_pairs(
    product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, guard: int = 16, degree: int = 10, most_passes: int = 600, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, int, float]:
    """The k largest eigenpairs of V, known by product(Q) = VQ alone: values, vectors, passes, largest residual against the first value."""
    rng = np.random.default_rng(seed)
    block = min(dims, k + max(guard, k // 2))
    lanczos = Lanczos(rng.standard_normal(dims), 24 if block < dims else 0)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        v = lanczos.vector
        if v is None:
            return product(q)
        both = product(np.column_stack([q, v]))
        lanczos.took(both[:, -1])
        return both[:, :-1]

    q = np.linalg.qr(rng.standard_normal((dims, block)))[0]
    before = math.inf
    while passes < most_passes:
        vq = times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        first = float(values[0])
        if first <= 0:
            return values[:0], q[:, :0], passes, 0.0
        wanted = min(k, int(np.sum(values > LEAST * first)))
        residual = float(np.max(np.linalg.norm(vq - q * values, axis=0)[:wanted])) / first
        low, seen = lanczos.bounds()
        done = residual <= 1e-14 or residual <= 1e-12 and residual > before / 2
        if done and seen <= first * (1 + 1e-9):
            return values[:wanted], q[:, :wanted], passes, residual
        before = residual
        high = float(values[-1])
        if block == dims or high <= LEAST * first:  # all of the spectrum is in the block: a step of plain iteration settles it
            q = np.linalg.qr(vq if block < dims else q)[0]
            continue
        low = min(low, high * (1 - 1e-3))
        # The block must stay independent: no polynomial that grows above 1e8 at the largest value.
        growth = math.acosh(max(1 + 1e-12, (2 * first - high - low) / (high - low)))
        steps = int(max(2, min(degree, math.log(2e8) / growth)))
        q = np.linalg.qr(chebyshev(times, q, vq, low, high, max(first, seen), steps))[0]
    raise RuntimeError(f"eigenvectors are not certified after {passes} passes: residual {before:.2g} of the first eigenvalue")


def fit_whitening(rows: DataFrame, components: int = 32, **how) -> Fit | None:
    """rows: x, written, all of one length. None for no rows or no variance."""
    total = fold(rows, lambda x: [len(x), x.sum(axis=0)])
    if total is None or not len(total[1]):
        return None
    n, sums = int(total[0]), total[1]

    def squares(x: np.ndarray) -> list:
        c = centred(x, n, sums)
        return [sum(int(v) for v in _deviation(c))]

    trace = fold(rows, squares)[0] / n**3

    def product(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> list:
            c = centred(x, n, sums) / n
            return [c.T @ (c @ q)]

        return fold(rows, of)[0] / n

    values, vectors, passes, residual = top_pairs(product, len(sums), components, **how)
    return Fit(n, sums, vectors, values, trace, passes, residual) if len(values) else None


def _deviation(c: np.ndarray) -> np.ndarray:
    if c.size and float(np.max(np.einsum("ij,ij->i", c.astype(float), c.astype(float)))) > 9.2e18:
        raise OverflowError("a deviation does not fit into 64 bits")
    return np.einsum("ij,ij->i", c, c)


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return (centred(x, fit.n, fit.sums) / fit.n) @ (fit.vectors / np.sqrt(fit.values))


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, in one more pass."""

    def of(x: np.ndarray) -> list:
        z = _whitened(x, fit)
        return [z.sum(axis=0), z.T @ z]

    total, square = fold(rows, of)
    mean = total / fit.n
    return float(np.max(np.abs(square / fit.n - np.outer(mean, mean) - np.eye(len(mean)))))


def whiten(embeddings: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_numbers(embeddings, id_col, vector_col)
    kind = dict(rows.dtypes)["vec_id"]
    fit = fit_whitening(rows, components, **how)
    if fit is None:
        return rows.limit(0).selectExpr("vec_id", "0 component", "0L n", "0L deviation", "0D whitened", "0D explained", "0D identity_error")
    error = identity_error(rows, fit)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch) if len(batch) else np.zeros((0, len(fit.sums)), np.int64)
            z = _whitened(x, fit)
            flat = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), z.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviation(centred(x, fit.n, fit.sums))), flat], names=["vec_id", "deviation", "z"])

    wide = rows.select("vec_id", "x").mapInArrow(of, f"vec_id {kind}, deviation long, z array<double>")
    share = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values])
    long = wide.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
