"""Whitening of embeddings by a matrix-free block Jacobi-Davidson eigensolver.

The covariance is never formed. The vectors lie in the shared folder as blocks of
integers, and the solver asks for its product with a few directions at a time: one
Spark job that centres each block, multiplies it by the directions and back by
itself, and sums the partial products, a number for each dimension and direction.
All that the driver holds is a few vectors of the embeddings' dimension.

The solver keeps a subspace and its product. Rayleigh-Ritz gives the best pairs
in it; each wanted pair that is not there yet gets a correction from the
equation projected against the locked and kept vectors, solved by some steps of
MINRES, all pairs' steps in one product; the corrections widen the subspace.
Pairs whose residual has come down to rounding are locked and taken out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.llm.shared import table

#: Entries a block holds.
BLOCK = 1 << 20
EPS = float(np.finfo(float).eps)


class NotConverged(RuntimeError):
    pass


# ---- the solver, on any symmetric product ---------------------------------------------------


def _unit(a: np.ndarray) -> np.ndarray:
    norm = np.sqrt((a * a).sum(0))
    return a / np.where(norm > 0, norm, 1)


def _orthonormal(a: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of a add to those of `against`; columns that add nothing are left out."""
    for _ in range(2):
        a = _unit(a - against @ (against.T @ a))
    kept = []
    for i in range(a.shape[1]):
        v = a[:, i]
        for _ in range(2):
            for u in kept:
                v = v - u * (u @ v)
            v = v - against @ (against.T @ v)
        norm = np.sqrt(v @ v)
        if norm > 1e-8:
            kept.append(v / norm)
    return np.stack(kept, 1) if kept else a[:, :0]


def minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Columns x with product(x) near b, each by its own MINRES, all columns' products
    at once. Ends after `steps` products or when every residual is below tolerance
    times its right side."""
    beta = np.sqrt((b * b).sum(0))
    start = np.where(beta > 0, beta, 1)
    v, before = b / start, np.zeros_like(b)
    x, w, w_before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta = beta.copy()
    beta = np.zeros_like(eta)
    cos, cos_before, sin, sin_before = np.ones_like(eta), np.ones_like(eta), np.zeros_like(eta), np.zeros_like(eta)
    going = eta > 0
    for _ in range(steps):
        if not going.any():
            break
        a = product(v)
        alpha = (v * a).sum(0)
        after = a - alpha * v - beta * before
        next_beta = np.sqrt((after * after).sum(0))
        delta = cos * alpha - cos_before * sin * beta
        above, far = sin * alpha + cos_before * cos * beta, sin_before * beta
        rho = np.hypot(delta, next_beta)
        going &= rho > 0
        safe = np.where(rho > 0, rho, 1)
        cos_before, sin_before = cos, sin
        cos, sin = delta / safe, next_beta / safe
        w, w_before = (v - far * w_before - above * w) / safe, w
        x += np.where(going, cos * eta, 0) * w
        eta = -sin * eta
        small = next_beta <= EPS * np.abs(alpha)
        before, v = v, after / np.where(next_beta > 0, next_beta, 1)
        beta = next_beta
        going &= ~small & (np.abs(eta) > tolerance * start)
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 1, steps: int = 5, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k greatest eigenvalues of a positive semi-definite
    product on d dimensions, falling. All residuals end at rounding: below
    4 eps sqrt(d) of the greatest value, or where they no longer fall and are
    below 1e-12 of it; else NotConverged."""
    k = min(k, d)
    kept = min(d, 2 * k + 2)  # vectors that a restart keeps
    most = min(d, 6 * k + 2)
    q = _orthonormal(np.random.default_rng(seed).normal(size=(d, kept)), np.zeros((d, 0)))
    w = product(q)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    best, idle = np.inf, 0
    for _ in range(rounds):
        h = q.T @ w
        theta, y = np.linalg.eigh((h + h.T) / 2)
        y, theta = y[:, ::-1], theta[::-1]
        q, w = q @ y, w @ y
        top = max([*values, *theta[:1], 0.0])
        want = k - int((values >= theta[0]).sum()) if len(theta) else 0
        want = min(max(want, 0), len(theta))
        r = w[:, :want] - q[:, :want] * theta[:want]
        r -= locked @ (locked.T @ r)
        size = np.sqrt((r * r).sum(0))
        done = size <= 4 * EPS * np.sqrt(d) * top
        worst = size.max(initial=0.0)
        best, idle = (worst, 0) if worst < best / 2 else (best, idle + 1)
        if idle >= 4:
            done |= size <= 1e-12 * top
        if done.any():
            at = np.flatnonzero(done)
            locked, values = np.hstack([locked, q[:, at]]), np.concatenate([values, theta[at]])
            stay = np.setdiff1d(np.arange(q.shape[1]), at)
            q, w, theta, r = q[:, stay], w[:, stay], theta[stay], r[:, ~done]
            best, idle = np.inf, 0
        left = r.shape[1]
        # Done if no pair is wanted and nothing left in the subspace is above the least of those taken.
        if not left and (len(values) >= k or q.shape[1] == 0) and (not len(theta) or not len(values) or theta[0] <= np.sort(values)[::-1][min(k, len(values)) - 1]):
            order = np.argsort(-values)[:k]
            return values[order], locked[:, order]
        if not left:
            continue
        if q.shape[1] + left > most - locked.shape[1]:
            q, w, theta = q[:, :kept], w[:, :kept], theta[:kept]
        z = np.hstack([locked, q[:, :kept]])
        shift = theta[:left]
        off = lambda v: v - z @ (z.T @ v)  # noqa: B023, E731
        t = minres(lambda v: off(product(off(v)) - shift * off(v)), -off(r), steps, 1e-3)  # noqa: B023
        new = _orthonormal(off(t), np.hstack([locked, q]))
        if new.shape[1]:
            q, w = np.hstack([q, new]), np.hstack([w, product(new)])
    raise NotConverged(f"{len(values)} of {k} components after {rounds} rounds")


# ---- vectors in the shared folder -----------------------------------------------------------


def quantise(c: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as 64-bit integers."""
    x = np.floor(1024 * c.astype(float))
    if (np.abs(x) >= 2.0**62).any():
        raise ValueError("an entry is too large for a long")
    return x.astype(np.int64) + 100_000


@dataclass(frozen=True)
class Blocks:
    """Vectors as blocks of rows (ids, x little-endian integers, m rows), their number, dimension and exact sums."""

    rows: DataFrame
    n: int
    d: int
    sums: tuple[int, ...]

    def centred(self) -> Callable[[bytes, int], np.ndarray]:
        """Rows of x - S / n: the whole part of the mean is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        d = self.d
        return lambda data, m: (np.frombuffer(data, "<i4" if len(data) == 4 * m * d else "<i8").reshape(m, d) - whole) - rest

    def fold(self, job: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of job(centred rows), an array of `shape`: each task
        adds up its own blocks, Spark adds up the tasks' numbers by their places."""
        centred = self.centred()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, any_rows = np.zeros(shape), False
            for b in batches:
                for data, m in zip(b.column(0), b.column(1).to_pylist()):
                    total, any_rows = total + job(centred(data.as_buffer(), m)), True
            if any_rows:
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

        parts = self.rows.select("x", "m").mapInArrow(run, "part array<double>")
        out = np.zeros(int(np.prod(shape)))
        for r in parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out.reshape(shape)

    def covariance_times(self, u: np.ndarray) -> np.ndarray:
        """The covariance (divisor n) times the columns of u."""
        return self.fold(lambda c: c.T @ (c @ u), u.shape) / self.n


def valid(vectors: DataFrame, vec_col: str, dims: int | None = None) -> DataFrame:
    """Rows whose vector is there, holds no null and no NaN or infinity, and has `dims`
    entries; where dims is None the most frequent number, the greater one on ties."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(fine)
    if dims is None:
        found = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dims = found["d"] if found else 0
    return rows.where(F.size(v) == dims)


def blocks(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int | None = None) -> Blocks:
    """Valid vectors, quantised, in the shared folder."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = quantise(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1)
            step = max(1, BLOCK // max(1, x.shape[1]))
            for i in range(0, b.num_rows, step):
                part = x[i : i + step]
                small = part.size == 0 or np.abs(part).max() < 2**31
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), b.column(0).slice(i, step)), pa.array([part.astype("<i4" if small else "<i8").tobytes()], pa.binary()), pa.array([len(part)], pa.int32()), pa.array([part.sum(0).tolist()], pa.list_(pa.int64()))],
                    names=["ids", "x", "m", "sums"],
                )

    rows = valid(vectors, vec_col, dims).select(id_col, F.col(vec_col).cast("array<double>").alias("v"))
    found = table(rows.mapInArrow(run, f"ids array<{kind}>, x binary, m int, sums array<long>"), "vectors")
    n = found.agg(F.sum("m")).first()[0] or 0
    sums = found.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    return Blocks(found, n, len(sums), tuple(int(r["s"]) for r in sums))


# ---- whitening ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """Mean (exact sums over n), unit eigenvectors as columns, their eigenvalues falling, the covariance's trace."""

    sums: tuple[int, ...]
    n: int
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def map(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def transform(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(id, whitened array<double>) of the valid rows of any vectors of the fitted dimension."""
        made = blocks(vectors, id_col, vec_col, len(self.sums))
        scale = self.map
        centred = Blocks(made.rows, self.n, len(self.sums), self.sums).centred() if self.n else None

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, data, m in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                    y = centred(data.as_buffer(), m) @ scale
                    yield pa.RecordBatch.from_arrays([ids.values, pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))], names=[id_col, "whitened"])

        return made.rows.select("ids", "x", "m").mapInArrow(run, f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, whitened array<double>")


def fit(made: Blocks, k: int, seed: int = 1, steps: int = 5) -> Whitening:
    """The k leading components; those without variance (below d eps of the trace) are left out."""
    if not made.n:
        return Whitening((), 0, np.zeros((0, 0)), np.zeros(0), 0.0)
    trace = float(made.fold(lambda c: np.array((c * c).sum()), ())) / made.n
    if not trace:
        return Whitening(made.sums, made.n, np.zeros((made.d, 0)), np.zeros(0), 0.0)
    values, vectors = jacobi_davidson(made.covariance_times, made.d, k, seed, steps)
    there = values > made.d * EPS * trace
    return Whitening(made.sums, made.n, vectors[:, there], values[there], trace)


def identity_error(made: Blocks, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, 0 without any."""
    scale, k = model.map, len(model.values)
    if not k or not made.n:
        return 0.0
    mean = made.fold(lambda c: (c @ scale).sum(0), (k,)) / made.n
    cov = made.fold(lambda c: (y := c @ scale - mean).T @ y, (k, k)) / made.n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """(id, component int, n long, deviation decimal(38,0), whitened double, explained
    double, identity_error double) of every valid row and component up to k.

    Rows whose vector is null, or holds a null, NaN or infinity, are left out, and so
    are those of another length than `dims` (where that is None, than the most
    frequent length). Repeated rows and null ids take part like others; other columns
    are ignored. Components beyond the vectors' rank have no rows; without any
    variance, or for an empty table, the result is empty. Equal eigenvalues share
    their space in one of its bases. An entry of 2^62 / 1024 or more in size is an error.
    """
    made = blocks(vectors, id_col, vec_col, dims)
    model = fit(made, k)
    error = identity_error(made, model)
    scale, explained, n, d = model.map, model.values / (model.trace or 1.0), made.n, made.d
    found = len(model.values)
    if not found:
        return made.rows.where("false").select(F.explode("ids").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    centred = made.centred()
    whole, rest = [s // n for s in made.sums], [s % n for s in made.sums]

    def deviations(x: np.ndarray) -> pa.Array:
        """sum over dimensions of (n x - S)^2, exact."""
        off = x.astype(np.int64) - np.array(whole, np.int64)
        high = (int(np.abs(off).max(initial=0)) + 1) * n
        if d * high * high < 2**63:
            return pa.array(((off * n - np.array(rest, np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
        exact = off.astype(object) * n - np.array(rest, object)
        return pa.array([Decimal(int(v)) for v in (exact * exact).sum(1)], pa.decimal128(38, 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data, m in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                buffer = data.as_buffer()
                y = centred(buffer, m) @ scale
                far = deviations(np.frombuffer(buffer, "<i4" if len(buffer) == 4 * m * d else "<i8").reshape(m, d))
                at = pa.array(np.repeat(np.arange(m), found))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(at), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), m)), pa.array(np.full(m * found, n)), far.take(at), pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * found, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return made.rows.select("ids", "x", "m").mapInArrow(run, f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
