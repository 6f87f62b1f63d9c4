"""Vector transforms: fit on a table, apply and reverse as column expressions or matrix products.

Matrices (d x d) are small and travel with the plan; sums over rows are grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import minus, normalized, plus, remapped
from nearfield.operators.search import _matrix


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, gram = 0, None, None
    for batch in batches:
        x = _matrix(batch.column("vec"))
        if len(x):
            n += len(x)
            total = x.sum(0) if total is None else total + x.sum(0)
            gram = x.T @ x if gram is None else gram + x.T @ x
    if n:
        d = len(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d + 1), pa.int32()), pa.array([n] * (d + 1), pa.int64()), pa.array([total.tolist(), *gram.tolist()], pa.list_(pa.float64()))], names=["row", "n", "x"]
        )


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance: partial sums per task, summed by matrix row; d + 1 rows reach the driver."""
    parts = rows.where("vec is not null").select("vec").mapInArrow(_moment_rows, "row int, n long, x array<double>")
    sums = parts.select("row", "n", F.posexplode("x").alias("col", "x")).groupBy("row", "col").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    got = sums.orderBy("row", "col").toPandas()
    if got.empty:
        raise ValueError("no vectors to fit on")
    d, n = int(got["col"].max()) + 1, int(got["n"].iloc[0])
    m = got["x"].to_numpy().reshape(d + 1, d)
    mean = m[0] / n
    return n, mean, m[1:] / n - np.outer(mean, mean)


@dataclass
class Linear:
    """y = A x + b; reversible when A has orthonormal rows."""

    a: np.ndarray
    b: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.b = np.zeros(len(self.a)) if self.b is None else self.b

    @property
    def orthonormal(self) -> bool:
        return bool(np.allclose(self.a @ self.a.T, np.eye(len(self.a)), atol=1e-5))

    def apply(self, rows: DataFrame) -> DataFrame:
        return _mapped(rows, self.a, self.b)

    def reverse(self, rows: DataFrame) -> DataFrame:
        if not self.orthonormal:
            raise ValueError("only an orthonormal transform can be reversed")
        return _mapped(rows, self.a.T, -self.a.T @ self.b)


def _mapped(rows: DataFrame, a: np.ndarray, b: np.ndarray) -> DataFrame:
    kept = [c for c in rows.columns if c != "vec"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column("vec")) @ a.T + b
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(a), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, "vec"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vec"), "vec array<double>"])
    return rows.where("vec is not null").select(*kept, "vec").mapInArrow(multiply, kinds)


def random_rotation(d_in: int, d_out: int, seed: int = 1234) -> Linear:
    """Orthonormal by QR of a seeded normal matrix."""
    n = max(d_in, d_out)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return Linear((q * np.sign(np.diag(r)))[:d_out, :d_in])


def pca(rows: DataFrame, d_out: int, whiten: float = 0.0, rotate: int | None = None, bins: int = 0) -> Linear:
    """Principal axes, largest first (with bins: dealt so that each bin of axes holds as much variance); each axis's largest
    element is positive. whiten: power of the eigenvalues."""
    _, mean, cov = moments(rows)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:d_out]
    if bins:
        order = order[balanced_axes(values[order], bins)]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    if whiten:
        axes = axes * (np.maximum(values[order], 1e-12) ** whiten)[:, None]
    if rotate is not None:
        axes = random_rotation(d_out, d_out, rotate).a @ axes
    return Linear(axes, -axes @ mean)


def _walsh(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of rows whose length is a power of two; its own inverse."""
    n, p = x.shape
    h = 1
    while h < p:
        y = x.reshape(n, p // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, p)
        h *= 2
    return x / np.sqrt(p)


@dataclass(frozen=True)
class Hadamard:
    """Three rounds of sign flips and Walsh-Hadamard transforms over vectors padded to a power of two."""

    d: int
    seed: int = 12345

    def _signs(self) -> np.ndarray:
        return np.random.default_rng(self.seed).choice([-1.0, 1.0], (3, 1 << max(0, (self.d - 1).bit_length())))

    def forward(self, x: np.ndarray) -> np.ndarray:
        signs = self._signs()
        x = np.pad(x, ((0, 0), (0, signs.shape[1] - x.shape[1])))
        for s in signs:
            x = _walsh(x * s)
        return x

    def backward(self, y: np.ndarray) -> np.ndarray:
        for s in self._signs()[::-1]:
            y = _walsh(y) * s
        return y[:, : self.d]

    def apply(self, rows: DataFrame) -> DataFrame:
        return _through_matrix(rows, self.forward)

    def reverse(self, rows: DataFrame) -> DataFrame:
        return _through_matrix(rows, self.backward)


def _through_matrix(rows: DataFrame, f) -> DataFrame:
    kept = [c for c in rows.columns if c != "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = f(_matrix(batch.column("vec")))
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, "vec"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vec"), "vec array<double>"])
    return rows.where("vec is not null").select(*kept, "vec").mapInArrow(run, kinds)


def reflection(normals: np.ndarray) -> np.ndarray:
    """The matrix that reflects at the hyperplanes with these normals, one after the other."""
    out = np.eye(normals.shape[1])
    for v in normals:
        v = v / np.linalg.norm(v)
        out = out - 2.0 * np.outer(v, v @ out)
    return out


def balanced_axes(values: np.ndarray, bins: int) -> np.ndarray:
    """An order of axes in which cuts into equal bins have variances of nearly equal product: the largest axes go, one by
    one, to the bin with room whose sum of logarithms is least."""
    room, load = np.full(bins, len(values) // bins), np.zeros(bins)
    if len(values) % bins:
        raise ValueError("bins must divide the number of axes")
    held: list[list[int]] = [[] for _ in range(bins)]
    logs = np.log(np.maximum(values, 1e-30))
    logs = logs - logs.min()
    for i in np.argsort(-values, kind="stable").tolist():
        b = min((j for j in range(bins) if room[j]), key=lambda j: (load[j], j))
        held[b].append(i)
        room[b] -= 1
        load[b] += logs[i]
    return np.array([i for h in held for i in h])


@dataclass(frozen=True)
class Normalize:
    """To length 1; the reverse is the identity."""

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("vec", normalized(F.col("vec")))

    def reverse(self, rows: DataFrame) -> DataFrame:
        return rows


@dataclass(frozen=True)
class Center:
    mean: tuple[float, ...]

    @classmethod
    def fit(cls, rows: DataFrame) -> Center:
        from nearfield.operators.stats import per_dimension

        got = per_dimension(rows).orderBy("dim").collect()  # d rows
        return cls(tuple(r["mean"] for r in got))

    def _mean(self):
        return F.array(*map(F.lit, self.mean))

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("vec", minus(F.col("vec"), self._mean()))

    def reverse(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("vec", plus(F.col("vec"), self._mean()))


@dataclass(frozen=True)
class Remap:
    """Output i is input sources[i], 0 for -1."""

    sources: tuple[int, ...]
    d_in: int

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("vec", remapped(F.col("vec"), list(self.sources)))

    def reverse(self, rows: DataFrame) -> DataFrame:
        back = [self.sources.index(i) if i in self.sources else -1 for i in range(self.d_in)]
        return rows.withColumn("vec", remapped(F.col("vec"), back))


def pad(d_in: int, d_out: int) -> Remap:
    return Remap(tuple(i if i < d_in else -1 for i in range(d_out)), d_in)


@dataclass(frozen=True)
class Chain:
    steps: tuple

    def apply(self, rows: DataFrame) -> DataFrame:
        for s in self.steps:
            rows = s.apply(rows)
        return rows

    def reverse(self, rows: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            rows = s.reverse(rows)
        return rows
