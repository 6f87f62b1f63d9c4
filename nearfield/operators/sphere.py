"""Codes of points on integer spheres, and sign-and-magnitude codes of one to nine bits an element.

Sphere codec: each of m sub-vectors is its length, in steps of a trained range, and the nearest integer point whose
squares sum to r2. Points are numbered by shape (the sorted absolute values), arrangement and signs.
Zero vectors decode to zero length. Codes are longs: a sphere of 2**63 points or more is refused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import factorial, isqrt, prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.additive import _through


def shapes(d: int, r2: int) -> list[tuple[int, ...]]:
    """All falling sequences of d integers >= 0 whose squares sum to r2."""

    def grow(left: int, places: int, top: int) -> Iterator[tuple[int, ...]]:
        if places == 0:
            if left == 0:
                yield ()
            return
        for v in range(min(top, isqrt(left)), -1, -1):
            if v * v * places < left:
                return
            for rest in grow(left - v * v, places - 1, v):
                yield (v, *rest)

    return list(grow(r2, d, isqrt(r2)))


def _ways(counts: Counter) -> int:
    return factorial(sum(counts.values())) // prod(factorial(n) for n in counts.values())


def rank(values: list[int]) -> int:
    """The place of an arrangement among all of the same values, smallest first."""
    counts, out = Counter(values), 0
    for v in values:
        for u in sorted(counts):
            if u >= v:
                break
            counts[u] -= 1
            out += _ways(counts)
            counts[u] += 1
        counts[v] -= 1
        counts += Counter()
    return out


def unrank(shape: tuple[int, ...], place: int) -> list[int]:
    counts, out = Counter(shape), []
    while len(out) < len(shape):
        for v in sorted(counts):
            counts[v] -= 1
            n = _ways(counts)
            if place < n:
                out.append(v)
                counts += Counter()
                break
            place -= n
            counts[v] += 1
    return out


@dataclass(frozen=True)
class SphereCodec:
    d: int
    m: int
    r2: int
    bits: int
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if self.d % self.m:
            raise ValueError("m must divide the dimension")
        if not self._shapes or self._starts[-1] >= 1 << 63:
            raise ValueError("no such points, or too many for a code of 63 bits")

    @cached_property
    def _shapes(self) -> list[tuple[int, ...]]:
        return shapes(self.d // self.m, self.r2)

    @cached_property
    def _starts(self) -> list[int]:
        out = [0]
        for s in self._shapes:
            out.append(out[-1] + _ways(Counter(s)) * (1 << sum(v > 0 for v in s)))
        return out

    @classmethod
    def fit(cls, rows: DataFrame, d: int, m: int, r2: int, bits: int = 8) -> SphereCodec:
        """The range of lengths of each sub-vector."""
        s = d // m
        norm = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.sqrt(F.aggregate(F.slice("vec", i * s + 1, F.lit(s)), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
        got = rows.where("vec is not null").select(F.posexplode(norm).alias("part", "n")).groupBy("part").agg(F.min("n").alias("a"), F.max("n").alias("b")).orderBy("part").collect()  # m rows
        return cls(d, m, r2, bits, tuple(r["a"] for r in got), tuple(r["b"] for r in got))

    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        low = np.array(self.low)
        return low, np.maximum(np.array(self.high) - low, 1e-30) / ((1 << self.bits) - 1)

    def nearest(self, y: np.ndarray) -> np.ndarray:
        """The integer points nearest in direction to the rows of y; ties go to the first shape and first places."""
        order = np.argsort(-np.abs(y), 1, kind="stable")
        atoms = np.array(self._shapes)
        best = atoms[(np.take_along_axis(np.abs(y), order, 1) @ atoms.T).argmax(1)]
        out = np.zeros(y.shape, np.int64)
        np.put_along_axis(out, order, best, 1)
        return np.where(y < 0, -out, out)

    def number(self, point: list[int]) -> int:
        size = [abs(v) for v in point]
        shape = tuple(sorted(size, reverse=True))
        signs = [v < 0 for v in point if v]
        return self._starts[self._shapes.index(shape)] + (rank(size) << len(signs)) + sum(s << i for i, s in enumerate(signs))

    def point(self, number: int) -> list[int]:
        at = int(np.searchsorted(np.array(self._starts, dtype=object), number, "right")) - 1
        shape, rest = self._shapes[at], number - self._starts[at]
        n = sum(v > 0 for v in shape)
        out, i = unrank(shape, rest >> n), 0
        for j, v in enumerate(out):
            if v:
                out[j], i = (-v if rest >> i & 1 else v), i + 1
        return out

    def encode_matrix(self, x: np.ndarray) -> np.ndarray:
        y = x.reshape(len(x), self.m, -1)
        low, step = self._steps()
        length = np.clip(np.rint((np.sqrt((y**2).sum(2)) - low) / step), 0, (1 << self.bits) - 1).astype(np.int64)
        points = self.nearest(y.reshape(len(x) * self.m, -1))
        numbers = np.array([self.number(p) for p in points.tolist()], np.int64).reshape(len(x), self.m)
        return np.stack((length, numbers), 2).reshape(len(x), -1)

    def decode_matrix(self, codes: np.ndarray) -> np.ndarray:
        c = codes.reshape(len(codes), self.m, 2)
        low, step = self._steps()
        points = np.array([[self.point(int(v)) for v in row] for row in c[:, :, 1]], np.float64).reshape(len(c), self.m, -1)
        return (points / self.r2**0.5 * (low + c[:, :, 0] * step)[:, :, None]).reshape(len(c), -1)

    def encode(self, rows: DataFrame) -> DataFrame:
        """id, code: per sub-vector the step of its length and the number of its point."""
        return _through(rows.where("vec is not null").select("id", "vec"), "vec", "code", "long", self.encode_matrix)

    def decode(self, rows: DataFrame) -> DataFrame:
        """id, vec of rows (id, code)."""
        return _through(rows.select("id", "code"), "code", "vec", "double", self.decode_matrix, whole=True)


@dataclass(frozen=True)
class SignMagnitude:
    """Signs and magnitudes of the residual from a centre in bits bits an element; one bit keeps signs alone. Magnitudes
    are cut at the scale with the largest cosine to the residual, found by sweeping every scale at which one changes."""

    center: tuple[float, ...]
    bits: int = 1

    def encode_matrix(self, x: np.ndarray) -> np.ndarray:
        """Per row: the codes (sign in the top bit), then the factor that gives the residual back."""
        r = x - np.array(self.center)
        size, top = np.abs(r), (1 << (self.bits - 1)) - 1
        mag = np.zeros(r.shape, np.int64)
        if top:
            for row, o in enumerate(size):
                mag[row] = _magnitudes(o, top)
        dot = ((mag + 0.5) * size).sum(1)
        factor = np.divide((r * r).sum(1), dot, out=np.zeros(len(r)), where=dot > 0)
        return np.hstack(((mag + (r > 0) * (top + 1)).astype(np.float64), factor[:, None]))

    def decode_matrix(self, coded: np.ndarray) -> np.ndarray:
        half = 1 << (self.bits - 1)
        code, factor = coded[:, :-1].astype(np.int64), coded[:, -1:]
        return np.where(code >= half, 1, -1) * (code % half + 0.5) * factor + np.array(self.center)

    def encode(self, rows: DataFrame) -> DataFrame:
        """id, code (array<double>: codes, factor)."""
        return _through(rows.where("vec is not null").select("id", "vec"), "vec", "code", "double", self.encode_matrix)

    def decode(self, rows: DataFrame) -> DataFrame:
        return _through(rows.select("id", "code"), "code", "vec", "double", self.decode_matrix)

    def search(self, queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        from nearfield.operators.search import knn_join

        return knn_join(queries, self.decode(rows), k, metric)


def _magnitudes(o: np.ndarray, top: int) -> np.ndarray:
    """The magnitudes at the best scale: an element reaches j at scale j / o."""
    some = np.flatnonzero(o > 0)
    if not len(some):
        return np.zeros(len(o), np.int64)
    j = np.arange(1, top + 1)
    at = (j[None] / o[some, None]).ravel()
    order = np.argsort(at, kind="stable")
    who = np.repeat(some, top)[order]
    dots = 0.5 * o.sum() + np.concatenate(([0.0], np.cumsum(o[who])))
    squares = 0.25 * len(o) + np.concatenate(([0.0], np.cumsum(2.0 * np.tile(j, len(some))[order])))
    best = int((dots / np.sqrt(squares)).argmax())
    return np.bincount(who[:best], minlength=len(o))
