"""Scalar and product quantizers, sign hashes: train, encode, decode, search on codes.

Models are small (ranges, codebooks) and travel with the plan. Scalar codes are column expressions; product codes are
made, decoded and scored by matrix products and look-ups over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.metrics import descending
from nearfield.functions.vectors import bits, words
from nearfield.operators.search import _matrix, _query_blocks, best_of, ranked, searched
from nearfield.operators.stats import medians, per_dimension


def _array(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


@dataclass(frozen=True)
class ScalarQuantizer:
    """Each dimension in [low, low + width] to bits-bit integers; codes decode to the middle of their step."""

    low: tuple[float, ...]
    width: tuple[float, ...]
    bits: int = 8

    @classmethod
    def fit(cls, rows: DataFrame, bits: int = 8, uniform: bool = False, spread: float | None = None, quantile: float | None = None, optimal: bool = False) -> ScalarQuantizer:
        """Range per dimension, or one for all (uniform): min and max, or mean -+ spread standard deviations, or from the
        quantile to one less it (of a sketch that is exact to a ten-thousandth), or with the least squared error on a bounded
        sample (optimal)."""
        if quantile is not None or optimal:
            return cls._fit_shape(rows, bits, uniform, quantile)
        got = per_dimension(rows).orderBy("dim").collect()  # a row per dimension
        if uniform:
            n, mean = sum(r["n"] for r in got), sum(r["n"] * r["mean"] for r in got) / max(1, sum(r["n"] for r in got))
            std = (sum(r["n"] * (r["std"] ** 2 + r["mean"] ** 2) for r in got) / n - mean**2) ** 0.5
            got = [{"min": min(r["min"] for r in got), "max": max(r["max"] for r in got), "mean": mean, "std": std}] * len(got)
        if spread is not None:
            edges = [(r["mean"] - spread * r["std"], r["mean"] + spread * r["std"]) for r in got]
        else:
            edges = [(r["min"], r["max"]) for r in got]
        return cls(tuple(a for a, _ in edges), tuple(b - a for a, b in edges), bits)

    @classmethod
    def _fit_shape(cls, rows: DataFrame, bits: int, uniform: bool, quantile: float | None) -> ScalarQuantizer:
        if quantile is not None:
            x = rows.select(F.posexplode("vec").alias("dim", "x"))
            by = x.groupBy(F.lit(0).alias("dim")) if uniform else x.groupBy("dim")
            got = by.agg(F.percentile_approx(F.col("x").cast("double"), [quantile, 1 - quantile], 10_000).alias("e")).orderBy("dim").collect()  # a row per dimension
            edges = [tuple(r["e"]) for r in got]
            if uniform:
                edges *= rows.agg(F.max(F.size("vec"))).first()[0]
        else:
            from nearfield.operators.additive import sample_matrix

            x = sample_matrix(rows)
            edges = [optimal_range(x.ravel(), bits)] * x.shape[1] if uniform else [optimal_range(v, bits) for v in x.T]
        return cls(tuple(float(a) for a, _ in edges), tuple(float(b - a) for a, b in edges), bits)

    def encode_matrix(self, x: np.ndarray) -> np.ndarray:
        width = np.array(self.width)
        part = np.divide(x - np.array(self.low), width, out=np.zeros_like(x), where=width != 0)
        return np.floor(np.clip(part, 0.0, 1.0) * ((1 << self.bits) - 1)).astype(np.int64)

    def decode_matrix(self, codes: np.ndarray) -> np.ndarray:
        return (codes + 0.5) / float((1 << self.bits) - 1) * np.array(self.width) + np.array(self.low)

    def encode(self, vec: Column) -> Column:
        top = (1 << self.bits) - 1
        scaled = F.zip_with(F.zip_with(vec, _array(self.low), lambda x, a: x.cast("double") - a), _array(self.width), lambda x, w: F.when(w == 0, F.lit(0.0)).otherwise(x / F.when(w != 0, w)))
        return F.transform(scaled, lambda x: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * top).cast("int"))

    def decode(self, code: Column) -> Column:
        top = float((1 << self.bits) - 1)
        return F.zip_with(F.zip_with(code, _array(self.width), lambda c, w: (c + 0.5) / top * w), _array(self.low), lambda x, a: x + a)

    def search(self, queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        """Exact queries against decoded rows (id, code)."""
        from nearfield.operators.search import knn_join

        return knn_join(queries, rows.select("id", self.decode(F.col("code")).alias("vec")), k, metric)

    def encoded(self, rows: DataFrame) -> DataFrame:
        """id, code of rows (id, vec)."""
        return rows.where("vec is not null").select("id", self.encode(F.col("vec")).alias("code"))

    def decoded(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", self.decode(F.col("code")).alias("vec"))


def optimal_range(values: np.ndarray, bits: int, steps: int = 20) -> tuple[float, float]:
    """The range whose codes lose least of values: fit steps to their codes by least squares, in turn."""
    a, b, top = float(values.min()), float(values.max()), (1 << bits) - 1
    for _ in range(steps):
        if b <= a:
            break
        code = np.floor(np.clip((values - a) / (b - a), 0.0, 1.0) * top) + 0.5
        var = code.var()
        if var == 0:
            break
        step = ((code - code.mean()) * (values - values.mean())).mean() / var
        a2, b2 = values.mean() - step * code.mean(), values.mean() + step * (top - code.mean())
        if abs(a2 - a) + abs(b2 - b) < 1e-9 * (abs(a) + abs(b) + 1e-30):
            break
        a, b = a2, b2
    return a, b


def half_matrix(x: np.ndarray, kind: str = "fp16") -> np.ndarray:
    if kind == "fp16":
        return x.astype(np.float32).astype(np.float16).astype(np.float64)
    u = x.astype(np.float32).view(np.uint32).astype(np.uint64)
    u = (u + 0x7FFF + ((u >> 16) & 1)) & 0xFFFF0000
    return u.astype(np.uint32).view(np.float32).astype(np.float64)


def half(vec: Column, kind: str = "fp16") -> Column:
    """Elements rounded to fp16 or bf16 and back."""

    @F.pandas_udf("array<double>")
    def rounded(v):
        return v.map(lambda x: half_matrix(np.asarray(x), kind))

    return rounded(vec)


@dataclass(frozen=True)
class ProductQuantizer:
    """codebook[m][c] is centroid c of sub-space m; codes are arrays of m small integers."""

    codebook: np.ndarray

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.codebook.shape

    @classmethod
    def from_rows(cls, rows: DataFrame, m: int, k: int) -> ProductQuantizer:
        """The sub-vectors of the k rows with the smallest ids: a fixed codebook."""
        got = rows.orderBy("id").limit(k).toPandas()
        x = np.array(got["vec"].tolist(), np.float64)
        return cls(np.stack([x[:, i * (x.shape[1] // m) : (i + 1) * (x.shape[1] // m)] for i in range(m)]))

    @classmethod
    def fit(cls, rows: DataFrame, m: int, nbits: int = 8, iterations: int = 10, most: int = 65_536, seed: int = 1234) -> ProductQuantizer:
        """k-means per sub-space on a bounded sample (most rows, those with the smallest seeded hash of the id)."""
        got = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most).toPandas()
        x, rng = np.array(got["vec"].tolist(), np.float64), np.random.default_rng(seed)
        d, k = x.shape[1] // m, 1 << nbits
        if len(x) < k:
            raise ValueError("fewer rows than centroids")
        books = []
        for i in range(m):
            part = x[:, i * d : (i + 1) * d]
            c = part[rng.choice(len(part), k, replace=False)].copy()
            for _ in range(iterations):
                near = _nearest(part, c)
                sums = np.zeros_like(c)
                np.add.at(sums, near, part)
                sizes = np.bincount(near, minlength=k)
                c[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
            books.append(c)
        return cls(np.stack(books))

    def cells(self, x: np.ndarray, metric: str = "l2") -> np.ndarray:
        """(n, m, k): scores of each sub-vector with each centroid of its book."""
        parts = x.reshape(len(x), len(self.codebook), -1)
        dots = np.einsum("nmd,mkd->nmk", parts, self.codebook)
        if descending(metric):
            return dots
        if x.size * self.codebook.shape[1] < 4_000_000:
            return ((parts[:, :, None] - self.codebook[None]) ** 2).sum(3)
        return (parts**2).sum(2)[:, :, None] - 2 * dots + (self.codebook**2).sum(2)[None]

    def encode_matrix(self, x: np.ndarray) -> np.ndarray:
        """Nearest centroid of each sub-vector, the smallest number of equals."""
        return np.stack([best_of(part, book) for part, book in zip(np.split(x, len(self.codebook), 1), self.codebook, strict=True)], 1)

    def decode_matrix(self, codes: np.ndarray) -> np.ndarray:
        return self.codebook[np.arange(len(self.codebook))[None], codes.astype(np.int64)].reshape(len(codes), -1)

    def encode(self, rows: DataFrame) -> DataFrame:
        """id, code of rows (id, vec)."""
        return appended(rows.where("vec is not null").select("id", "vec"), "vec", "code", "int", self.encode_matrix).drop("vec")

    def decode(self, rows: DataFrame) -> DataFrame:
        """id, vec of rows (id, code)."""
        return appended(rows.select("id", "code"), "code", "vec", "double", self.decode_matrix).drop("code")

    def search(self, queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        """ADC: each query's table of scores is made once and sent, in blocks; a task looks up its rows (id, code) in it."""
        rows = rows.where("code is not null").select(F.col("id").cast("long").alias("id"), "code")
        parts = []
        for qid, q in _query_blocks(queries, self.codebook.shape[0] * self.codebook.shape[1]):
            shared = rows.sparkSession.sparkContext.broadcast((qid, self.cells(q, metric)))
            parts.append(searched(rows, shared, _looked_up, metric, k))
        if not parts:
            return rows.sparkSession.createDataFrame([], "qid long, rank int, id long, dist double")
        return ranked(reduce(DataFrame.unionByName, parts), k, metric).select("qid", "rank", "id", "dist")

    def symmetric(self, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """SDC: both sides are codes."""
        return self.search(self.decode(queries), rows, k)

    def hamming_histogram(self, codes_a: DataFrame, codes_b: DataFrame) -> DataFrame:
        """bits, n: pairs of a stated set of codes (id, code) and all others, by their differing bits."""
        pairs = codes_b.crossJoin(F.broadcast(codes_a.select(F.col("code").alias("own"))))  # a stated set
        count = F.aggregate(F.zip_with("own", "code", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return pairs.select(count.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))


def _looked_up(shared, batch: pa.RecordBatch, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sums of table entries at the codes."""
    tables = shared[1]
    if not batch.num_rows:
        return
    codes = _matrix(batch.column("code")).astype(np.int64)
    books = np.arange(codes.shape[1])
    for i, table in enumerate(tables):
        s = table[books, codes].sum(1)
        at = keep(s)
        yield i, at, s[at]


def lists_of(flat: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) // max(1, width) + 1) * width, pa.int32()), pa.array(flat))


_NUMPY = {"int": np.int32, "long": np.int64, "double": np.float64}


def appended(rows: DataFrame, source: str, out: str, kind: str, f, whole: bool = False) -> DataFrame:
    """rows with a further list column f(matrix of source), a few hundred rows at a time. whole: f takes longs that doubles
    can't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                y = f(np.array(part.column(source).to_pylist(), np.int64) if whole else _matrix(part.column(source)))
                y = y.reshape(len(y), -1).astype(_NUMPY[kind])
                yield pa.RecordBatch.from_arrays([*part.columns, lists_of(y.ravel(), y.shape[1])], names=[*part.schema.names, out])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` array<{'bigint' if kind == 'long' else kind}>"])
    return rows.mapInArrow(run, kinds)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return best_of(x, c)


@dataclass(frozen=True)
class SignHash:
    """LSH: sign bits of the first n elements (or of a rotation applied before), minus trained medians if asked."""

    n: int
    thresholds: tuple[float, ...] | None = None

    @classmethod
    def fit(cls, rows: DataFrame, n: int) -> SignHash:
        got = medians(rows.where("vec is not null").select(F.lit(0).alias("part"), F.slice("vec", 1, n).alias("vec")), "part").orderBy("dim").collect()  # n rows
        return cls(n, tuple(r["median"] for r in got))

    def encode(self, rows: DataFrame) -> DataFrame:
        v = F.transform(F.slice("vec", 1, self.n), lambda x: x.cast("double"))
        if self.thresholds is not None:
            v = F.zip_with(v, _array(self.thresholds), lambda x, t: x - t)
        return rows.where("vec is not null").select("id", words(bits(v), self.n).alias("words"))


def _fp16(x: Column) -> Column:
    """A number of fp16's normal range rounded to its eleven bits."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-14)) - 10)
    return F.when(size > 0, F.rint(x / step) * step).otherwise(F.lit(0.0))


def row_scaled(vec: Column, bits_: int = 8, fp16: bool = False) -> Column:
    """Row-wise min-max: struct(low, width, code) of one vector; with fp16 low and width are of that precision."""
    low, high = F.array_min(vec).cast("double"), F.array_max(vec).cast("double")
    if fp16:
        low, width = _fp16(low), _fp16(high - low)
        high = low + width
    top = float((1 << bits_) - 1)
    code = F.transform(vec, lambda x: F.when(high == low, F.lit(0)).otherwise(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x.cast("double") - low) / F.when(high != low, high - low))) * top).cast("int")))
    return F.struct(low.alias("low"), (high - low).alias("width"), code.alias("code"))


def row_unscaled(coded: Column, bits_: int = 8) -> Column:
    top = float((1 << bits_) - 1)
    return F.transform(coded["code"], lambda c: coded["low"] + (c + 0.5) / top * coded["width"])


def rabitq_encode(vec: Column, centroid: list[float]) -> Column:
    """One-bit RaBitQ: struct(code bits, norm2 of the residual, mult)."""
    r = F.zip_with(vec, _array(centroid), lambda x, c: x.cast("double") - c)
    norm2 = F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x)
    l1 = F.aggregate(r, F.lit(0.0), lambda s, x: s + F.abs(x))
    d = float(len(centroid))
    mult = F.when(l1 == 0, F.lit(0.0)).otherwise(norm2 * F.sqrt(F.lit(d)) / F.when(l1 != 0, l1))
    return F.struct(bits(r, strict=True).alias("code"), norm2.alias("norm2"), mult.alias("mult"))


def rabitq_decode(coded: Column, centroid: list[float]) -> Column:
    d = float(len(centroid))
    return F.zip_with(coded["code"], _array(centroid), lambda b, c: (b - 0.5) * coded["mult"] * (2 / d**0.5) + c)


def worst(metric: str) -> float:
    return -np.inf if descending(metric) else np.inf
