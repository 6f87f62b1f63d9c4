"""Metrics as Column expressions and as numpy kernels. All accumulate in double from the vectors' elements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics for which larger is better.
SIMILARITIES = {"ip", "jaccard", "cosine"}
NAMES = ("l2", "ip", "l1", "linf", "lp", "canberra", "braycurtis", "jensenshannon", "jaccard", "nan_l2", "gower", "cosine")


def descending(metric: str) -> bool:
    return metric in SIMILARITIES


def _nan() -> Column:
    return F.lit(float("nan"))


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _ratio(a: Column, b: Column) -> Column:
    """a / b, NaN for a zero divisor."""
    return F.when(b == 0, _nan()).otherwise(a / F.when(b != 0, b))


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def _js(x: Column, y: Column) -> Column:
    m = (x + y) / 2
    ok = (x > 0) & (y > 0)
    return F.when(ok, -x * F.log(F.when(ok, m / x)) - y * F.log(F.when(ok, m / y))).otherwise(_nan())


def _gower(x: Column, y: Column) -> Column:
    d = F.abs(x - y)
    return (
        F.when(F.isnan(x) | F.isnan(y), F.lit(None).cast("double"))
        .when((x >= 0) & (y >= 0), F.when(d > 1, _nan()).otherwise(d))
        .when((x < 0) & (y < 0), (x != y).cast("double"))
        .otherwise(_nan())
    )


def distance(a: Column, b: Column, metric: str = "l2", arg: float = 2.0) -> Column:
    """The metric of two array columns of equal length. L2 and Lp have no root; Jaccard, IP and cosine are similarities."""
    if metric == "l2":
        return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "ip":
        return _sum(_zip(a, b, lambda x, y: x * y))
    if metric == "l1":
        return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))
    if metric == "linf":
        return F.array_max(_zip(a, b, lambda x, y: F.abs(x - y)))
    if metric == "lp":
        return _sum(_zip(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(arg)))))
    if metric == "canberra":
        return _sum(_zip(a, b, lambda x, y: _ratio(F.abs(x - y), F.abs(x) + F.abs(y))))
    if metric == "braycurtis":
        return _ratio(_sum(_zip(a, b, lambda x, y: F.abs(x - y))), _sum(_zip(a, b, lambda x, y: F.abs(x + y))))
    if metric == "jensenshannon":
        return _sum(_zip(a, b, _js)) * 0.5
    if metric == "jaccard":
        return _ratio(_sum(_zip(a, b, F.least)), _sum(_zip(a, b, F.greatest)))
    if metric == "nan_l2":
        terms = F.filter(_zip(a, b, lambda x, y: (x - y) * (x - y)), lambda t: ~F.isnan(t))
        return _ratio(F.size(a) * _sum(terms), F.size(terms).cast("double"))
    if metric == "gower":
        terms = F.filter(_zip(a, b, _gower), lambda t: t.isNotNull())
        return _ratio(_sum(terms), F.size(terms).cast("double"))
    if metric == "hamming":  # of arrays of words
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("long").bitwiseXOR(y.cast("long")))), F.lit(0), lambda s, x: s + x).cast("double")
    if metric == "cosine":
        norms = F.sqrt(distance(a, a, "ip")) * F.sqrt(distance(b, b, "ip"))
        return F.when(norms == 0, F.lit(0.0)).otherwise(distance(a, b, "ip") / F.when(norms != 0, norms))
    raise ValueError(f"unknown metric {metric}")


def block(q: np.ndarray, x: np.ndarray, metric: str, arg: float = 2.0) -> np.ndarray:
    """The metric of one query (d) with rows x (n, d), both double."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            return ((x - q) ** 2).sum(1)
        if metric == "ip":
            return (x * q).sum(1)
        if metric == "l1":
            return np.abs(x - q).sum(1)
        if metric == "linf":
            return np.abs(x - q).max(1)
        if metric == "lp":
            return (np.abs(x - q) ** arg).sum(1)
        if metric == "canberra":
            return (np.abs(x - q) / (np.abs(x) + np.abs(q))).sum(1)
        if metric == "braycurtis":
            return np.abs(x - q).sum(1) / np.abs(x + q).sum(1)
        if metric == "jensenshannon":
            m = (x + q) / 2
            t = np.where((x > 0) & (q > 0), -x * np.log(m / x) - q * np.log(m / q), np.nan)
            return t.sum(1) * 0.5
        if metric == "jaccard":
            return np.minimum(x, q).sum(1) / np.maximum(x, q).sum(1)
        if metric == "nan_l2":
            t = (x - q) ** 2
            return x.shape[1] * np.nansum(t, 1) / np.where(np.isnan(t), 0.0, 1.0).sum(1)
        if metric == "gower":
            d = np.abs(x - q)
            t = np.where((x >= 0) & (q >= 0), np.where(d > 1, np.inf, d), np.where((x < 0) & (q < 0), (x != q) * 1.0, np.inf))
            some = ~(np.isnan(x) | np.isnan(q))
            out = np.where(some, t, 0.0).sum(1) / some.sum(1)
            return np.where(np.isfinite(out), out, np.nan)
        if metric == "hamming":  # words of 32 bits, which doubles hold exactly
            return np.bitwise_count(x.astype(np.int64) ^ q.astype(np.int64)).sum(1).astype(np.float64)
        if metric == "cosine":
            norms = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
            return np.where(norms == 0, 0.0, (x * q).sum(1) / np.where(norms == 0, 1.0, norms))
    raise ValueError(f"unknown metric {metric}")
