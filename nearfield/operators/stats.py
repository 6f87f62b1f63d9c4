"""Statistics and grouping of vector sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import bits, norm2
from nearfield.operators.search import _matrix


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per dimension of what a task holds: counts, range, mean and sum of squared deviations."""
    held = None
    for batch in batches:
        x = _matrix(batch.column("vec"))
        if not len(x):
            continue
        ok = ~np.isnan(x)
        n, y = ok.sum(0), np.where(ok, x, 0.0)
        with np.errstate(invalid="ignore"):
            mean = y.sum(0) / np.maximum(1, n)
            m2 = (np.where(ok, x - mean, 0.0) ** 2).sum(0)
        now = [n, (~ok).sum(0), (x == 0).sum(0), np.isinf(x).sum(0), np.where(ok, x, np.inf).min(0), np.where(ok, x, -np.inf).max(0), mean, m2]
        held = now if held is None else _merged(held, now)
    if held is not None:
        kinds = [pa.int64()] * 4 + [pa.float64()] * 4
        cols = [pa.array(np.arange(len(held[0])), pa.int32()), *(pa.array(v, k) for v, k in zip(held, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(cols, names=["dim", "n", "n_nan", "n_zero", "n_inf", "min", "max", "mean", "m2"])


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    n = np.maximum(1, a[0] + b[0])
    with np.errstate(invalid="ignore"):
        gap = b[6] - a[6]
        return [*(x + y for x, y in zip(a[:4], b[:4], strict=True)), np.minimum(a[4], b[4]), np.maximum(a[5], b[5]), a[6] + gap * b[0] / n, a[7] + b[7] + gap * gap * a[0] * b[0] / n]


def per_dimension(rows: DataFrame) -> DataFrame:
    """dim, n, n_nan, n_zero, n_inf, min, max, mean, std (population) of the elements that are numbers: a row per task and
    dimension is shuffled, not one per element."""
    parts = rows.where("vec is not null").select("vec").mapInArrow(_moment_rows, "dim int, n long, n_nan long, n_zero long, n_inf long, min double, max double, mean double, m2 double")
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))
    spread = F.sum("m2") + F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * mean * mean)
    none = total == 0
    return parts.groupBy("dim").agg(
        total.alias("n"), F.sum("n_nan").alias("n_nan"), F.sum("n_zero").alias("n_zero"), F.sum("n_inf").alias("n_inf"), F.when(~none, F.min("min")).alias("min"), F.when(~none, F.max("max")).alias("max"),
        mean.alias("mean"), F.sqrt(spread / F.nullif(total, F.lit(0))).alias("std"),
    )


def advice(rows: DataFrame) -> list[str]:
    """What a look at the whole set says of it, in words."""
    one, dims = overall(rows).first(), per_dimension(rows).collect()  # a row per dimension
    said = [f"{one['n']} vectors, {one['n_distinct']} distinct"]
    if one["n_zero_vectors"]:
        said.append(f"{one['n_zero_vectors']} vectors of zeros")
    if any(r["n_nan"] or r["n_inf"] for r in dims):
        said.append("elements that are no finite numbers: most searches leave such scores out")
    if one["n"] and one["max_norm2"] is not None and one["max_norm2"] - one["min_norm2"] <= 1e-5 * max(one["max_norm2"], 1e-30):
        said.append("vectors of equal length: L2 and inner product rank alike")
    flat = [r["dim"] for r in dims if r["std"] == 0]
    if flat:
        said.append(f"{len(flat)} constant dimensions")
    return said


def medians(rows: DataFrame, key: str) -> DataFrame:
    """key, dim, median of the elements of rows (key, vec), exactly, without a buffer of all values: a sketch brackets the
    middle, the values inside the bracket are counted, and those below it are only a number."""
    x = rows.select(key, F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double")).where("x is not null and not isnan(x)")
    edges = x.groupBy(key, "dim").agg(F.percentile_approx("x", [0.499, 0.501], 10_000).alias("e"), F.count("*").alias("total"))
    edges = edges.select(key, "dim", "total", F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
    marked = x.join(F.broadcast(edges), [key, "dim"])  # a row per key and dimension
    below = marked.groupBy(key, "dim").agg(F.count(F.when(F.col("x") < F.col("lo"), 1)).alias("below"))
    inside = marked.where("x between lo and hi").groupBy(key, "dim", "total", "x").agg(F.count("*").alias("n")).join(F.broadcast(below), [key, "dim"])
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(key, "dim").orderBy("x"))
    last = inside.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    # the middle place, or the two middle places, counted from 0
    a, b = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("upto")), F.col("x")))
    return last.groupBy(key, "dim").agg(((at(a) + at(b)) / 2).alias("median"))


def overall(rows: DataFrame) -> DataFrame:
    """n, n_zero_vectors, n_distinct, min_norm2, max_norm2 in one row."""
    return rows.select("vec", norm2(F.col("vec")).alias("n2")).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("n2") == 0, 1)).alias("n_zero_vectors"),
        F.countDistinct("vec").alias("n_distinct"),
        F.min("n2").alias("min_norm2"),
        F.max("n2").alias("max_norm2"),
    )


def imbalance(rows: DataFrame, key: str) -> DataFrame:
    """k * sum(h^2) / sum(h)^2 over the sizes h of the groups: 1 when they are equal."""
    h = rows.groupBy(key).agg(F.count("*").cast("double").alias("h"))
    return h.agg((F.count("*") * F.sum(F.col("h") * F.col("h")) / (F.sum("h") * F.sum("h"))).alias("imbalance"))


def histogram(rows: DataFrame, value: str, size: int) -> DataFrame:
    """bin, n of integer values in [0, size)."""
    return rows.where((F.col(value) >= 0) & (F.col(value) < size)).groupBy(F.col(value).alias("bin")).agg(F.count("*").alias("n"))


def bit_histogram(rows: DataFrame, strict: bool = False) -> DataFrame:
    """bit, n: ones per position of the sign bits."""
    return rows.select(F.posexplode(bits(F.col("vec"), strict)).alias("bit", "b")).groupBy("bit").agg(F.sum("b").alias("n"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row per distinct vector: id (the smallest) and copies."""
    return rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies", "vec")


def copies(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, copy): the ids that each distinct vector stands for."""
    return rows.select("vec", F.col("id").alias("copy")).join(distinct.select("id", "vec"), "vec").select("id", "copy")


def expanded(hits: DataFrame, table: DataFrame) -> DataFrame:
    """Hits over distinct vectors with all copies of each, at its score."""
    return hits.select("qid", F.col("id").alias("rep"), "dist").join(table.select(F.col("id").alias("rep"), F.col("copy").alias("id")), "rep").select("qid", "id", "dist")


def code_set(rows: DataFrame, *key: str) -> DataFrame:
    """The first row (smallest id) of each different code: what a set of codes lets in."""
    return rows.groupBy(*key).agg(F.min("id").alias("id")).select("id", *key)


def checksum(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: n, checksum (the exclusive or of a hash of each row, so the order of rows doesn't matter), total of the hashes."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("checksum"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"))


def repeated_codes(rows: DataFrame, *key: str) -> DataFrame:
    """Groups of more than one id with the same key columns: key, n, first id."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
