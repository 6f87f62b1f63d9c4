"""Periodic bits of projected vectors, list by list, compared by Hamming distance in the probed lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import doubles, words
from nearfield.operators.ivf import InvertedFile, named_lists, probed_blocks, runs_of_lists
from nearfield.operators.search import _matrix, ranked, searched
from nearfield.operators.stats import medians

KINDS = ("global", "centroid", "centroid_half", "median")


def periodic_bits(vec: Column, thresholds: Column, period: float) -> Column:
    """1 where the element lies in the second half of its period, counted from the threshold; without a period (0), where it
    is above the threshold."""
    if not period:
        return F.zip_with(vec, thresholds, lambda x, t: (x.cast("double") > t).cast("int"))
    return F.zip_with(vec, thresholds, lambda x, t: F.pmod(F.floor((x.cast("double") - t) * 2.0 / period), F.lit(2)).cast("int"))


def _bits_of(x: np.ndarray, period: float) -> np.ndarray:
    """The same of elements less their thresholds."""
    return x > 0 if not period else (np.floor(x * 2.0 / period).astype(np.int64) & 1).astype(bool)


def _in_lists(period: float, n: int):
    def scored(shared, batch: pa.RecordBatch, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        _, q, asked, thresholds = shared
        x = _matrix(batch.column("words")).astype(np.int64) if batch.num_rows else None
        for name, places, who in runs_of_lists(batch, asked):
            ones = _bits_of(q[who][:, :n] - thresholds[name][:n], period)
            own = np.stack([(ones[:, a : a + 32] << np.arange(min(32, n - a))).sum(1) for a in range(0, n, 32)], 1)
            for i, row in zip(who.tolist(), own, strict=True):
                s = np.bitwise_count(x[places] ^ row).sum(1).astype(np.float64)
                at = keep(s)
                yield i, places[at], s[at]

    return scored


@dataclass(frozen=True)
class SpectralLists:
    """rows (list_no, id, words), thresholds (list_no, t); a list's rows and the queries that probe it share thresholds."""

    file: InvertedFile
    rows: DataFrame
    thresholds: DataFrame
    period: float
    bits: int

    @classmethod
    def build(cls, file: InvertedFile, period: float = 10.0, kind: str = "global", bits: int = 64) -> SpectralLists:
        c = file.centroids.select("list_no", doubles(F.col("vec")).alias("t"))
        if kind == "global":
            t = c.select("list_no", F.transform("t", lambda x: F.lit(0.0)).alias("t"))
        elif kind == "centroid":
            t = c
        elif kind == "centroid_half":
            t = c.select("list_no", F.transform("t", lambda x: x - period / 4).alias("t"))
        elif kind == "median":  # of the rows that file holds; lists without rows keep their centroid
            m = medians(file.rows.select("list_no", "vec"), "list_no").groupBy("list_no").agg(F.array_sort(F.collect_list(F.struct("dim", F.col("median").alias("m")))).alias("e"))
            t = c.join(m, "list_no", "left").select("list_no", F.coalesce(F.transform("e", lambda s: s["m"]), "t").alias("t"))
        else:
            raise ValueError(f"thresholds are one of {', '.join(KINDS)}")
        return cls.with_thresholds(file, t, period, bits)

    @classmethod
    def with_thresholds(cls, file: InvertedFile, t: DataFrame, period: float, bits: int) -> SpectralLists:
        coded = file.rows.where("vec is not null").join(t, "list_no").select("list_no", "id", words(periodic_bits(F.slice("vec", 1, bits), F.slice("t", 1, bits), period), bits).alias("words"))
        return cls(file, coded, t, period, bits)

    def search(self, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
        """The k nearest by differing bits in the nprobe nearest lists."""
        got = self.thresholds.toPandas()  # a row per list
        t, parts, sc = dict(zip(got["list_no"].tolist(), (np.array(v, np.float64) for v in got["t"]), strict=True)), [], self.rows.sparkSession.sparkContext
        rows = self.rows.select("list_no", F.col("id").cast("long").alias("id"), "words")
        for qid, q, asked, names in probed_blocks(queries, self.file.probes(queries, nprobe)):
            shared = sc.broadcast((qid, q, asked, {x: t[x] for x in names.tolist()}))
            parts.append(searched(named_lists(rows, names), shared, _in_lists(self.period, self.bits), "l2", k))
        hits = reduce(DataFrame.unionByName, parts) if parts else self.rows.sparkSession.createDataFrame([], "qid long, id long, dist double")
        return ranked(hits, k).select("qid", "rank", "id", F.col("dist").cast("int").alias("dist"))
