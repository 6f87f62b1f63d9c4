"""Inverted lists of codes: product codes of residuals with refinement and a Hamming screen, product-cell lists, two-layer codes.

A task makes the look-up tables of the queries that probe a list when it meets rows of that list; codes are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.metrics import descending, distance
from nearfield.functions.vectors import minus, plus
from nearfield.operators.codecs import ProductQuantizer, appended
from nearfield.operators.ivf import InvertedFile, named_lists, probed_blocks, runs_of_lists
from nearfield.operators.search import _matrix, ranked, searched, within_radius


def product_codes(rows: DataFrame, pq: ProductQuantizer, source: str = "vec", out: str = "code") -> DataFrame:
    """rows with product codes of a column."""
    return appended(rows, source, out, "int", pq.encode_matrix)


def product_vectors(rows: DataFrame, pq: ProductQuantizer, source: str = "code", out: str = "vec") -> DataFrame:
    return appended(rows, source, out, "double", pq.decode_matrix)


def _in_coded_lists(pq: ProductQuantizer, metric: str, screen: int | None):
    def scored(shared, batch: pa.RecordBatch, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        _, q, asked, centroids = shared
        codes = _matrix(batch.column("code")).astype(np.int64) if batch.num_rows else None
        books = np.arange(len(pq.codebook))
        for name, places, who in runs_of_lists(batch, asked):
            c, own = centroids[name], codes[places]
            coarse = q[who] @ c if descending(metric) else np.zeros(len(who))
            for a in range(0, len(who), 256):
                some = who[a : a + 256]
                tables = pq.cells(q[some] if descending(metric) else q[some] - c, metric)
                for j, table in enumerate(tables):
                    s = table[books, own].sum(1) + coarse[a + j]
                    if screen is not None:
                        s = np.where(np.bitwise_count(own ^ table.argmin(1)[None]).sum(1) < screen, s, np.nan)
                    at = keep(s)
                    yield int(some[j]), places[at], s[at]

    return scored


@dataclass(frozen=True)
class CodedLists:
    """rows (list_no, id, code[, fine]) of residuals from centroids (list_no, vec); fine: codes of what code leaves."""

    rows: DataFrame
    centroids: DataFrame
    pq: ProductQuantizer
    fine: ProductQuantizer | None = None
    metric: str = "l2"

    @classmethod
    def build(cls, file: InvertedFile, pq: ProductQuantizer, fine: ProductQuantizer | None = None) -> CodedLists:
        rows = product_codes(file.residuals(), pq)
        if fine is not None:
            rows = product_vectors(rows, pq, "code", "near").withColumn("vec", minus(F.col("vec"), F.col("near"))).drop("near")
            rows = product_codes(rows, fine, "vec", "fine")
        return cls(rows.drop("vec"), file.centroids, pq, fine, file.metric)

    def add_codes(self, rows: DataFrame) -> CodedLists:
        """Rows that are already codes, of the same columns."""
        return replace(self, rows=self.rows.unionByName(rows.select(*self.rows.columns)))

    def hits(self, queries: DataFrame, nprobe: int, k: int | None = None, radius: float | None = None, screen: int | None = None, probes: DataFrame | None = None) -> DataFrame:
        """qid, id, dist of the probed lists (or of probes: qid, list_no). screen: only codes with fewer differing bits than that from the query's own
        code (L2 only)."""
        if screen is not None and descending(self.metric):
            raise ValueError("a Hamming screen needs L2")
        file = InvertedFile(self.rows, self.centroids, self.metric)
        numbers, c = file._lists
        rows = self.rows.select("list_no", F.col("id").cast("long").alias("id"), "code")
        sc, parts = rows.sparkSession.sparkContext, []
        for qid, q, asked, names in probed_blocks(queries, file.probes(queries, nprobe) if probes is None else probes):
            some = np.isin(numbers, names)
            shared = sc.broadcast((qid, q, asked, dict(zip(numbers[some].tolist(), c[some], strict=True))))
            parts.append(searched(named_lists(rows, names), shared, _in_coded_lists(self.pq, self.metric, screen), self.metric, k, radius))
        return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], "qid long, id long, dist double")

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, screen: int | None = None, probes: DataFrame | None = None) -> DataFrame:
        return ranked(self.hits(queries, nprobe, k, screen=screen, probes=probes), k, self.metric).select("qid", "rank", "id", "dist")

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1) -> DataFrame:
        return within_radius(self.hits(queries, nprobe, radius=radius), radius, self.metric)

    def search_refined(self, queries: DataFrame, k: int, nprobe: int = 1, factor: float = 4.0, probes: DataFrame | None = None) -> DataFrame:
        """The k * factor best by the first code, rescored with both codes."""
        if self.fine is None:
            raise ValueError("no fine codes")
        many = int(k * factor)
        first = ranked(self.hits(queries, nprobe, many, probes=probes), many, self.metric).select("qid", "id")
        out = first.join(self.decode().select("id", "vec"), "id")
        out = out.join(queries.select(F.col("id").alias("qid"), F.col("vec").alias("q")), "qid")
        return ranked(out.select("qid", "id", distance(F.col("q"), F.col("vec"), self.metric).alias("dist")), k, self.metric).select("qid", "rank", "id", "dist")

    def decode(self) -> DataFrame:
        """list_no, id, vec as the codes give it back."""
        rows = product_vectors(self.rows, self.pq)
        if self.fine is not None:
            rows = product_vectors(rows, self.fine, "fine", "more").withColumn("vec", plus(F.col("vec"), F.col("more")))
        c = self.centroids.select("list_no", F.col("vec").alias("c"))
        return rows.join(c, "list_no").select("list_no", "id", plus(F.col("vec"), F.col("c")).alias("vec"))


@dataclass(frozen=True)
class ProductCells:
    """A coarse quantizer of two (or more) sub-spaces: a cell is one centroid of each, numbered with the first sub-space lowest."""

    pq: ProductQuantizer

    def _numbers(self, places: np.ndarray) -> np.ndarray:
        m, k, _ = self.pq.codebook.shape
        return (places * k ** np.arange(m)).sum(-1)

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """qid, list_no, rank, coarse: the cells with the smallest sums. Only sub-centroids that are among a sub-space's
        nprobe best can be part of them, and partial sums are cut to nprobe after each sub-space."""
        pq = self.pq

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for qid, t in zip(batch.column("id").to_pylist(), pq.cells(_matrix(batch.column("vec"))), strict=True):
                    sums, cells = np.zeros(1), np.zeros(1, np.int64)
                    for m, row in enumerate(t):
                        near = np.lexsort((np.arange(len(row)), row))[:nprobe]
                        sums, cells = (sums[:, None] + row[near]).ravel(), (cells[:, None] + near * len(row) ** m).ravel()
                        first = np.lexsort((cells, sums))[:nprobe]
                        sums, cells = sums[first], cells[first]
                    out.append((np.full(len(sums), qid), cells, np.arange(len(sums), dtype=np.int32), sums))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["qid", "list_no", "rank", "coarse"])

        rows = queries.where("vec is not null").select(F.col("id").cast("long").alias("id"), "vec")
        return rows.mapInArrow(best, "qid long, list_no long, rank int, coarse double")

    def file(self, base: DataFrame) -> InvertedFile:
        """Rows in their cells; the centroids are those of cells that hold rows."""
        coded = product_codes(base.where("vec is not null").select("id", "vec"), self.pq)
        k = self.pq.codebook.shape[1]
        cell = F.aggregate(F.transform("code", lambda c, m: c.cast("long") * F.pow(F.lit(k), m).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
        rows = coded.withColumn("list_no", cell)
        used = product_vectors(rows.select("list_no", "code").distinct(), self.pq)
        return InvertedFile(rows.select("list_no", "id", "vec"), used.select("list_no", "vec"))

    def search(self, file: InvertedFile, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        return file.search_preassigned(queries, self.probes(queries, nprobe), k)


@dataclass(frozen=True)
class TwoLayer:
    """A codec only: code is the coarse number, then the product codes of the residual."""

    centroids: DataFrame
    pq: ProductQuantizer

    def encode(self, base: DataFrame) -> DataFrame:
        got = CodedLists.build(InvertedFile.build(base, self.centroids), self.pq).rows
        return got.select("id", F.concat(F.array(F.col("list_no").cast("int")), "code").alias("code"))

    def decode(self, rows: DataFrame) -> DataFrame:
        split = rows.select("id", F.get("code", F.lit(0)).alias("list_no"), F.slice("code", 2, len(self.pq.codebook)).alias("code"))
        return CodedLists(split, self.centroids, self.pq).decode().select("id", "vec")
