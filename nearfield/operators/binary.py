"""Search over binary codes: rows (id, words), words an array of longs of 32 bits each.

Hamming distance is a metric of the general searches ("hamming" over words as the vector), so k-NN, range and inverted-file
searches of codes are those of vectors; the bits as 0 and 1 have it as squared L2, which graphs use."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import bits, hamming, unpacked, words
from nearfield.operators import cluster
from nearfield.operators.graph import GraphIndex
from nearfield.operators.ivf import InvertedFile
from nearfield.operators.search import _matrix, _query_blocks, knn_join, range_join, ranked, searched


def codes(rows: DataFrame, n: int, strict: bool = False, vec: str = "vec") -> DataFrame:
    """id, words: sign bits of the first n elements."""
    return rows.where(F.col(vec).isNotNull()).select("id", words(bits(F.slice(vec, 1, n), strict), n).alias("words"))


def as_vectors(rows: DataFrame) -> DataFrame:
    """id, vec: the words as vectors for the metric "hamming"."""
    return rows.select("id", F.col("words").alias("vec"))


def _whole(hits: DataFrame) -> DataFrame:
    return hits.withColumn("dist", F.col("dist").cast("int"))


def hamming_knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k nearest by differing bits."""
    return _whole(knn_join(as_vectors(queries), as_vectors(base), k, "hamming"))


def hamming_range(queries: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    """All with fewer than radius differing bits."""
    return _whole(range_join(as_vectors(queries), as_vectors(base), radius, "hamming"))


def hamming_counts(queries: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    """qid, n: how many rows differ in at most radius bits."""
    return hamming_range(queries, base, radius + 1).groupBy("qid").agg(F.count("*").alias("n"))


def hamming_matches(queries: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    """qid, id of pairs that differ in at most radius bits."""
    return hamming_range(queries, base, radius + 1).select("qid", "id")


def hamming_self_count(rows: DataFrame, radius: int) -> DataFrame:
    """One row, n: pairs of different rows, each once, that differ in at most radius bits."""
    return hamming_range(rows, rows, radius + 1).where("qid < id").agg(F.count("*").alias("n"))


def _differing(shared, batch: pa.RecordBatch, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if batch.num_rows:
        x = _matrix(batch.column("vec"))
        for i, row in enumerate(shared[1]):
            s = (x != row).sum(1).astype(np.float64)
            at = keep(s)
            yield i, at, s[at]


def differing_knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k nearest by differing code elements; rows (id, code). Queries go in blocks."""
    rows = base.where("code is not null").select(F.col("id").cast("long").alias("id"), F.col("code").alias("vec"))
    sc = rows.sparkSession.sparkContext
    parts = [searched(rows, sc.broadcast(b), _differing, "l2", k) for b in _query_blocks(queries.select("id", F.col("code").alias("vec")))]
    if not parts:
        return rows.sparkSession.createDataFrame([], "qid long, rank int, id long, dist int")
    return _whole(ranked(reduce(DataFrame.unionByName, parts), k).select("qid", "rank", "id", "dist"))


@dataclass(frozen=True)
class BinaryLists:
    """Codes in inverted lists: centroids are codes too, the majority bits of k-means over the bits as -1 and 1."""

    file: InvertedFile
    n: int

    @classmethod
    def fit(cls, rows: DataFrame, nlist: int, n: int, iterations: int = 10, seed: int = 1234) -> BinaryLists:
        real = rows.select("id", F.transform(unpacked(F.col("words"), n), lambda b: 2.0 * b - 1.0).alias("vec"))
        found = cluster.kmeans(real, nlist, iterations, seed=seed).table(rows.sparkSession)
        return cls.of(found.select("list_no", words(bits(F.col("vec")), n).alias("words")), n)

    @classmethod
    def of(cls, centroids: DataFrame, n: int) -> BinaryLists:
        """Empty lists of given centroids (list_no, words)."""
        c = centroids.select("list_no", F.col("words").alias("vec"))
        return cls(InvertedFile(c.select("list_no", F.lit(0).cast("long").alias("id"), "vec").limit(0), c, "hamming"), n)

    def add(self, rows: DataFrame) -> BinaryLists:
        return replace(self, file=self.file.add(as_vectors(rows)))

    def search(self, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
        return _whole(self.file.search(as_vectors(queries), k, nprobe))

    def range_search(self, queries: DataFrame, radius: int, nprobe: int = 1) -> DataFrame:
        return _whole(self.file.range_search(as_vectors(queries), radius, nprobe))


@dataclass(frozen=True)
class BinaryGraph:
    """An HNSW graph over bits as 0 and 1, where squared L2 is the Hamming distance."""

    graph: GraphIndex
    n: int

    @staticmethod
    def _vectors(rows: DataFrame, n: int) -> DataFrame:
        return rows.select("id", F.transform(unpacked(F.col("words"), n), lambda b: b.cast("double")).alias("vec"))

    @classmethod
    def build(cls, rows: DataFrame, n: int, m: int = 32, **kw) -> BinaryGraph:
        return cls(GraphIndex.build(cls._vectors(rows, n), "hnsw", m, **kw), n)

    def search(self, queries: DataFrame, k: int, ef: int = 16) -> DataFrame:
        return _whole(self.graph.search(self._vectors(queries, self.n), k, ef))


def from_float(queries: DataFrame, rows: DataFrame, n: int, k: int, search=knn_join) -> DataFrame:
    """Codes searched by a search of vectors (queries, rows, k), over their bits as -1 and 1; dist in bits."""
    real = lambda t: t.select("id", F.transform(unpacked(F.col("words"), n), lambda b: 2.0 * b - 1.0).alias("vec"))
    return search(real(queries), real(rows), k).withColumn("dist", F.round(F.col("dist") / 4).cast("int"))


def _key(word: Column, b: int, shift: int = 0) -> Column:
    return F.shiftright(word, shift).bitwiseAND(F.lit((1 << b) - 1).cast("long"))


def flips(b: int, most: int) -> list[int]:
    """All masks of b bits with at most `most` bits set."""
    return [sum(1 << i for i in c) for n in range(min(b, most) + 1) for c in combinations(range(b), n)]


def bucket_range(queries: DataFrame, base: DataFrame, radius: int, b: int, flip: int, shifts: tuple[int, ...] = (0,)) -> DataFrame:
    """Hash search: rows that share a bucket of b bits (at one of the shifts into the first word) with the query after
    at most `flip` flips, verified to fewer than radius differing bits. An equi-join on the bucket."""
    masks = F.array(*(F.lit(m).cast("long") for m in flips(b, flip)))
    key = lambda: F.array(*(F.struct(F.lit(s).alias("t"), _key(F.get("words", F.lit(0)), b, s).alias("key")) for s in shifts))
    q = queries.select(F.col("id").alias("qid"), F.col("words").alias("q"), F.explode(key()).alias("x"))
    q = q.select("qid", "q", F.col("x.t").alias("t"), F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("x.key")))).alias("key"))
    rows = base.select("id", "words", F.explode(key()).alias("x")).select("id", "words", "x.t", "x.key")
    hits = q.join(rows, ["t", "key"]).select("qid", "id", hamming(F.col("q"), F.col("words")).alias("dist"))
    return hits.where(F.col("dist") < radius).distinct()
