"""Additive quantizers: a vector is the sum of one codeword from each book. Books are fitted on a bounded sample of rows
(those with the smallest seeded hash of the id); encoding and decoding go over all rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.search import _matrix, knn_join

#: Rows that books are fitted on at most.
SAMPLE_ROWS = 65_536


def sample_matrix(rows: DataFrame, most: int = SAMPLE_ROWS, seed: int = 1234) -> np.ndarray:
    got = rows.where("vec is not null").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most).select("vec").toPandas()
    if got.empty:
        raise ValueError("no vectors to fit on")
    return np.array(got["vec"].tolist(), np.float64)


def lloyd(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(iterations):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        sizes, sums = np.bincount(near, minlength=k), np.zeros_like(c)
        np.add.at(sums, near, x)
        c[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return c


def beam_codes(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Stage by stage, the `beam` best partial codes of each row; the best of the last stage. Ties go to smaller codes."""
    n = len(x)
    left, codes, rows = x[:, None], np.zeros((n, 1, 0), np.int32), np.arange(n)[:, None]
    for book in books:
        k = len(book)
        cost = (left**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * left @ book.T
        order = np.argsort(cost.reshape(n, -1), 1, kind="stable")[:, :beam]
        src, c = order // k, order % k
        codes = np.concatenate((codes[rows, src], c[:, :, None].astype(np.int32)), 2)
        left = left[rows, src] - book[c]
    return codes[:, 0]


def summed(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def local_search_codes(x: np.ndarray, books: np.ndarray, sweeps: int, rounds: int, seed: int) -> np.ndarray:
    """Conditional modes, a book at a time, from the greedy code; then rounds that perturb a few books and keep what is better."""
    rng = np.random.default_rng(seed)

    def settle(codes: np.ndarray) -> np.ndarray:
        left = x - summed(codes, books)
        for _ in range(sweeps):
            for m, book in enumerate(books):
                left = left + book[codes[:, m]]
                codes[:, m] = ((book**2).sum(1)[None] - 2 * left @ book.T).argmin(1)
                left = left - book[codes[:, m]]
        return codes

    best = settle(beam_codes(x, books, 1))
    cost = ((x - summed(best, books)) ** 2).sum(1)
    for _ in range(rounds):
        tried = best.copy()
        for m in rng.choice(len(books), max(1, len(books) // 2), replace=False):
            tried[:, m] = rng.integers(0, len(books[m]), len(x))
        tried = settle(tried)
        now = ((x - summed(tried, books)) ** 2).sum(1)
        best[now < cost], cost = tried[now < cost], np.minimum(cost, now)
    return best


@dataclass(frozen=True)
class AdditiveQuantizer:
    """books[part] is (M, K, d / parts). kind: "rq" (beam search) or "lsq" (local search)."""

    books: tuple[np.ndarray, ...]
    kind: str = "rq"
    beam: int = 5
    seed: int = 1234

    @classmethod
    def fit(cls, rows: DataFrame, m: int, nbits: int = 8, kind: str = "rq", parts: int = 1, beam: int = 5, iterations: int = 10, seed: int = 1234) -> AdditiveQuantizer:
        """m books for each of `parts` equal cuts of the vector (parts > 1: the product forms)."""
        x, rng, books = sample_matrix(rows, seed=seed), np.random.default_rng(seed), []
        if x.shape[1] % parts:
            raise ValueError("parts must divide the dimension")
        for y in np.split(x, parts, 1):
            made = np.zeros((0, 1 << nbits, y.shape[1]))
            for _ in range(m):
                left = y - summed(beam_codes(y, made, beam), made) if len(made) else y
                made = np.concatenate((made, lloyd(left, 1 << nbits, iterations, rng)[None]))
            for turn in range(4 if kind == "lsq" else 0):
                codes = local_search_codes(y, made, 2, 2, seed + turn)
                at = codes + np.arange(m)[None] * (1 << nbits)
                hot = np.zeros((len(y), m << nbits))
                hot[np.arange(len(y))[:, None], at] = 1.0
                made = np.linalg.solve(hot.T @ hot + 1e-6 * np.eye(m << nbits), hot.T @ y + 1e-6 * made.reshape(m << nbits, -1)).reshape(made.shape)
            books.append(made)
        return cls(tuple(books), kind, beam, seed)

    def encode_matrix(self, x: np.ndarray) -> np.ndarray:
        cuts = zip(np.split(x, len(self.books), 1), self.books, strict=True)
        return np.concatenate([local_search_codes(y, b, 2, 4, self.seed) if self.kind == "lsq" else beam_codes(y, b, self.beam) for y, b in cuts], 1)

    def decode_matrix(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([summed(c, b) for c, b in zip(np.split(codes.astype(np.int64), len(self.books), 1), self.books, strict=True)], 1)

    def encode(self, rows: DataFrame) -> DataFrame:
        """id, code."""
        return _through(rows.where("vec is not null").select("id", "vec"), "vec", "code", "int", self.encode_matrix)

    def decode(self, rows: DataFrame) -> DataFrame:
        """id, vec of rows (id, code)."""
        return _through(rows.select("id", "code"), "code", "vec", "double", lambda c: self.decode_matrix(c.astype(np.int64)))

    def search(self, queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        """Exact queries against rows (id, code)."""
        return knn_join(queries, self.decode(rows), k, metric)


_NUMPY = {"int": np.int32, "long": np.int64, "double": np.float64}


def _through(rows: DataFrame, source: str, out: str, kind: str, f, whole: bool = False) -> DataFrame:
    """id, out: f of the source lists as a matrix of doubles (whole: of longs, which doubles can't all hold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                y = f(np.array(part.column(source).to_pylist(), np.int64) if whole else _matrix(part.column(source)))
                flat = pa.array(y.ravel().astype(_NUMPY[kind]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), flat)], names=["id", out])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {out} array<{kind}>")
