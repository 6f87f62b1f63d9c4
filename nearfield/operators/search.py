"""Similarity joins: k nearest, range, candidates, pairs, and what is done with their results.

Results are long tables: qid, rank (from 0), id, dist, best first, equal scores by smallest id; NaN and null scores and
null vectors are never returned. `where` restricts the base before the search, so k rows come from what passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.metrics import block, descending, distance

#: Queries of one block: what is sent to the executors at a time (rows, and elements).
BLOCK_QUERIES, BLOCK_ELEMENTS = 4096, 4_000_000
#: Query sets of more blocks than that don't pass through the driver: chunks of queries meet chunks of the base in tasks.
MOST_BLOCKS = 16
#: Hits that a task holds before it passes them on, give or take a batch: a wide radius finds a block times a batch.
HIT_ROWS = 1 << 17
#: Groups of a batch that are looked at one by one; more are sorted together.
FEW_GROUPS = 64

_HITS = "qid long, id long, dist double"


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as an (n, d) matrix of doubles."""
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _query_blocks(queries: DataFrame, elements: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of each block of the query set; a block at a time is on the driver. elements: what is sent of one
    query, if more than its vector."""
    rows = queries.select("id", "vec").where("vec is not null")
    total, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not total:
        return
    size = max(1, min(BLOCK_QUERIES, BLOCK_ELEMENTS // max(1, dim, elements)))
    blocks = -(-total // size)
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        got = part.toArrow().combine_chunks()
        if got.num_rows:
            yield got.column("id").to_numpy(), _matrix(got.column("vec").combine_chunks() if isinstance(got.column("vec"), pa.ChunkedArray) else got.column("vec"))


def _scores(q: np.ndarray, x: np.ndarray, metric: str, arg: float, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its kept rows and their exact scores. L2 and IP are screened by one matrix product first."""
    if metric not in ("l2", "ip"):
        for i in range(len(q)):
            s = block(q[i], x, metric, arg)
            at = keep(s, 0.0)
            yield i, at, s[at]
        return
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    for start in range(0, len(q), 256):
        part = q[start : start + 256] @ x.T
        if metric == "l2":
            part = qq[start : start + 256, None] + xx[None, :] - 2 * part
        for k in range(len(part)):
            i = start + k
            slack = 1e-9 * (qq[i] + float(xx.max(initial=0.0)) + 1)
            at = keep(part[k], slack)
            s = block(q[i], x[at], metric, arg)
            again = keep(s, 0.0)
            yield i, at[again], s[again]


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    cat = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(cat[2].astype(np.float64))], names=["qid", "id", "dist"])


def _hits_in_parts(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(qid, ids, scores) as they are found, some HIT_ROWS rows at a time."""
    rows, n = [], 0
    for qid, ids, s in found:
        if len(ids):
            rows.append((np.full(len(ids), qid), ids, s))
            n += len(ids)
        if n >= HIT_ROWS:
            yield _hits(rows)
            rows, n = [], 0
    if rows:
        yield _hits(rows)


def keep_best(k: int, metric: str) -> Callable[[np.ndarray, float], np.ndarray]:
    """Places of scores that may be among the k best, give or take a slack."""
    sign = -1.0 if descending(metric) else 1.0

    def keep(scores: np.ndarray, slack: float = 0.0) -> np.ndarray:
        s = np.where(np.isnan(scores), np.inf, sign * scores)
        if len(s) <= k:
            return np.flatnonzero(s < np.inf)
        return np.flatnonzero(s <= min(np.partition(s, k - 1)[k - 1] + slack, np.finfo(float).max))

    return keep


def keep_within(radius: float, metric: str) -> Callable[[np.ndarray, float], np.ndarray]:
    def keep(scores: np.ndarray, slack: float = 0.0) -> np.ndarray:
        return np.flatnonzero(scores > radius - slack if descending(metric) else scores < radius + slack)

    return keep


class Best:
    """The k best (id, score) of each query in a task."""

    def __init__(self, k: int, metric: str) -> None:
        self.k, self.sign = k, -1.0 if descending(metric) else 1.0
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = self.sign * scores
        if query in self.held:
            ids, scores = np.append(self.held[query][0], ids), np.append(self.held[query][1], scores)
        order = np.lexsort((ids, scores))[: self.k]
        self.held[query] = (ids[order], scores[order])

    def hits(self, qid: np.ndarray) -> pa.RecordBatch:
        return _hits([(np.full(len(m), qid[i]), m, self.sign * s) for i, (m, s) in self.held.items()])


def searched(rows: DataFrame, shared: Any, scored: Callable[[Any, pa.RecordBatch, Callable], Iterator[tuple[int, np.ndarray, np.ndarray]]], metric: str, k: int | None = None, radius: float | None = None) -> DataFrame:
    """Hits (qid, id, dist) of a block of queries in rows (id, ...): of each task the k best per query, or all within the
    radius. shared holds the qids first; scored(shared, batch, keep) gives (query number, places in the batch, scores)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keep = Best(k, metric), keep_best(k, metric)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, at, s in scored(shared.value, batch, keep):
                held.add(i, ids[at], s)
        yield held.hits(shared.value[0])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keep_within(radius, metric)
        for batch in batches:
            ids, qid = batch.column("id").to_numpy(), shared.value[0]
            yield from _hits_in_parts((qid[i], ids[at], s) for i, at, s in scored(shared.value, batch, keep))

    return rows.mapInArrow(best if k is not None else within, _HITS)


def _all_pairs(metric: str, arg: float):
    def scored(shared, batch: pa.RecordBatch, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if batch.num_rows:
            yield from _scores(shared[1], _matrix(batch.column("vec")), metric, arg, keep)

    return scored


_CHUNK = "ids binary, vecs binary, n int"


def _chunks(rows: DataFrame) -> DataFrame:
    """rows (id, vec) packed into chunks of at most a block; with a column grp, that of each row too, in an array grps."""
    grouped = "grp" in rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column("vec")), batch.column("id").to_numpy()
            size = max(1, min(BLOCK_QUERIES, BLOCK_ELEMENTS // max(1, x.shape[1])))
            for a in range(0, len(ids), size):
                part = ids[a : a + size]
                made = [pa.array([part.tobytes()], pa.binary()), pa.array([x[a : a + size].tobytes()], pa.binary()), pa.array([len(part)], pa.int32())]
                if grouped:
                    made.append(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column("grp").slice(a, size)))
                yield pa.RecordBatch.from_arrays(made, names=["ids", "vecs", "n", "grps"][: len(made)])

    return rows.mapInArrow(pack, f"{_CHUNK}, grps array<{rows.schema['grp'].dataType.simpleString()}>" if grouped else _CHUNK)


def _chunk_pairs(queries: DataFrame, base: DataFrame, metric: str, arg: float, k: int | None, radius: float | None) -> DataFrame:
    """Hits of all queries: every chunk of queries meets every chunk of the base in some task, none on the driver."""
    pairs = _chunks(queries).toDF("qids", "qvecs", "qn").crossJoin(_chunks(base))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keep_best(k, metric) if k is not None else keep_within(radius, metric)
        for batch in batches:
            for i in range(batch.num_rows):
                qid, q, n, ids, x, m = (batch.column(c)[i].as_py() for c in ("qids", "qvecs", "qn", "ids", "vecs", "n"))
                qid, ids = np.frombuffer(qid, np.int64), np.frombuffer(ids, np.int64)
                found = _scores(np.frombuffer(q).reshape(n, -1), np.frombuffer(x).reshape(m, -1), metric, arg, keep)
                yield from _hits_in_parts((qid[j], ids[at], s) for j, at, s in found)

    return pairs.mapInArrow(meet, _HITS)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.where("vec is not null and id is not null").select(F.col("id").cast("long").alias("id"), "vec")


def _many(queries: DataFrame) -> bool:
    """Whether queries (id, vec) are too many to pass through the driver."""
    size, dim = queries.agg(F.count("*"), F.max(F.size("vec"))).first()
    return size > MOST_BLOCKS * max(1, min(BLOCK_QUERIES, BLOCK_ELEMENTS // max(1, dim or 1)))


def joined(queries: DataFrame, base: DataFrame, metric: str, arg: float = 2.0, k: int | None = None, radius: float | None = None) -> DataFrame:
    """Hits (qid, id, dist) that hold the k best of each query, or all within the radius."""
    q, rows, spark = _plain(queries), _plain(base), base.sparkSession
    if _many(q):
        return _chunk_pairs(q, rows, metric, arg, k, radius)
    parts = [searched(rows, spark.sparkContext.broadcast(b), _all_pairs(metric, arg), metric, k, radius) for b in _query_blocks(q)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _HITS)


def ranked(hits: DataFrame, k: int, metric: str = "l2", key: str = "qid") -> DataFrame:
    """The k best per key of (key, id, dist, ...), with rank. Plans as a partial and a final limit per key."""
    score = F.col("dist").desc() if descending(metric) else F.col("dist").asc()
    w = Window.partitionBy(key).orderBy(score, F.col("id").asc())
    return hits.where(F.col("dist").isNotNull() & ~F.isnan("dist")).withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k)


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", arg: float = 2.0, where: Column | None = None, other: bool = False) -> DataFrame:
    """The k best base rows (id, vec) for each query (id, vec); with `other`, a row isn't its own neighbour.

    The base stays where it is: each task streams its rows past a block of queries and keeps k per query, so what is
    shuffled is k rows per query and task. Query sets of more than MOST_BLOCKS blocks meet the base chunk by chunk."""
    if k <= 0:
        raise ValueError("k must be positive")
    hits = joined(queries, base if where is None else base.where(where), metric, arg, k=k + other)
    return ranked(hits.where("qid <> id") if other else hits, k, metric).select("qid", "rank", "id", "dist")


def range_join(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", arg: float = 2.0, where: Column | None = None) -> DataFrame:
    """All base rows strictly better than the radius: qid, id, dist, in no order."""
    return joined(queries, base if where is None else base.where(where), metric, arg, radius=radius)


def within_radius(hits: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """A range result cut to a smaller radius."""
    return hits.where(F.col("dist") > radius if descending(metric) else F.col("dist") < radius)


def best_of(x: np.ndarray, c: np.ndarray, metric: str = "l2", arg: float = 2.0) -> np.ndarray:
    """The number of the best row of c for each row of x, the smallest of equals, a bounded block of x at a time."""
    out, sign = np.zeros(len(x), np.int64), -1.0 if descending(metric) else 1.0
    if metric not in ("l2", "ip"):
        for i, row in enumerate(x):
            s = sign * block(row, c, metric, arg)
            out[i] = int(np.where(np.isnan(s), np.inf, s).argmin())
        return out
    cc, step = (c * c).sum(1), max(1, BLOCK_ELEMENTS // max(1, len(c)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        s = -(part @ c.T) if metric == "ip" else cc - 2 * (part @ c.T)
        best = s.argmin(1)
        slack = 1e-9 * ((part * part).sum(1) + float(cc.max(initial=0.0)) + 1)
        close = s <= (s[np.arange(len(part)), best] + slack)[:, None]
        for i in np.flatnonzero(close.sum(1) > 1):
            some = np.flatnonzero(close[i])
            best[i] = some[(sign * block(part[i], c[some], metric)).argmin()]
        out[a : a + step] = best
    return out


def assign(queries: DataFrame, base: DataFrame, metric: str = "l2") -> DataFrame:
    """qid, id of the best row."""
    return knn_join(queries, base, 1, metric).select("qid", "id")


def pair_scores(pairs: DataFrame, queries: DataFrame, base: DataFrame, metric: str = "l2", arg: float = 2.0) -> DataFrame:
    """The scores of given (qid, id); ids of -1 and unknown ones are left out."""
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    out = pairs.where("id <> -1").join(base.select("id", F.col("vec").alias("x")), "id").join(q, "qid").where("x is not null and q is not null")
    return out.select("qid", "id", distance(F.col("q"), F.col("x"), metric, arg).alias("dist"))


def candidate_join(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", arg: float = 2.0) -> DataFrame:
    """The k best of each query's own candidates (qid, id)."""
    return ranked(pair_scores(candidates.distinct(), queries, base, metric, arg), k, metric).select("qid", "rank", "id", "dist")


def pairwise(queries: DataFrame, base: DataFrame, metric: str = "l2", arg: float = 2.0) -> DataFrame:
    """The whole matrix as rows. Meant for a stated query set; the result has a row per query and base row."""
    worst = -np.inf if descending(metric) else np.inf
    return range_join(queries, base, worst, metric, arg)


def padded(hits: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """k rows per query: ranks without a hit have id -1 and the worst score."""
    slots = queries.select(F.col("id").alias("qid")).select("qid", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("rank"))
    worst = F.lit(-3.4028234663852886e38 if descending(metric) else 3.4028234663852886e38)
    out = slots.join(hits, ["qid", "rank"], "left")
    return out.select("qid", F.col("rank").cast("int").alias("rank"), F.coalesce("id", F.lit(-1).cast("long")).alias("id"), F.coalesce("dist", worst).alias("dist"))


def merged(results: list[DataFrame], k: int, metric: str = "l2") -> DataFrame:
    """One k-best table from several (shards, blocks, slices); an id found twice counts once."""
    every = reduce(DataFrame.unionByName, [r.select("qid", "id", "dist") for r in results])
    best = F.max("dist") if descending(metric) else F.min("dist")
    return ranked(every.groupBy("qid", "id").agg(best.alias("dist")), k, metric).select("qid", "rank", "id", "dist")


def _of_groups(hits: DataFrame, k: int, per_group: int, metric: str) -> DataFrame:
    score = F.col("dist").desc() if descending(metric) else F.col("dist").asc()
    w = Window.partitionBy("qid", "grp").orderBy(score, F.col("id"))
    few = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_group)
    return ranked(few, k, metric).select("qid", "rank", "id", "grp", "dist")


def diverse(hits: DataFrame, groups: DataFrame, k: int, per_group: int, metric: str = "l2") -> DataFrame:
    """The k best hits with at most per_group of each group (groups: id, grp)."""
    return _of_groups(hits.select("qid", "id", "dist").join(groups, "id"), k, per_group, metric)


def _first_of_each(codes: np.ndarray, few: int) -> np.ndarray:
    """Places, in order, of the first few of each code."""
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
    return np.sort(order[place < few])


class BestOfGroups:
    """The k best (id, score) of each query with at most `few` of a group, in a task. A row among the best of all rows is
    among the best of any part of them that holds it: fewer better rows count there. So k per query are enough to hold."""

    def __init__(self, k: int, few: int, metric: str, arg: float) -> None:
        self.k, self.few, self.metric, self.arg, self.sign = k, few, metric, arg, -1.0 if descending(metric) else 1.0
        self.numbers: dict = {}
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _keep(self, groups: np.ndarray) -> Callable[[np.ndarray, float], np.ndarray]:
        """Places of scores that may be among the best of rows of these groups, give or take a slack."""
        names, codes = np.unique(groups, return_inverse=True)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        place = np.arange(len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
        runs = np.split(order, starts[1:]) if len(names) <= FEW_GROUPS else []

        def edges(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The few-th best score of each group, and the few best of all groups in any order."""
            edge = np.full(len(names), np.inf)
            if not runs:
                order = np.lexsort((s, codes))
                last = order[place == self.few - 1]
                edge[codes[last]] = s[last]
                return edge, s[order[place < self.few]]
            first = [np.partition(s[r], self.few - 1)[: self.few] if len(r) >= self.few else s[r] for r in runs]
            for i, best in enumerate(first):
                if len(best) == self.few:
                    edge[i] = best[-1]
            return edge, np.concatenate(first)

        def keep(scores: np.ndarray, slack: float = 0.0) -> np.ndarray:
            s = np.where(np.isnan(scores), np.inf, self.sign * scores)
            if len(s) < len(codes):  # exact scores of rows that were screened before
                return np.flatnonzero(s < np.inf)
            edge, first = edges(s)
            if len(first) > self.k:
                edge = np.minimum(edge, np.partition(first, self.k - 1)[self.k - 1])
            return np.flatnonzero((s <= edge[codes] + slack) & (s < np.inf))

        return keep

    def add(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, groups: pa.Array) -> None:
        if not len(ids):
            return
        coded = groups.dictionary_encode(null_encoding="encode")
        names = [v if v == v else "nan" for v in coded.dictionary.to_pylist()]
        numbers = np.array([self.numbers.setdefault((type(v), v), len(self.numbers)) for v in names], np.int64)[coded.indices.to_numpy()]
        for i, at, s in _scores(q, x, self.metric, self.arg, self._keep(numbers)):
            row = (ids[at], self.sign * s, numbers[at])
            if i in self.held:
                row = tuple(np.append(a, b) for a, b in zip(self.held[i], row, strict=True))
            order = np.lexsort(row[:2])
            order = order[_first_of_each(row[2][order], self.few)[: self.k]]
            self.held[i] = tuple(c[order] for c in row)

    def hits(self, qid: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        out = _hits([(np.full(len(ids), qid[i]), ids, self.sign * s) for i, (ids, s, _) in self.held.items()])
        names = [float("nan") if (t, v) == (str, "nan") and pa.types.is_floating(kind) else v for t, v in self.numbers]
        groups = pa.array([names[n] for _, _, found in self.held.values() for n in found.tolist()], kind)
        return pa.RecordBatch.from_arrays([*out.columns, groups], names=["qid", "id", "dist", "grp"])


def diverse_join(queries: DataFrame, base: DataFrame, k: int, per_group: int, metric: str = "l2", arg: float = 2.0) -> DataFrame:
    """The k best base rows (id, vec, grp) for each query (id, vec), at most per_group of a group: qid, rank, id, grp, dist.

    As in knn_join a task keeps k rows per query, so neither the pairs nor a row per group are shuffled. Groups are numbers,
    strings, dates or truth values; a task holds the names of those in its rows. Null is a group."""
    if k <= 0 or per_group <= 0:
        raise ValueError("k and per_group must be positive")
    spark, q = base.sparkSession, _plain(queries)
    rows = base.where("vec is not null and id is not null").select(F.col("id").cast("long").alias("id"), "vec", "grp")
    schema = f"{_HITS}, grp {rows.schema['grp'].dataType.simpleString()}"

    def best(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, kind = BestOfGroups(k, per_group, metric, arg), None
            for batch in batches:
                kind = batch.column("grp").type
                held.add(shared.value[1], _matrix(batch.column("vec")), batch.column("id").to_numpy(), batch.column("grp"))
            if kind is not None:
                yield held.hits(shared.value[0], kind)

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, groups = BestOfGroups(k, per_group, metric, arg), batch.column("grps")[i].values
                qid, q, n, ids, x, m = (batch.column(c)[i].as_py() for c in ("qids", "qvecs", "qn", "ids", "vecs", "n"))
                held.add(np.frombuffer(q).reshape(n, -1), np.frombuffer(x).reshape(m, -1), np.frombuffer(ids, np.int64), groups)
                yield held.hits(np.frombuffer(qid, np.int64), groups.type)

    if _many(q):
        hits = _chunks(q).toDF("qids", "qvecs", "qn").crossJoin(_chunks(rows)).mapInArrow(meet, schema)
    else:
        parts = [rows.mapInArrow(best(spark.sparkContext.broadcast(b)), schema) for b in _query_blocks(q)]
        hits = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return _of_groups(hits, k, per_group, metric)


def budgeted(hits: DataFrame, most: int, metric: str = "l2") -> DataFrame:
    """A range result cut to at most `most` rows by a smaller radius: the (most + 1)-th best score, strictly."""
    order = F.col("dist").desc() if descending(metric) else F.col("dist").asc()
    edge = hits.orderBy(order).limit(most + 1).agg(F.count("*").alias("n"), (F.min if descending(metric) else F.max)("dist").alias("edge"))
    out = hits.crossJoin(F.broadcast(edge))  # one row
    better = F.col("dist") > F.col("edge") if descending(metric) else F.col("dist") < F.col("edge")
    return out.where((F.col("n") <= most) | better).select("qid", "id", "dist")


def refined(hits: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Hits rescored with the exact vectors and ranked anew."""
    return candidate_join(hits.select("qid", "id"), queries, base, k, metric)


def refined_range(hits: DataFrame, queries: DataFrame, base: DataFrame, metric: str = "l2") -> DataFrame:
    """A range result with exact scores; rows aren't filtered again."""
    return pair_scores(hits.select("qid", "id"), queries, base, metric)


def split_search(queries: DataFrame, parts: list[tuple[DataFrame, int, int]], metric: str = "l2") -> DataFrame:
    """Top-1 over vectors cut into parts [(base, from, size)]: qid, then the best id of each part in an array."""
    found = []
    for i, (base, at, size) in enumerate(parts):
        cut = queries.select("id", F.slice("vec", at + 1, size).alias("vec"))
        found.append(assign(cut, base, metric).select("qid", F.lit(i).alias("part"), "id"))
    every = reduce(DataFrame.unionByName, found).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("part", "id"))).alias("p"))
    return every.select("qid", F.transform("p", lambda x: x["id"]).alias("ids"))


def similarity_graph(base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Each row's k nearest other rows, exactly: src, rank, dst, dist."""
    hits = knn_join(base, base, k, metric, other=True)
    return hits.select(F.col("qid").alias("src"), "rank", F.col("id").alias("dst"), "dist")
