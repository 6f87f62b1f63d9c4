"""Graph indexes. NN-descent is an iterated join over the whole table. HNSW and NSG graphs are built per shard, a bounded
number of rows dealt by a hash of the (unique) id; every query walks every shard and the shards' k best are merged.
Distances are squared L2. Null vectors are left out. Rows of a graph hold vectors, or codes of them: then the walk goes
over what the codes give back."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.lineage import cut
from nearfield.operators.search import _matrix, _query_blocks, pair_scores, ranked

#: Rows of a shard on average, and rows of one ring when NN-descent draws its first neighbours.
SHARD_ROWS, RING_ROWS = 20_000, 4_096
#: Orders of rings that the first neighbours come from, and neighbours that NN-descent proposes to each row of a meeting.
RINGS, PROPOSED = 8, 6


def _best_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges (src, dst, dist, new) of each row; an edge is new if it is in all its copies."""
    best = edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
    return ranked(best.withColumnRenamed("dst", "id"), k, key="src").select("src", F.col("id").alias("dst"), "dist", "new")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (via, dst): the vectors that a row knows, compared with each other; pairs of old ones are known."""
    at, ids, fresh, vecs = None, [], [], []

    def met() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(ids)
        if n < 2 or not any(fresh):
            return
        x, who, new = np.array(vecs), np.array(ids), np.array(fresh)
        norms = (x * x).sum(1)
        d = norms[:, None] + norms[None] - 2 * x @ x.T
        d[~(new[:, None] | new[None]) | (who[:, None] == who[None])] = np.inf
        near = np.argpartition(d, min(PROPOSED, n) - 1, 1)[:, :PROPOSED]
        src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
        some = np.isfinite(d[src, dst])
        src, dst = src[some], dst[some]
        yield who[src], who[dst], ((x[src] - x[dst]) ** 2).sum(1)

    for batch in batches:
        out = []
        x = _matrix(batch.column("vec"))
        for i, (via, dst, new) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("via", "dst", "new")), strict=True)):
            if via != at:
                out += met()
                at, ids, fresh, vecs = via, [], [], []
            ids.append(dst)
            fresh.append(new)
            vecs.append(x[i])
        yield _pairs(out)
    yield _pairs(list(met()))


def _pairs(out: list) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["src", "dst", "dist"])


def nn_descent(base: DataFrame, k: int, iterations: int = 8, held: int | None = None, seed: int = 1234, stop: float = 0.001) -> DataFrame:
    """An approximate k-NN graph: src, rank, dst, dist.

    While it runs, `held` neighbours are kept (48 or 6 k). The first are the next ones in RINGS different rings of rows, ordered by hashes.
    In each iteration every row brings together its neighbours and up to `held` rows that have it as theirs (drawn by hash,
    so a hub meets no more than others); pairs of which one is new to it are compared where they meet, and each row is
    proposed its PROPOSED nearest. It ends when at most `stop` of the edges are new."""
    rows = base.where("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    held = held or max(48, 6 * k)
    rings = max(1, -(-rows.count() // RING_ROWS))

    def ring(turn: int) -> DataFrame:
        h = rows.select("id", F.xxhash64("id", F.lit(seed + turn)).alias("h")).withColumn("ring", F.pmod("h", F.lit(rings)))
        after = F.collect_list("id").over(Window.partitionBy("ring").orderBy("h", "id").rowsBetween(1, max(1, held // RINGS)))
        return h.select(F.col("id").alias("src"), after.alias("dsts")).select("src", F.explode("dsts").alias("dst")).where("src <> dst")

    first = reduce(DataFrame.unionByName, [ring(t) for t in range(RINGS)])
    first = first.unionByName(first.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    scored = pair_scores(first.select(F.col("src").alias("qid"), F.col("dst").alias("id")), rows, rows).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")
    edges = cut(_best_edges(scored.withColumn("new", F.lit(True)), held))
    for turn in range(iterations):
        w = Window.partitionBy("via").orderBy(F.xxhash64("via", "dst", F.lit(seed + turn)), "dst")
        back = edges.select(F.col("dst").alias("via"), F.col("src").alias("dst"), "new").withColumn("n", F.row_number().over(w)).where(F.col("n") <= held).drop("n")
        known = edges.select(F.col("src").alias("via"), "dst", "new").unionByName(back).groupBy("via", "dst").agg(F.max("new").alias("new"))
        near = known.join(rows.select(F.col("id").alias("dst"), "vec"), "dst").select("via", "dst", "new", "vec").repartition("via").sortWithinPartitions("via", "dst")
        proposed = near.mapInArrow(_meetings, "src long, dst long, dist double").groupBy("src", "dst").agg(F.min("dist").alias("dist"))
        now = cut(_best_edges(edges.withColumn("new", F.lit(False)).unionByName(proposed.withColumn("new", F.lit(True))), held))
        new, every = now.agg(F.count(F.when(F.col("new"), 1)), F.count("*")).first()
        edges = now
        if new <= stop * every:
            break
    out = ranked(edges.select("src", F.col("dst").alias("id"), "dist"), k, key="src")
    return out.select("src", "rank", F.col("id").alias("dst"), "dist")


def _walk(q: np.ndarray, x: np.ndarray, links: Callable[[int], list[int]], start: int, ef: int) -> list[tuple[float, int]]:
    """Best-first from start with a list of ef: (squared distance, row), best first."""
    d = float(((x[start] - q) ** 2).sum())
    todo, best, seen = [(d, start)], [(-d, start)], {start}
    while todo:
        d, at = heapq.heappop(todo)
        if len(best) >= ef and d > -best[0][0]:
            break
        fresh = [j for j in links(at) if j not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        for dj, j in zip(((x[fresh] - q) ** 2).sum(1).tolist(), fresh, strict=True):
            if len(best) < ef or dj < -best[0][0]:
                heapq.heappush(todo, (dj, j))
                heapq.heappush(best, (-dj, j))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted((-d, j) for d, j in best)


def _spread(found: list[tuple[float, int]], x: np.ndarray, most: int) -> list[int]:
    """Of candidates by distance, those nearer to the point than to any one kept before; room that is left goes to the
    nearest of the others, since sets in which a few rows are near to all would otherwise keep hardly a link."""
    kept, others = [], []
    for d, j in found:
        if len(kept) >= most:
            break
        if not kept or (((x[kept] - x[j]) ** 2).sum(1) >= d).all():
            kept.append(j)
        else:
            others.append(j)
    return kept + others[: most - len(kept)]


def _reaching_all(out: list[list[int]], x: np.ndarray, root: int) -> None:
    """Links from the nearest row that is reached to rows that aren't, until all are."""
    reached, todo = np.zeros(len(x), bool), [root]
    reached[root] = True
    while True:
        while todo:
            fresh = [j for j in out[todo.pop()] if not reached[j]]
            reached[fresh] = True
            todo += fresh
        if reached.all():
            return
        lost, have = int(np.flatnonzero(~reached)[0]), np.flatnonzero(reached)
        out[have[((x[have] - x[lost]) ** 2).sum(1).argmin()]].append(lost)
        reached[lost] = True
        todo = [lost]


def _sorted_by(i: int, others: list[int], x: np.ndarray) -> list[tuple[float, int]]:
    return sorted(zip(((x[others] - x[i]) ** 2).sum(1).tolist(), others, strict=True))


def _pruned_knn(x: np.ndarray, m: int, pool: int) -> list[list[int]]:
    """For each row links to m of its `pool` exactly nearest, spread, and with the links of others turned back to 2 m."""
    n, norms, out = len(x), (x * x).sum(1), []
    for a in range(0, n, 256):
        d = norms[a : a + 256, None] + norms[None] - 2 * x[a : a + 256] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, min(pool, n) - 1, 1)[:, :pool]
        out += [_spread(_sorted_by(a + i, [j for j in row.tolist() if j != a + i], x), x, m) if n > 1 else [] for i, row in enumerate(near)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, links in enumerate(out):
        for j in links:
            back[j].append(i)
    return [_spread(_sorted_by(i, sorted({*links, *back[i]}), x), x, 2 * m) if links else links for i, links in enumerate(out)]


def _hnsw_links(x: np.ndarray, m: int, pool: int, seed: int) -> list[list[list[int]]]:
    """Per row, its links on each of its levels. A shard is small enough to find each level's candidates exactly, which is
    quicker and loses less than walking the unfinished graph for them."""
    tops = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(m)).astype(int)
    out: list[list[list[int]]] = [[] for _ in range(len(x))]
    for level in range(int(tops.max(initial=-1)) + 1):
        here = np.flatnonzero(tops >= level)
        links = _pruned_knn(x[here], m if level == 0 else max(1, m // 2), pool)
        # from the row that a search enters by, all others of the level are reached
        _reaching_all(links, x[here], int(np.flatnonzero(here == int(tops.argmax()))[0]))
        for i, own in zip(here.tolist(), links, strict=True):
            out[i].append(here[own].tolist())
    return out


def _nsg_links(x: np.ndarray, m: int, pool: int) -> tuple[list[list[list[int]]], int]:
    """A pruned exact k-NN graph in which the row nearest to the mean reaches all others; and that row."""
    out = _pruned_knn(x, m, pool)
    root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    _reaching_all(out, x, root)
    return [[links] for links in out], root


_GRAPH = "shard int, id long, vec array<double>, links array<array<long>>, entry boolean"


def _vectors(part: pd.DataFrame, codec: Any) -> np.ndarray:
    x = np.array(part["vec"].tolist(), np.float64)
    return x if codec is None else codec.decode_matrix(x)


def _graph_of(part: pd.DataFrame) -> tuple[list, int]:
    place = {int(v): i for i, v in enumerate(part["id"])}
    links = [[[place[int(v)] for v in level] for level in levels] for levels in part["links"]]
    return links, int(np.flatnonzero(part["entry"].to_numpy())[0])


def _start(v: np.ndarray, x: np.ndarray, links: list, entry: int) -> int:
    at = entry
    for level in range(len(links[entry]) - 1, 0, -1):
        at = _walk(v, x, lambda j, lv=level: links[j][lv], at, 1)[0][1]
    return at


def _finder(shared, k: int, ef: int, codec: Any):
    def find(part: pd.DataFrame) -> pd.DataFrame:
        qids, q = shared.value
        x, ids, hits = _vectors(part, codec), part["id"].to_numpy(), []
        links, entry = _graph_of(part)
        for qid, v in zip(qids.tolist(), q, strict=True):
            hits += [(qid, int(ids[j]), d) for d, j in _walk(v, x, lambda j: links[j][0], _start(v, x, links, entry), max(ef, k))[:k]]
        return pd.DataFrame(hits, columns=["qid", "id", "dist"])

    return find


def _ranger(shared, radius: float, ef: int, codec: Any):
    """All rows within the radius that can be reached through such rows from the ef best."""

    def find(part: pd.DataFrame) -> pd.DataFrame:
        qids, q = shared.value
        x, ids, hits = _vectors(part, codec), part["id"].to_numpy(), []
        links, entry = _graph_of(part)
        for qid, v in zip(qids.tolist(), q, strict=True):
            near = {j: d for d, j in _walk(v, x, lambda j: links[j][0], _start(v, x, links, entry), ef)}
            todo, seen = [j for j, d in near.items() if d < radius], set(near)
            within = {j: near[j] for j in todo}
            while todo:
                fresh = [j for j in links[todo.pop()][0] if j not in seen]
                seen.update(fresh)
                for j in fresh:
                    d = float(((x[j] - v) ** 2).sum())
                    if d < radius:
                        within[j] = d
                        todo.append(j)
            hits += [(qid, int(ids[j]), d) for j, d in within.items()]
        return pd.DataFrame(hits, columns=["qid", "id", "dist"])

    return find


@dataclass(frozen=True)
class GraphIndex:
    """Rows (shard, id, vec, links per level, entry); links hold ids of the same shard. With a codec (encode_matrix,
    decode_matrix), vec is the code."""

    rows: DataFrame
    codec: Any = None

    @classmethod
    def build(cls, base: DataFrame, kind: str = "hnsw", m: int = 32, ef: int = 40, seed: int = 1234, shard_rows: int = SHARD_ROWS, codec: Any = None) -> GraphIndex:
        rows = base.where("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        shards = max(1, -(-rows.count() // shard_rows))

        def make(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("id").reset_index(drop=True)
            x, ids = np.array(part["vec"].tolist(), np.float64), part["id"].to_numpy()
            if codec is not None:
                codes = codec.encode_matrix(x)
                x = codec.decode_matrix(codes)
                part["vec"] = codes.astype(np.float64).tolist()
            if kind == "nsg":
                links, entry = _nsg_links(x, m, 4 * m)
            else:
                links = _hnsw_links(x, m, max(ef, 4 * m), seed)
                entry = max(range(len(x)), key=lambda i: (len(links[i]), -i))
            return part.assign(links=[[ids[lv].tolist() for lv in levels] for levels in links], entry=np.arange(len(x)) == entry)[["shard", "id", "vec", "links", "entry"]]

        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        return cls(cut(dealt.groupBy("shard").applyInPandas(make, _GRAPH)), codec)

    def _over(self, queries: DataFrame, find) -> DataFrame:
        spark, parts = self.rows.sparkSession, []
        for block in _query_blocks(queries):
            parts.append(self.rows.groupBy("shard").applyInPandas(find(spark.sparkContext.broadcast(block)), "qid long, id long, dist double"))
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "qid long, id long, dist double")

    def search(self, queries: DataFrame, k: int, ef: int = 16) -> DataFrame:
        return ranked(self._over(queries, lambda shared: _finder(shared, k, ef, self.codec)), k).select("qid", "rank", "id", "dist")

    def range_search(self, queries: DataFrame, radius: float, ef: int = 64) -> DataFrame:
        """qid, id, dist of rows found within the radius (squared)."""
        return self._over(queries, lambda shared: _ranger(shared, radius, ef, self.codec))

    def neighbours(self) -> DataFrame:
        """id, level, place, neighbour: the links as a table."""
        levels = self.rows.select("id", F.posexplode("links").alias("level", "l"))
        return levels.select("id", "level", F.posexplode("l").alias("place", "neighbour"))

    def write(self, path: str) -> None:
        self.rows.write.parquet(path)
