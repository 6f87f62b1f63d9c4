"""k-means and its variants. An iteration is one pass over the rows: assign, partial sums per task, one row per cluster."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.search import _matrix, best_of


@dataclass(frozen=True)
class Clusters:
    centroids: np.ndarray
    objectives: list[float]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "list_no int, vec array<double>")


def _assigned(x: np.ndarray, c: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties to the smallest number) and the squared distance or inner product."""
    best = best_of(x, c, "ip" if spherical else "l2")
    return best, (x * c[best]).sum(1) if spherical else ((x - c[best]) ** 2).sum(1)


def _sum_rows(shared, spherical: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, mass, count, objective = np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c), np.int64), np.zeros(len(c))
        for batch in batches:
            x, w = _matrix(batch.column("vec")), batch.column("w").to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            if not np.isfinite(x).all():
                raise ValueError("NaN or infinite elements")
            near, score = _assigned(x, c, spherical)
            np.add.at(sums, near, x * w[:, None])
            mass += np.bincount(near, w, len(c))
            count += np.bincount(near, minlength=len(c))
            objective += np.bincount(near, score * w, len(c))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(count[some]), pa.array(mass[some]), pa.array(objective[some]), pa.array(sums[some].tolist(), pa.list_(pa.float64()))],
            names=["c", "n", "mass", "objective", "sums"],
        )

    return rows


def step(rows: DataFrame, c: np.ndarray, weight: str | None = None, spherical: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """One Lloyd step over rows (vec): new means (old where a cluster is empty), sizes, objective before the step."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(c, np.float64))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    parts = rows.where("vec is not null").select("vec", w.alias("w")).mapInArrow(_sum_rows(shared, spherical), "c long, n long, mass double, objective double, sums array<double>")
    d = c.shape[1]
    got = parts.groupBy("c").agg(
        F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.sum("objective").alias("objective"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(d))).alias("sums")
    ).collect()  # a row per cluster
    out, sizes, objective = np.array(c, np.float64), np.zeros(len(c), np.int64), 0.0
    for r in got:
        sizes[r["c"]] = r["n"]
        objective += r["objective"]
        if r["mass"] > 0:
            out[r["c"]] = np.array(r["sums"]) / r["mass"]
    return out, sizes, objective


def split_empty(c: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> int:
    """Empty clusters take half of a donor, drawn by size, moved by 1/1024 in alternating directions."""
    n_split, n, k = 0, int(sizes.sum()), len(c)
    for e in np.flatnonzero(sizes == 0):
        p = np.maximum(sizes - 1, 0) / max(1, n - k)
        if p.sum() == 0:
            break
        donor = int(rng.choice(k, p=p / p.sum()))
        sign = np.where(np.arange(c.shape[1]) % 2 == 0, 1.0, -1.0) / 1024
        c[e] = c[donor] * (1 + sign)
        c[donor] = c[donor] * (1 - sign)
        sizes[e] = sizes[donor] // 2
        sizes[donor] -= sizes[e]
        n_split += 1
    return n_split


def _sample(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    got = rows.where("vec is not null").withColumn("h", F.xxhash64(F.lit(seed), "vec")).orderBy("h").limit(n).select("vec").toPandas()
    return np.array(got["vec"].tolist(), np.float64)


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on a sample: each next centroid drawn with its squared distance to those before."""
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = near.sum()
        nxt = int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(nxt)
        near = np.minimum(near, ((x - x[nxt]) ** 2).sum(1))
    return x[chosen]


def _afk_mc2(x: np.ndarray, k: int, rng: np.random.Generator, chain: int = 50) -> np.ndarray:
    """AFK-MC2 on a sample: Metropolis chains over a mixture of squared distance to the first centroid and uniform."""
    first = int(rng.integers(len(x)))
    d = ((x - x[first]) ** 2).sum(1)
    q = 0.5 * d / max(d.sum(), 1e-300) + 0.5 / len(x)
    q /= q.sum()
    chosen = [first]
    while len(chosen) < k:
        cand = rng.choice(len(x), chain, p=q)
        dist = ((x[cand][:, None] - x[chosen][None]) ** 2).sum(2).min(1)
        at = 0
        for j in range(1, chain):
            if dist[at] * q[cand[j]] == 0 or dist[j] * q[cand[at]] / (dist[at] * q[cand[j]]) > rng.random():
                at = j
        if cand[at] in chosen:
            rest = np.setdiff1d(np.arange(len(x)), chosen)
            chosen.append(int(rng.choice(rest)))
        else:
            chosen.append(int(cand[at]))
    return x[chosen]


def kmeans(
    rows: DataFrame, k: int, iterations: int = 25, redo: int = 1, seed: int = 1234, init: str | np.ndarray = "random", weight: str | None = None,
    spherical: bool = False, integer: bool = False, frozen: int = 0, tolerance: float = 0.0, sample_per_centroid: int = 256, max_points: int | None = None,
) -> Clusters:
    """Lloyd's iterations over all rows (vec), or over about max_points a centroid, those with the smallest seeded hashes of
    the vector; the best of `redo` runs. Initial centroids come from a bounded sample
    (k * sample_per_centroid rows by seeded hash): random, "++", "afkmc2", or given. Stops early when the objective
    changes by no more than `tolerance` of itself."""
    best: Clusters | None = None
    if max_points is not None and (n := rows.where("vec is not null").count()) > max_points * k:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec"), F.lit(1 << 30)) < int((1 << 30) * max_points * k / n))
    pool = None if isinstance(init, np.ndarray) else _sample(rows, k * (1 if init == "random" else sample_per_centroid), seed)
    if pool is not None and len(pool) < k:
        raise ValueError("fewer rows than clusters")
    for turn in range(redo):
        rng = np.random.default_rng(seed + turn)
        if isinstance(init, np.ndarray):
            c = init.astype(np.float64).copy()
        elif init == "++":
            c = _plus_plus(pool, k, rng)
        elif init == "afkmc2":
            c = _afk_mc2(pool, k, rng)
        else:
            c = _sample(rows, k, seed + turn) if turn else pool[:k].copy()
        objectives: list[float] = []
        for _ in range(iterations):
            new, sizes, objective = step(rows, c, weight, spherical)
            objectives.append(objective)
            split_empty(new, sizes, rng)
            if spherical:
                new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-30)
            if integer:
                new = np.rint(new)
            new[:frozen] = c[:frozen]
            c = new
            if len(objectives) > 1 and abs(objectives[-2] - objectives[-1]) <= tolerance * abs(objectives[-2]):
                break
        better = best is None or (objectives[-1] > best.objectives[-1] if spherical else objectives[-1] < best.objectives[-1])
        if better:
            best = Clusters(c, objectives)
    return best


def kmeans_codes(rows: DataFrame, decode, k: int, **kw) -> Clusters:
    """k-means of vectors that are kept as codes: rows (id, code), decode(rows) to (id, vec)."""
    return kmeans(decode(rows), k, **kw)


def kmeans_sparse(rows: DataFrame, d: int, k: int, iterations: int = 10, seed: int = 1234) -> Clusters:
    """k-means of sparse rows (dims array<int>, vals array<double>, rising dims) of d dimensions; centroids are dense. A
    row is compared by its own dimensions: |c|^2 - 2 <x, c>."""
    some = rows.where("dims is not null and vals is not null").select("dims", "vals")
    first = some.withColumn("h", F.xxhash64(F.lit(seed), "dims", "vals")).orderBy("h").limit(k).toPandas()  # k rows
    if len(first) < k:
        raise ValueError("fewer rows than clusters")
    c = np.zeros((k, d))
    for i, (dims, vals) in enumerate(zip(first["dims"], first["vals"], strict=True)):
        c[i, dims] = vals
    objectives: list[float] = []
    for _ in range(iterations):
        shared = rows.sparkSession.sparkContext.broadcast(c)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            norms, total, n, cost = (c * c).sum(1), np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))
            for batch in batches:
                for dims, vals in zip(batch.column("dims").to_pylist(), batch.column("vals").to_pylist(), strict=True):
                    v = np.array(vals)
                    s = norms - 2 * c[:, dims] @ v
                    at = int(s.argmin())
                    total[at, dims] += v
                    n[at] += 1
                    cost[at] += float(s[at] + v @ v)
            at, dim = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dim), pa.array(total[at, dim]), pa.array(np.zeros(len(at), np.int64))], names=["c", "dim", "x", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(np.full(len(c), -1)), pa.array(cost), pa.array(n)], names=["c", "dim", "x", "n"])

        got = some.mapInArrow(sums, "c long, dim long, x double, n long").groupBy("c", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()  # k (d + 1) rows
        heads, body = got[got["dim"] < 0], got[got["dim"] >= 0]
        sizes, new = np.zeros(k), np.zeros((k, d))
        sizes[heads["c"]] = heads["n"]
        new[body["c"], body["dim"]] = body["x"]
        c = np.where(sizes[:, None] > 0, new / np.maximum(1, sizes)[:, None], c)
        objectives.append(float(heads["x"].sum()))
    return Clusters(c, objectives)


def kmeans_1d(values: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Exact 1-D k-means of a bounded column by dynamic programming with divide and conquer: centroids, objective."""
    x = np.sort(np.asarray(values, np.float64))
    n = len(x)
    s, q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        m = j - i
        return np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / m, 0.0)

    before = np.concatenate(([0.0], [cost(np.array([0]), j)[0] for j in range(1, n + 1)]))
    cuts = [np.zeros(n + 1, np.int64)]
    for c in range(1, min(k, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        todo = [(c + 1, n, c, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid - 1, b) + 1)
            total = before[i] + cost(i, mid)
            best = int(total.argmin())
            now[mid], cut[mid] = total[best], i[best]
            todo += [(lo, mid - 1, a, int(i[best])), (mid + 1, hi, int(i[best]), b)]
        before = now
        cuts.append(cut)
    edges, j = [n], n
    for cut in reversed(cuts[1:]):
        j = int(cut[j])
        edges.append(j)
    edges.append(0)
    edges = edges[::-1]
    return np.array([(s[b] - s[a]) / (b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a]), float(before[n])


def shares(sizes: np.ndarray, k: int) -> np.ndarray:
    """k parts in proportion to the sizes, at least one for each that has rows, none larger than its size."""
    sizes = np.asarray(sizes, np.int64)
    out = np.minimum(np.maximum((sizes * k) // max(1, sizes.sum()), sizes > 0), sizes)
    while out.sum() != k:
        room = sizes - out if out.sum() < k else np.where(out > 1, 1, 0)
        if not room.any():
            break
        gap = np.where(room > 0, (sizes * k / sizes.sum() - out) * (1 if out.sum() < k else -1), -np.inf)
        out[int(gap.argmax())] += 1 if out.sum() < k else -1
    return out


def two_level(rows: DataFrame, first: int, k: int, iterations: int = 25, seed: int = 1234, sample_per_centroid: int = 256) -> np.ndarray:
    """k centroids by k-means into `first` clusters, then within each into a share of k in proportion to its rows.

    The second level fits each cluster on at most sample_per_centroid rows a centroid, those with the smallest seeded
    hash, so no task holds a whole cluster."""
    top = kmeans(rows, first, iterations, seed=seed)
    shared = rows.sparkSession.sparkContext.broadcast(top.centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _assigned(_matrix(batch.column("vec")), shared.value, False)[0]
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("vec")], names=["c", "vec"])

    placed = rows.where("vec is not null").select("vec").mapInArrow(place, f"c int, vec {rows.schema['vec'].dataType.simpleString()}")
    sizes = np.zeros(first, np.int64)
    for r in placed.groupBy("c").count().collect():  # a row per cluster
        sizes[r["c"]] = r["count"]
    parts = shares(sizes, k)
    most = F.get(F.array(*(F.lit(int(p) * sample_per_centroid) for p in parts)), F.col("c"))
    w = Window.partitionBy("c").orderBy(F.xxhash64(F.lit(seed), "vec"))
    some = placed.withColumn("n", F.row_number().over(w)).where(F.col("n") <= int(parts.max()) * sample_per_centroid).where(F.col("n") <= most).drop("n")

    def split(part: pd.DataFrame) -> pd.DataFrame:
        from nearfield.operators.additive import lloyd

        c = int(part["c"].iloc[0])
        found = lloyd(np.array(part["vec"].tolist(), np.float64), int(parts[c]), iterations, np.random.default_rng(seed + c))
        return pd.DataFrame({"c": c, "place": range(len(found)), "vec": found.tolist()})

    got = some.groupBy("c").applyInPandas(split, "c int, place int, vec array<double>").orderBy("c", "place").collect()  # k rows
    return np.array([r["vec"] for r in got])


def progressive(rows: DataFrame, k: int, stages: int = 10, iterations: int = 10, axes: bool = True, seed: int = 1234) -> np.ndarray:
    """k-means over a growing number of leading dimensions (after PCA if axes), each stage from the centroids before."""
    from nearfield.operators.transforms import pca

    d = int(rows.agg(F.max(F.size("vec"))).first()[0])
    turned = pca(rows, d) if axes else None
    x = rows if turned is None else turned.apply(rows.select("vec"))
    c = np.zeros((k, 0))
    for stage in range(stages):
        n = int(round(d ** ((stage + 1) / stages)))
        if n == c.shape[1]:
            continue
        cut = x.select(F.slice("vec", 1, n).alias("vec"))
        start = np.hstack((c, np.zeros((k, n - c.shape[1])))) if c.shape[1] else "random"
        c = kmeans(cut, k, iterations, seed=seed, init=start).centroids
    return c if turned is None else (c - turned.b) @ turned.a
