"""Inverted files: rows partitioned by their nearest centroid, searched in a query's nearest lists.

An inverted file is a table (list_no, id, vec) and a bounded table of centroids (list_no, vec). A search sends a block of
queries, with the lists that each probes, to the rows where they are: a task scores its rows list by list against the
queries of that list and keeps the k best of each, so no row is shuffled and a long list is shared by all tasks that hold
rows of it. A table written with partitionBy("list_no") reads only the probed lists. Ids are stable: nothing renumbers
them unless asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.metrics import descending
from nearfield.functions.vectors import minus
from nearfield.operators.search import BLOCK_ELEMENTS, BLOCK_QUERIES, _matrix, _scores, best_of, candidate_join, knn_join, ranked, searched, within_radius

#: Elements of centroids that are sent to tasks at most; more lists than that need product cells.
CENTROID_ELEMENTS = 32_000_000
#: Probed lists that a scan of the rows is restricted to by name at most.
NAMED_LISTS = 1_000


def _centroids(c: DataFrame) -> DataFrame:
    return c.select(F.col("list_no").cast("long").alias("id"), "vec")


def probed_blocks(queries: DataFrame, probes: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray]]:
    """Blocks of queries (id, vec) with their probes (qid, list_no): qids, vectors, the query numbers of each list, lists."""
    asked = probes.select("qid", "list_no").join(queries.where("vec is not null").select(F.col("id").alias("qid"), "vec"), "qid")
    asked = asked.groupBy("qid").agg(F.first("vec").alias("vec"), F.collect_set("list_no").alias("lists"))
    total, width = asked.agg(F.count("*"), F.max(F.size("vec") + F.size("lists"))).first()
    blocks = -(-total // max(1, min(BLOCK_QUERIES, BLOCK_ELEMENTS // max(1, width or 1))))
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        got = part.toArrow().combine_chunks()
        if not got.num_rows:
            continue
        vecs, lists = (got.column(c).chunk(0) for c in ("vec", "lists"))
        flat, number = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(flat, kind="stable")
        names, first = np.unique(flat[order], return_index=True)
        yield got.column("qid").to_numpy(), _matrix(vecs), dict(zip(names.tolist(), np.split(number[order], first[1:]), strict=True)), names


def runs_of_lists(batch: pa.RecordBatch, asked: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each probed list in a batch: its number, the places of its rows, the numbers of the queries that probe it."""
    lists = batch.column("list_no").to_numpy()
    order = np.argsort(lists, kind="stable")
    names, first = np.unique(lists[order], return_index=True)
    for name, places in zip(names.tolist(), np.split(order, first[1:]) if len(names) else [], strict=True):
        if name in asked:
            yield name, places, asked[name]


def named_lists(rows: DataFrame, names: np.ndarray) -> DataFrame:
    """rows of few enough lists by their names, so that folders of other lists aren't read."""
    return rows.where(F.col("list_no").isin(names.tolist())) if len(names) <= NAMED_LISTS else rows


def _in_lists(metric: str):
    def scored(shared, batch: pa.RecordBatch, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        _, q, asked = shared
        x = _matrix(batch.column("vec")) if batch.num_rows else None
        for _, places, who in runs_of_lists(batch, asked):
            for i, at, s in _scores(q[who], x[places], metric, 2.0, keep):
                yield int(who[i]), places[at], s

    return scored


@dataclass(frozen=True)
class InvertedFile:
    rows: DataFrame
    centroids: DataFrame
    metric: str = "l2"

    @cached_property
    def _lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and vectors of the centroids, by number."""
        n, d = self.centroids.agg(F.count("*"), F.max(F.size("vec"))).first()
        if n * (d or 0) > CENTROID_ELEMENTS:
            raise ValueError("too many centroids to send to every task: use product cells")
        got = self.centroids.select("list_no", "vec").toArrow().combine_chunks().sort_by("list_no")
        return got.column("list_no").to_numpy().astype(np.int64), _matrix(got.column("vec").combine_chunks()) if n else np.zeros((0, 0))

    @classmethod
    def build(cls, base: DataFrame, centroids: DataFrame, metric: str = "l2") -> InvertedFile:
        """Each row (id, vec) goes to its best centroid (list_no, vec), the lowest number of equals."""
        empty = cls(base.select(F.lit(0).alias("list_no"), "id", "vec").limit(0), centroids, metric)
        return replace(empty, rows=empty.assigned(base))

    def assigned(self, base: DataFrame) -> DataFrame:
        """list_no, id, vec; null vectors are left out."""
        rows = base.where("vec is not null").select("id", "vec")
        shared = rows.sparkSession.sparkContext.broadcast(self._lists)
        metric = self.metric

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, c = shared.value
            for batch in batches:
                if batch.num_rows:
                    best = numbers[best_of(_matrix(batch.column("vec")), c, metric)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(best), batch.column("id"), batch.column("vec")], names=["list_no", "id", "vec"])

        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "vec"))
        return rows.mapInArrow(place, f"list_no int, {kinds}")

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """qid, list_no, rank, coarse: the nprobe best lists of each query."""
        hits = knn_join(queries, _centroids(self.centroids), nprobe, self.metric)
        return hits.select("qid", F.col("id").cast("int").alias("list_no"), "rank", F.col("dist").alias("coarse"))

    def hits(self, queries: DataFrame, probes: DataFrame, k: int | None = None, radius: float | None = None, where: Column | None = None) -> DataFrame:
        """qid, id, dist in the given (qid, list_no): rows that hold the k best, or all within the radius."""
        rows = (self.rows if where is None else self.rows.where(where)).where("vec is not null").select("list_no", F.col("id").cast("long").alias("id"), "vec")
        sc, parts = rows.sparkSession.sparkContext, []
        for qid, q, asked, names in probed_blocks(queries, probes):
            parts.append(searched(named_lists(rows, names), sc.broadcast((qid, q, asked)), _in_lists(self.metric), self.metric, k, radius))
        return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], "qid long, id long, dist double")

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, where: Column | None = None) -> DataFrame:
        return self.search_preassigned(queries, self.probes(queries, nprobe), k, where)

    def search_preassigned(self, queries: DataFrame, probes: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        return ranked(self.hits(queries, probes, k, where=where), k, self.metric).select("qid", "rank", "id", "dist")

    def search_with(self, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
        """Results with list_no and what is stored: the vector, or a code."""
        return self.search(queries, k, nprobe).join(self.rows, "id").select("qid", "rank", "id", "dist", *(c for c in self.rows.columns if c != "id"))

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1) -> DataFrame:
        return within_radius(self.hits(queries, self.probes(queries, nprobe), radius=radius), radius, self.metric)

    def search_budgeted(self, queries: DataFrame, k: int, nprobe: int, max_codes: int) -> DataFrame:
        """Lists in probe order until max_codes rows were scanned; the last list is scanned in id order up to the rest."""
        sizes = self.rows.groupBy("list_no").agg(F.count("*").alias("size"))
        probes = self.probes(queries, nprobe).join(sizes, "list_no", "left").na.fill({"size": 0})
        w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        probes = probes.withColumn("room", F.lit(max_codes) - F.coalesce(F.sum("size").over(w), F.lit(0))).where("room > 0")
        # at most max_codes rows of a list can be scanned: a limit per list, which is applied before rows are shuffled
        place = F.row_number().over(Window.partitionBy("list_no").orderBy("id"))
        rows = self.rows.where("vec is not null").withColumn("place", place).where(F.col("place") <= max_codes)
        pairs = probes.select("qid", "list_no", "room").join(rows.select("list_no", "id", "place"), "list_no").where("place <= room")
        return candidate_join(pairs.select("qid", "id"), queries, rows.select("id", "vec"), k, self.metric)

    def residuals(self) -> DataFrame:
        """list_no, id, vec minus its centroid."""
        c = self.centroids.select("list_no", F.col("vec").alias("c"))
        return self.rows.join(c, "list_no").select("list_no", "id", minus(F.col("vec"), F.col("c")).alias("vec"))

    # --- changes: each gives a new inverted file

    def add(self, base: DataFrame) -> InvertedFile:
        return replace(self, rows=self.rows.unionByName(self.assigned(base)))

    def merge(self, other: InvertedFile, add_id: int = 0) -> InvertedFile:
        _require_compatible(self, other)
        return replace(self, rows=self.rows.unionByName(other.rows.withColumn("id", F.col("id") + add_id)))

    def remove(self, where: Column) -> InvertedFile:
        return replace(self, rows=self.rows.where(~F.coalesce(where, F.lit(False))))

    def update(self, changed: DataFrame) -> InvertedFile:
        """Rows of changed (id, vec) replace those of the same id."""
        kept = self.rows.join(changed.select("id").distinct(), "id", "left_anti").select(*self.rows.columns)
        return replace(self, rows=kept).add(changed)

    def reset(self) -> InvertedFile:
        return replace(self, rows=self.rows.limit(0))

    # --- subsets

    def ids_between(self, low: int, high: int) -> InvertedFile:
        return replace(self, rows=self.rows.where((F.col("id") >= low) & (F.col("id") < high)))

    def ids_modulo(self, n: int, rest: int) -> InvertedFile:
        return replace(self, rows=self.rows.where(F.pmod("id", F.lit(n)) == rest))

    def elements_between(self, low: int, high: int) -> InvertedFile:
        """Of all rows in list and id order, those at places [low, high): list sizes give each list its first place."""
        sizes = self.rows.groupBy("list_no").agg(F.count("*").alias("size"))  # a row per list
        first = F.coalesce(F.sum("size").over(Window.orderBy("list_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = self.rows.withColumn("place", F.row_number().over(Window.partitionBy("list_no").orderBy("id")) - 1)
        rows = rows.join(sizes.select("list_no", first.alias("first")), "list_no").where((F.col("place") + F.col("first") >= low) & (F.col("place") + F.col("first") < high))
        return replace(self, rows=rows.select("list_no", "id", "vec"))

    def list_share(self, n: int, part: int) -> InvertedFile:
        """Part `part` of n of every list, in id order."""
        size = F.count("*").over(Window.partitionBy("list_no"))
        place = F.row_number().over(Window.partitionBy("list_no").orderBy("id")) - 1
        rows = self.rows.withColumn("size", size).withColumn("place", place)
        rows = rows.where((F.col("place") >= F.floor(F.col("size") * part / n)) & (F.col("place") < F.floor(F.col("size") * (part + 1) / n)))
        return replace(self, rows=rows.select("list_no", "id", "vec"))

    def lists_between(self, low: int, high: int) -> InvertedFile:
        return replace(self, rows=self.rows.where((F.col("list_no") >= low) & (F.col("list_no") < high)))

    # --- views of the lists

    def sizes(self) -> DataFrame:
        return self.rows.groupBy("list_no").agg(F.count("*").alias("size"))

    def without_long_lists(self, maxsize: int) -> InvertedFile:
        """Lists of maxsize rows or more are empty."""
        short = self.sizes().where(F.col("size") < maxsize).select("list_no")
        return replace(self, rows=self.rows.join(short, "list_no", "left_semi").select(*self.rows.columns))

    def capped(self, maxsize: int) -> InvertedFile:
        """The first maxsize rows of each list."""
        place = F.row_number().over(Window.partitionBy("list_no").orderBy("id"))
        return replace(self, rows=self.rows.withColumn("place", place).where(F.col("place") <= maxsize).drop("place"))

    def masked_by(self, other: InvertedFile) -> InvertedFile:
        """Own lists, and the other's where the own list is empty."""
        mine = self.rows.select("list_no").distinct()
        return replace(self, rows=self.rows.unionByName(other.rows.join(mine, "list_no", "left_anti").select(*self.rows.columns)))

    def permuted(self, numbers: DataFrame) -> InvertedFile:
        """Lists renumbered by (list_no, new_no)."""
        def moved(t: DataFrame) -> DataFrame:
            return t.join(F.broadcast(numbers), "list_no").withColumn("list_no", F.col("new_no")).drop("new_no")  # a row per list

        return replace(self, rows=moved(self.rows).select("list_no", "id", "vec"), centroids=moved(self.centroids).select("list_no", "vec"))

    def shard(self, n: int, i: int) -> InvertedFile:
        """The lists with list_no mod n = i."""
        return replace(self, rows=self.rows.where(F.pmod("list_no", F.lit(n)) == i))

    def shards_to(self, path: str, shard_of: Column) -> None:
        """Write a folder shard=i of rows for each value of shard_of, a column made from list_no, and the centroids beside."""
        self.rows.withColumn("shard", shard_of).write.partitionBy("shard", "list_no").parquet(f"{path}/rows")
        self.centroids.withColumn("shard", shard_of).write.partitionBy("shard").parquet(f"{path}/centroids")

    def sorted_by_size(self) -> InvertedFile:
        """Lists renumbered by falling size, equal sizes by number."""
        sizes = self.centroids.select("list_no").join(self.sizes(), "list_no", "left").na.fill({"size": 0})
        order = F.row_number().over(Window.orderBy(F.col("size").desc(), "list_no")) - 1  # a row per list
        return self.permuted(sizes.select("list_no", order.cast("int").alias("new_no")))

    def shifted(self, by: int) -> InvertedFile:
        """All list numbers moved, so that files can be stacked list after list."""
        return replace(self, rows=self.rows.withColumn("list_no", (F.col("list_no") + by).cast("int")), centroids=self.centroids.withColumn("list_no", (F.col("list_no") + by).cast("int")))

    def stats(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """One row: nq, nlist (lists probed), ndis (rows compared)."""
        probed = self.probes(queries, nprobe).join(self.sizes(), "list_no", "left")
        return probed.agg(F.countDistinct("qid").alias("nq"), F.count("*").alias("nlist"), F.coalesce(F.sum("size"), F.lit(0)).alias("ndis"))

    def write(self, path: str) -> None:
        self.rows.write.partitionBy("list_no").parquet(f"{path}/rows")
        self.centroids.write.parquet(f"{path}/centroids")

    @classmethod
    def read(cls, spark, path: str, metric: str = "l2") -> InvertedFile:
        return cls(spark.read.parquet(f"{path}/rows").select("list_no", "id", "vec"), spark.read.parquet(f"{path}/centroids"), metric)


def _require_compatible(a: InvertedFile, b: InvertedFile) -> None:
    if a.centroids is not b.centroids and not compatible(a, b) or a.metric != b.metric:
        raise ValueError("inverted files of different centroids or metrics")


def stacked(files: list[InvertedFile]) -> InvertedFile:
    """The same lists of several inverted files side by side."""
    for f in files[1:]:
        _require_compatible(files[0], f)
    return replace(files[0], rows=reduce(DataFrame.unionByName, [f.rows for f in files]))


def stacked_lists(files: list[InvertedFile]) -> InvertedFile:
    """The lists of several inverted files one after the other; those of a later file are numbered behind."""
    out, after = [], 0
    for f in files:
        if f.metric != files[0].metric:
            raise ValueError("inverted files of different metrics")
        out.append(f.shifted(after))
        after += (f.centroids.agg(F.max("list_no")).first()[0] or 0) + 1
    return InvertedFile(reduce(DataFrame.unionByName, [f.rows for f in out]), reduce(DataFrame.unionByName, [f.centroids for f in out]), files[0].metric)


def compatible(a: InvertedFile, b: InvertedFile) -> bool:
    """The same metric and centroids: what may be merged."""
    return a.metric == b.metric and a.centroids.exceptAll(b.centroids).isEmpty() and b.centroids.exceptAll(a.centroids).isEmpty()
