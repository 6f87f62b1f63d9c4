"""Tables that change while they are searched: a first-in first-out window of slices, and searches of a stream.

A slice is a number in the column `slice`. Files of a slice lie together, so dropping or reading slices prunes folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from nearfield.operators.search import knn_join


@dataclass(frozen=True)
class SlidingWindow:
    """Rows (slice, id, ...) of slices [first, after)."""

    rows: DataFrame | None = None
    first: int = 0
    after: int = 0

    def step(self, slice_rows: DataFrame | None, remove_oldest: bool) -> SlidingWindow:
        """Add a slice, or add one and drop the oldest, or only drop the oldest (None)."""
        out = self
        if remove_oldest:
            if self.first == self.after:
                raise ValueError("no slice to remove")
            out = replace(out, first=out.first + 1, rows=out.rows.where(F.col("slice") > self.first))
        if slice_rows is not None:
            new = slice_rows.withColumn("slice", F.lit(self.after).cast("int"))
            out = replace(out, after=out.after + 1, rows=new if out.rows is None else out.rows.unionByName(new))
        return out

    def current(self) -> DataFrame:
        return self.rows.drop("slice")


def last_slices(rows: DataFrame, width: int) -> DataFrame:
    """The rows of the last `width` slices by number; the greatest number is one aggregate."""
    top = rows.agg(F.max("slice").alias("top"))
    return rows.join(F.broadcast(top), F.col("slice") > F.col("top") - width).drop("top")


def search_stream(queries: DataFrame, base: DataFrame, k: int, write: Callable[[DataFrame, int], None], metric: str = "l2") -> DataStreamWriter:
    """Each micro-batch of a stream of queries (id, vec) searched in base; write(result, batch) stores it. Start the
    returned writer with a checkpointLocation: a batch replayed after a failure gives the same result."""

    def one(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            write(knn_join(kept, base, k, metric), number)
        finally:
            kept.unpersist()

    return queries.writeStream.foreachBatch(one)


def add_stream(rows: DataFrame, path: str) -> DataStreamWriter:
    """Each micro-batch of rows (id, vec) becomes one slice under path; a replayed batch overwrites its own slice."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/slice={number}")

    return rows.writeStream.foreachBatch(one)
