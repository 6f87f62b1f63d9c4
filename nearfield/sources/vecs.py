"""fvecs, ivecs and bvecs files: per row an int32 dimension, then that many float32, int32 or uint8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

KINDS = {"fvecs": ("<f4", 4, "float"), "ivecs": ("<i4", 4, "int"), "bvecs": ("u1", 1, "int")}


def parse(data: bytes, kind: str) -> np.ndarray:
    """A file's bytes as an (n, d) matrix."""
    dtype, size, _ = KINDS[kind]
    if not data:
        return np.zeros((0, 0), dtype)
    d = int(np.frombuffer(data, "<i4", 1)[0])
    if d <= 0 or len(data) % (4 + size * d):
        raise ValueError("not a whole number of rows")
    rows = np.frombuffer(data, np.uint8).reshape(-1, 4 + size * d)
    if (rows[:, :4].copy().view("<i4") != d).any():
        raise ValueError("rows of different dimensions")
    return rows[:, 4:].copy().view(dtype)


def dump(x: np.ndarray, kind: str) -> bytes:
    dtype = KINDS[kind][0]
    heads = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
    return np.hstack([heads, np.ascontiguousarray(x.astype(dtype)).view(np.uint8).reshape(len(x), -1)]).tobytes()


def read(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """path, row (in its file), vec. Files are the unit of parallelism: write many of moderate size."""
    dtype, _, element = KINDS[kind]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                x = parse(content.as_py(), kind)
                for at in range(0, len(x), 10_000):
                    part = x[at : at + 10_000]
                    flat = pa.array(part.ravel().astype("<f4" if kind == "fvecs" else "<i4"))
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * x.shape[1], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part)), pa.int64()), vec], names=["path", "row", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, f"path string, row long, vec array<{element}>")
