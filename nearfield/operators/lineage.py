"""Cutting lineage in iterative operators: checkpoint() in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in spark.checkpoint.dir; a temporary folder serves where it is unset, in local mode only."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="nearfield-"))
    return df.checkpoint()
