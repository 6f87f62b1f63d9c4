"""Whole indexes in a folder: tables as Parquet (lists partitioned by their number), models and settings as tables of
numbers, indexes inside of indexes as folders of their own. A table `kind` says what the folder holds."""

from __future__ import annotations

from dataclasses import fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from nearfield.operators.binary import BinaryGraph, BinaryLists
from nearfield.operators.coded_lists import CodedLists
from nearfield.operators.graph import GraphIndex
from nearfield.operators.ivf import InvertedFile
from nearfield.operators.spectral import SpectralLists
from nearfield.plans.index import BinaryIndex, Index
from nearfield.sources import models

KINDS = {c.__name__: c for c in (InvertedFile, CodedLists, SpectralLists, GraphIndex, BinaryLists, BinaryGraph, Index, BinaryIndex)}
#: Tables that a list's number partitions; searches read the folders of the lists they probe.
_BY_LIST = ("rows", "stored")


def write(spark: SparkSession, path: str, index: Any) -> None:
    """An index of one of KINDS. The folder must be new."""
    said = [("", type(index).__name__)]
    for f in fields(index):
        value, at = getattr(index, f.name), f"{path}/{f.name}"
        if isinstance(value, DataFrame):
            writer = value.write
            (writer.partitionBy("list_no") if f.name in _BY_LIST and "list_no" in value.columns else writer).parquet(at)
            said.append((f.name, f"table {','.join(value.columns)}"))
        elif type(value).__name__ in KINDS:
            write(spark, at, value)
            said.append((f.name, "index"))
        else:
            models.write(spark, at, value)
            said.append((f.name, "model"))
    spark.createDataFrame(said, "name string, kind string").coalesce(1).write.parquet(f"{path}/kind")


def read(spark: SparkSession, path: str) -> Any:
    said = {r["name"]: r["kind"] for r in spark.read.parquet(f"{path}/kind").collect()}  # a row per field
    cls, values = KINDS[said.pop("")], {}
    for name, kind in said.items():
        if kind == "index":
            values[name] = read(spark, f"{path}/{name}")
        elif kind == "model":
            values[name] = models.read(spark, f"{path}/{name}")
        else:
            values[name] = spark.read.parquet(f"{path}/{name}").select(*kind.removeprefix("table ").split(","))
    return cls(**values)
