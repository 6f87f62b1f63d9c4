"""The corpus pipeline: quality, exact copies, near copies, packing. Part of nearfield.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder
as Parquet and rereads it as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import exact_dedup, packing, quality, shingles, simhash
from nearfield.llm.common import staged
from nearfield.llm.tokens import default_path


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels, F.col("source"), F.col("lang"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is within two bits as in op9_simhash, then edited copies: 0.8 or more of the 5-word shingles in common."""
    return shingles.deduplicated(simhash.deduplicated(docs))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, default_path())


STAGES = [("quality classifier", _quality), ("exact dedup", _exact_dedup), ("simhash near-dedup", _near_dedup), ("best-fit packing", _packing)]

#: SQL can neither fit the classifier nor tokenize; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
