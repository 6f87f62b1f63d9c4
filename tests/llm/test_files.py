"""Small tables of the shared folder have few files, however many partitions a shuffle has."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nearfield.llm import common, components, exact_dedup, simhash


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_graphs_are_written_to_few_files(spark, monkeypatch, many_partitions):
    files = {}

    def counted(df, name, **options):
        out = common.staged(df, name, **options)
        files.setdefault(name, []).append(len(list(Path(out.staged_path.removeprefix("file:")).glob("part-*"))))
        return out

    monkeypatch.setattr(components, "staged", counted)
    monkeypatch.setattr(simhash, "staged", counted)
    # a chain of prints one bit apart, and prints that stand alone
    chain = [(1 << i) - 1 for i in range(60)]
    alone = [(0x9E3779B97F4A7C15 * (i + 1) & 0x7FFFFFFFFFFFFFFF) | 1 << 62 for i in range(100)]
    prints = spark.createDataFrame([(500 + i, fp) for i, fp in enumerate(chain + alone)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(prints).collect()}

    rest = set(chain + alone)
    while rest:  # brute force
        part, grown = set(), {rest.pop()}
        while grown:
            x = grown.pop()
            part.add(x)
            near = {y for y in rest if (x ^ y).bit_count() <= 2}
            grown, rest = grown | near, rest - near
        least = 500 + min((chain + alone).index(x) for x in part)
        assert {got[x] for x in part} == {least}
    assert {"simhash-nodes", "simhash-parts", "edges", "least"} <= set(files)
    assert max(max(n) for n in files.values()) == 1


def test_rows_beyond_a_file_are_shared_out(spark, monkeypatch, many_partitions):
    monkeypatch.setattr(common, "FILE_ROWS", 10)
    rows = spark.range(100).groupBy("id").count()
    out = common.staged(rows, "some", most=100)
    assert out.count() == 100
    assert 1 < len(list(Path(out.staged_path.removeprefix("file:")).glob("part-*"))) <= 10


def test_exact_dedup_writes_small_tables_to_few_files(spark, monkeypatch):
    """Whatever number of tasks reads the texts: each file is given its rights by processes that count as large as the JVM."""
    files, staged = {}, exact_dedup.staged

    def counted(df, name, **how):
        out = staged(df, name, **how)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(exact_dedup, "staged", counted)
    texts = [f"Some Text {i % 40}, ÄÉ" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    out = exact_dedup.decisions(docs)
    assert out.select(F.spark_partition_id()).distinct().count() == 1 and set(files.values()) == {1} and "prints" in files
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], bytes(r["sha"])) for r in out.collect()}
    for i, t in enumerate(texts):
        same = [k for k in range(60) if k % 40 == i % 40]
        normal = "".join(c.lower() if c.isascii() else c for c in t)
        assert got[i] == (same[-1], len(same), i == same[-1], hashlib.sha256(normal.encode()).digest())
