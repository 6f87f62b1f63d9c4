"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a bucketed, sorted table (h1, h2, n, often): n documents of one or more batches hold the line, and `often` says
that with the runs before it the line reached the threshold. A new batch counts its lines (its only shuffle, aggregated
before it), merge-anti-joins the lines that the runs have decided, adds up what they count of the others and becomes a run
at level 0. When a level has `fanout` runs they are merged into one run of the next level. All runs have the buckets and
the order of the shuffle, so the joins and the merges of runs need neither an exchange nor a sort. The frequent lines are
the runs' rows that say `often`. Hashes are two XXH64 values of different input, 128 bits together.

Defined results. Null text counts as empty: one empty line. A line's key is the line without \\x20, \\x09-\\x0D at its
ends, A-Z lower-cased; keys shorter than `min_chars` code points are never dropped. A line counts once in a row of the
input; rows that repeat a doc_id count each for itself. A text whose lines all go becomes the empty text. A very long text
is one row of lines, and what is dropped from it a set of line numbers, so time and memory are linear in its lines. Extra
columns are ignored by `deduplicated_lines`. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import ascii_lower, discard, scratch_path, small, staged, whole

BLANKS = " \t\n\x0b\x0c\r"
KEYS = ["h1", "h2"]


def lines(text: str | Column = "text") -> Column:
    return F.split(whole(text), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


@contextmanager
def _order_of_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of buckets of one file each say in what order their rows are."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The runs, by level; bucketed tables whose files are in the shared folder. `close` drops them."""

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 2) -> None:
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name).hint("merge")

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"nearfield_line_run_{uuid.uuid4().hex}", scratch_path(self.spark, f"line-run-{level}")
        writer = rows.select(*KEYS, "n", "often").write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS)
        writer.option("path", path).option("compression", "zstd").saveAsTable(name)
        self.levels[level].append(name)
        self.paths[name] = path

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def told(self, hashed: DataFrame) -> DataFrame:
        """The batch's undecided lines: h1, h2, n, often."""
        now = hashed.groupBy(*KEYS).agg(F.count("*").alias("n")).withColumn("before", F.lit(0).cast("long"))
        for name in (n for level in self.levels for n in level):
            # one merge join drops what the run has decided and brings its other counts; an anti join by that name would be
            # pushed below the count, and the batch be shuffled before it is aggregated
            now = now.join(self._read(name).toDF(*KEYS, "m", "decided"), KEYS, "left").where(~F.coalesce("decided", F.lit(False)))
            now = now.select(*KEYS, "n", (F.col("before") + F.coalesce("m", F.lit(0))).alias("before"))
        return now.select(*KEYS, "n", (F.col("n") + F.col("before") >= self.threshold).alias("often"))

    def add(self, hashed: DataFrame) -> None:
        """hashed (h1, h2): a row for each document of the batch and each distinct line in it."""
        with _order_of_buckets(self.spark):
            self._write(self.told(hashed), 0)
            self._compact()

    def merged(self, names: list[str]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.toDF(*KEYS, "n2", "often2"), KEYS, "full")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            return both.select(*KEYS, n.alias("n"), (F.coalesce("often", F.lit(False)) | F.coalesce("often2", F.lit(False))).alias("often"))

        return reduce(two, [self._read(n) for n in names])

    def _compact(self) -> None:
        k = 0
        while len(self.levels[k]) >= self.fanout:
            old, self.levels[k] = self.levels[k], []
            if len(self.levels) == k + 1:
                self.levels.append([])
            self._write(self.merged(old), k + 1)
            for name in old:
                self._drop(name)
            k += 1

    def frequent(self) -> DataFrame:
        """(h1, h2) of the lines that reached the threshold, each once."""
        found = [self.spark.table(n).where("often").select(*KEYS) for level in self.levels for n in level]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], "h1 long, h2 long")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = [[]]


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2) of line keys found in at least min_docs rows of docs, which come in `batches` batches by hash of the id."""
    keys = F.array_distinct(F.transform(lines(text_col), line_key))
    rows = docs.select(F.pmod(F.xxhash64(id_col), F.lit(batches)).cast("int").alias("batch"), F.explode(keys).alias("key"))
    rows = rows.where(F.length("key") >= min_chars).select("batch", *_hashes(F.col("key")))
    hashed = staged(rows, "line-hashes", partition_by="batch")
    runs = LineRuns(docs.sparkSession, min_docs)
    for b in range(batches):
        runs.add(hashed.where(F.col("batch") == b).select(*KEYS))
    discard(hashed)
    out = staged(runs.frequent(), "frequent-lines")
    runs.close()
    return out


def deduplicated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, text (the lines that stay)."""
    often = frequent_lines(docs, min_docs, min_chars, batches, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("text"), "text")})
    at = rows.select("doc_id", "t1", "t2", F.posexplode(lines()).alias("no", "line")).select("doc_id", "t1", "t2", "no", line_key(F.col("line")).alias("key"))
    at = at.where(F.length("key") >= min_chars).select("doc_id", "t1", "t2", "no", *_hashes(F.col("key")))
    hits = at.join(small(often), KEYS, "left_semi")
    gone = hits.groupBy("doc_id", "t1", "t2").agg(F.collect_set("no").alias("gone"))
    gone = staged(gone, "dropped-lines").withColumnsRenamed({"doc_id": "g_id", "t1": "g1", "t2": "g2"})
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2"))
    out = rows.join(small(gone), same, "left")

    def kept(every: Column) -> Column:
        """The lines at the places that a set difference leaves."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "gone")
        return F.array_join(F.transform(stay, lambda i: F.get(every, i)), "\n")

    # an array of the one list of lines, so that the text is split once and not for each line
    left = F.get(F.transform(F.array(lines()), kept), F.lit(0))
    return out.select(
        "doc_id",
        F.size(lines()).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
    )
