"""Plumbing that the training-data operators share: tables in the shared folder, checked broadcasts, text folding."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table of at most this many rows and bytes may be broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 32 << 20

#: Rows of a few numbers that go to one file at least, where a bound for a table's rows is known.
FILE_ROWS = 1 << 17

#: Rows and bytes in an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset (tests), a temporary one, in local mode only."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="nearfield-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/nearfield/{name}-{uuid.uuid4().hex[:12]}"


def files_of(most: int) -> int:
    """Files for at most so many rows of a few numbers."""
    return max(1, -(-most // FILE_ROWS))


def staged(df: DataFrame, name: str, partition_by: str | None = None, codec: str = "zstd", most: int | None = None, dealt: bool = False) -> DataFrame:
    """Write df to the shared folder and reread it: lineage ends there, and a lost executor costs only its own tasks.

    most: df, which comes from a shuffle, has at most so many rows, of a few numbers; FILE_ROWS of them make a file. dealt: df
    comes from work that all its tasks are to share, and its rows are shuffled to those files. Else a
    small table has a file for each shuffle partition, and on a local file system without Hadoop's native library an
    executor starts a process (chmod) several times a file, each of which counts as large as the JVM until it runs."""
    path = scratch_path(df.sparkSession, name)
    if most is not None:
        df = df.repartition(files_of(most)) if dealt else df.coalesce(files_of(most))
    writer = df.write.option("compression", codec)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what staged() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if a look at it shows at most `most` rows and MAX_BROADCAST_BYTES bytes; else as it is,
    for a shuffled join. Columns are numbers, strings, binaries, arrays of numbers, or structs of those."""
    most = MAX_BROADCAST_ROWS if most is None else most

    def width(c: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            return F.lit(8)
        if isinstance(kind, T.StructType):
            return reduce(lambda x, y: x + y, (width(c[f.name], f.dataType, f.name) for f in kind))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            return 8 * F.greatest(F.size(c), F.lit(0)) + 8
        raise TypeError(f"no bound is known for the bytes of {name}")

    sizes = reduce(lambda x, y: x + y, (width(F.col(f.name), f.dataType, f.name) for f in df.schema))
    n, size = df.select(sizes.cast("long").alias("w")).limit(most + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= MAX_BROADCAST_BYTES else df


def bounded_batches(spark: SparkSession) -> None:
    """Hold what a Python worker gets at a time to BATCH_ROWS rows and BATCH_BYTES bytes (a single longer text aside): ten
    thousand long texts at once, the usual setting, may exceed an executor. These are settings of the session, since
    Spark has none for one operator; every operator that sends texts to Python makes them, and lower ones stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if now <= 0 or now > most:  # 0: no bound
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def give_back() -> None:
    """Give the system back what this Python worker holds and doesn't use: Arrow's pool and the C library keep it until asked."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def giving_back(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that does so behind each task: workers live on, all idle ones in turn, beside other work."""

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names behind a prefix that no column has, in upper or lower case."""
    prefix = "__nf_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return [prefix + w for w in wanted]


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of UTF-8 text (runs outside \\x20, \\x09-\\x0D; A-Z lower-cased) in order, some `size` bytes at a time."""
    at = 0
    while at < len(data):
        gap = _BLANK.search(data, at + size) if len(data) - at > size else None
        end = gap.start() if gap else len(data)
        yield data[at:end].lower().split()
        at = end


def ascii_lower(text: str | Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(text, UPPER, UPPER.lower())


def whole(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
