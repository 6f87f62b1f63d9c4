"""Token ids in files of rANS blocks.

A static range asymmetric numeral system codes the ids under one frequency table, shared by all blocks: counts of all
ids of the corpus, scaled to 2^SCALE_BITS. A block holds whole documents up to BLOCK_TOKENS tokens (a longer document
has blocks of its own) and is coded by LANES interleaved states, so it is independent of all others: numpy steps all
lanes at once, and any task decodes any block. A checkpoint in the middle of each block (states and word position) lets
a reader start there: a block is read in two halves, the second from its checkpoint, and the first has to end in the
state that the checkpoint says. A CRC-32 covers the block's ids.

The files are a folder in the shared one with two Parquet tables: `blocks` (file_no, block_no, start_in_file, n_tokens,
doc_ids, doc_tokens, doc_no, doc_piece, words, states, check_words, check_states, crc32), in ascending doc_id order from
file to file, block to block and within a block, and `frequencies` (id, freq). A reader needs the folder's name alone.

Defined results. Null text counts as empty: the end id alone. Null doc_ids come first; rows that repeat a doc_id follow
each other, ordered by their ids' CRC. A very long text is cut into blocks of its own, whose CRCs are combined in order.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, discard, scratch_path, staged, whole
from nearfield.llm.tokens import bpe, forget

SCALE_BITS, LANES, BLOCK_TOKENS = 20, 2048, 1 << 19
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


@dataclass(frozen=True)
class Table:
    """freq[s] and its running sum cum[s]; symbol[slot] of each of the 2^SCALE_BITS slots."""

    freq: np.ndarray
    cum: np.ndarray
    symbol: np.ndarray

    @classmethod
    def of_freq(cls, freq: np.ndarray) -> Table:
        freq = freq.astype(np.uint64)
        return cls(freq, np.cumsum(freq) - freq, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)))


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^SCALE_BITS, at least 1 for all that occur."""
    total, size = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        out = np.zeros(max(1, len(counts)), np.int64)
        out[0] = size
        return out
    if int((counts > 0).sum()) > size // 2:
        raise ValueError("too many different ids for the scale")
    spare = size - int((counts > 0).sum())
    out = np.where(counts > 0, 1 + (counts.astype(np.float64) * (spare / total)).astype(np.int64), 0)
    out[int(out.argmax())] += size - int(out.sum())
    return out


@dataclass(frozen=True)
class Block:
    words: np.ndarray
    states: np.ndarray
    check_words: int
    check_states: np.ndarray


def encode_block(ids: np.ndarray, t: Table) -> Block:
    """ids to words and states; step s of the decoder takes ids[s * LANES : (s + 1) * LANES]."""
    steps = max(1, -(-len(ids) // LANES))
    grid = np.full(steps * LANES, int(t.freq.argmax()), np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(steps, LANES)
    x, out, check, written = np.full(LANES, _LOW, np.uint64), [], None, 0
    freqs, cums = t.freq[grid], t.cum[grid]
    limits, spare = freqs << np.uint64(63 - SCALE_BITS), np.uint64(1 << SCALE_BITS) - freqs
    for s in range(steps - 1, -1, -1):
        full = np.flatnonzero(x >= limits[s])
        if len(full):
            words = x[full]
            out.append(words.astype(np.uint32))
            written += len(words)
            x[full] = words >> _WORD
        x += x // freqs[s] * spare[s] + cums[s]  # the quotient shifted, the remainder and the running sum
        if s == steps // 2:
            check = (written, x.copy())
    return Block(np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32), x, written - check[0], check[1])


def _decode_steps(words: np.ndarray, states: np.ndarray, at: int, steps: int, t: Table) -> tuple[np.ndarray, np.ndarray, int]:
    """The ids of so many steps from a state and word position, and the state and position after them."""
    x, out = states.copy(), np.empty((steps, LANES), np.uint32)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for s in range(steps):
        slot = x & mask
        symbol = t.symbol.take(slot.view(np.int64)).astype(np.int64)
        out[s] = symbol
        x >>= np.uint64(SCALE_BITS)
        x *= t.freq.take(symbol)
        x += slot
        x -= t.cum.take(symbol)
        low = np.flatnonzero(x < _LOW)
        k = len(low)
        if k:
            x[low] = (x[low] << _WORD) | words[at : at + k]
            at += k
    return out.ravel(), x, at


def decode_block(b: Block, n: int, t: Table, from_check: bool = False) -> np.ndarray:
    """The n ids of a block; with from_check those from its checkpoint (step steps // 2) on. Raises if the halves don't meet."""
    steps = max(1, -(-n // LANES))
    half = steps // 2
    rest = _decode_steps(b.words, b.check_states, b.check_words, steps - half, t)[0][: n - half * LANES]
    if from_check:
        return rest
    first, states, at = _decode_steps(b.words, b.states, 0, half, t)
    if at != b.check_words or not np.array_equal(states, b.check_states):
        raise ValueError("a block doesn't meet its checkpoint")
    return np.concatenate((first, rest))


def crc32_combine(a: int, b: int, b_bytes: int) -> int:
    """The CRC-32 of two byte strings in a row from that of each, by squaring the matrix that appends a zero bit."""

    def times(m: list[int], v: int) -> int:
        s, i = 0, 0
        while v:
            if v & 1:
                s ^= m[i]
            v >>= 1
            i += 1
        return s

    m = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        m = [times(m, x) for x in m]
    while b_bytes:
        if b_bytes & 1:
            a = times(m, a)
        m = [times(m, x) for x in m]
        b_bytes >>= 1
    return a ^ b


def _id_rows(tokenizer: str, end_id: int):
    """Rows of ids; behind a task's last a row with n = -1 whose blob is its counts, ids first. They stand or fall with the
    task, so a retry counts nothing twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = bpe(tokenizer).encode, int(end_id).to_bytes(4, "little")
        press = zstandard.ZstdCompressor(level=1)
        total, names = np.zeros(0, np.int64), ["doc_id", "n", "crc", "ids"]
        for batch in batches:
            ids = [encode(t) + end for t in batch.column("text").to_pylist()]
            made = [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64())]
            plain = [np.frombuffer(i, "<u4") for i in ids]
            counts = np.bincount(np.concatenate(plain), minlength=len(total)) if plain else total * 0
            counts[: len(total)] += total
            total = counts
            made.append(pa.array([press.compress((x.astype("<u2") if x.max() < 65536 else x).tobytes()) for x in plain], pa.binary()))
            yield pa.RecordBatch.from_arrays(made, names=names)
        some = np.nonzero(total)[0]
        if len(some):
            blob = press.compress(np.concatenate((some, total[some])).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([blob], pa.binary())], names=names)

    return rows


def _unpacked(blob: bytes, n: int, unpress: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = unpress.decompress(blob)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for blob in batch.column("ids").to_pylist():
            some, counts = np.frombuffer(unpress.decompress(blob), "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n"])


_BLOCK = (
    "file_no int, block_no int, start_in_file long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, doc_no long, doc_piece int, "
    "words binary, states binary, check_words int, check_states binary, crc32 long"
)


def _block_rows(freq):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table, unpress = Table.of_freq(freq.value), zstandard.ZstdDecompressor()
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
        file_no, block_no, start, doc_no = None, 0, 0, 0
        doc_ids, sizes, held, size = [], [], [], 0

        def block(ids: np.ndarray, piece: int) -> pa.RecordBatch:
            nonlocal block_no, start, doc_ids, sizes, held, size, doc_no
            b = encode_block(ids, table)
            row = (file_no, block_no, start, len(ids), doc_ids, sizes, doc_no, piece, b.words.tobytes(), b.states.tobytes(), b.check_words, b.check_states.tobytes(), zlib.crc32(ids.astype("<u4").tobytes()))
            block_no, start, doc_no = block_no + 1, start + len(ids), doc_no + (len(doc_ids) if piece < 0 else 0)
            doc_ids, sizes, held, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for file, doc_id, n, blob in zip(*(batch.column(c).to_pylist() for c in ("file_no", "doc_id", "n", "ids")), strict=True):
                file_no = file
                if held and size + n > BLOCK_TOKENS:
                    yield block(np.concatenate(held), -1)
                ids = _unpacked(blob, n, unpress)
                if n > BLOCK_TOKENS:
                    for piece, at in enumerate(range(0, n, BLOCK_TOKENS)):
                        part = ids[at : at + BLOCK_TOKENS]
                        doc_ids, sizes = [doc_id], [len(part)]
                        yield block(part, piece)
                    doc_no += 1
                    continue
                doc_ids.append(doc_id)
                sizes.append(n)
                held.append(ids)
                size += n
        if held:
            yield block(np.concatenate(held), -1)

    return rows


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenize, count and write; returns the folder. Ids are kept compressed between the two passes, so each text is
    tokenized once."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    written = staged(rows.mapInArrow(_id_rows(tokenizer, end_id), "doc_id long, n long, crc long, ids binary"), "token-ids", codec="none")
    ids = written.where("n >= 0")
    counted = written.where("n < 0").select("ids").mapInArrow(_count_rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the vocabulary has
    known, n = counted.column("id").to_numpy(), counted.column("n").to_numpy()
    counts = np.zeros(int(known.max()) + 1 if len(known) else 1, np.int64)
    counts[known] = n
    freq, folder = scaled_frequencies(counts), scratch_path(spark, "tokens")
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.nonzero(freq)[0]], "id long, freq long").coalesce(1).write.parquet(f"{folder}/frequencies")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc")
    dealt = dealt.select(F.spark_partition_id().alias("file_no"), "doc_id", "n", "ids")
    dealt.mapInArrow(_block_rows(spark.sparkContext.broadcast(freq)), _BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(written)
    return folder


def read_frequencies(spark: SparkSession, folder: str) -> np.ndarray:
    got = spark.read.parquet(f"{folder}/frequencies").toArrow()  # as many rows as the vocabulary has
    ids = got.column("id").to_numpy()
    freq = np.zeros(int(ids.max()) + 1, np.int64)
    freq[ids] = got.column("freq").to_numpy()
    return freq


def _decoded_rows(freq):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table = Table.of_freq(freq.value)
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(np.frombuffer(row["words"], np.uint32), np.frombuffer(row["states"], np.uint64), row["check_words"], np.frombuffer(row["check_states"], np.uint64))
                ids = decode_block(b, row["n_tokens"], table).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["crc32"]:
                    raise ValueError(f"block {row['block_no']} of file {row['file_no']} is broken")
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                data, k = ids.tobytes(), len(sizes)
                crcs = [zlib.crc32(data[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                made = [
                    pa.array([row["file_no"]] * k, pa.int32()), pa.array(row["doc_no"] + np.arange(k) if row["doc_piece"] < 0 else [row["doc_no"]], pa.int64()), pa.array([row["doc_piece"]] * k, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["start_in_file"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["file_no", "doc_no", "doc_piece", "doc_id", "start", "n", "crc"])

    return rows


_PARTS = "file_no int, doc_no long, doc_piece int, doc_id long, start long, n long, crc long"


def _joined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by (file_no, doc_no, doc_piece) to a row per document."""
    doc, held = None, None
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file_no", "doc_id", "start", "n_tokens", "ids_crc32"])

    for batch in batches:
        out = []
        for file_no, doc_no, doc_id, start, n, crc in zip(*(batch.column(c).to_pylist() for c in ("file_no", "doc_no", "doc_id", "start", "n", "crc")), strict=True):
            if (file_no, doc_no) != doc:
                out += [held] if held else []
                doc, held = (file_no, doc_no), [file_no, doc_id, start, 0, 0]
            held[3], held[4] = held[3] + n, crc32_combine(held[4], crc, 4 * n)
        yield batch_of(out)
    yield batch_of([held] if held else [])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files in the folder: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    ends = blocks.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).orderBy("file_no").collect()  # a row per file
    before, starts = 0, []
    for row in ends:
        starts.append((row["file_no"], before))
        before += row["n"]
    bases = F.broadcast(spark.createDataFrame(starts, "file_no int, base long"))
    decode = _decoded_rows(spark.sparkContext.broadcast(read_frequencies(spark, folder)))
    one = blocks.where("doc_piece < 0").mapInArrow(decode, _PARTS).select("file_no", "doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    parts = blocks.where("doc_piece >= 0").mapInArrow(decode, _PARTS).repartition("file_no", "doc_no").sortWithinPartitions("file_no", "doc_no", "doc_piece")
    many = parts.mapInArrow(_joined_rows, "file_no int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return one.unionByName(many).join(bases, "file_no").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, end_id))
