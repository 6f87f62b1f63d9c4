"""Best-fit packing with certified bounds.

Documents are cut into pieces of at most `capacity` tokens; full pieces are sequences of their own. The rest are dealt
over partitions by a hash and packed there by best-fit decreasing. Dual feasible functions give each partition a lower
bound on its bins: where the bound is met, the partition's count is certified and it closes all bins but its emptiest.
Partitions with a gap give up all bins with free space. What was given up is dealt anew over fewer partitions and
packed again, until one partition is left, all is certified, or a round saves nothing. `pack` returns the certificates
beside the sequences: bins and bound of each partition of each round, and of the whole.

Defined results. Null text counts as empty: one piece, the end id alone. Ties in length are broken by doc_id, start.
Rows that repeat a doc_id are packed each for itself. Very long texts become pieces as they are encoded, one text at a
time. Extra columns are ignored. An empty table gives no rows, no bins and a bound of 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, staged, whole
from nearfield.llm.tokens import bpe, forget

#: Pieces that one task packs at a time, and how often leftovers are dealt anew at most.
PARTITION_PIECES, MAX_ROUNDS = 65_536, 8

#: Words that a worker remembers: fewer than elsewhere, since packing may follow other stages in the same executors.
CACHE_WORDS = 120_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, lasting: bool = False) -> DataFrame:
    """Rows of _PIECE: each document's ids and the end id, the first piece taking what is over a multiple of capacity.
    lasting: workers remember words from task to task; else they give that memory back."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = bpe(tokenizer, cache_words).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        if not lasting:
            del encode
            forget()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(cut, _PIECE)


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Bins that any packing needs at least: the best of the volume and a family of dual feasible functions. With counts,
    lengths are distinct, rising and so often there.

    For a threshold t <= capacity / 2, lengths above capacity - t count as a whole bin, those under t as nothing and
    the others as they are. For k, the rounding function floor((k + 1) x) / k, exact at multiples, counts in k-ths.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True) if counts is None else (lengths, counts)
    best = -(-int((sizes * counts).sum()) // capacity)
    big, mass = np.cumsum(counts[::-1])[::-1], np.cumsum(sizes * counts)
    for t in np.unique(np.minimum(sizes, capacity // 2)).tolist():
        lo, hi = np.searchsorted(sizes, t), np.searchsorted(sizes, capacity - t, "right")
        whole_bins = int(big[hi]) if hi < len(sizes) else 0
        middle = int(mass[hi - 1] - (mass[lo - 1] if lo else 0)) if hi > lo else 0
        best = max(best, whole_bins + -(-middle // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        units = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)  # in capacity / k
        best = max(best, -(-int((units * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """lengths, falling, to the bin of each and the number of bins."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_mask, made = 0, 0
    out = np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        fits = open_mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_mask ^= 1 << left
        else:
            left, b = capacity, made
            made += 1
        out[i] = b
        left -= size
        if left:
            if not room[left]:
                open_mask |= 1 << left
            room[left].append(b)
    return out, made


_PACKED = f"{_PIECE}, part long, bin long, offset long, fill long, open boolean, bound long, bins long"


def _pack_part(capacity: int, last: bool):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        rows["bin"], n = best_fit_decreasing(lengths, capacity)
        rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        fill = np.bincount(rows["bin"], weights=lengths, minlength=n).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        given = fill < capacity
        if n == bound:  # certified: only the emptiest bin is given up
            given &= np.arange(n) == int(fill.argmin())
        rows["fill"], rows["open"] = fill[rows["bin"]], given[rows["bin"]] & (not last)
        return rows.assign(bound=bound, bins=n)[[c.split()[0] for c in _PACKED.split(", ")]]

    return pack


def _dealt(rows: DataFrame, parts: int, capacity: int, turn: int) -> DataFrame:
    """Pack rows over so many partitions. A row's place in its staged file decides, so copies of a row spread too."""
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)).cast("long")
    columns = [c.split()[0] for c in _PIECE.split(", ")]
    return staged(rows.select(*columns, part.alias("part")).groupBy("part").applyInPandas(_pack_part(capacity, parts == 1), _PACKED), "packed")


@dataclass(frozen=True)
class Packing:
    """sequences: rows of _PIECE with sequence_id and offset. certificates: a row per partition and round: turn, part, bins,
    bound, certified (bins = bound), given_up (bins dealt anew). bins: sequences in all; bound: what no packing is below."""

    sequences: DataFrame
    certificates: DataFrame
    bins: int
    bound: int


def _certificates(now: DataFrame, turn: int) -> DataFrame:
    by = now.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count_distinct(F.when(F.col("open"), F.col("bin"))).alias("given_up"))
    return by.select(F.lit(turn).alias("turn"), "part", "bins", "bound", (F.col("bins") == F.col("bound")).alias("certified"), "given_up")


def pack(rows: DataFrame, capacity: int = 2048, partition_pieces: int = PARTITION_PIECES) -> Packing:
    """Pack rows of _PIECE (staged)."""
    full = rows.where(F.col("length") == capacity)
    pool = rows.where(F.col("length") < capacity)
    sizes = rows.groupBy("length").count().orderBy("length").toArrow()  # at most `capacity` rows
    lengths, counts = (sizes.column(c).to_numpy() for c in ("length", "count"))
    bound = lower_bound(lengths, capacity, counts)
    bins = int(counts[lengths == capacity].sum())
    n, held = int(counts.sum()) - bins, None
    done: list[DataFrame] = []
    told = rows.sparkSession.createDataFrame([], "turn int, part long, bins long, bound long, certified boolean, given_up long")
    while n:
        parts, turn = -(-n // partition_pieces), len(done)
        now = _dealt(pool, parts, capacity, turn)
        certificates = _certificates(now, turn)
        made, given = certificates.agg(F.sum("bins"), F.sum("given_up")).first()
        if held is not None and made > held:  # the round lost: what it started from stays as it was
            done.append(pool)
            bins += held
            break
        told = told.unionByName(certificates)
        if not given or made == held or turn + 1 >= MAX_ROUNDS:  # nothing to deal anew, or this saved nothing
            done.append(now)
            bins += made
            break
        done.append(now.where("not open"))
        bins += made - given
        pool = now.where("open")
        n, held = pool.count(), given
    out = full.withColumn("m", F.monotonically_increasing_id()).select(*rows.columns, (2 * F.col("m")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for turn, packed in enumerate(done):
        # odd ids: the partition, then the turn, then the bin
        number = (F.shiftleft(F.col("part") * len(done) + turn, 32) + F.col("bin")) * 2 + 1
        out = out.unionByName(packed.select(*rows.columns, number.alias("sequence_id"), "offset"))
    return Packing(out, told, bins, bound)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, cache_words: int = CACHE_WORDS, lasting: bool = False) -> DataFrame:
    return pack(staged(pieces(docs, tokenizer, capacity, end_id, cache_words=cache_words, lasting=lasting), "pieces"), capacity).sequences
