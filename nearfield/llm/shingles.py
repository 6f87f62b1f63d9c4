"""Near copies by word shingles: minhash bands find candidates, the shingle sets themselves decide.

A 64-bit fingerprint can't serve here: texts with four fifths of their shingles in common are typically 4 to 11 bits
apart, and fingerprints 11 bits apart need not share a byte. So each text gets ROWS * BANDS minima of its shingle
hashes, and every BANDS-th part of them is one key. A pair of similarity s shares a key with probability
1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8, more above. Groups with the same members are looked at once, and only
texts that share a key with another are read again.

In a group, sets are compared one against all that are not linked yet, so each pair is either compared or already
connected: no list is cut, and a large group of copies is done in about one pass. A task holds its group's shingle hashes.

Defined results. Words and lower-casing as in simhash; a shorter text is one shingle, a text without words has the
empty set. Texts with equal sets are one node. Of what is linked, directly or not, the row with the smallest doc_id
stays (null ids last, then by the text's hash). Sets are of 64-bit hashes. Very long texts are read in blocks of words.
Extra columns, whatever their names, are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, discard, giving_back, small, staged, whole, word_blocks
from nearfield.llm.components import connected_components
from nearfield.llm.simhash import stay_of_parts, text_hashes, without

ROWS, BANDS = 5, 20
#: Hashes times minima computed at a time.
BLOCK = 1 << 11
_RNG = np.random.default_rng(20)
_TIMES = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    digest, tail, found = xxhash.xxh64_intdigest, [], []
    for block in word_blocks((text or "").encode()):
        w = tail + block
        found.append(np.unique(np.array([digest(g, 42) for g in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))], np.uint64)))
        tail = w[max(0, len(w) - words + 1) :]
    if not any(len(f) for f in found):
        return np.array([digest(b" ".join(tail), 42)] if tail else [], np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set (none of an empty one)."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[at : at + BLOCK, None] * _TIMES + _PLUS).min(0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), seed=i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _sketch_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            out = [batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array([_node(s) for s in sets], pa.int64()), pa.array([band_keys(s).tolist() for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "t1", "t2", "sh", "keys"])

    return rows


def _set_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sh"), pa.array(sets, pa.binary())], names=["sh", "grams"])

    return rows


def linked(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets (sorted, not empty) of at least this Jaccard similarity that connect all that such pairs connect."""
    sizes, left, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            n = sizes[left]
            fit = left[np.minimum(n, sizes[i]) >= similarity * np.maximum(n, sizes[i])]
            if not len(fit):
                continue
            near = []
            for at in range(0, len(fit), BLOCK):
                part = fit[at : at + BLOCK]
                flat = np.concatenate([sets[j] for j in part])
                place = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
                ends = np.cumsum(sizes[part])
                common = np.add.reduceat((sets[i][place] == flat).astype(np.int64), ends - sizes[part])
                near += part[common >= similarity * (sizes[part] + sizes[i] - common)].tolist()
            out += [(int(i), j) for j in near]
            todo += near
            left = left[~np.isin(left, near)]
    return out


def _link_rows(similarity: float):
    def links(members: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        found = linked([np.frombuffer(g, np.uint64) for _, g in members], similarity)
        return [(members[i][0], members[j][0]) for i, j in found]

    def batch_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, []
        for batch in batches:
            out = []
            for key, sh, grams in zip(*(batch.column(c).to_pylist() for c in ("key", "sh", "grams")), strict=True):
                if key != at:
                    out += links(mine)
                    at, mine = key, []
                mine.append((sh, grams))
            yield batch_of(out)
        yield batch_of(links(mine))

    return rows


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows linked to one that stays; rows that repeat both doc_id and text count once."""
    bounded_batches(docs.sparkSession)
    t1, t2 = text_hashes(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), whole(text_col).alias("text"))
    rows = staged(texts.mapInArrow(giving_back(_sketch_rows(words)), "doc_id long, t1 long, t2 long, sh long, keys array<long>"), "shingle-keys")

    row = F.struct("doc_id", "t1", "t2")
    nodes = rows.groupBy("sh").agg(F.min_by(F.struct("doc_id", "t1", "t2", "keys"), row).alias("x"))
    listed = staged(nodes.select("sh", "x.doc_id", "x.t1", "x.t2", F.explode("x.keys").alias("key")), "shingle-lists")
    groups = listed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sh")).alias("x"), F.min("sh").alias("lo"), F.max("sh").alias("hi")).where("n > 1")
    members = staged(listed.join(groups.groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")).select("key"), "key"), "shingle-groups")
    asked = members.select("sh", F.col("doc_id").alias("i"), F.col("t1").alias("a"), F.col("t2").alias("b")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t1") == F.col("a")) & (F.col("t2") == F.col("b"))
    again = texts.join(small(asked), same).select("sh", "text")
    sets = staged(again.mapInArrow(giving_back(_set_rows(words)), "sh long, grams binary").dropDuplicates(["sh"]), "shingle-sets")
    grouped = members.select("key", "sh").join(sets, "sh").repartition("key").sortWithinPartitions("key")
    parts = connected_components(grouped.mapInArrow(giving_back(_link_rows(similarity)), "u long, v long"))

    named = rows.select("doc_id", "t1", "t2", "sh").join(parts.select(F.col("node").alias("sh"), "component"), "sh", "left")
    gone = staged(stay_of_parts(named.select("doc_id", "t1", "t2", F.coalesce("component", "sh").alias("part"))), "shingle-gone")
    left = without(docs, gone, rows, id_col, text_col)
    for used in (rows, listed, members, sets):
        discard(used)
    return left
