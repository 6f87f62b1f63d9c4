"""SimHash near-dedup with a byte-position inverted index and count filtering.

The 8 bytes of a fingerprint are features (position, byte). Fingerprints that differ in at most k <= 3 bits differ
in at most k bytes, so they share at least 8 - k positional bytes: the guaranteed minimum. A posting list for a single
(position, byte) would hold 1/256 of the corpus and pair up quadratically, so lists are kept for combinations: of
2k blocks of positions (4 of two bytes for k = 2), at least k survive, and each choice of k blocks is one key of the
index. The rows met in a list are tallied, pair by pair, over all 8 positions; pairs that reach the minimum are
verified bit by bit. Only links that join something new inside the list leave the task, so output is linear.

A list with more than DENSE fingerprints is not paired: with k bits masked in every possible way, fingerprints that
become equal are within k bits of each other, and every linked pair becomes equal under some mask. That is exact,
linear in the list, and needs memory for the list alone.

Defined results. A-Z are lower-cased, words are runs of bytes outside \\x20 and \\x09-\\x0D, shingles are `words` words
joined by a space (a shorter text: all its words). No words (null and empty texts too): fingerprint zero, linked like
any other. Very long texts are read in blocks of words. Fingerprints, not ids, are the nodes: copies cost nothing, and
null or repeated ids neither make nor break a link. component_id is the smallest doc_id of all rows reachable; it is null
only where all their ids are. Extra columns, whatever their names, are kept by `deduplicated`, ignored otherwise. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, free_names, giving_back, small, staged, whole, word_blocks
from nearfield.llm.components import connected_components, with_least

#: Posting lists above this size are linked by masks instead of pairs.
DENSE = 1024
#: Hashes counted at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash as an unsigned int."""
    import xxhash

    digest, ones, n, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for block in word_blocks((text or "").encode()):
        w = tail + block
        grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
        h = np.array([digest(g, 42) for g in grams], ">u8")
        n += len(h)
        for at in range(0, len(h), BLOCK):
            ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        tail = w[max(0, len(w) - words + 1) :]
    if not n:
        return digest(b" ".join(tail), 42) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def _print_rows(words: int, kept: tuple[str, ...] = ("doc_id",)):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(prints)], names=[*kept, "fp"])

    return rows


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(_print_rows(words), "doc_id long, fp long")


def _blocks(bits: int) -> list[tuple[int, ...]]:
    """Position blocks: 2 * bits of them, as even as 8 positions allow."""
    n = max(2, 2 * bits)
    return [tuple(int(x) for x in b) for b in np.array_split(np.arange(8), n)]


def index_masks(bits: int) -> list[int]:
    """For each key of the index, the mask of the positions it holds."""
    blocks = _blocks(bits)
    keep = len(blocks) - bits
    return [sum(0xFF << (8 * p) for b in chosen for p in b) for chosen in combinations(blocks, keep)]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The pairs that join two parts when added in turn."""
    root, out, label = list(range(n)), [], np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        apart = label[a] != label[b]
        if apart.any():
            for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                p, q = find(i), find(j)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((i, j))
            label = np.array([find(x) for x in range(n)])
    return out


def _tallied(fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a list that share enough positional bytes and differ in at most `bits` bits."""
    by = fps.view(np.uint8).reshape(-1, 8)
    step = max(1, (1 << 18) // len(fps))
    for at in range(0, len(fps), step):
        shared = np.zeros((min(step, len(fps) - at), len(fps)), np.uint8)
        for p in range(8):
            shared += by[at : at + step, p, None] == by[None, :, p]
        i, j = np.nonzero(shared >= 8 - bits)
        i += at
        i, j = i[i < j], j[i < j]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        yield i[near], j[near]


def _masked(fps: np.ndarray, free: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same links for a dense list: star links of what is equal under each mask of `bits` free bits."""
    places = [i for i in range(64) if free >> i & 1]
    for chosen in combinations(places, min(bits, len(places))):
        v = fps & np.uint64(~sum(1 << i for i in chosen) & 0xFFFFFFFFFFFFFFFF)
        order = np.argsort(v, kind="stable")
        same = np.nonzero(v[order][1:] == v[order][:-1])[0]
        yield order[same], order[same + 1]


def _link_rows(bits: int):
    masks = index_masks(bits)

    def links(key: int, fps: list[int]) -> list[tuple[int, int]]:
        u = np.array(fps, np.int64).view(np.uint64)
        found = _tallied(u, bits) if len(u) <= DENSE else _masked(u, ~masks[key] & 0xFFFFFFFFFFFFFFFF, bits)
        return [(fps[i], fps[j]) for i, j in _forest(len(fps), found)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, out = None, [], []
        for batch in batches:
            for key, part, fp in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "fp")), strict=True):
                if (key, part) != at:
                    if len(mine) > 1:
                        out += links(at[0], mine)
                    at, mine = (key, part), []
                mine.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out = []
        if len(mine) > 1:
            out = links(at[0], mine)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that give the same components as all pairs within `bits` bits."""
    keys = F.array(*(F.struct(F.lit(k).alias("key"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(index_masks(bits))))
    listed = prints.select("fp", F.explode(keys).alias("x")).select("x.key", "x.part", "fp")
    listed = listed.repartition("key", "part").sortWithinPartitions("key", "part")
    return listed.mapInArrow(_link_rows(bits), "a long, b long").distinct()


def classes(prints: DataFrame, bits: int = 2) -> DataFrame:
    """prints (doc_id, fp), staged, to (fp, part, component_id): a name of fp's component and its smallest doc_id."""
    n = prints.count()  # from the footers of what is staged
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes", most=n)
    parts = connected_components(links(nodes, bits).toDF("u", "v"), n * len(index_masks(bits)))  # a list's links are fewer than its rows
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("part"))
    named = staged(named, "simhash-parts", most=n)
    return with_least(named, "part", "node", "component_id", n).select("fp", "part", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id."""
    prints = staged(fingerprints(docs, words, id_col, text_col), "simhash")
    return prints.join(classes(prints, bits), "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def text_hashes(text_col: str) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(whole(text_col)), F.xxhash64(F.lit("text"), whole(text_col))]


def stay_of_parts(named: DataFrame) -> DataFrame:
    """named (doc_id, t1, t2, part) to the distinct (doc_id, t1, t2) that don't stay: in each part the row with the smallest
    doc_id stays (null ids last, then by the text's hashes)."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    rows = staged(named.select("part", row.alias("row")).distinct(), "rows-of-parts")
    gone = with_least(rows, "part", "row", "stays").where("row <> stays")
    return gone.select("row.doc_id", "row.t1", "row.t2").distinct()


def without(docs: DataFrame, gone: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose id and text are in gone (doc_id, t1, t2); rows that repeat both id and text count once.
    named: staged, has these three of each row of docs, so that no text is read to see whether some repeat."""
    i, a, b, gi, ga, gb = free_names(docs.columns, "id", "t1", "t2", "gone_id", "gone_t1", "gone_t2")
    t1, t2 = text_hashes(text_col)
    keyed = docs.withColumns({i: F.col(id_col).cast("long"), a: t1, b: t2})
    same = F.col(i).eqNullSafe(F.col(gi)) & (F.col(a) == F.col(ga)) & (F.col(b) == F.col(gb))
    left = keyed.join(small(gone.toDF(gi, ga, gb)), same, "left_anti")
    twice = named.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        left = left.dropDuplicates([i, a, b])
    return left.drop(i, a, b)


def deduplicated(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id; among null ids and repeated ones, that with the
    smallest hash of its text. Rows that repeat both doc_id and text count once."""
    bounded_batches(docs.sparkSession)
    t1, t2 = text_hashes(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), whole(text_col).alias("text"))
    prints = staged(texts.mapInArrow(giving_back(_print_rows(words, ("doc_id", "t1", "t2"))), "doc_id long, t1 long, t2 long, fp long"), "simhash", most=docs.count(), dealt=True)
    named = prints.join(classes(prints.select("doc_id", "fp"), bits).select("fp", "part"), "fp").select("doc_id", "t1", "t2", "part")
    return without(docs, staged(stay_of_parts(named), "near-dups"), prints, id_col, text_col)
