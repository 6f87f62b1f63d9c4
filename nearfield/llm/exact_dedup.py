"""Exact dedup by composable polynomial fingerprints.

A chunk of bytes c has the hash H(c) = sum of c[i] * B^(n-1-i) mod P, and H(ab) = H(a) * B^len(b) + H(b). So the
chunks of a huge document are hashed by different tasks and their hashes combined in order; a small document is
hashed where it is read, by the same formula. Two moduli below 2^31 give 62 bits. Documents with equal fingerprints
and lengths are compared chunk by chunk, as streams: a task holds the distinct texts of a group (one, but for collisions
of all 62 bits and the length) and one chunk of the text compared; chunks are kept only once they differ.

Defined results. Null text counts as empty; empty texts are equal to each other. Texts are equal when identical
after lower-casing A-Z. Of equal texts the row with the largest doc_id stays; a null doc_id is the smallest; of
rows that repeat text and doc_id exactly one stays. Very long texts are hashed in parts by several tasks. Any further
columns of the input, whatever their names, are ignored by the decisions and kept by `deduplicated`. An empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import ascii_lower, bounded_batches, files_of, free_names, giving_back, small, staged, whole

#: Moduli and bases of the two hashes.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_221)
#: Bytes hashed at a time; characters in a chunk row; texts longer than HUGE_CHARS are hashed by several tasks.
HASH_BYTES, CHUNK_CHARS, HUGE_CHARS = 1 << 16, 1 << 16, 1 << 20
#: A task compares at most about so many members of one group at each level.
FAN_IN = 256


def _powers(base: int, modulus: int) -> np.ndarray:
    out, x = np.empty(HASH_BYTES, np.uint64), 1
    for i in range(HASH_BYTES - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


_POWERS: list[np.ndarray] = []


def chunk_hash(data: bytes) -> tuple[int, int]:
    """The two polynomial hashes of data, built from pieces of HASH_BYTES."""
    if not _POWERS:
        _POWERS.extend(_powers(b, m) for b, m in zip(BASES, MODULI, strict=True))
    h = [0, 0]
    for at in range(0, len(data), HASH_BYTES):
        piece = np.frombuffer(data, np.uint8, min(HASH_BYTES, len(data) - at), at).astype(np.uint64)
        for k, m in enumerate(MODULI):
            h[k] = (h[k] * pow(BASES[k], len(piece), m) + int(np.dot(piece, _POWERS[k][HASH_BYTES - len(piece) :]))) % m
    return h[0], h[1]


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """The hashes of left's bytes followed by right's."""
    return tuple((a * pow(b, right_bytes, m) + c) % m for a, c, b, m in zip(left, right, BASES, MODULI, strict=True))


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text (UTF-8, not normalised yet) to _HASHED; sha: of text, for rows that bring none."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        rows, shas = [], []
        for text in batch.column("text").to_pylist():
            data = text.lower()  # of bytes: A-Z only
            if "sha" not in names:
                shas.append(sha256(data).digest())
            rows.append((len(data), *chunk_hash(data), *(pow(b, len(data), m) for b, m in zip(BASES, MODULI, strict=True))))
        made = [batch.column(n) for n in names] + [pa.array(shas, pa.binary())] * ("sha" not in names)
        made += [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(made, names=names + ["sha"] * ("sha" not in names) + ["n_bytes", "h1", "h2", "s1", "s2"])


_HASHED = "n_bytes long, h1 long, h2 long, s1 long, s2 long"


def _valid(text_col: str) -> Column:
    return F.make_valid_utf8(whole(text_col))


def _sha(text: Column) -> Column:
    """The normalised text's, in the JVM: it makes an object of each character, so for few texts."""
    return F.unhex(F.sha2(ascii_lower(text), 256))


def _chunks(text: Column, size: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("no"), F.substring(text, i * size + 1, F.lit(size)).alias("text")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, fp (62 bits), sha (of the normalised text, names it in later joins)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _valid(text_col).alias("text"))
    near = rows.where(F.length("text") <= HUGE_CHARS).select("doc_id", F.col("text").cast("binary").alias("text"))
    near = near.mapInArrow(giving_back(_hash_rows), f"doc_id long, sha binary, {_HASHED}")
    huge = rows.where(F.length("text") > HUGE_CHARS).withColumns({"sha": _sha(F.col("text")), "row": F.monotonically_increasing_id()})
    pieces = huge.select("doc_id", "sha", "row", F.explode(_chunks(F.col("text"), HUGE_CHARS)).alias("c"))
    pieces = pieces.select("doc_id", "sha", "row", "c.no", F.col("c.text").cast("binary").alias("text")).repartition("row", "no")
    hashed = pieces.mapInArrow(giving_back(_hash_rows), f"doc_id long, sha binary, row long, no int, {_HASHED}")
    parts = F.array_sort(F.collect_list(F.struct("no", "h1", "h2", "s1", "s2")))
    far = hashed.groupBy("row", "doc_id", "sha").agg(F.sum("n_bytes").alias("n_bytes"), parts.alias("p"))
    fold = [F.expr(f"aggregate(p, 0L, (a, x) -> (a * x.s{k} + x.h{k}) % {m}L)").alias(f"h{k}") for k, m in enumerate(MODULI, 1)]
    both = near.select("doc_id", "sha", "n_bytes", "h1", "h2").unionByName(far.select("doc_id", "sha", "n_bytes", *fold))
    return both.select("doc_id", "n_bytes", (F.shiftleft("h1", 31).bitwiseOR(F.col("h2"))).alias("fp"), "sha")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows sorted by (fp, n_bytes, salt, doc_id, sha, copy, no): the distinct texts of each (fp, n_bytes, salt)."""
    out: list[tuple] = []
    group = doc = None
    refs: list[list[str]] = []
    alive: list[int] = []
    seen, mine = 0, None  # chunks so far; the chunks themselves once no reference is equal up to here

    def close() -> None:
        nonlocal mine
        if doc is None or any(len(refs[r]) == seen for r in alive):
            return
        if mine is None:
            mine = refs[alive[0]][:seen] if alive else []
        out.append((*group, doc[0], doc[1], len(refs)))
        refs.append(mine)

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("fp", "n_bytes", "salt", "doc_id", "sha", "copy", "no", "text")]
        for fp, n, salt, doc_id, sha, copy, no, text in zip(*cols, strict=True):
            if (fp, n, salt) != group or (doc_id, sha, copy) != doc:
                close()
                if (fp, n, salt) != group:
                    group = (fp, n, salt)
                    refs.clear()
                doc, alive, seen, mine = (doc_id, sha, copy), list(range(len(refs))), 0, None
            before, alive = alive, [r for r in alive if no < len(refs[r]) and refs[r][no] == text]
            if not alive:
                if mine is None:
                    mine = refs[before[0]][:seen] if before else []
                mine.append(text)
            seen += 1
        if out:
            yield _distinct_batch(out)
            out.clear()
    close()
    yield _distinct_batch(out)


def _distinct_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["fp", "n_bytes", "salt", "doc_id", "sha", "class_no"])


def collisions(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """prints to (fp, n_bytes, sha, class_no >= 1) of texts that share a fingerprint and length with another, different text.

    A group's members are dealt over ceil(size / FAN_IN) salts and compared with the first of their salt; the
    distinct texts that remain go to the next level, with FAN_IN times fewer salts, until a group has one salt.
    """
    groups = prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("size")).where("size > 1")
    n = prints.count()
    groups = staged(groups, "print-groups", most=n)
    most = groups.agg(F.max("size")).first()[0] or 0
    members = staged(prints.join(small(groups), ["fp", "n_bytes"]).select("fp", "n_bytes", "size", "doc_id", "sha").distinct(), "members", most=n)
    text = docs.select(F.col(id_col).cast("long").alias("d"), _valid(text_col).alias("text"))
    level = 1
    while True:
        at, rows = small(members), text
        if at is not members:  # few: texts of other ids are not looked at; a plain = below would hash them to see that no hash is null
            asked = F.broadcast(members.select(F.col("doc_id").alias("asked")).distinct())
            rows = rows.join(asked, F.col("d").eqNullSafe(F.col("asked")), "left_semi")
        rows = rows.withColumn("text", ascii_lower("text")).withColumn("s", F.unhex(F.sha2("text", 256))).join(at, F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("sha")))
        rows = rows.withColumn("copy", F.monotonically_increasing_id())
        salts = F.ceil(F.col("size") / float(FAN_IN**level))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), salts)).select(
            "fp", "n_bytes", "salt", "doc_id", "sha", "copy", F.explode(_chunks(F.col("text"), CHUNK_CHARS)).alias("c")
        )
        rows = rows.select("fp", "n_bytes", "salt", "doc_id", "sha", "copy", "c.no", "c.text").repartition("fp", "n_bytes", "salt")
        rows = rows.sortWithinPartitions("fp", "n_bytes", "salt", "doc_id", "sha", "copy", "no")
        left = staged(rows.mapInArrow(giving_back(_compare), "fp long, n_bytes long, salt long, doc_id long, sha binary, class_no int"), "distinct-texts", most=n, dealt=True)
        if most <= FAN_IN**level:
            return left.where("class_no > 0").select("fp", "n_bytes", "sha", "class_no").dropDuplicates(["fp", "n_bytes", "sha"])
        members = staged(left.join(small(groups), ["fp", "n_bytes"]).select("fp", "n_bytes", "size", "doc_id", "sha"), "members")
        level += 1


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, sha, n_bytes, fp."""
    n = docs.count()
    prints = staged(fingerprints(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "prints", most=n, dealt=True)
    differ = collisions(docs, prints, id_col, text_col)
    if differ.isEmpty():
        prints = prints.withColumn("class_no", F.lit(0))
    else:
        prints = prints.join(differ, ["fp", "n_bytes", "sha"], "left").withColumn("class_no", F.coalesce("class_no", F.lit(0)))
    key = ["fp", "n_bytes", "class_no"]
    best = F.max(F.struct("doc_id", "row"))
    groups = prints.groupBy(*key).agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    out = prints.join(groups, key, "left")
    return out.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
        "sha", "n_bytes", "fp",
    ).coalesce(files_of(n))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns."""
    told = staged(decisions(docs, id_col, text_col).select("doc_id", "sha", "kept"), "exact-decisions")
    d, h, away, gone_h, asked, met = free_names(docs.columns, "id", "sha", "gone_id", "gone_sha", "asked_id", "met")
    gone = told.where("not kept").select(F.col("doc_id").alias(away), F.col("sha").alias(gone_h)).distinct()
    few, sha = small(gone), _sha(_valid(text_col))
    keyed = docs.withColumn(d, F.col(id_col).cast("long"))
    if few is not gone:  # few: texts of other ids stay unhashed, and match none
        ids = F.broadcast(gone.select(F.col(away).alias(asked), F.lit(True).alias(met)).distinct())
        keyed = keyed.join(ids, F.col(d).eqNullSafe(F.col(asked)), "left").drop(asked)
        keyed = keyed.withColumn(h, F.when(F.col(met), sha)).drop(met)
    else:
        keyed = keyed.withColumn(h, sha)
    same = F.col(d).eqNullSafe(F.col(away)) & (F.col(h) == F.col(gone_h))
    rows = keyed.join(few, same, "left_anti")
    # Rows that repeat both text and doc_id of the one that stays: they are in `gone` too, and one of them comes back.
    twice = told.groupBy("doc_id", "sha").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept and n > 1")
    twice = twice.select(F.col("doc_id").alias(away), F.col("sha").alias(gone_h))
    if not twice.isEmpty():
        rows = rows.unionByName(keyed.join(small(twice), same, "left_semi").dropDuplicates([d, h]))
    return rows.drop(d, h)
