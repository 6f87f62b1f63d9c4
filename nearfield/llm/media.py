"""Media columns stored by content-defined chunks.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become the samples of an 8-bit grey image 64
wide (binary PGM, lossless). A rolling gear hash cuts the image's bytes into chunks where its content says so; equal
passages give equal chunks. A task stores a chunk the first time it meets it, next to the document it came from; a
Spark join over the digests then finds the copies that other tasks stored and drops all but the first. Each image keeps
its ordered chunk list. To read, an image whose chunks all lie in its own row is put together where it is; only for the
others are foreign chunks fetched by a join on the digest. Every chunk and every image is verified against its digest.

Defined results. Null text counts as empty: 64 zero bytes. Equal texts are one image, read once; rows that repeat an id
get a row each. A very long text is one image; a task holds it and hashes it in slices. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, discard, small, staged, whole

WIDTH = 64
#: Chunk sizes in bytes; a cut needs CUT_BITS zero bits at the top of the hash. MIN_CHUNK exceeds the hash's window of
#: 32 bytes, so a cut depends on its own chunk only.
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 16_384, 11
#: Digests that a task remembers as stored before it forgets them, and bytes hashed at a time.
REMEMBERED, SLICE_BYTES = 300_000, 4 << 20

GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:4] for i in range(256)), "<u4")


def media_bytes(text: str) -> bytes:
    """The PGM image of a text."""
    data = text.encode()
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + data.ljust(rows * WIDTH, b"\0")


def payload_of(media: bytes) -> memoryview:
    """The samples of a PGM image written by media_bytes."""
    at = media.index(b"\n255\n") + 5
    width, rows = map(int, media[3 : at - 5].split())
    if media[:3] != b"P5\n" or len(media) - at != width * rows:
        raise ValueError("not such an image")
    return memoryview(media)[at:]


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Places (ends of chunks) where the gear hash of the 32 bytes before has CUT_BITS zero bits at the top."""
    found = []
    for at in range(0, len(data), SLICE_BYTES):
        before = min(at, 31)
        h = GEAR[data[at - before : at + SLICE_BYTES]]
        for k in (1, 2, 4, 8, 16):  # windows double: h over 2k bytes from two over k
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        found.append(np.flatnonzero(h[before:] >> np.uint32(32 - CUT_BITS) == 0) + at + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(n: int, candidates: np.ndarray) -> list[int]:
    """The ends of the chunks of n bytes, given the candidates in them."""
    ends, start = [], 0
    while n - start > MIN_CHUNK:
        k = np.searchsorted(candidates, start + MIN_CHUNK)
        end = min(int(candidates[k]) if k < len(candidates) else n, start + MAX_CHUNK, n)
        ends.append(end)
        start = end
    if start < n or not ends:
        ends.append(n)
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


_OWN = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))
_CONTAINER = "doc_id long, n_bytes long, media binary, recipe array<binary>, own array<struct<digest: binary, data: binary>>"


def _container_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stored: set[bytes] = set()
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        texts = batch.column("text")
        for doc_id, scalar in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            text = scalar.as_py()
            media = media_bytes(text)
            ends = chunk_ends(len(media), cut_candidates(np.frombuffer(media, np.uint8)))
            chunks = [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            recipe = [digest(c) for c in chunks]
            own = {}
            for d, c in zip(recipe, chunks, strict=True):
                if d not in stored:
                    own.setdefault(d, c)
            if len(stored) + len(own) > REMEMBERED:
                stored.clear()
            stored.update(own)
            data_bytes = len(text.encode())
            rows.append((doc_id, data_bytes, hashlib.sha256(media).digest(), recipe, [{"digest": d, "data": c} for d, c in own.items()]))
            size += len(media)
            if size > SLICE_BYTES:
                yield _container_batch(rows)
                rows, size = [], 0
        yield _container_batch(rows)


def _container_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), _OWN]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "media", "recipe", "own"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunk store, in the shared folder: uid, doc_id, n_bytes, media (SHA-256), recipe, own; each chunk is in one row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    held = staged(rows.mapInArrow(_container_rows, _CONTAINER).withColumn("uid", F.monotonically_increasing_id()), "containers")
    found = held.select("uid", F.posexplode("own.digest").alias("at", "digest"))
    owners = found.groupBy("digest").agg(F.min("uid").alias("owner"), F.count("*").alias("n")).where("n > 1")
    extra = found.join(owners, "digest").where("uid <> owner").groupBy("uid").agg(F.collect_list("at").alias("extra"))
    extra = staged(extra, "stored-twice")
    out = held.join(small(extra), "uid", "left")
    # The places that stay, by a set difference: its time is linear in the chunks of a row.
    stay = F.array_except(F.sequence(F.lit(0), F.size("own") - 1), "extra")
    own = F.when(F.col("extra").isNull(), F.col("own")).otherwise(F.transform(stay, lambda i: F.get("own", i)))
    out = staged(out.select("uid", "doc_id", "n_bytes", "media", "recipe", own.alias("own")), "chunk-store")
    discard(held)
    return out


def feature(samples: np.ndarray) -> str:
    """Moments, range, roughness and spread of the samples, from exact integer sums."""
    x = samples.astype(np.int64)
    counts = np.bincount(samples, minlength=256)
    edges = int(np.abs(np.diff(x)).sum())
    return f"n={len(x)};sum={int(x.sum())};squares={int((x * x).sum())};min={int(x.min())};max={int(x.max())};distinct={int((counts > 0).sum())};edges={edges}"


_FEATURES = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            named, recipe, own, fetched = (batch.column(c)[i].as_py() for c in ("media", "recipe", "own", "fetched"))
            chunks = {x["digest"]: x["data"] for x in (own or []) + (fetched or [])}
            if any(digest(c) != d for d, c in chunks.items()):
                raise ValueError("a chunk is broken")
            media = b"".join([chunks[d] for d in recipe])
            sha = hashlib.sha256(media)
            if sha.digest() != named:
                raise ValueError("an image is broken")
            payload = payload_of(media)
            samples = np.frombuffer(payload, np.uint8)
            out.append((named, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha.hexdigest(), feature(samples)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _FEATURES.split(", ")])


def features(held: DataFrame) -> DataFrame:
    """The chunk store to one row of _FEATURES per distinct image, read back from its chunks."""
    lacks = held.select("uid", "media", F.array_except("recipe", "own.digest").alias("lacks"))
    chosen = lacks.groupBy("media").agg(F.min(F.struct(F.size("lacks").alias("n"), "uid")).alias("x")).select("x.uid", "x.n")
    chosen = staged(chosen, "images-to-read")
    one = held.where(F.size(F.array_except("recipe", "own.digest")) == 0)  # whole rows own a chunk: one per image
    none = F.lit(None).cast("array<struct<digest: binary, data: binary>>").alias("fetched")
    whole_rows = one.select("media", "recipe", "own", none).mapInArrow(_feature_rows, _FEATURES)
    part = held.join(small(chosen.where("n > 0").select("uid")), "uid", "left_semi")
    needed = part.select("uid", F.explode(F.array_except("recipe", "own.digest")).alias("digest"))
    needed = staged(needed, "foreign-chunks")
    chunks = held.select(F.explode("own").alias("c")).select("c.digest", "c.data")
    chunks = chunks.join(small(needed.select("digest").distinct()), "digest", "left_semi")
    got = needed.join(chunks, "digest").groupBy("uid").agg(F.collect_list(F.struct("digest", "data")).alias("fetched"))
    rest = part.join(got, "uid").select("media", "recipe", "own", "fetched").mapInArrow(_feature_rows, _FEATURES)
    return whole_rows.unionByName(rest)


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes and the columns of _FEATURES but media."""
    held = store(docs, id_col, text_col)
    read = staged(features(held), "media-features")
    return held.select("doc_id", "n_bytes", "media").join(read, "media").drop("media")
