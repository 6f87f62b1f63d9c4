"""WARC archives as a chunked record table.

A record is one or more rows (record, chunk_no, last, data, digest_so_far): the bytes of its chunks in order are the
record as WARC/1.1 has it, header, HTTP header, payload and the closing line ends. No chunk holds more than CHUNK bytes
of payload, and each carries the SHA-1 of the payload up to its end, so records of any size are written and checked
piece by piece and a broken chunk is found where it is. Records of one chunk, nearly all, are read back where they lie;
only the rows of longer ones are dealt by record and streamed in order.

Defined results. Null html is an empty payload. Of records with equal payloads (length and SHA-1) of at least min_bytes
bytes, that with the smallest page_id is a response and the others are revisits of it; rows that repeat that page_id are
responses too, null page_ids count as largest. Null url is empty; line ends in it are percent-encoded. Extra columns are
ignored. An empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import small, staged, whole

#: Bytes of payload in a chunk at most.
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_TABLE = "record long, chunk_no int, last boolean, data binary, digest_so_far binary"


def _views(column: pa.Array) -> Iterator[memoryview]:
    for x in column:
        yield memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")


def sha1_in_pieces(data: memoryview) -> bytes:
    h = hashlib.sha1()
    for at in range(0, len(data), CHUNK):
        h.update(data[at : at + CHUNK])
    return h.digest()


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        views = list(_views(batch.column("html")))
        made = [batch.column("page_id"), pa.array([len(v) for v in views], pa.int64()), pa.array([sha1_in_pieces(v) for v in views], pa.binary())]
        yield pa.RecordBatch.from_arrays(made, names=["page_id", "n_bytes", "digest"])


def header(kind: str, page_id: int | None, url: str, digest: bytes, n_bytes: int, refers_to: int | None, date: str) -> bytes:
    """The WARC header and the HTTP header, which states the whole payload's length also in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields.append(f"Content-Length: {len(http) + (n_bytes if kind == 'response' else 0)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def _record_rows(date: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            rest = zip(*(batch.column(c).to_pylist() for c in ("record", "page_id", "url", "refers_to")), strict=True)
            for view, (record, page_id, url, refers_to) in zip(_views(batch.column("html")), rest, strict=True):
                kind = "response" if refers_to is None else "revisit"
                head = header(kind, page_id, url, sha1_in_pieces(view), len(view), refers_to, date)
                body = view if kind == "response" else view[:0]
                so_far, n = hashlib.sha1(), max(1, -(-len(body) // CHUNK))
                for k in range(n):
                    piece = body[k * CHUNK : (k + 1) * CHUNK]
                    so_far.update(piece)
                    data = b"".join((head if k == 0 else b"", piece, b"\r\n\r\n" if k == n - 1 else b""))
                    out.append((record, k, k == n - 1, data, so_far.digest()))
                    size += len(data)
                    if size > 8 * CHUNK:
                        yield _table_batch(out)
                        out, size = [], 0
            yield _table_batch(out)

    return rows


def _table_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _TABLE.split(", ")])


def write_records(pages: DataFrame, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html) to the archive, written to the shared folder: rows of _TABLE."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), whole("url").alias("url"), whole("html").alias("html"))
    digests = staged(rows.select("page_id", "html").mapInArrow(_digest_rows, "page_id long, n_bytes long, digest binary"), "page-digests")
    firsts = digests.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = staged(firsts.where("n > 1").select("digest", "n_bytes", "first"), "page-firsts")
    keyed = rows.withColumns({"k": F.unhex(F.sha1("html")), "b": F.octet_length("html").cast("long")})
    told = keyed.join(small(firsts), (F.col("k") == F.col("digest")) & (F.col("b") == F.col("n_bytes")), "left")
    told = told.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first")))
    told = told.select(F.monotonically_increasing_id().alias("record"), "page_id", "url", "html", "refers_to")
    return staged(told.mapInArrow(_record_rows(date), _TABLE), "warc")


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str) -> int | None:
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "None" else int(x)


class _Reader:
    """One record, chunk by chunk."""

    def __init__(self) -> None:
        self.seen, self.sha = 0, hashlib.sha1()

    def take(self, chunk_no: int, last: bool, data: bytes, so_far: bytes) -> tuple | None:
        view = memoryview(data)
        if chunk_no == 0:
            at = data.index(b"\r\n\r\n") + 4
            self.head = _fields(data[:at])
            http = data.index(b"\r\n\r\n", at) + 4
            self.http, self.http_bytes = _fields(data[at:http]), http - at
            view = view[http:]
        if last:
            if bytes(view[-4:]) != b"\r\n\r\n":
                raise ValueError("a record doesn't end where it should")
            view = view[:-4]
        self.sha.update(view)
        self.seen += len(view)
        if self.sha.digest() != so_far:
            raise ValueError(f"chunk {chunk_no} of {self.head['warc-record-id']} is broken")
        if not last:
            return None
        kind, n, digest = self.head["warc-type"], int(self.http["content-length"]), self.head["warc-payload-digest"].removeprefix("sha1:")
        if self.seen != int(self.head["content-length"]) - self.http_bytes or kind == "response" and (self.seen != n or base64.b32encode(self.sha.digest()).decode() != digest):
            raise ValueError(f"{self.head['warc-record-id']} is broken")
        to = self.head.get("warc-refers-to")
        return _page(self.head["warc-record-id"]), n, digest, kind, None if to is None else _page(to)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, kinds = _Reader(), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        out = []
        for chunk_no, last, data, so_far in zip(*(batch.column(c).to_pylist() for c in ("chunk_no", "last", "data", "digest_so_far")), strict=True):
            if chunk_no == 0:
                reader = _Reader()
            if (got := reader.take(chunk_no, last, data, so_far)) is not None:
                out.append(got)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _READ.split(", ")])


def read_records(table: DataFrame) -> DataFrame:
    """Rows of _READ, one per record; raises on broken chunks, digests or lengths."""
    short = table.where("chunk_no = 0 and last")
    long = table.where("not (chunk_no = 0 and last)").repartition("record").sortWithinPartitions("record", "chunk_no")
    return short.mapInArrow(_read_rows, _READ).unionByName(long.mapInArrow(_read_rows, _READ))


def stream(table: DataFrame) -> Iterator[bytes]:
    """The archive's bytes, chunk by chunk, as a .warc file has them (for export; one partition at a time)."""
    for row in table.orderBy("record", "chunk_no").select("data").toLocalIterator():
        yield bytes(row["data"])
