"""Chat formatting by columnar byte assembly.

Rows come sorted by conversation and turn. For each slice of a batch the lengths of all segments (markers, roles,
texts) are known from the Arrow offsets; their running sum gives every segment's place, and numpy scatters markers and
contents into one preallocated buffer, which becomes the Arrow column as it is. A conversation of any length streams
through as several parts, so a task never holds one whole.

The template is <|turn|>role<|say|>text<|end|> and a line feed. Control strings (the template's own and those of
common chat templates) that occur in a role or text get SUB and "c" behind their first character; SUB itself becomes
SUB and "e". That is reversible. The loss mask is the byte ranges of assistant texts.

Defined results. Null text and role are empty. Rows of a conversation are ordered by turn, then role, then text, null
turns first; null conv_ids are one conversation. Rows that repeat are turns of their own. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import staged, whole

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>\n"
#: Control strings of this template and of other common ones.
CONTROL = r"<\|(?:turn|say|end|im_start|im_end|endoftext|system|user|assistant)\|>|</?s>|\[/?INST\]|<</?SYS>>"
ESCAPE = "\x1a"
#: Bytes of text assembled at a time; a longer single text is copied on its own.
SLICE_BYTES = 4 << 20

_PARTS = "conv_id long, part long, data string, starts array<int>, lengths array<int>"
_CONTROL = re.compile(CONTROL)


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, ESCAPE, f"{ESCAPE}e")
    hit = pc.match_substring_regex(texts, CONTROL)
    if not pc.any(hit).as_py():
        return texts
    marked = [_CONTROL.sub(lambda m: f"{m[0][0]}{ESCAPE}c{m[0][1:]}", t) for t in texts.filter(hit).to_pylist()]
    return pc.replace_with_mask(texts, hit, pa.array(marked, texts.type))


def unescape(text: str) -> str:
    return text.replace(f"{ESCAPE}c", "").replace(f"{ESCAPE}e", ESCAPE)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets into them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Escaped roles and texts to the formatted bytes, each row's start in them (and the end), text starts and lengths."""
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (TURN, SAY, END)]
    role, role_at = _bytes_of(roles)
    text, text_at = _bytes_of(texts)
    n = len(texts)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = (len(m) for m in marks)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, mark in zip((0, 2, 4), marks, strict=True):
        out[starts[:, k, None] + np.arange(len(mark))] = mark
    for k, data, at in ((1, role, role_at), (3, text, text_at)):
        if n == 1:
            out[starts[0, k] : starts[0, k] + len(data)] = data
        else:
            out[np.repeat(starts[:, k] - at[:-1], np.diff(at)) + np.arange(len(data))] = data
    return out, np.append(starts[:, 0], len(out)), starts[:, 3], lengths[:, 3]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES of text, or a single row."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), SLICE_BYTES, "right")))
        yield at, min(len(sizes), at + n)
        at += n


def _format_rows(assistant: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = (), 0
        for batch in batches:
            for a, b in _slices(batch.column("text")):
                cut = batch.slice(a, b - a)
                ids = cut.column("conv_id").to_pylist()
                out, at, text_at, text_n = assemble(escape(cut.column("role")), escape(cut.column("text")))
                learn = pc.equal(cut.column("role"), assistant).to_numpy(zero_copy_only=False)
                first = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
                conv, parts, edges, spans, sizes = [], [], [], [], []
                for i, j in zip(first, [*first[1:], len(ids)], strict=True):
                    part = part + 1 if last == (ids[i],) else 0
                    last = (ids[i],)
                    mine = np.nonzero(learn[i:j])[0] + i
                    conv.append(ids[i])
                    parts.append(part)
                    edges.append(at[i])
                    spans.append(text_at[mine] - at[i])
                    sizes.append(text_n[mine])
                edges.append(at[-1])
                data = pa.StringArray.from_buffers(len(conv), pa.py_buffer(np.array(edges, np.int32)), pa.py_buffer(out))
                lists = [pa.array(x, pa.list_(pa.int32())) for x in (spans, sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(parts, pa.int64()), data, *lists], names=["conv_id", "part", "data", "starts", "lengths"])

    return rows


def formatted(rows: DataFrame, assistant: str = "assistant") -> DataFrame:
    """rows (conv_id, turn, role, text) to the formatted parts, written to the shared folder: rows of _PARTS."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", whole("role").alias("role"), whole("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return staged(rows.select("conv_id", "role", "text").mapInArrow(_format_rows(assistant), _PARTS), "chat")


def turns(data: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted part, unescaped."""
    out = []
    for turn in data.split(END)[:-1]:
        role, _, text = turn.removeprefix(TURN).partition(SAY)
        out.append((unescape(role), unescape(text)))
    return out


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _READ.split(", ")])

    at, state = None, None

    def closed() -> list[tuple]:
        return [] if state is None else [(at[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])]

    for batch in batches:
        out = []
        for conv_id, data, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "data", "starts", "lengths")), strict=True):
            if at != (conv_id,):
                out += closed()
                at, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in turns(data):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            raw = data.encode()
            for start, n in zip(starts, lengths, strict=True):
                learned = unescape(raw[start : start + n].decode())
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(data)
        yield batch_of(out)
    yield batch_of(closed())


def read_back(parts: DataFrame) -> DataFrame:
    """Rows of _READ, from the formatted parts alone."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_read_rows, _READ)
