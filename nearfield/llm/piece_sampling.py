"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

Pieces never cross from a character to a space, so a text's lattice falls into the lattices of its units: a run of space
marks and what follows up to the next space. Each distinct unit's forward table is computed once: alpha[j] sums, over all
pieces that end at j, alpha at their start times their weight. Going backward from a unit's end, the piece that ends at j
is drawn with its share of alpha[j]; numpy steps all units of a slice at once. The draw at a character comes from a counter
hash of (seed, row key, place in the text), so a row's segmentation is the same in any partition, batch or retry.

A long text goes through in blocks cut before spaces. A unit of more than LONG_CHARS characters (a text without spaces) is
filtered forward in windows, of which only the last alphas are kept, since no piece is longer; then the windows are taken
from the last to the first, filtered again and sampled. So what a task holds beside the text and its ids is bounded.

The vocabulary's ranks are not probabilities: a piece of rank r weighs (1 + r) ** -alpha. A character outside the
vocabulary (and a literal space mark) becomes the byte pieces of its UTF-8 form. Decoding joins pieces, turns space
marks into spaces and drops the first.

Defined results. Null text is encoded as the empty text: the space mark alone if `text` is empty. Rows are keyed by
`key`, null keys count as -1; rows that repeat key and text get the same ids. Extra columns are kept; a new column whose
name is taken gets underscores behind it. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, whole

SPACE = "▁"
#: Nodes of unit lattices that a worker remembers (at about 100 bytes each), and the longest unit it remembers.
NODES, REMEMBERED_CHARS = 1_500_000, 64
#: Characters of text worked on at a time, and those of a unit that goes through in windows, and of a window.
SLICE_CHARS, LONG_CHARS, WINDOW_CHARS = 400_000, 4_096, 1 << 15

#: Slots of the filter of each piece length, as a power of two.
FILTER_BITS = 18
#: Slots of the table of all pieces, as a power of two.
TABLE_BITS = 19

_B = 0x9E3779B97F4A7C15 | 1
_WEYL = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PieceLattice:
    """Vocabulary, remembered unit lattices, sampling and decoding. Memory is bounded by NODES, SLICE_CHARS and WINDOW_CHARS."""

    def __init__(self, model: str, alpha: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.byte = np.full(256, -1, np.int64)
        self.surface: list[bytes] = [b""] * len(pieces)
        normal: dict[int, list[tuple[int, int, float]]] = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b], self.surface[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.surface[i] = p.replace(SPACE, " ").encode()
                if p and SPACE not in p.lstrip(SPACE):
                    normal.setdefault(len(p), []).append((self._hash(p), i, -alpha * np.log1p(-sp.get_score(i))))
        self.longest = max(normal)
        self.by_length = {}
        for n, rows in normal.items():
            rows.sort()
            keys, maybe = np.array([r[0] for r in rows], np.uint64), np.zeros(1 << FILTER_BITS, bool)
            maybe[self._slot(keys)] = True
            self.by_length[n] = (keys, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]), maybe)
        self.byte_weight = -alpha * np.log1p(len(pieces))
        every = [(h, i, w, n) for n, rows in normal.items() for h, i, w in rows]
        slots = self._slot(np.array([e[0] for e in every], np.uint64), TABLE_BITS).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        per_slot = np.bincount(slots, minlength=1 << TABLE_BITS)
        #: All pieces by the slot of their hash: those of a slot from first[slot] on, at most `run`, and as many that stand for none.
        self.run, self.taken, self.first = int(per_slot.max()), per_slot > 0, (np.cumsum(per_slot) - per_slot).astype(np.int32)
        by_slot = [every[i] for i in order.tolist()] + [(0, 0, 0.0, 0)] * self.run
        self.keys, self.piece_ids = np.array([e[0] for e in by_slot], np.uint64), np.array([e[1] for e in by_slot], np.int32)
        self.weights, self.lengths = np.array([e[2] for e in by_slot]), np.array([e[3] for e in by_slot], np.int32)
        self._forget()

    @staticmethod
    def _slot(h: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
        """Where a hash stands in the filter of its length: most strings that are no piece are out before the search."""
        return ((h ^ (h >> np.uint64(32))) * _WEYL) >> np.uint64(64 - bits)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _B + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _forget(self) -> None:
        self.end: dict[str, int] = {}
        self.used = 0
        self.share = np.zeros((0, self.longest), np.float32)
        self.piece = np.zeros((0, self.longest), np.int32)

    def _room(self, n: int) -> None:
        if self.used + n > len(self.share):
            size = max(2 * len(self.share), self.used + n, 1 << 16)
            for name in ("share", "piece"):
                old = getattr(self, name)
                new = np.zeros((size, self.longest), old.dtype)
                new[: self.used] = old[: self.used]
                setattr(self, name, new)

    @staticmethod
    def _chars(units: list[str]) -> np.ndarray:
        """The code points of units, each behind its first space: spaces as marks, a literal mark as no character."""
        code = _codes("".join([" " + u for u in units])).astype(np.uint64)
        code[code == ord(SPACE)] = 0x110000
        code[code == ord(" ")] = ord(SPACE)
        return code

    def _matches(self, code: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece length: where pieces start (left: characters to the unit's end), their ids and log weights."""
        total = len(code)
        h = np.zeros(total, np.uint64)
        for n in range(1, min(self.longest, total) + 1):
            last = np.zeros(total, np.uint64)
            last[: total - n + 1] = code[n - 1 :]
            h = h * np.uint64(_B) + last + np.uint64(1)
            if n not in self.by_length:
                continue
            keys, piece_ids, weights, maybe = self.by_length[n]
            at = np.flatnonzero(maybe[self._slot(h)] & (left >= n))
            k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[k] == h[at]
            yield n, at[hit], piece_ids[k[hit]], weights[k[hit]]

    @staticmethod
    def _bare_ids(code: np.ndarray) -> np.ndarray:
        """What stands for characters without a piece until they become bytes."""
        return -np.where(code == 0x110000, ord(SPACE), code).astype(np.int64) - 1

    def learn(self, units: list[str]) -> None:
        """Forward filtering: the lattices of units that aren't known. A unit's characters are SPACE, then its own.

        All units of at least j characters take step j at once. Row r of `hashes` and `alpha` belongs to the pieces that
        start at one character: their hash up to here, and alpha before them. The last `longest` rows are in use."""
        units = sorted(units, key=len, reverse=True)
        if not units:
            return
        sizes = np.array([len(u) + 1 for u in units], np.int64)
        total = int(sizes.sum())
        self._room(total)
        code = self._chars(units)
        starts = np.cumsum(sizes) - sizes
        rows = 4 * self.longest
        hashes = np.empty((rows, len(units)), np.uint64)
        alpha = np.zeros((rows + 1, len(units)))  # before a unit's first character it is 0
        r = -1
        for j, m in enumerate(np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right").tolist(), 1):
            r += 1
            if r == rows:
                r = self.longest - 1
                hashes[:r, :m] = hashes[rows - r :, :m]
                alpha[: r + 1, :m] = alpha[rows - r :, :m]
            ends = starts[:m] + j - 1
            here = code[ends]
            reach = min(j, self.longest)
            hashes[r, :m] = 0
            h = hashes[r - reach + 1 : r + 1, :m]
            h *= np.uint64(_B)
            h += here + np.uint64(1)
            terms = np.full((reach, m), -np.inf)  # row n - 1: the piece of length n that ends here
            ids = np.zeros((reach, m), np.int32)
            row, at, k = self._found(h)
            terms[row, at] = self.weights[k]
            ids[row, at] = self.piece_ids[k]
            bare = np.isneginf(terms[0])
            if bare.any():
                terms[0, bare] = self.byte_weight
                ids[0, bare] = self._bare_ids(here[bare])
            terms += alpha[r - reach + 1 : r + 1, :m][::-1]
            top = terms.max(0)
            terms -= top
            shares = np.exp(terms, out=terms)
            total_share = shares.sum(0)
            alpha[r + 1, :m] = top + np.log(total_share)
            to = self.used + ends
            own = np.full((m, self.longest), 2.0, np.float32)
            own[:, : reach - 1] = (np.cumsum(shares[:-1], 0) / total_share).T
            self.share[to] = own
            own = np.zeros((m, self.longest), np.int32)
            own[:, :reach] = ids.T
            self.piece[to] = own
        self.end.update(zip(units, (self.used + starts + sizes - 1).tolist(), strict=True))
        self.used += total

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are pieces, where row i of h holds strings of len(h) - i characters: length - 1, column, place in `keys`."""
        slots = (h ^ (h >> np.uint64(32))) * _WEYL
        slots >>= np.uint64(64 - TABLE_BITS)
        slots = slots.view(np.int64)
        row, at = np.divmod(np.flatnonzero(self.taken.take(slots)), h.shape[1])
        k, own = self.first[slots[row, at]], h[row, at]
        for _ in range(self.run - 1):  # keys of one slot stand next to each other
            k += self.keys[k] != own
        row = len(h) - 1 - row
        hit = (self.keys[k] == own) & (self.lengths[k] == row + 1)
        return row[hit], at[hit], k[hit]

    def _ends(self, units: list[str]) -> np.ndarray:
        def known() -> np.ndarray:
            return np.fromiter(map(self.end.get, units, repeat(-1)), np.int64, len(units))

        got = known()
        new = np.flatnonzero(got < 0).tolist()
        if new and self.used > NODES:
            self._forget()
            self.learn(list(set(units)))
            return known()
        if new:
            missing = [units[i] for i in new]
            self.learn(list(set(missing)))
            got[new] = list(map(self.end.__getitem__, missing))
        return got

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """One array of ids per text, drawn by (seed, key, place)."""
        streams = _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(int(_WEYL) * (seed + 1) & 0xFFFFFFFFFFFFFFFF))
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int, list[str]]] = []
        size = 0

        def flush() -> None:
            for (doc, _, _), ids in zip(held, self._sample_blocks([(streams[d], place, units) for d, place, units in held]), strict=True):
                parts[doc].append(ids)
            held.clear()

        for doc, text in enumerate(texts):
            for place, units in _unit_blocks(text):
                if len(units) == 1 and len(units[0]) > LONG_CHARS:
                    flush()
                    size = 0
                    parts[doc].append(self._sample_long(units[0], place, streams[doc]))
                    continue
                held.append((doc, place, units))
                size += sum(map(len, units)) + len(units)
                if size > SLICE_CHARS:
                    flush()
                    size = 0
        flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]

    def _sample_blocks(self, blocks: list[tuple[np.uint64, int, list[str]]]) -> list[np.ndarray]:
        """The ids of blocks (stream, characters before it, units)."""
        if not blocks:
            return []
        counts = np.array([len(units) for _, _, units in blocks], np.int64)
        units = [u for _, _, own in blocks for u in own]
        node = self._ends(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
        doc = np.repeat(np.arange(len(blocks)), counts)
        begin = np.cumsum(counts) - counts
        place = np.cumsum(sizes)
        place -= np.repeat(place[begin] - sizes[begin] - np.array([p for _, p, _ in blocks], np.int64), counts)  # characters of the text up to each unit's end
        stream = np.array([s for s, _, _ in blocks], np.uint64)[doc]
        live, left, cur, pos = np.arange(len(units)), sizes.copy(), node, place
        took, drawn = [], []
        while len(live):
            u = _uniform(stream[live], pos)
            n = (self.share[cur] > u[:, None]).argmax(1)  # the first running share above the draw; the last is 2
            took.append(live)
            drawn.append(self.piece[cur, n].astype(np.int64))
            n += 1
            left = left - n
            on = left > 0
            live, left, cur, pos = live[on], left[on], (cur - n)[on], (pos - n)[on]
        unit_pieces = np.zeros(len(units), np.int64)
        for who in took:
            unit_pieces[who] += 1
        ends = np.cumsum(unit_pieces)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for t, (who, ids) in enumerate(zip(took, drawn, strict=True)):
            flat[ends[who] - 1 - t] = ids
        doc_pieces = np.bincount(doc, weights=unit_pieces, minlength=len(blocks)).astype(np.int64)
        edges = np.cumsum(doc_pieces)[:-1]
        return [self._bytes_for_bare(x) for x in np.split(flat, edges)]

    def _filtered(self, code: np.ndarray, begin: int, end: int, before: list[float]) -> tuple[list[float], list[list[tuple[float, int, int]]]]:
        """Forward over characters [begin, end) of a unit, given the alphas of the characters before (up to `longest`, in
        any scale): the last alphas, and for each character the terms (weight times alpha, length, id) that end there."""
        lead = len(before) - 1  # before[0] may be the alpha ahead of the unit's first character
        seg = code[begin - lead : end]
        terms: list[list[tuple[float, int, int]]] = [[] for _ in range(end - begin)]
        bare = np.ones(len(seg), bool)
        for n, at, ids, weights in self._matches(seg, len(seg) - np.arange(len(seg))):
            if n == 1:
                bare[at] = False
            on = at + n > lead
            for i, w, x in zip((at[on] + n - 1 - lead).tolist(), np.exp(weights[on]).tolist(), ids[on].tolist(), strict=True):
                terms[i].append((w, n, x))
        some = np.flatnonzero(bare[lead:])
        for i, x in zip(some.tolist(), self._bare_ids(seg[lead:][some]).tolist(), strict=True):
            terms[i].append((float(np.exp(self.byte_weight)), 1, x))
        alphas = list(before)
        for i, own in enumerate(terms):
            at, total, shares = lead + 1 + i, 0.0, []
            for w, n, x in own:
                if n <= at:
                    w *= alphas[at - n]
                    total += w
                    shares.append((w, n, x))
            terms[i] = shares
            alphas.append(total)
            if total < 1e-200:  # shares are ratios within one character: rescale what later ones refer to
                for j in range(max(0, at + 1 - self.longest), at + 1):
                    alphas[j] *= 1e200
        return alphas[-self.longest :], terms

    def _sample_long(self, unit: str, place: int, stream: np.uint64) -> np.ndarray:
        code = self._chars([unit])
        edges = [*range(0, len(code), WINDOW_CHARS), len(code)]
        states = [[1.0]]
        for a, b in zip(edges[:-2], edges[1:], strict=False):
            states.append(self._filtered(code, a, b, states[-1])[0])
        out, at = [], len(code)  # at: characters that are not yet covered
        for a, b, before in zip(edges[-2::-1], edges[:0:-1], states[::-1], strict=True):
            terms = self._filtered(code, a, b, before)[1]
            draws = _uniform(np.full(b - a, stream), place + np.arange(a + 1, b + 1)).tolist()
            while at > a:
                own = terms[at - 1 - a]
                rest = draws[at - 1 - a] * sum(t[0] for t in own)
                for share, n, x in own:
                    rest -= share
                    if rest < 0:
                        break
                out.append(x)
                at -= n
        return self._bytes_for_bare(np.array(out[::-1], np.int64))

    def _bytes_for_bare(self, ids: np.ndarray) -> np.ndarray:
        bare = ids < 0
        if not bare.any():
            return ids
        if ids[bare].min() >= -128:
            ids[bare] = self.byte[-ids[bare] - 1]
            return ids
        made = [self.byte[list(chr(-i - 1).encode("utf-8", "surrogatepass"))].tolist() if i < 0 else [i] for i in ids.tolist()]
        return np.array([x for m in made for x in m], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


def _uniform(stream: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The draw at a place of a stream, in [0, 1)."""
    return (_mixed(stream + _WEYL * place.astype(np.uint64)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)


def _unit_blocks(text: str) -> Iterator[tuple[int, list[str]]]:
    """A text behind a space, in blocks of units: the characters before the block, and each unit without its first space.

    Blocks end before a space that follows no space; a unit of more than LONG_CHARS is a block of its own."""
    at = -1  # the place of the block's first space; the text's own first one is at -1
    while at < len(text):
        end = at + SLICE_CHARS
        if end < len(text):
            end = text.find(" ", end)
            while end > 0 and text[end - 1] == " ":
                end = text.find(" ", end + 1)
        end = len(text) if end < 0 or end > len(text) else end
        units = _units(text[at + 1 : end])
        if max(map(len, units)) <= LONG_CHARS:
            yield at + 1, units
        else:
            place, few = at + 1, []
            for u in units:
                if len(u) > LONG_CHARS:
                    if few:
                        yield place, few
                        place += sum(map(len, few)) + len(few)
                    yield place, [u]
                    place, few = place + len(u) + 1, []
                else:
                    few.append(u)
            if few:
                yield place, few
        if end == len(text):
            return
        at = end


def _units(block: str) -> list[str]:
    """A block behind its first space cut before each space that follows no space."""
    parts = block.split(" ")
    if "" not in parts[1:] and parts[0]:
        return parts
    out, spaces = [], 0
    for p in parts:
        if p:
            out.append(" " * spaces + p)
            spaces = 0
        else:
            spaces += 1
    return [*out, " " * (spaces - 1)] if spaces else out


def _new_name(columns: list[str], wanted: str) -> str:
    while wanted.lower() in {c.lower() for c in columns}:
        wanted += "_"
    return wanted


_LOADED: dict[tuple[str, float], PieceLattice] = {}


def lattice(model: str, alpha: float) -> PieceLattice:
    """One for each Python worker."""
    if (model, alpha) not in _LOADED:
        _LOADED[model, alpha] = PieceLattice(model, alpha)
    return _LOADED[model, alpha]


def encode(docs: DataFrame, model: str, seed: int = 42, alpha: float = 2.0, key_col: str = "doc_id", text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """docs with a last column out_col: array<int>."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series, keys: pd.Series) -> pd.Series:
        got = lattice(model, alpha).sample(texts.tolist(), keys.to_numpy(np.int64), seed)
        return pd.Series([x.astype(np.int32) for x in got], dtype=object)

    bounded_batches(docs.sparkSession)
    return docs.withColumn(_new_name(docs.columns, out_col), ids(whole(text_col), F.coalesce(F.col(key_col).cast("long"), F.lit(-1).cast("long"))))


def decode(rows: DataFrame, model: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """rows with a last column out_col: the text that ids_col stands for; null ids give null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        back = lattice(model, 1.0).decode
        return pd.Series([None if x is None else back(np.asarray(x, np.int64)) for x in ids], dtype=object)

    bounded_batches(rows.sparkSession)
    return rows.withColumn(_new_name(rows.columns, out_col), text(ids_col))


_ROUND_TRIP = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean"


def round_trip(docs: DataFrame, model: str, seed: int = 42, alpha: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), lossless (decodes to the text).

    Encodes and decodes in one pass, without passing the ids through Spark."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = lattice(model, alpha)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = both.sample(texts, batch.column("key").to_numpy(zero_copy_only=False), seed)
            made = [
                batch.column("doc_id"), pa.array([len(x) for x in got], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()),
                pa.array([both.decode(x) == t for x, t in zip(got, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    bounded_batches(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("key")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key, whole(text_col).alias("text")).mapInArrow(rows, _ROUND_TRIP)
