"""Byte-level BPE ids through the tokenizers library, with remembered words.

The vocabulary's pre-tokenizer starts a new token at every space that follows a character other than white space,
whatever comes before. So a text falls into pieces at those spaces, each piece has its own ids, and a word met
again needs no new encoding. Pieces of plain letters, digits, punctuation and single line feeds are split here;
all others by the library's own pre-tokenizer. Memory is bounded: what doesn't fit a full cache goes to
a smaller one, which starts anew when it is full and replaces the full one where texts have changed.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode

from nearfield.llm.common import give_back

_BREAK = re.compile(r"(?<=\S) ")
#: Runs that the pre-tokenizer keeps whole. Letters up to U+00FF only: their class is the same in every Unicode version.
_RUN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")
#: Half the entries of a cache, and the longest piece that is remembered.
CACHE_WORDS, CACHE_CHARS = 400_000, 40

#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for U+0100 and up.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_ALPHABET = "".join(chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in range(256))


def _form(text: str) -> str:
    """A text's bytes in the byte-level alphabet."""
    return charmap_decode(text.encode(), "strict", _ALPHABET)[0]


class _Unsplit(Exception):
    """A word that ends with white space, or none: the space behind it starts no token."""


class _Ageing:
    """Two dicts of 2 * most entries together: `now` takes three quarters, the first met and so the frequent ones; `new` takes
    the others and starts anew when it is full. Asked so often that `now` must be of other texts, `new` takes its place."""

    def __init__(self, most: int) -> None:
        self.most, self.asked = most, 0
        self.now: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}

    def later(self, key: str) -> bytes | None:
        """What `new` holds of a key that isn't in `now`."""
        got = self.new.get(key)
        if got is not None:
            self.asked += 1
            if self.asked > 4 * self.most:
                self.now, self.new, self.asked = self.new, {}, 0
        return got

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.now) < self.most + self.most // 2:
            self.now[key] = value
        else:
            if len(self.new) >= max(1, self.most // 2):
                self.new, self.asked = {}, 0
            self.new[key] = value
        return value


class WordCachedBPE:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers, equal to Tokenizer.encode(text).ids."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pre, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        #: words: ids of a space and the key; units: ids of the key, or behind a NUL of the library's form of it.
        self.words, self.units = _Ageing(cache_words), _Ageing(cache_words)

    def _ids(self, form: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(form)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        got = self.units.now.get(unit) or self.units.later(unit)
        if got is None:
            got = self._ids(unit[1:] if unit[:1] == "\0" else _form(unit))
            if len(unit) <= CACHE_CHARS:
                self.units.put(unit, got)
        return got

    def _piece(self, piece: str) -> bytes:
        """A text's first piece, or one that the short way below can't take."""
        runs = _RUN.findall(piece)
        if len("".join(runs)) != len(piece) or "\n\n" in piece:
            runs = ["\0" + u for u, _ in self.pre.pre_tokenize_str(piece)]
        return b"".join([self._unit(u) for u in runs])

    def _word(self, word: str, inner: bool = False) -> bytes:
        """Ids of a space and word; the first run takes the space. Words that end with white space, or none, are never
        remembered, so an inner one gets here wherever it is met."""
        words = self.words
        got = words.later(word)
        if got is not None:
            return got
        if not word or word[-1].isspace():
            if inner:
                raise _Unsplit
            return self._piece(f" {word}")
        runs = [word] if word.isascii() and word.isalpha() else _RUN.findall(word)
        if len(runs) == 1 and len(runs[0]) == len(word) and word != "\n":
            got = self._ids("Ġ" + (word if word.isascii() else _form(word)))
        elif runs and len("".join(runs)) == len(word) and runs[0] != "\n" and "\n\n" not in word:
            first = runs[0]
            got = (words.now.get(first) or self._word(first)) + b"".join([self._unit(u) for u in runs[1:]])
        else:
            got = self._piece(f" {word}")
        return words.put(word, got) if len(word) <= CACHE_CHARS else got

    def encode(self, text: str) -> bytes:
        parts, inner = text.split(" "), True
        if len(parts) > 1 and (not parts[0] or parts[0][-1].isspace()):
            parts, inner = _BREAK.split(text), False
        try:
            return self._joined(parts, inner)
        except _Unsplit:
            return self._joined(_BREAK.split(text), False)

    def _joined(self, parts: list[str], inner: bool) -> bytes:
        first, known = self._piece(parts[0]), self.words.now
        rest = [known.get(w) or self._word(w, inner) for w in parts[1:-1]]
        if len(parts) > 1:
            rest.append(known.get(parts[-1]) or self._word(parts[-1]))
        return first + b"".join(rest)


_LOADED: dict[tuple[str, int], WordCachedBPE] = {}


def bpe(path: str, cache_words: int = CACHE_WORDS) -> WordCachedBPE:
    """One for each Python worker and cache size."""
    if (path, cache_words) not in _LOADED:
        _LOADED[path, cache_words] = WordCachedBPE(path, cache_words)
    return _LOADED[path, cache_words]


def forget() -> None:
    """Give back what this Python worker holds for words. Workers live on after a task, and Spark hands tasks to all idle
    ones in turn: what they remember adds up behind other work."""
    if _LOADED:
        _LOADED.clear()
        give_back()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
