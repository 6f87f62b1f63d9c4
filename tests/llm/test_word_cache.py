"""The word cache of the tokenizer: frequent words are met once, its size is bounded, and changed texts get room."""

import random

import pytest

from nearfield.llm import tokens


def _text(rng, common, n):
    rare = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    return " ".join(w for r in rare for w in (r, rng.choice(common), f"{rng.choice(common)},"))


def test_frequent_words_are_worked_out_once():
    rng, asked = random.Random(5), []
    bpe = tokens.WordCachedBPE(tokens.default_path(), 200)
    plain = bpe._word
    bpe._word = lambda word, inner=False: asked.append(word) or plain(word, inner)
    for _ in range(10):
        bpe.encode("first " + _text(rng, ["common", "other"], 100) + " last")
    assert len(asked) > 900
    assert [asked.count(w) for w in ("common", "other", "common,", "other,")] == [1, 1, 1, 1]


@pytest.mark.parametrize("most", [1, 2, 50])
def test_a_bounded_cache_gives_the_librarys_ids(most):
    rng = random.Random(7)
    bpe = tokens.WordCachedBPE(tokens.default_path(), most)
    for common in (["one", "añadió", "x.\ny"], ["two", "日本", "12a"], ["one", "###", " "]):
        for _ in range(5):
            text = _text(rng, common, 60)
            assert list(memoryview(bpe.encode(text)).cast("I")) == bpe.tokenizer.encode(text, add_special_tokens=False).ids
            for held in (bpe.words, bpe.units):
                assert len(held.now) + len(held.new) <= 2 * most


def test_changed_texts_take_the_place_of_old_ones():
    bpe = tokens.WordCachedBPE(tokens.default_path(), 20)
    for i in range(100):
        bpe.encode(f"start {'a' * (i % 10 + 1)}{'b' * (i // 10 + 1)} end")
    assert "changed" not in bpe.words.now
    for _ in range(100):
        bpe.encode("start changed texts end")
    assert {"changed", "texts"} <= set(bpe.words.now)
