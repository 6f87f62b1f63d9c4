"""Unit lattices of op6 against plain sums, and how often known units are looked up."""

import math

import numpy as np

from nearfield.llm import piece_sampling

UNITS = ["", "a", "international", "añadió", "▁x", "日本語の", "  b", "e" * 150, "ab" * 70 + "日", "running" * 12, "\U0001f600z"]


def _weights(lattice):
    """Surface with its space mark, to log weight and id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.default_path())
    skip = {i for i in range(sp.vocab_size()) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
    return {sp.id_to_piece(i): (-2.0 * math.log1p(-sp.get_score(i)), i) for i in range(sp.vocab_size()) if i not in skip}


def test_shares_are_those_of_plain_sums():
    lattice = piece_sampling.PieceLattice(piece_sampling.default_path(), 2.0)
    known = _weights(lattice)
    ends = lattice._ends([*UNITS, *UNITS])
    assert (ends[: len(UNITS)] == ends[len(UNITS) :]).all()
    for unit, end in zip(UNITS, ends.tolist(), strict=False):
        marks = "".join("▁" if c == " " else "\0" if c == "▁" else c for c in " " + unit)
        alpha = [0.0]
        for j in range(1, len(marks) + 1):
            terms = []
            for n in range(1, min(j, lattice.longest) + 1):
                weight, _ = known.get(marks[j - n : j], (lattice.byte_weight if n == 1 else -math.inf, 0))
                terms.append(weight + alpha[j - n])
            top = max(terms)
            shares = np.cumsum([math.exp(t - top) for t in terms])
            alpha.append(top + math.log(shares[-1]))
            node = end - len(marks) + j
            assert np.allclose(lattice.share[node, : len(terms) - 1], shares[:-1] / shares[-1], atol=1e-6)
            assert (lattice.share[node, len(terms) - 1 :] == 2).all()
            for n in range(1, len(terms) + 1):
                if marks[j - n : j] in known:
                    assert lattice.piece[node, n - 1] == known[marks[j - n : j]][1]


def test_known_units_are_looked_up_once():
    class Counted(dict):
        looks = 0

        def get(self, *a):
            Counted.looks += 1
            return super().get(*a)

    lattice = piece_sampling.PieceLattice(piece_sampling.default_path(), 2.0)
    lattice._ends(["some", "known", "words"])
    lattice.end = Counted(lattice.end)
    units = ["some", "known", "words"] * 100 + ["new"]
    ends = lattice._ends(units)
    assert Counted.looks <= len(units) + 1
    assert [lattice.end[u] for u in units] == ends.tolist()


def test_a_full_memory_starts_anew(monkeypatch):
    lattice = piece_sampling.PieceLattice(piece_sampling.default_path(), 2.0)
    texts = ["one two three", "three four  five", "one six"]
    want = [x.tolist() for x in lattice.sample(texts, np.arange(3), 7)]
    monkeypatch.setattr(piece_sampling, "NODES", 0)
    assert [lattice.sample([t], np.array([i]), 7)[0].tolist() for i, t in enumerate(texts)] == want
