"""The pipeline's near-dedup stage against brute force over 5-word shingle sets."""

import corpus_pipeline
import numpy as np

from nearfield.llm import shingles, simhash


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited(seed, n, changes):
    """A text of n words and a copy with some of them changed."""
    rng = np.random.default_rng(seed)
    w = [f"w{x}" for x in rng.integers(0, 5000, n)]
    v = list(w)
    for at in rng.choice(n, changes, replace=False):
        v[at] = "changed"
    return " ".join(w), " ".join(v)


def test_stage_drops_edited_copies(spark):
    texts = [t for s, (n, c) in enumerate([(300, 3), (300, 5), (80, 1), (900, 12), (300, 40), (60, 20)]) for t in edited(s, n, c)]
    texts += ["a b c", "A  b c", "a b d", None, "", "x"]
    rows = [(10 * i, t, "en") for i, t in enumerate(texts)] + [(None, edited(0, 300, 3)[0] + " more", "en"), (50, "another text under an id that is there", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert any(similar(grams(texts[i]), grams(texts[i + 1])) and bin(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i + 1])).count("1") > 2 for i in range(0, 12, 2))
    left = corpus_pipeline._near_dedup(spark, docs, "")
    assert left.columns == docs.columns
    stay = [(r["doc_id"], r["text"]) for r in left.collect()]
    sets = [grams(t) for _, t in stay]
    assert not [1 for i, a in enumerate(sets) for b in sets[:i] if a and similar(a, b)]
    for row in rows:
        if (row[0], row[1]) not in stay:
            assert any(similar(grams(row[1]), s) or bin(simhash.fingerprint(row[1]) ^ simhash.fingerprint(t)).count("1") <= 2 for s, (_, t) in zip(sets, stay, strict=True)), row
    assert {(80, texts[8]), (90, texts[9]), (100, texts[10]), (110, texts[11]), (50, "another text under an id that is there")} <= set(stay)
    assert corpus_pipeline._near_dedup(spark, docs.limit(0), "").count() == 0


def test_groups_are_linked_like_all_pairs():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 2**63, int(rng.integers(5, 200)), dtype=np.uint64)
        for _ in range(12):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.07], rng.integers(0, 2**63, 1 + len(base) // 20, dtype=np.uint64)])))
    plain = [set(s.tolist()) for s in sets]

    def parts(pairs):
        of = list(range(len(sets)))
        for i, j in pairs:
            a, b = of[i], of[j]
            of = [min(a, b) if x in (a, b) else x for x in of]
        return of

    every = [(i, j) for i in range(len(sets)) for j in range(i) if similar(plain[i], plain[j])]
    found = shingles.linked(sets, 0.8)
    assert every and parts(found) == parts(every) and all(similar(plain[i], plain[j]) for i, j in found)
