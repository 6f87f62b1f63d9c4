"""What Python workers hold of words once a task is done."""

import numpy as np
import pyarrow as pa
import pytest

from nearfield.llm import common, exact_dedup, packing, shingles, simhash, token_output, tokens


class _Rows:
    """Stands for a table: what a task would run."""

    sparkSession = None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("lasting", [False, True])
def test_packing_gives_words_back_behind_a_task(spark, monkeypatch, lasting):
    monkeypatch.setattr(packing, "bounded_batches", lambda s: None)
    run = packing.pieces(_Rows(), tokens.default_path(), lasting=lasting)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words, añadió", ""])], names=["doc_id", "text"])
    out = pa.Table.from_batches(list(run(iter([batch]))))
    assert out.column("doc_id").to_pylist() == [1, 2] and out.column("length").to_pylist()[1] == 1
    assert bool(tokens._LOADED) is lasting
    tokens.forget()


def test_coding_blocks_gives_words_back():
    class Freq:
        value = token_output.scaled_frequencies(np.array([3, 5, 1]))

    for rows in (token_output._block_rows(Freq), token_output._decoded_rows(Freq)):
        tokens.bpe(tokens.default_path()).encode("some words")
        assert list(rows(iter([]))) == []
        assert not tokens._LOADED


def test_dedup_gives_memory_back_behind_a_task(spark, monkeypatch):
    """All text work of the dedup stages: their workers live on beside packing's."""
    docs = spark.createDataFrame([(i, f"some words that are here {i % 3} times and more of them") for i in range(9)], "doc_id long, text string")
    runs, given, kind = {}, [], type(docs)
    real = kind.mapInArrow

    def noted(self, run, schema, *more, **named):
        runs[run.__qualname__] = run
        return real(self, run, schema, *more, **named)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    for module in (exact_dedup, simhash, shingles):
        assert module.deduplicated(docs).count() <= 3
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    names = ["_hash_rows", "_compare", "_print_rows", "_sketch_rows", "_set_rows"]
    for name in names:
        before, (run,) = len(given), [r for q, r in runs.items() if q.startswith(name)]
        list(run(iter([])))
        assert len(given) == before + 1, name


def test_no_text_is_read_to_look_for_repeated_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "others are here"), (None, "x"), (None, "x")], "doc_id long, text string").repartition(2)
    seen, real = [], simhash.without
    monkeypatch.setattr(simhash, "without", lambda d, gone, named, *more: (seen.append(named), real(d, gone, named, *more))[1])
    rows = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.deduplicated(docs).collect())
    assert rows == [(0, "x"), (1, "a b c d"), (2, "others are here")]
    assert hasattr(seen[0], "staged_path") and "text" not in seen[0].columns and seen[0].count() == 5
