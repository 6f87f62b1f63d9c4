"""Null bridges, columns named like internal ones, very long texts, many short texts, hot groups, and plans."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearfield.llm import common, components, exact_dedup, line_dedup, piece_sampling, quality, shingles, simhash, token_output
from nearfield.llm.tokens import bpe, default_path

CLASHES = ["__nf_id", "__nf_sha", "__nf_p", "__nf_host", "__nf_me", "__nf_site_n", "__nf_told", "__nf_t1", "__nf_gone", "__nf_keep", "__NF_x", "fp", "sha", "sh", "part", "row", "node", "judgement", "piece_ids", "piece_ids_"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t) for i, t in enumerate(["a b c d", "A b c d", "a b c d", "other words are here now", None, ""])] + [(2, "a b c d"), (None, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    return docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES}).cache()


def untouched(out, clashing):
    assert out.columns[: len(clashing.columns)] == clashing.columns
    assert all(r[c] == f"mine {c}" for r in out.collect() for c in CLASHES if c != "judgement")


def test_clashing_columns_are_kept(spark, clashing):
    labels = spark.createDataFrame([(0, 1), (3, 0), (5, 1)], "doc_id long, quality int")
    for out in (exact_dedup.deduplicated(clashing), simhash.deduplicated(clashing), shingles.deduplicated(clashing), quality.accepted(clashing, labels, F.lit("h"), F.lit(None))):
        assert out.columns == clashing.columns
        untouched(out, clashing)
    judged = quality.judged(clashing, quality.train(clashing, labels), F.lit("h"), F.col("fp"))
    untouched(judged, clashing)
    coded = piece_sampling.encode(clashing, piece_sampling.default_path())
    assert coded.columns[-1] == "piece_ids__"
    untouched(coded, clashing)


def test_a_fingerprint_with_null_ids_bridges(spark):
    prints = spark.createDataFrame([(9, 0), (None, 3), (5, 15), (None, 255 << 40), (7, 255 << 20), (7, 0)], "doc_id long, fp long").cache()
    got = {r["fp"]: r["component_id"] for r in simhash.classes(prints).collect()}
    assert got == {0: 5, 3: 5, 15: 5, 255 << 40: None, 255 << 20: 7}


def test_repeated_ids_make_no_link(spark):
    docs = spark.createDataFrame([(1, "one text of some length about a thing"), (1, "quite another one with words that differ"), (2, "and the third that is like neither of them")], "doc_id long, text string")
    assert simhash.deduplicated(docs).count() == 3 and shingles.deduplicated(docs).count() == 3
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == 2


def test_quality_rates_and_posterior_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["good", "fine", "bad!!", "x"], 12)), f"h{rng.integers(4)}", f"p{rng.integers(3)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(t.count("bad") < 3)) for i, t, _, _ in rows[:200]], "doc_id long, quality int")
    model = quality.train(docs, labels)
    again = quality.train(docs.unionByName(docs).repartition(7), labels)
    assert np.array_equal(model.weights, again.weights)
    got = quality.judged(docs, model, F.col("source"), F.col("lang")).select("doc_id", "source", "lang", "text", "judgement.*").toPandas().sort_values("doc_id")
    p = 1 / (1 + np.exp(-np.clip(model.logit(np.stack([quality.features(t) for t in got["text"]])), -30, 30)))
    p = np.clip(p, quality.FLOOR, 1 - quality.FLOOR)
    assert np.allclose(got["p_doc"], p)
    t = pd.DataFrame({"host": got["source"], "path": got["lang"], "p": p})
    mu = t["p"].mean()

    def strength(sites):
        n, r, v = sites.size().to_numpy(float), sites["p"].mean().to_numpy(), np.maximum(sites["p"].var(ddof=0).to_numpy(), 1e-9)
        between = ((n * (r - mu) ** 2).sum() - (len(n) - 1) * v.mean()) / (n.sum() - (n**2).sum() / n.sum())
        return min(1e6, max(1.0, mu * (1 - mu) / max(between, 1e-9) - 1))

    hosts, paths = t.groupby("host"), t.groupby(["host", "path"])
    kh, kp = strength(hosts), strength(paths)
    clip = lambda x: np.clip(x, quality.FLOOR, 1 - quality.FLOOR)
    host = clip((hosts["p"].transform("sum") - p + kh * mu) / (hosts["p"].transform("size") - 1 + kh))
    path = clip((paths["p"].transform("sum") - p + kp * host) / (paths["p"].transform("size") - 1 + kp))
    odds = p / (1 - p) * path / (1 - path) / (mu / (1 - mu))
    assert np.allclose(got["host_rate"], host) and np.allclose(got["path_rate"], path) and np.allclose(got["posterior"], odds / (1 + odds))
    assert (got["kept"] == (odds / (1 + odds) >= 0.5)).all()


def test_features_of_long_texts_add_up():
    text = "some words, Some words and 12 more é of them\n" * 20_000
    whole = quality.features(text)
    block, quality.BLOCK = quality.BLOCK, 100_000
    parts = quality.features(text)
    quality.BLOCK = block
    assert np.abs(whole - parts).max() < 2e-3
    assert np.isfinite(quality.features("")).all() and np.isfinite(quality.features("x" * 600_000)).all()


def test_long_texts_have_the_fingerprints_of_short_ones(monkeypatch):
    text = "Some words " * 3_000 + "of a text " * 2_000 + "that Is Long"
    one, sets = simhash.fingerprint(text), shingles.shingle_hashes(text)
    blocks = common.word_blocks
    for module in (simhash, shingles):
        monkeypatch.setattr(module, "word_blocks", lambda data: blocks(data, 7))
    assert simhash.fingerprint(text) == one and np.array_equal(shingles.shingle_hashes(text), sets)
    assert simhash.fingerprint("a b") != 0 and simhash.fingerprint(" \n") == 0 and len(shingles.shingle_hashes("a b")) == 1


def test_five_megabytes_without_a_space():
    lattice = piece_sampling.PieceLattice(piece_sampling.default_path(), 2.0)
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 5_000_000)))
    ids = lattice.sample([text], np.array([4]), 42)[0]
    assert lattice.decode(ids) == text
    assert lattice.share.nbytes + lattice.piece.nbytes < 64 << 20


def test_windows_and_blocks_change_nothing(monkeypatch):
    lattice = piece_sampling.PieceLattice(piece_sampling.default_path(), 0.5)
    text = "words  and   more words\n   中文▁é " * 40 + "unbroken" * 900 + "  end "
    want = lattice.sample([text], np.array([4]), 42)[0]
    assert lattice.decode(want) == text
    monkeypatch.setattr(piece_sampling, "WINDOW_CHARS", 333)
    monkeypatch.setattr(piece_sampling, "SLICE_CHARS", 50)
    assert np.array_equal(lattice.sample([text], np.array([4]), 42)[0], want)


def test_long_units_are_sampled_like_short_ones(monkeypatch):
    n = 6_000
    short = piece_sampling.PieceLattice(piece_sampling.default_path(), 0.5).sample(["thinking"] * n, np.arange(n), 1)
    monkeypatch.setattr(piece_sampling, "LONG_CHARS", 3)
    long = piece_sampling.PieceLattice(piece_sampling.default_path(), 0.5).sample(["thinking"] * n, np.arange(n), 1)
    share = [{k: sum(tuple(x) == k for x in got) / n for k in {tuple(x) for x in got}} for got in (short, long)]
    assert all(abs(share[0].get(k, 0) - share[1].get(k, 0)) < 0.03 for k in {*share[0], *share[1]})


def test_runs_of_spaces_have_their_pieces():
    lattice = piece_sampling.PieceLattice(piece_sampling.default_path(), 2.0)
    runs = {i for i, s in enumerate(lattice.surface) if len(s) > 1 and not s.strip(b" ")}
    drawn = {i for ids in lattice.sample(["a        b"] * 50, np.arange(50), 3) for i in ids}
    assert runs & drawn


def test_many_empty_documents(spark):
    docs = spark.range(500_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = token_output.write_and_read(docs, default_path())
    assert got.agg(F.count("*"), F.countDistinct("start"), F.max("start"), F.sum("n_tokens")).first() == (500_000, 500_000, 499_999, 500_000)
    assert got.where(F.col("start") != F.col("doc_id")).isEmpty()


def test_documents_of_several_blocks_and_a_reader_with_the_folder_alone(spark, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 5_000)
    texts = ["alpha beta gamma delta " * 4_000, "short one", None, "x y " * 9_000]
    folder = token_output.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), default_path())
    got = token_output.read_tokens(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan
    start = 0
    for row, text in zip(got.orderBy("doc_id").collect(), texts, strict=True):
        ids = bpe(default_path()).encode(text or "") + b"\0\0\0\0"
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_a_broken_checkpoint_is_found():
    ids = (np.arange(9_000) * 7 % 50).astype(np.int64)
    t = token_output.Table.of_freq(token_output.scaled_frequencies(np.bincount(ids)))
    b = token_output.encode_block(ids, t)
    bad = token_output.Block(b.words, b.states, b.check_words, b.check_states + np.uint64(1))
    with pytest.raises(ValueError):
        token_output.decode_block(bad, len(ids), t)


def test_a_document_of_100_000_lines(spark):
    lines = [f"line {i % 70_000}" if i % 2 else "often" for i in range(100_000)]
    docs = spark.createDataFrame([(i, "Often\nfew " + str(i)) for i in range(12)] + [(99, "\n".join(lines))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.deduplicated_lines(docs, min_docs=10).collect()}
    assert got[99]["n_lines"] == 100_000 and got[99]["n_dropped"] == 50_000
    assert got[99]["text"] == "\n".join(x for x in lines if x != "often") and got[3]["text"] == "few 3"


def test_runs_need_no_exchange(spark):
    def batch(a, b):
        x = (F.col("id") / 3).cast("int")
        return spark.range(a, b).select(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"))

    runs = line_dedup.LineRuns(spark, 7)
    for a in (0, 1_000, 2_000):
        runs.add(batch(a, a + 4_000))
    names = [n for level in runs.levels for n in level]
    assert len(names) == 2
    with line_dedup._order_of_buckets(spark):
        add, merge = runs.told(batch(0, 5_000)), runs.merged(names)
        plans = [x._jdf.queryExecution().sparkPlan().toString() for x in (add, merge)]
        full = [x._jdf.queryExecution().executedPlan().toString() for x in (add, merge)]
    assert "SortMergeJoin" in plans[0] and full[0].count("Exchange hashpartitioning") == 1 and full[1].count("Exchange") == 0 and full[1].count("Sort [") == 0
    counts = {}
    for a in (0, 1_000, 2_000):
        for i in range(a, a + 4_000):
            counts[i // 3] = counts.get(i // 3, 0) + 1
    assert runs.frequent().count() == sum(n >= 7 for n in counts.values()) and runs.frequent().distinct().count() == runs.frequent().count()
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("nearfield_line_run")]


def test_second_level_of_comparison(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    monkeypatch.setattr(exact_dedup, "CHUNK_CHARS", 3)
    texts = ["abcdefgh"] * 9 + ["abcdefgX"] * 4 + ["abcXefgh"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = exact_dedup.fingerprints(docs).withColumn("fp", F.lit(5).cast("long")).cache()
    found = {bytes(r["sha"]): r["class_no"] for r in exact_dedup.collisions(docs, prints).collect()}
    shas = {hashlib.sha256(t.lower().encode()).digest() for t in texts}
    assert set(found) < shas and len(found) == 2 and set(found.values()) == {1, 2}


@pytest.mark.parametrize("broadcasts", [True, False])
def test_components_of_hubs(spark, monkeypatch, broadcasts):
    if not broadcasts:
        monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    edges = [(0, i) for i in range(1, 400)] + [(399, 1_000), (1_000, 1_001)] + [(5_000 + i, 9_999) for i in range(200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(got) == 402 + 201
    assert all(got[i] == 0 for i in (*range(400), 1_000, 1_001)) and all(got[i] == 5_000 for i in (*range(5_000, 5_200), 9_999))


def test_small_looks_at_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 8 << 20).alias("s"))
    assert "Hint broadcast" not in common.small(wide)._jdf.queryExecution().logical().toString()
    assert "Hint broadcast" in common.small(spark.range(10))._jdf.queryExecution().logical().toString()
    with pytest.raises(TypeError):
        common.small(spark.range(1).select(F.create_map("id", "id").alias("m")))
    pair = spark.range(9).select(F.struct("id", F.repeat(F.lit("x"), 4).alias("t")).alias("s"))
    assert "Hint broadcast" in common.small(pair)._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize("broadcasts", [True, False])
def test_many_copies_leave_one(spark, monkeypatch, broadcasts):
    if not broadcasts:
        monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    body = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"{body} tail {i % 3}") for i in range(50, 250)] + [(7, "nothing like the others here")], "doc_id long, text string")
    for out in (simhash.deduplicated(docs), shingles.deduplicated(docs)):
        assert 7 in {r["doc_id"] for r in out.collect()}
    assert {r["doc_id"] for r in shingles.deduplicated(docs).collect()} == {7, 50}


def test_words_with_white_space_around_them():
    """Spaces behind white space start no token, whatever was remembered before."""
    from tokenizers import Tokenizer

    from nearfield.llm.tokens import WordCachedBPE

    whole, cached = Tokenizer.from_file(default_path()), WordCachedBPE(default_path(), 50)
    whole.encode_special_tokens = True
    rng = np.random.default_rng(9)
    parts = ["a", "foo", " ", "  ", "\n", "\t", "é", "日", "23", "!", "\x1c", "\n\n", "\r\n", " the", "\x85", "ª", "<|endoftext|>"]
    for _ in range(2_000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert cached.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
