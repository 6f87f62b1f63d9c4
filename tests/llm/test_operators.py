"""The ten operators against brute force, on small tables with nulls, empties, copies and clashing columns."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearfield.llm import chat, common, components, exact_dedup, line_dedup, media, packing, piece_sampling, quality, simhash, token_output, warc
from nearfield.llm.tokens import bpe, default_path

TEXTS = [
    None, "", "", "a", "A", "one two", "One two", "one  two\n\nthree ", "x" * 5000, "é ▁ \x1a </s>[INST] q [/INST]", "the cat sat on the mat. " * 300,
    "The cat sat on the mat. " * 300, "line\nline\nother", " Line \nunique", "\n", "word word\t!", "１２ 🙂 end", "<|endoftext|> x", "ab\n \nc  d", "z",
]
KIND = "doc_id long, text string, lang string, source string, row long, fp string, __x int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", "src", None, "clash", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (3, "a", "en", "src", 1, "clash", 0), (None, "a", "de", None, 1, "clash", 0), (None, None, None, None, None, None, None)], KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("broadcasts", [True, False])
def test_exact_dedup(docs, empty, monkeypatch, broadcasts):
    if not broadcasts:
        monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    rows = docs.toPandas()
    rows["doc_id"] = rows["doc_id"].astype(object).where(rows["doc_id"].notna(), None)
    got = exact_dedup.decisions(docs).toPandas()
    assert len(got) == len(rows)
    groups = {}
    for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
        groups.setdefault(folded(text), []).append(doc_id)
    by_sha = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got.itertuples():
        ids = by_sha[bytes(r.sha)]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
    kept = got[got.kept]
    assert len(kept) == len(groups)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.decisions(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def test_fingerprints_compose_and_huge_texts_match(spark, monkeypatch):
    a, b = b"hello " * 30_000, "wörld".encode()
    assert exact_dedup.chunk_hash(a + b) == exact_dedup.combine(exact_dedup.chunk_hash(a), exact_dedup.chunk_hash(b), len(b))
    monkeypatch.setattr(exact_dedup, "HUGE_CHARS", 7)
    got = exact_dedup.fingerprints(spark.createDataFrame([(1, "some longer téxt of mine"), (2, "short")], "doc_id long, text string")).collect()
    for r in got:
        h = exact_dedup.chunk_hash(("some longer téxt of mine" if r["doc_id"] == 1 else "short").encode())
        assert r["fp"] == h[0] << 31 | h[1]


def test_colliding_fingerprints_are_told_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "aa", "bb", "cc"])], "doc_id long, text string")
    prints = exact_dedup.fingerprints(docs).withColumn("fp", F.lit(1).cast("long")).cache()
    got = exact_dedup.collisions(docs, prints).select("sha", "class_no").collect()
    assert len({bytes(r["sha"]) for r in got}) == 2 and {r["class_no"] for r in got} == {1, 2}


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", folded(text).encode())
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_fingerprints_and_components(spark, docs, empty):
    got = simhash.near_duplicates(docs).toPandas()
    rows = docs.toPandas()
    fps = [slow_fingerprint(t) for t in rows["text"]]
    assert sorted(got["fp"].to_numpy(np.int64).view(np.uint64).tolist()) == sorted(fps)
    parent = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 2:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    ids = rows["doc_id"].tolist()
    for r in got.itertuples():
        mine = next(parent[k] for k, f in enumerate(fps) if f == int(np.int64(r.fp).view(np.uint64)))
        assert r.component_id == min(ids[k] for k in range(len(ids)) if parent[k] == mine and ids[k] == ids[k])
    left = simhash.deduplicated(docs)
    assert left.columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dense", [1024, 3])
def test_links_lose_nothing(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(15):
            fps.add(int(s) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ ((1 << int(rng.integers(64))) if rng.random() < 0.3 else 0))
    fps = sorted(fps)
    want = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(a ^ b).count("1") <= 2 and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    prints = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long").cache()
    got = {r["fp"] & (2**64 - 1): r["component_id"] for r in simhash.classes(prints).collect()}
    assert {f: fps[c] for f, c in got.items()} == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100 and 200 not in got
    assert components.connected_components(edges.limit(0)).count() == 0


def test_cached_words_equal_the_library(docs):
    b = bpe(default_path())
    for t in [t for t in TEXTS if t is not None] + ["  a", "a\n b", "it's we'll", "a\nb\n", "\n\na", "12ab 3.4 été² x’s", "　 a  b "]:
        assert np.frombuffer(b.encode(t), "<u4").tolist() == b.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, empty):
    got = packing.packed_documents(docs, default_path(), capacity=64).toPandas()
    rows = docs.toPandas()
    assert got["length"].between(1, 64).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 64
    want = []
    for doc_id, t in zip(rows["doc_id"], rows["text"], strict=True):
        ids = np.frombuffer(bpe(default_path()).encode(t or "") + b"\0\0\0\0", "<u4")
        edges = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        want += [(str(doc_id), a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(edges, edges[1:], strict=False)]
    assert sorted(want) == sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert packing.packed_documents(empty, default_path()).count() == 0


def test_packing_rounds_and_bounds(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 101, 600))], packing._PIECE)
    from nearfield.llm.common import staged

    packed = packing.pack(staged(rows, "t"), 100, partition_pieces=100)
    got, told = packed.sequences.toPandas(), packed.certificates.toPandas()
    fill = got.groupby("sequence_id")["length"].sum()
    bound = packing.lower_bound(got["length"].to_numpy(), 100)
    assert len(got) == 600 and fill.max() <= 100 and bound <= len(fill) <= bound * 1.03 + 1
    assert packed.bins == len(fill) and packed.bound == bound
    assert len(told) >= 6 and (told["bins"] >= told["bound"]).all() and (told["certified"] == (told["bins"] == told["bound"])).all()
    # full pieces, the bins of each round that were not given up and those of the last round are the sequences
    last = told["turn"] == told["turn"].max()
    assert (got["length"] == 100).sum() + told.loc[~last, "bins"].sum() - told.loc[~last, "given_up"].sum() + told.loc[last, "bins"].sum() == packed.bins
    assert packing.lower_bound(np.array([60, 60, 60, 41]), 100) == 3 or packing.lower_bound(np.array([60, 60, 60, 41]), 100) == 4
    assert packing.lower_bound(np.array([34, 34, 34, 34, 34]), 100) >= 3


def brute_media(text):
    """All of op4's columns but doc_id, from the text alone."""
    data = (text or "").encode()
    payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    image = f"P5\n64 {len(payload) // 64}\n255\n".encode() + payload
    steps = sum(abs(a - b) for a, b in zip(payload, payload[1:], strict=False))
    feature = f"n={len(payload)};sum={sum(payload)};squares={sum(b * b for b in payload)};min={min(payload)};max={max(payload)};distinct={len(set(payload))};edges={steps}"
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature)


@pytest.mark.parametrize("broadcasts", [True, False])
def test_media(docs, empty, monkeypatch, broadcasts):
    if not broadcasts:
        monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    got = media.stored_features(docs).toPandas()
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    want = sorted((str(r.doc_id), *brute_media(r.text)) for r in docs.toPandas().itertuples())
    assert want == sorted((str(r[0]), *r[1:]) for r in got[["doc_id", *columns]].itertuples(index=False))
    assert media.stored_features(empty).count() == 0


def test_cuts_follow_content():
    a = np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8)
    in_slices = media.cut_candidates(a)
    whole_size, media.SLICE_BYTES = media.SLICE_BYTES, 1_000
    assert np.array_equal(media.cut_candidates(a), in_slices)
    media.SLICE_BYTES = whole_size
    shifted = np.concatenate([np.zeros(777, np.uint8), a])
    cuts = [{bytes(x[s:e].tobytes()) for s, e in zip([0, *ends], ends, strict=False)} for x in (a, shifted) for ends in [media.chunk_ends(len(x), media.cut_candidates(x))]]
    assert len(cuts[0] & cuts[1]) > 0.9 * len(cuts[0])


def test_chat(spark, empty):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a </s>[INST] b\x1a\x1ac <|end|>\n x"), (1, 2, None, None), (2, 0, "assistant", ""), (None, 5, "assistant", "é"), (2, None, "user", "<|say|>")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"data": F.lit("clash"), "part": F.lit(9), "starts": F.lit(None)})
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(table)).collect()}
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(mine) and got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pieces_round_trip(docs, empty):
    model = piece_sampling.default_path()
    got = piece_sampling.round_trip(docs, model).toPandas()
    assert got["lossless"].all() and len(got) == docs.count()
    again = piece_sampling.round_trip(docs.repartition(5), model).toPandas()
    key = ["n_pieces", "ids_crc32"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))
    assert piece_sampling.round_trip(empty, model).count() == 0
    back = piece_sampling.decode(piece_sampling.encode(docs, model), model)
    assert back.where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))).count() == 0


def test_sampling_follows_the_lattice():
    lat = piece_sampling.PieceLattice(piece_sampling.default_path(), 0.3)
    n = 4000
    drawn = {}
    for ids in lat.sample(["then"] * n, np.arange(n), 1):
        drawn[tuple(ids)] = drawn.get(tuple(ids), 0) + 1
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.default_path())
    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not sp.is_byte(i)}
    unit, paths = "▁then", {}

    def walk(at, ids, w):
        if at == len(unit):
            paths[tuple(ids)] = w
        for e in range(at + 1, len(unit) + 1):
            if unit[at:e] in known:
                i = known[unit[at:e]]
                walk(e, [*ids, i], w * (1 - sp.get_score(i)) ** -0.3)

    walk(0, [], 1.0)
    total = sum(paths.values())
    assert set(drawn) <= set(paths)
    for p, w in paths.items():
        assert abs(drawn.get(p, 0) / n - w / total) < 0.04


@pytest.mark.parametrize("broadcasts", [True, False])
def test_warc(spark, monkeypatch, broadcasts):
    if not broadcasts:
        monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "CHUNK", 16)
    pages = [(5, "http://a/\r\nX: y", "same payload, longer than a chunk"), (2, "http://b", "same payload, longer than a chunk"), (3, None, None), (4, "u", ""), (7, "u", "é" * 30), (2, "http://b", "same payload, longer than a chunk")]
    rows = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    table = warc.write_records(rows)
    got = warc.read_records(table).collect()
    assert len(got) == len(pages)
    for r in got:
        html = next(p[2] or "" for p in pages if p[0] == r["page_id"]).encode()
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        first = min(p[0] for p in pages if (p[2] or "").encode() == html)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
    assert b"".join(warc.stream(table)).count(b"WARC/1.1\r\n") == len(pages)
    assert warc.read_records(warc.write_records(rows.limit(0))).count() == 0


@pytest.mark.parametrize("broadcasts", [True, False])
def test_line_dedup(spark, docs, empty, monkeypatch, broadcasts):
    if not broadcasts:
        monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    got = line_dedup.deduplicated_lines(docs, min_docs=3).toPandas()
    key = lambda x: folded(x.strip(" \t\n\x0b\x0c\r"))
    texts = [t or "" for t in docs.toPandas()["text"]]
    counts = {}
    for t in texts:
        for k in {key(x) for x in t.split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    want = []
    for t in texts:
        lines = t.split("\n")
        left = [x for x in lines if not key(x) or counts[key(x)] < 3]
        want.append((len(lines), len(lines) - len(left), "\n".join(left)))
    assert sorted(want) == sorted(zip(got["n_lines"], got["n_dropped"], got["text"], strict=True))
    assert line_dedup.deduplicated_lines(empty).count() == 0


def test_token_files(docs, empty, monkeypatch):
    got = token_output.write_and_read(docs, default_path()).toPandas().sort_values("start")
    rows = docs.toPandas().sort_values("doc_id", na_position="first", kind="stable")
    assert len(got) == len(rows)
    assert got["start"].tolist() == [0, *np.cumsum(got["n_tokens"])[:-1]]
    want = sorted((str(d), zlib.crc32(bpe(default_path()).encode(t or "") + b"\0\0\0\0")) for d, t in zip(rows["doc_id"], rows["text"], strict=True))
    assert want == sorted((str(r.doc_id), r.ids_crc32) for r in got.itertuples())
    assert got["doc_id"].isna().tolist() == [True, True] + [False] * (len(got) - 2)
    assert token_output.write_and_read(empty, default_path()).count() == 0


def test_rans_blocks_checkpoints_and_crc():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 30_000) % 50_257).astype(np.int64)
    t = token_output.Table.of_freq(token_output.scaled_frequencies(np.bincount(ids)))
    for n in (1, 2047, 2048, 2049, 30_000):
        b = token_output.encode_block(ids[:n], t)
        assert (token_output.decode_block(b, n, t) == ids[:n]).all()
        half = max(1, -(-n // token_output.LANES)) // 2 * token_output.LANES
        assert (token_output.decode_block(b, n, t, from_check=True) == ids[half:n]).all()
    x, y = b"abc" * 70, b"defg" * 33
    assert token_output.crc32_combine(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) == 0
    out = quality.judged(docs, quality.train(docs, labels.where(~held)), F.col("source"), F.col("lang"))
    got = out.select("doc_id", "judgement.kept").join(labels.where(held), "doc_id").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.97


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.accepted(docs, none, F.col("source"), F.col("lang")).count() == docs.count()
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(10)], "doc_id long, quality int")
    out = quality.accepted(docs, labels, F.col("source"), F.col("lang"))
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert quality.accepted(empty, labels, F.col("source"), F.col("lang")).count() == 0
