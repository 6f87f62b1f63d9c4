"""Indexes that are stored once: written, read, merged, changed; binary indexes; small operators that SQL can't check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import binary, cluster, codecs, coded_lists, evaluate, graph, ivf, search, spectral, stats, transforms
from nearfield.plans.index import BinaryIndex, Index
from nearfield.sources import indexes


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(11).standard_normal((200, 8))
    return x, table(spark, x).cache()


def found(df):
    return sorted((r["qid"], r["rank"], r["id"], round(float(r["dist"]), 9)) for r in df.collect())


@pytest.mark.parametrize("text", ["PCA4,IVF4,Flat", "IVF4,PQ4x4,RFlat", "IVF4,SQ8", "IVF4,SH1.5c", "HNSW8,SQ8", "RQ2x4", "PQ4x4,Refine(SQ8)", "IVF4,FlatDedup", "IVF4_HNSW8,Flat", "HR,MinMaxFP16,SQ8", "LSH8rt", "IMI2x2,Flat"])
def test_an_index_comes_back(spark, data, tmp_path, text):
    _, rows = data
    index = Index.of(text).train(rows).add(rows)
    indexes.write(spark, str(tmp_path / "i"), index)
    back, q = indexes.read(spark, str(tmp_path / "i")), rows.where("id < 6")
    assert back.spec == index.spec
    assert found(back.search(q, 5, nprobe=3, ef=64, factor=4.0)) == found(index.search(q, 5, nprobe=3, ef=64, factor=4.0))


def test_lists_and_graphs_come_back(spark, data, tmp_path):
    _, rows = data
    file = ivf.InvertedFile.build(rows, cluster.kmeans(rows, 4, 4).table(spark))
    q = rows.where("id < 6")
    coded = coded_lists.CodedLists.build(file, codecs.ProductQuantizer.fit(file.residuals(), 4, 4))
    bits = binary.codes(rows, 8)
    for i, (x, run) in enumerate([
        (file, lambda i: i.search(q, 5, 2)), (coded, lambda i: i.search(q, 5, 2)), (spectral.SpectralLists.build(file, 1.5, "median", 8), lambda i: i.search(q, 5, 2)),
        (graph.GraphIndex.build(rows, m=8), lambda i: i.search(q, 5, 32)), (BinaryIndex.of("BIVF4_HNSW4", 8).train(bits).add(bits), lambda i: i.search(binary.codes(q, 8), 5, 3)),
    ]):
        indexes.write(spark, str(tmp_path / str(i)), x)
        assert found(run(indexes.read(spark, str(tmp_path / str(i))))) == found(run(x))


def test_adding_twice_merging_and_removing(data):
    _, rows = data
    for text in ("IVF4,Flat", "HNSW8", "FlatDedup", "PQ4x4", "IVF4,FlatDedup"):
        trained = Index.of(text).train(rows)
        both = trained.add(rows.where("id < 100")).add(rows.where("id >= 100"))
        q = rows.where("id < 4")
        assert found(both.search(q, 5, nprobe=4, ef=64)) == found(trained.add(rows).search(q, 5, nprobe=4, ef=64)), text
        left = both.remove(rows.where("id % 2 = 0"))
        assert all(r["id"] % 2 for r in left.search(q, 5, nprobe=4, ef=64).collect()), text
    trained = Index.of("IVF4,SQ8").train(rows)
    merged = trained.add(rows.where("id < 100")).merge(trained.add(rows.where("id >= 100")))
    assert found(merged.search(rows.where("id < 4"), 5, nprobe=4)) == found(trained.add(rows).search(rows.where("id < 4"), 5, nprobe=4))
    with pytest.raises(ValueError):
        trained.add(rows).merge(Index.of("IVF4,SQ8").train(rows).add(rows))


def test_reconstruct(data):
    x, rows = data
    got = Index.of("RR,SQ8").train(rows).add(rows).reconstruct(rows.where("id in (3, 9)")).orderBy("id").collect()
    assert [r["id"] for r in got] == [3, 9] and np.allclose([r["vec"] for r in got], x[[3, 9]], atol=0.05)


def test_search_plans_hold_no_training(data):
    _, rows = data
    plan = Index.of("IVF4,PQ4x4").train(rows).add(rows).search(rows.where("id < 4"), 5, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "zip_with" not in plan and "FlatMapGroupsInPandas" not in plan


def test_incompatible_files_are_refused(spark, data):
    _, rows = data
    a, b = (ivf.InvertedFile.build(rows, rows.where(f"id between {i} and {i + 3}").select(F.col("id").cast("int").alias("list_no"), "vec")) for i in (0, 4))
    with pytest.raises(ValueError):
        a.merge(b)
    with pytest.raises(ValueError):
        ivf.stacked([a, b])
    side = ivf.stacked_lists([a, a])
    assert side.rows.count() == 400 and side.centroids.select("list_no").distinct().count() == 8
    big = a.sorted_by_size().sizes().orderBy("list_no").collect()
    assert [r["size"] for r in big] == sorted((r["size"] for r in big), reverse=True)


@pytest.mark.parametrize("text", ["ResidualMx", "Residual2x3,PQ4", "RQ2x4_Nqint8", "IVF4(PQ4),Flat", "HNSW8,LSH"])
def test_what_is_not_done_is_refused(text):
    with pytest.raises(ValueError):
        Index.of(text)


def test_binary_indexes(spark, data):
    rng = np.random.default_rng(0)
    rows = table(spark, rng.standard_normal((300, 64)))
    bits = binary.codes(rows, 64).cache()
    q = bits.where("id % 20 = 0")
    want = {(r["qid"], r["rank"]): r["dist"] for r in binary.hamming_knn(q, bits, 5).collect()}
    for text, least in (("BFlat", 1.0), ("BHNSW16", 0.9), ("BIVF8", 0.8), ("BIVF8_HNSW4", 0.8), ("IDMap2,BHash4x6", 0.5)):
        got = {(r["qid"], r["rank"]): r["dist"] for r in BinaryIndex.of(text, 64).train(bits).add(bits).search(q, 5, nprobe=7, ef=64, flip=2).collect()}
        assert sum(got.get(k) == d for k, d in want.items()) >= least * len(want), text
    with pytest.raises(ValueError):
        BinaryIndex.of("BFlatt", 64)


def test_chunks_meet_like_blocks(spark, data, monkeypatch):
    _, rows = data
    want = found(search.knn_join(rows, rows, 3, other=True))
    monkeypatch.setattr(search, "MOST_BLOCKS", 0)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 37)
    assert found(search.knn_join(rows, rows, 3, other=True)) == want


def test_exact_medians(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 1_000, 1_001):
        x = np.round(rng.standard_normal((n, 3)), 2)
        got = stats.medians(table(spark, x).select(F.lit(0).alias("part"), "vec"), "part").orderBy("dim").collect()
        assert np.allclose([r["median"] for r in got], np.median(x, 0))


def test_small_functions(spark, data):
    x, rows = data
    y = np.array(transforms.Hadamard(8).apply(rows).orderBy("id").toPandas()["vec"].tolist())
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(transforms.Hadamard(8).backward(y), x)
    assert np.allclose(transforms.Hadamard(5).backward(transforms.Hadamard(5).forward(x[:, :5])), x[:, :5])
    r = transforms.reflection(np.array([[1.0, 2.0, 0.0], [0.0, 1.0, 1.0]]))
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1.0)
    values = np.array([100.0, 50.0, 9.0, 4.0, 2.0, 1.0])
    order = transforms.balanced_axes(values, 2)
    assert sorted(order.tolist()) == list(range(6)) and abs(np.log(values[order[:3]]).sum() - np.log(values[order[3:]]).sum()) < 1.5
    noise = spark.range(2_000).select("id", V.seeded(F.col("id"), 4, 7, normal=True).alias("vec"), V.seeded(F.col("id"), 4, 7).alias("u")).orderBy("id").toPandas()
    z, u = np.array(noise["vec"].tolist()), np.array(noise["u"].tolist())
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05 and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    one, other = stats.checksum(rows, "id", "vec").first(), stats.checksum(rows.repartition(5), "id", "vec").first()
    assert one == other and stats.checksum(rows.where("id <> 4"), "id", "vec").first() != one
    assert any("200 vectors" in line for line in stats.advice(rows))


def test_draws(spark):
    kind = "qid long, id long, dist double"
    a = spark.createDataFrame([(1, 5, 0.5), (1, 6, 1.0), (1, 7, 2.0), (2, 1, 0.0)], kind)
    same = spark.createDataFrame([(1, 5, 0.5), (1, 6, 1.0), (1, 9, 2.0), (2, 1, 0.0)], kind)
    worse = spark.createDataFrame([(1, 5, 0.5), (1, 8, 1.0), (1, 7, 2.0), (2, 1, 0.0)], kind)
    assert evaluate.differences_beyond_draws(a, same).count() == 0 and [r["qid"] for r in evaluate.differences_beyond_draws(a, worse).collect()] == [1]


def test_ranges_of_scalar_codes(data):
    x, rows = data
    wide = np.vstack([x, np.full((1, 8), 60.0)])
    errors = {}
    spread = table(rows.sparkSession, wide)
    for name, kw in {"minmax": {}, "quantile": {"quantile": 0.02}, "optimal": {"optimal": True}}.items():
        s = codecs.ScalarQuantizer.fit(spread, 4, **kw)
        errors[name] = ((s.decode_matrix(s.encode_matrix(x)) - x) ** 2).sum()
    assert errors["quantile"] < errors["minmax"]
    flat = codecs.ScalarQuantizer.fit(rows, 3, optimal=True)
    plain = codecs.ScalarQuantizer.fit(rows, 3)
    assert ((flat.decode_matrix(flat.encode_matrix(x)) - x) ** 2).sum() <= ((plain.decode_matrix(plain.encode_matrix(x)) - x) ** 2).sum() * 1.01


def test_sparse_and_sampled_kmeans(spark):
    rng = np.random.default_rng(3)
    rows = [(sorted(rng.choice(np.arange(10) + 10 * (i % 3), 4, replace=False).tolist()), [1.0] * 4) for i in range(300)]
    got = cluster.kmeans_sparse(spark.createDataFrame(rows, "dims array<int>, vals array<double>"), 30, 3, 8)
    assert got.objectives[-1] <= got.objectives[0] and got.centroids.shape == (3, 30)
    x = table(spark, rng.standard_normal((500, 4)))
    assert cluster.kmeans(x, 4, 4, max_points=40).centroids.shape == (4, 4)


def test_graph_range_search_and_links(spark, data):
    x, rows = data
    g = graph.GraphIndex.build(rows, m=12)
    got = {(r["qid"], r["id"]) for r in g.range_search(rows.where("id < 10"), 6.0).collect()}
    want = {(r["qid"], r["id"]) for r in search.range_join(rows.where("id < 10"), rows, 6.0).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert g.neighbours().select("id").distinct().count() == 200
