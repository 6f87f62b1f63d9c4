"""Coded lists, sphere and sign codes, clustering variants, index descriptions, tuning, windows and models."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.operators import additive, cluster, codecs, coded_lists, ivf, search, spectral, sphere, transforms
from nearfield.plans import spec as specs
from nearfield.plans import tuning
from nearfield.plans.index import Index
from nearfield.sources import models
from nearfield.streaming import window


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(8).standard_normal((240, 8))
    return x, table(spark, x).cache()


def matrix(df):
    return np.array([r["vec"] for r in df.orderBy("id").collect()])


def pairs(df, a="qid", b="id"):
    return {(r[a], r[b]) for r in df.collect()}


@pytest.fixture(scope="module")
def lists(spark, data):
    _, rows = data
    c = cluster.kmeans(rows, 4, 5).table(spark).cache()
    return ivf.InvertedFile.build(rows, c)


def test_coded_lists_score_what_they_decode(data, lists):
    _, rows = data
    pq = codecs.ProductQuantizer.fit(lists.residuals(), 4, 4)
    fine = codecs.ProductQuantizer.fit(lists.residuals(), 2, 3)
    coded, q = coded_lists.CodedLists.build(lists, pq), rows.where("id < 6")
    exact = {(r["qid"], r["id"]): r["dist"] for r in search.knn_join(q, coded.decode().select("id", "vec"), 10).collect()}
    got = {(r["qid"], r["id"]): r["dist"] for r in coded.search(q, 10, 4).collect()}
    assert got.keys() == exact.keys() and all(abs(got[i] - exact[i]) < 1e-9 for i in got)
    both = coded_lists.CodedLists.build(lists, pq, fine)
    want = pairs(search.knn_join(q, both.decode().select("id", "vec"), 5))
    assert pairs(both.search_refined(q, 5, 4, factor=48)) == want
    assert pairs(coded.search(q, 10, 4, screen=99)) == set(got)
    assert coded.search(q, 240, 4, screen=3).count() < 6 * 240
    assert {r["id"] for r in coded.range_search(q, 2.0, 4).collect()} == {r["id"] for r in coded.search(q, 240, 4).where("dist < 2").collect()}


def test_two_layer_codes(data, lists):
    x, _ = data
    pq = codecs.ProductQuantizer.fit(lists.residuals(), 4, 4)
    two = coded_lists.TwoLayer(lists.centroids, pq)
    assert ((matrix(two.decode(two.encode(data[1]))) - x) ** 2).sum() < (x**2).sum() / 2


def test_product_cells_by_brute_force(data):
    x, rows = data
    cells = coded_lists.ProductCells(codecs.ProductQuantizer.fit(rows, 2, 3))
    b = cells.pq.codebook
    d = [((x[:9, None, i * 4 : i * 4 + 4] - b[i][None]) ** 2).sum(2) for i in (0, 1)]
    sums = (d[0][:, :, None] + d[1][:, None, :]).transpose(0, 2, 1).reshape(9, -1)
    got = cells.probes(rows.where("id < 9"), 7).orderBy("qid", "rank").collect()
    assert [r["list_no"] for r in got] == np.argsort(sums, 1, kind="stable")[:, :7].ravel().tolist()
    assert pairs(cells.search(cells.file(rows), rows.where("id < 9"), 5, 64)) == pairs(search.knn_join(rows.where("id < 9"), rows, 5))


@pytest.mark.parametrize("kind", spectral.KINDS)
def test_spectral_bits(data, lists, kind):
    x, rows = data
    s = spectral.SpectralLists.build(lists, 1.5, kind, 8)
    t = {r["list_no"]: np.array(r["t"]) for r in s.thresholds.collect()}
    bits = lambda v, no: np.floor((v - t[no]) * 2 / 1.5).astype(int) & 1
    of = {r["id"]: r["list_no"] for r in lists.rows.collect()}
    want = sorted((int((bits(x[0], of[i]) != bits(x[i], of[i])).sum()), i) for i in of)[:12]
    assert [(r["dist"], r["id"]) for r in s.search(rows.where("id = 0"), 12, 4).orderBy("rank").collect()] == want


@given(st.integers(1, 5), st.integers(1, 12))
@settings(max_examples=25, deadline=None)
def test_every_sphere_point_has_its_own_number(d, r2):
    from itertools import product

    top = int(r2**0.5)
    points = [list(p) for p in product(range(-top, top + 1), repeat=d) if sum(v * v for v in p) == r2]
    if not points:
        with pytest.raises(ValueError):
            sphere.SphereCodec(d, 1, r2, 8)
        return
    s = sphere.SphereCodec(d, 1, r2, 8)
    assert sorted(map(s.number, points)) == list(range(len(points)))
    assert all(s.point(s.number(p)) == p for p in points)
    y = np.random.default_rng(r2).standard_normal((5, d))
    assert np.allclose((s.nearest(y) * y).sum(1), (y @ np.array(points).T).max(1))


def test_sphere_codes(data):
    x, rows = data
    s = sphere.SphereCodec.fit(rows, 8, 2, 14, 8)
    y = matrix(s.decode(s.encode(rows)))
    assert np.allclose(np.linalg.norm(y.reshape(-1, 4), axis=1), np.linalg.norm(x.reshape(-1, 4), axis=1), atol=0.02)
    assert ((x - y) ** 2).sum() < (x**2).sum() / 10


def test_sign_codes_get_closer_with_bits(data):
    x, rows = data
    errors = [((matrix(q.decode(q.encode(rows))) - x) ** 2).sum() for q in (sphere.SignMagnitude((0.1,) * 8, b) for b in (1, 2, 4, 8))]
    assert errors == sorted(errors, reverse=True) and errors[-1] < errors[0] / 100
    want = [[*r["v"]] for r in rows.select("id", codecs.rabitq_decode(codecs.rabitq_encode(rows["vec"], [0.1] * 8), [0.1] * 8).alias("v")).orderBy("id").collect()]
    one = sphere.SignMagnitude((0.1,) * 8, 1)
    assert np.allclose(matrix(one.decode(one.encode(rows))), want)


def test_best_scale_beats_a_grid():
    rng = np.random.default_rng(4)
    for _ in range(20):
        o = np.abs(rng.standard_normal(6))
        cosine = lambda m: ((m + 0.5) * o).sum() / np.sqrt(((m + 0.5) ** 2).sum())
        grid = max(cosine(np.minimum(np.floor(t * o), 7)) for t in np.linspace(0, 20, 4001))
        assert cosine(sphere._magnitudes(o, 7)) >= grid - 1e-9


def test_two_level_and_progressive(data):
    x, rows = data
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    one = cost(cluster.kmeans(rows, 12, 10).centroids)
    two, grown = cluster.two_level(rows, 3, 12, 10), cluster.progressive(rows, 12, 4, 5)
    assert two.shape == grown.shape == (12, 8) and cost(two) < 1.3 * one and cost(grown) < 1.3 * one
    assert cluster.shares(np.array([0, 1, 100, 300]), 10).tolist()[:2] == [0, 1] and cluster.shares(np.array([0, 1, 100, 300]), 10).sum() == 10


@pytest.mark.parametrize("text", [
    "Flat", "IDMap2,Flat", "PCA4,Flat", "PCAWR4,IVF4,Flat", "L2norm,RR,IVF4,SQ8", "OPQ4_8,IVF4,PQ4x4", "IVF4,PQ4x4,RFlat", "ITQ4,LSH4", "HNSW8", "NSG8", "MinMax,SQ8",
    "IMI2x3,Flat", "RQ2x4", "PRQ2x1x4", "RaBitQ4", "IVF4,RaBitQ1", "ZnLattice2x14_8", "PCA4,IVF4,SH1.5c", "Pad10,SQfp16", "IVF4_HNSW32,Flat", "PQ4x4,Refine(SQ8)", "FlatDedup", "HR12345,SQ6",
])
def test_descriptions_build_and_search(data, text):
    x, rows = data
    assert specs.parse(specs.spell(specs.parse(text))) == specs.parse(text)
    assert specs.code_bytes(specs.parse(text), 8) > 0
    i = Index.of(text).train(rows).add(rows)
    got = i.search(rows.where("id < 5"), 3, nprobe=4, ef=32, factor=8.0)
    assert got.columns == ["qid", "rank", "id", "dist"] and got.count() == 15
    if text in ("Flat", "PQ4x4,Refine(SQ8)", "FlatDedup", "SQ8", "IMI2x3,Flat", "RaBitQ4"):
        assert all((q, q) in pairs(got) for q in range(5))


@pytest.mark.parametrize("text", ["", "Flatt", "IVF4", "IVF4,HNSW8", "PCA4,PCA4", "Refine(Flat", "PQ4,Flat"])
def test_wrong_descriptions(text):
    with pytest.raises(ValueError):
        specs.parse(text)


def test_removing_from_an_index(data):
    _, rows = data
    i = Index.of("Flat").train(rows).add(rows).remove(rows.where("id % 2 = 0"))
    assert all(r["id"] % 2 for r in i.search(rows.where("id < 5"), 3).collect())


def test_exploring(spark, data, lists):
    _, rows = data
    q, seen = rows.where("id < 5"), []
    truth = pairs(search.knn_join(q, rows, 5))

    def run(nprobe):
        seen.append(nprobe)
        return lists.search(q, 5, nprobe)

    best = tuning.explore(spark, run, lambda f: len(pairs(f) & truth) / 25, {"nprobe": (1, 2, 4)}).collect()
    assert seen[:2] == [1, 4] and max(r["perf"] for r in best) == 1.0
    assert tuning.combinations({"a": (1, 2), "b": (3,)}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_window(spark, data):
    _, rows = data
    w = window.SlidingWindow()
    for i in range(3):
        w = w.step(rows.where(rows["id"] % 3 == i), i == 2)
    assert {r["id"] % 3 for r in w.current().collect()} == {1, 2} and (w.first, w.after) == (1, 3)
    assert {r["id"] % 3 for r in w.step(None, True).current().collect()} == {2}
    with pytest.raises(ValueError):
        window.SlidingWindow().step(None, True)
    assert {r["slice"] for r in window.last_slices(rows.selectExpr("id", "vec", "id % 5 AS slice"), 2).collect()} == {3, 4}


def test_streams(spark, data, tmp_path):
    _, rows = data
    rows.where("id < 20").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    s = window.search_stream(stream(), rows, 4, lambda f, n: f.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    s.option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert pairs(spark.read.parquet(out)) == pairs(search.knn_join(rows.where("id < 20"), rows, 4))
    s = window.add_stream(stream(), str(tmp_path / "slices"))
    s.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "slices")).select("id").distinct().count() == 20


def test_models_come_back(spark, data, tmp_path):
    _, rows = data
    pq = codecs.ProductQuantizer.fit(rows, 2, 3)
    for i, m in enumerate((pq, codecs.ScalarQuantizer.fit(rows, 6), codecs.SignHash(8), sphere.SphereCodec.fit(rows, 8, 2, 14), coded_lists.ProductCells(pq),
                           transforms.Chain((transforms.Center.fit(rows), transforms.random_rotation(8, 8))), additive.AdditiveQuantizer.fit(rows, 2, 3, parts=2))):
        models.write(spark, str(tmp_path / str(i)), m)
        back = models.read(spark, str(tmp_path / str(i)))
        assert type(back) is type(m)
        if hasattr(m, "encode"):
            f = (lambda k: k.encode(rows).collect()) if not isinstance(m, codecs.ScalarQuantizer) else (lambda k: k.encoded(rows).collect())
            assert sorted(f(back)) == sorted(f(m))
    with pytest.raises(ValueError):
        models.write(spark, str(tmp_path / "x"), ivf.InvertedFile(rows, rows))
