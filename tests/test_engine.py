"""Properties that SQL doesn't check: trained parts, transforms, files, metric edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.metrics import NAMES, block, distance
from nearfield.operators import cluster, codecs, ivf, search, transforms
from nearfield.sources import vecs


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(5).standard_normal((300, 8))
    return x, table(spark, x).cache()


@pytest.mark.parametrize("metric", NAMES)
def test_expression_equals_kernel(spark, metric):
    rng = np.random.default_rng(1)
    x = np.abs(rng.standard_normal((20, 6))) if metric in ("jaccard", "jensenshannon", "gower") else rng.standard_normal((20, 6))
    x = np.minimum(x, 1) if metric == "gower" else x
    q = x[0]
    got = table(spark, x).select("id", distance(F.array(*map(F.lit, q.tolist())), F.col("vec"), metric, 3.0).alias("d")).orderBy("id").toPandas()["d"]
    assert np.allclose(got, block(q, x, metric, 3.0))


def test_nan_euclidean_and_gower_fixtures():
    nan = np.nan
    assert block(np.array([3, nan, nan, 6.0]), np.array([[1, nan, nan, 5.0]]), "nan_l2")[0] == 10
    base = np.array([[0.4, 0.2, -1, -2], [0.9, 0.1, -1, -2], [0.5, 0.3, -2, -2], [0.5, 0.3, -2, -3]])
    assert np.allclose(block(np.array([0.5, 0.3, -1, -2]), base, "gower"), [0.05, 0.15, 0.25, 0.5])
    assert np.allclose(block(np.array([0.7, 0.8, -1, -3]), base, "gower"), [0.475, 0.475, 0.675, 0.425])


def test_knn_ties_nulls_and_many_blocks(spark, monkeypatch):
    x = np.zeros((9, 3))
    rows = table(spark, x).unionByName(spark.createDataFrame([(100, None)], "id long, vec array<double>"))
    monkeypatch.setattr(search, "BLOCK_QUERIES", 2)
    got = search.knn_join(rows.where("id < 5"), rows, 4).orderBy("qid", "rank").toPandas()
    assert len(got) == 20 and got["id"].tolist() == [0, 1, 2, 3] * 5
    with pytest.raises(ValueError):
        search.knn_join(rows, rows, 0)
    assert search.knn_join(rows.limit(0), rows, 3).count() == 0


def test_rotation_pca_and_chain(data):
    x, rows = data
    r = transforms.random_rotation(8, 8)
    assert np.allclose(r.a @ r.a.T, np.eye(8))
    back = np.array(r.reverse(r.apply(rows)).orderBy("id").toPandas()["vec"].tolist())
    assert np.allclose(back, x)
    p = transforms.pca(rows, 3)
    y = np.array(p.apply(rows).orderBy("id").toPandas()["vec"].tolist())
    cov = np.cov(y.T, bias=True)
    assert np.allclose(cov, np.diag(np.diag(cov)), atol=1e-9) and (np.diff(np.diag(cov)) <= 1e-12).all()
    chain = transforms.Chain((transforms.Center.fit(rows), r))
    assert np.allclose(np.array(chain.reverse(chain.apply(rows)).orderBy("id").toPandas()["vec"].tolist()), x)


def test_kmeans_objective_falls_and_more_clusters_help(data):
    _, rows = data
    four, eight = cluster.kmeans(rows, 4, 6, init="++"), cluster.kmeans(rows, 8, 6, init="afkmc2")
    assert all(a >= b - 1e-9 for a, b in zip(four.objectives, four.objectives[1:], strict=False))
    assert eight.objectives[-1] < four.objectives[-1]


def test_exact_1d_kmeans_is_no_worse(spark):
    v = np.random.default_rng(3).random(200)
    c, exact = cluster.kmeans_1d(v, 5)
    assert len(c) == 5
    assert np.isclose(exact, (np.abs(v[:, None] - c[None]).min(1) ** 2).sum())
    assert exact <= cluster.kmeans(table(spark, v[:, None]), 5, 8).objectives[-1] + 1e-9


def test_quantizers_improve_with_bits(data):
    x, rows = data
    errors = []
    for b in (4, 6, 8):
        s = codecs.ScalarQuantizer.fit(rows, b)
        y = np.array(rows.select("id", s.decode(s.encode(F.col("vec"))).alias("y")).orderBy("id").toPandas()["y"].tolist())
        errors.append(((x - y) ** 2).sum())
    assert errors[0] > errors[1] > errors[2]
    pq = codecs.ProductQuantizer.fit(rows, 4, 5)
    y = np.array(pq.decode(pq.encode(rows)).orderBy("id").toPandas()["vec"].tolist())
    assert ((x - y) ** 2).sum() < (x**2).sum() * 0.3


def test_inverted_file_round_trip_and_full_probe(spark, data, tmp_path):
    _, rows = data
    f = ivf.InvertedFile.build(rows, rows.where("id < 6").select(F.col("id").cast("int").alias("list_no"), "vec"))
    f.write(str(tmp_path / "ivf"))
    g = ivf.InvertedFile.read(spark, str(tmp_path / "ivf"))
    q = rows.where("id < 5")
    want = search.knn_join(q, rows, 5).select("qid", "rank", "id").orderBy("qid", "rank").collect()
    assert g.search(q, 5, 6).select("qid", "rank", "id").orderBy("qid", "rank").collect() == want
    assert ivf.compatible(f, f)


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    for kind in vecs.KINDS:
        assert np.array_equal(vecs.parse(vecs.dump(x, kind), kind), x)
        (tmp_path / f"a.{kind}").write_bytes(vecs.dump(x, kind))
        got = vecs.read(spark, str(tmp_path / f"a.{kind}"), kind).orderBy("row").toPandas()
        assert np.array_equal(np.array(got["vec"].tolist()), x)
    with pytest.raises(ValueError):
        vecs.parse(vecs.dump(x, "fvecs")[:-1], "fvecs")
