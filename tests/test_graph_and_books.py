"""Graphs, additive quantizers and learnt rotations: recall and error on small tables."""

import numpy as np
import pytest

from nearfield.operators import additive, graph, learned, search


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(5).standard_normal((300, 8))
    return x, table(spark, x).cache()


def pairs(df, a, b):
    return {(r[a], r[b]) for r in df.collect()}


def test_nn_descent_recall(data):
    _, rows = data
    got, want = pairs(graph.nn_descent(rows, 8), "src", "dst"), pairs(search.similarity_graph(rows, 8), "src", "dst")
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want) and all(a != b for a, b in got)


@pytest.mark.parametrize("kind", ["hnsw", "nsg"])
def test_graph_recall_over_shards(data, kind):
    _, rows = data
    q = rows.where("id < 40")
    g = graph.GraphIndex.build(rows, kind, m=12, shard_rows=120)
    got, want = pairs(g.search(q, 5, 40), "qid", "id"), pairs(search.knn_join(q, rows, 5), "qid", "id")
    assert len(got) == 200 and len(got & want) >= 0.9 * len(want)


def test_graph_of_equal_and_of_no_rows(spark):
    same = table(spark, np.zeros((30, 3)))
    for kind in ("hnsw", "nsg"):
        assert graph.GraphIndex.build(same, kind, m=4).search(same.where("id < 2"), 3, 8).count() == 6
        assert graph.GraphIndex.build(same.limit(0), kind).search(same, 3).count() == 0


def test_additive_error_falls_with_books_and_search(data):
    x, rows = data
    errors = {}
    for kind, m, parts in (("rq", 1, 1), ("rq", 3, 1), ("lsq", 3, 1), ("rq", 2, 2)):
        a = additive.AdditiveQuantizer.fit(rows, m, 4, kind, parts)
        coded = a.encode(rows)
        y = np.array(a.decode(coded).orderBy("id").toPandas()["vec"].tolist())
        errors[kind, m, parts] = ((x - y) ** 2).sum()
    assert errors["rq", 1, 1] > errors["rq", 3, 1] and errors["lsq", 3, 1] < errors["rq", 1, 1] and errors["rq", 2, 2] < errors["rq", 1, 1]
    assert a.search(rows.where("id < 4"), coded, 3).count() == 12


def test_wider_beam_is_no_worse_on_average():
    rng = np.random.default_rng(2)
    x, books = rng.standard_normal((200, 6)), rng.standard_normal((3, 8, 6))
    cost = [((x - additive.summed(additive.beam_codes(x, books, b), books)) ** 2).sum() for b in (1, 8, 64)]
    every = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    exact = ((x[:, None] - additive.summed(every, books)[None]) ** 2).sum(2).min(1).sum()
    assert cost[0] >= cost[1] >= cost[2] - 1e-9 and np.isclose(cost[2], exact)


def test_learnt_rotations(data):
    _, rows = data
    assert learned.itq(rows, iterations=10).orthonormal and learned.opq(rows, 4, 4, 5).orthonormal
    assert learned.itq(rows, 4, 10).a.shape == (4, 8)
