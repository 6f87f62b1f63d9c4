"""Registered searches without SQL ask every twentieth row; what they find is held against brute force."""

import numpy as np
import pytest

from nearfield import registry

#: Least share of the ten exact neighbours that a graph search finds, over all queries.
LEAST = {"hnsw_search": 0.9, "nsg_search": 0.9, "graph_of_codes": 0.9}
DESCRIBED = ["pca_ivf_flat", "opq_ivf_pq_refined", "rabitq_refined", "sphere_refined", "minmax_sq8"]


@pytest.mark.parametrize("name", [*LEAST, *(f"described_{n}" for n in DESCRIBED)])
@pytest.mark.parametrize("scale", ["0.001", "0.1"])
def test_every_twentieth_row_is_asked(spark, name, scale):
    sf = f"/root/testdata/sf{scale}"
    rows = registry._vectors(spark, sf).toPandas().sort_values("id")
    ids, x = rows["id"].to_numpy(), np.array(rows["vec"].tolist())
    got = registry.queries()[name](spark, sf).toPandas()
    asked = ids[ids % 20 == 0]
    assert len(asked) > 10 and set(got["qid"]) == set(asked)
    assert (got.groupby("qid").size() == 10).all()
    found = 0
    for q in asked:
        dist = ((x - x[ids == q]) ** 2).sum(1)
        found += len(set(ids[np.lexsort((ids, dist))[:10]]) & set(got.loc[got["qid"] == q, "id"]))
    assert found >= LEAST.get(name, 0.9) * 10 * len(asked)
