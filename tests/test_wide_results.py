"""What a task or the driver holds of wide results, and what comes of them against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.operators import evaluate, search


class _Shared:
    def __init__(self, value):
        self.value = value


class _Rows:
    """Stands for a table: what a task would run."""

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_a_task_passes_hits_on_in_parts(metric):
    x = np.arange(40_000, dtype=np.float64).reshape(20_000, 2)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 10_000)), pa.array(x[a : a + 10_000].tolist())], names=["id", "vec"]) for a in (0, 10_000)]
    run = search.searched(_Rows(), _Shared((np.arange(60), x[:60])), search._all_pairs(metric, 2.0), metric, radius=np.inf)
    sizes = [b.num_rows for b in run(iter(batches))]
    assert sum(sizes) == 60 * 20_000
    assert max(sizes) <= search.HIT_ROWS + 10_000


def _table(n=400, groups=7):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (n, 3)).astype(float)  # many equal scores
    return x, rng.integers(0, groups, n)


def _brute(x, grp, queries, k, few, sign=1.0, score=lambda a, b: ((a - b) ** 2).sum(1)):
    out = set()
    for q in queries:
        dist, seen, rank = score(x, x[q]), {}, 0
        for i in np.lexsort((np.arange(len(x)), sign * dist)).tolist():
            if seen.get(grp[i], 0) < few and rank < k:
                out.add((q, rank, i, grp[i], float(dist[i])))
                seen[grp[i]], rank = seen.get(grp[i], 0) + 1, rank + 1
    return out


@pytest.mark.parametrize("groups", [7, 300])
@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_diverse_join_equals_brute_force(spark, monkeypatch, groups, many, metric):
    x, grp = _table(groups=groups)
    names = [None if g == 3 else f"g{g}" for g in grp.tolist()]
    base = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, names, strict=True))], "id long, vec array<double>, grp string").repartition(3)
    base = base.unionByName(spark.createDataFrame([(900, None, "g1")], base.schema))
    if many:
        monkeypatch.setattr(search, "MOST_BLOCKS", 0)
    got = search.diverse_join(base.where("id % 20 = 0"), base, 6, 2, metric).collect()
    score = (lambda a, b: a @ b) if metric == "ip" else lambda a, b: ((a - b) ** 2).sum(1)
    assert {tuple(r) for r in got} == _brute(x, names, range(0, 400, 20), 6, 2, -1.0 if metric == "ip" else 1.0, score)


def test_a_task_holds_k_rows_of_all_groups():
    x, grp = _table(groups=300)
    held = search.BestOfGroups(5, 2, "l2", 2.0)
    for a in range(0, 400, 100):
        held.add(x[:8], x[a : a + 100], np.arange(a, a + 100), pa.array(grp[a : a + 100]))
    assert held.hits(np.arange(8), pa.int64()).num_rows == 8 * 5


def test_a_curve_sends_thresholds_to_the_found_rows(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (1, 5), (1, 6)], "qid long, id long")
    found = spark.createDataFrame([(0, 1, 0.5), (0, 3, 1.5), (1, 5, 1.5), (1, 6, 9.0), (1, 7, None), (1, 8, float("nan"))], "qid long, id long, dist double")
    thresholds = spark.createDataFrame([(0.1,), (1.0,), (2.0,), (2.0,), (None,)], "threshold double")
    out = evaluate.curve(truth, found, thresholds)
    assert {tuple(r) for r in out.collect()} == {(0.1, 1.0, 0.0), (1.0, 1.0, 0.25), (2.0, 2 / 3, 0.5), (None, 1.0, 0.0)}
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin BuildRight, Inner" in plan
    assert "BroadcastNestedLoopJoin BuildRight, LeftOuter" not in plan
