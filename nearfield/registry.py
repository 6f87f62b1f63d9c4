"""Registered queries of the vector engine and their SQL.

Every query runs over the whole of `embeddings`; the query vectors are a stated set, every row whose vec_id is divisible by
20. Trained parts are replaced by fixed rules (the first 16 rows as centroids or codebooks), so that SQL can check the whole search path.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.functions.metrics import NAMES, descending
from nearfield.operators import additive, binary, cluster, codecs, coded_lists, evaluate, graph, ivf, search, selectors, spectral, sphere, stats, transforms
from nearfield.plans.index import BinaryIndex, Index
from nearfield.sources import indexes
from nearfield.sources.tables import embeddings
from nearfield.streaming import window

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Where a metric needs other vectors than the unit ones: what the elements are, in Spark and in SQL.
_ABS = {"jensenshannon", "jaccard"}
#: SQL of one element's term, of x and y.
_TERM = {
    "l2": "(x-y)*(x-y)", "ip": "x*y", "l1": "abs(x-y)", "linf": "abs(x-y)", "lp": "pow(abs(x-y),3)", "canberra": "abs(x-y)/(abs(x)+abs(y))",
    "jensenshannon": "0.5::DOUBLE*(-x*ln((x+y)/2/x)-y*ln((x+y)/2/y))", "nan_l2": "(x-y)*(x-y)",
    "gower": "CASE WHEN x>=0 AND y>=0 THEN abs(x-y) WHEN x<0 AND y<0 THEN (x<>y)::INT::DOUBLE ELSE 'nan'::DOUBLE END",
}


def _score_sql(metric: str, a: str = "q.v", b: str = "b.v", d: int = 64) -> str:
    """SQL of the metric of two double lists."""

    def total(term: str, f: str = "list_sum") -> str:
        return f"{f}(list_transform(range(1,{d + 1}), lambda i: ({_terms(term, a, b)})))"

    if metric == "linf":
        return total(_TERM[metric], "list_max")
    if metric == "braycurtis":
        return f"{total('abs(x-y)')}/{total('abs(x+y)')}"
    if metric == "jaccard":
        return f"{total('least(x,y)')}/{total('greatest(x,y)')}"
    if metric == "cosine":
        return f"{total('x*y')}/(sqrt({total('x*x')})*sqrt({total('y*y')}))"
    if metric == "gower":
        return f"{total(_TERM[metric])}/{d}"
    return total(_TERM[metric])


def _terms(term: str, a: str, b: str) -> str:
    out, names = "", {"x": f"{a}[i]", "y": f"{b}[i]"}
    for k, c in enumerate(term):
        alone = not (term[k - 1 : k].isalpha() and k) and not term[k + 1 : k + 2].isalpha()
        out += names[c] if c in names and alone else c
    return out


def _vec_sql(metric: str = "") -> str:
    if metric in _ABS:
        return "list_transform(embedding, lambda e: abs(e::DOUBLE))"
    if metric == "gower":
        return "list_transform(range(1,65), lambda i: CASE WHEN i <= 32 THEN least(1.0::DOUBLE, abs(embedding[i]::DOUBLE)) ELSE -(1.0::DOUBLE+label) END)"
    return "list_transform(embedding, lambda e: e::DOUBLE * (1 + label))"


def _base_sql(metric: str = "") -> str:
    return f"b AS (SELECT vec_id AS id, label, {_vec_sql(metric)} AS v FROM embeddings), q AS (SELECT id AS qid, v FROM b WHERE id % 20 = 0)"


def _vectors(spark: SparkSession, sf_dir: str, metric: str = "") -> DataFrame:
    """id, vec, label; not of unit length, so that metrics order rows differently."""
    rows = embeddings(spark, sf_dir)
    if metric in _ABS:
        v = F.transform("vec", lambda x: F.abs(x.cast("double")))
    elif metric == "gower":
        v = F.transform("vec", lambda x, i: F.when(i < 32, F.least(F.lit(1.0), F.abs(x.cast("double")))).otherwise(-(F.lit(1.0) + F.col("label"))))
    else:
        v = F.transform("vec", lambda x: x.cast("double") * (1 + F.col("label")))
    return rows.select("id", v.alias("vec"), "label")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 20 = 0")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _knn_sql(metric: str, k: int, where: str = "true") -> str:
    order = "DESC" if descending(metric) else "ASC"
    return (
        f"WITH {_base_sql(metric)}, s AS (SELECT qid, id, {_score_sql(metric)} AS dist FROM q, b WHERE {where}), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist {order}, id) - 1 AS rank FROM s WHERE NOT isnan(dist)) "
        f"SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM r WHERE rank < {k}"
    )


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql is not None:
        _SQL[name] = sql


def _knn(metric: str, k: int = 10, arg: float = 3.0, where=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _vectors(spark, sf_dir, metric)
        return _rounded(search.knn_join(_asked(rows), rows, k, metric, arg, None if where is None else where()), "dist")

    return run


for _m in NAMES:
    _add(f"knn_{_m}", _knn(_m), _knn_sql(_m, 10))

_SELECTORS = {
    "range": (lambda: selectors.id_range(30, 80), "id >= 30 AND id < 80"),
    "array": (lambda: selectors.id_in([3, 5, 70, 199, 240]), "id IN (3, 5, 70, 199, 240)"),
    "bitmap": (lambda: selectors.id_bitmap(bytes([0b10100101] * 20)), "id < 160 AND id % 8 IN (0, 2, 5, 7)"),
    "not": (lambda: selectors.negated(selectors.id_range(0, 400)), "NOT id < 400"),
    "and": (lambda: selectors.every(F.col("id") % 3 == 0, F.col("label").isin(1, 2)), "id % 3 = 0 AND label IN (1, 2)"),
    "or": (lambda: selectors.some(F.col("id") % 7 == 0, F.col("label") == 4), "id % 7 = 0 OR label = 4"),
    "xor": (lambda: selectors.either(F.col("id") % 2 == 0, F.col("id") % 3 == 0), "(id % 2 = 0) <> (id % 3 = 0)"),
}
for _n, (_p, _s) in _SELECTORS.items():
    _add(f"knn_where_{_n}", _knn("l2", where=_p), _knn_sql("l2", 10, _s))


def _on_rows(f, metric: str = ""):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(_vectors(spark, sf_dir, metric))

    return run


def _with(sql: str, metric: str = "") -> str:
    return f"WITH {_base_sql(metric)} {sql}"


for _m, _r in (("l2", 12.3456), ("ip", 3.2109)):
    _add(
        f"range_{_m}", _on_rows(lambda r, m=_m, x=_r: _rounded(search.range_join(_asked(r), r, x, m), "dist")),
        _with(f"SELECT qid, id, round({_score_sql(_m)}, 6) AS dist FROM q, b WHERE {_score_sql(_m)} {'>' if _m == 'ip' else '<'} {_r}"),
    )
_add("pairwise_l1", _on_rows(lambda r: _rounded(search.pairwise(_asked(r), r, "l1"), "dist")), _with(f"SELECT qid, id, round({_score_sql('l1')}, 6) AS dist FROM q, b"))
_add("assign_l2", _on_rows(lambda r: search.assign(r, r.where("id < 16"))), _with(f"SELECT x.id AS qid, arg_min(b.id, struct_pack(d := {_score_sql('l2', 'x.v')}, i := b.id)) AS id FROM b x, b WHERE b.id < 16 GROUP BY 1"))
_add(
    "candidates_l2", _on_rows(lambda r: _rounded(search.candidate_join(_asked(r).select(F.col("id").alias("qid")).join(r.where("id % 5 = 0").select("id")), _asked(r), r, 5), "dist")),
    _knn_sql("l2", 5, "id % 5 = 0"),
)
_add(
    "pair_scores_ip", _on_rows(lambda r: _rounded(search.pair_scores(r.select((F.col("id") - F.col("id") % 20).alias("qid"), "id"), _asked(r), r, "ip"), "dist")),
    _with(f"SELECT qid, id, round({_score_sql('ip')}, 6) AS dist FROM q, b WHERE id - id % 20 = qid"),
)
_add(
    "sharded_l2", _on_rows(lambda r: _rounded(search.merged([search.knn_join(_asked(r), r, 10, where=F.col("id") % 3 == i) for i in range(3)], 10), "dist")), _knn_sql("l2", 10)
)
_add(
    "padded_l2", _on_rows(lambda r: _rounded(search.padded(search.knn_join(_asked(r), r, 10, where=F.col("id") < 6), _asked(r), 10), "dist")),
    f"WITH h AS ({_knn_sql('l2', 10, 'id < 6')}), s AS (SELECT vec_id AS qid, unnest(range(10))::INT AS rank FROM embeddings WHERE vec_id % 20 = 0) "
    "SELECT qid, rank, coalesce(id, -1) AS id, round(coalesce(dist, 3.4028234663852886e38), 6) AS dist FROM s LEFT JOIN h USING (qid, rank)",
)
_add(
    "diverse_l2", _on_rows(lambda r: _rounded(search.diverse_join(_asked(r), r.select("id", "vec", F.col("label").alias("grp")), 10, 2), "dist")),
    _with(
        f", s AS (SELECT qid, id, label AS grp, {_score_sql('l2')} AS dist FROM q, b), g AS (SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY dist, id) AS n FROM s), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM g WHERE n <= 2) SELECT qid, rank::INT AS rank, id, grp, round(dist, 6) AS dist FROM r WHERE rank < 10"
    ),
)
_add(
    "budgeted_range", _on_rows(lambda r: _rounded(search.budgeted(search.range_join(_asked(r), r, 30.0), 50), "dist")),
    _with(
        f", s AS (SELECT qid, id, {_score_sql('l2')} AS dist FROM q, b), e AS (SELECT dist AS edge FROM s WHERE dist < 30 ORDER BY dist LIMIT 1 OFFSET 50) "
        "SELECT qid, id, round(dist, 6) AS dist FROM s WHERE dist < 30 AND dist < coalesce((SELECT edge FROM e), 30)"
    ),
)
_add("similarity_graph", _on_rows(lambda r: _rounded(search.similarity_graph(r, 3), "dist")), _with(
    f", s AS (SELECT x.id AS src, b.id AS dst, {_score_sql('l2', 'x.v')} AS dist FROM b x, b WHERE x.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS rank FROM s) "
    "SELECT src, rank::INT AS rank, dst, round(dist, 6) AS dist FROM r WHERE rank < 3"
))
_add("kmin_of_rows", _on_rows(lambda r: r.select("id", F.posexplode(V.k_smallest(F.col("vec"), 3)).alias("rank", "x")).select("id", "rank", F.round("x.value", 6).alias("value"), "x.place")), _with(
    ", e AS (SELECT id, unnest(v) AS value, unnest(range(64)) AS place FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value, place) - 1 AS rank FROM e) "
    "SELECT id, rank::INT AS rank, round(value, 6) AS value, place::INT AS place FROM r WHERE rank < 3"
))
_add("norms", _on_rows(lambda r: r.select("id", F.round(V.norm2(F.col("vec")), 6).alias("norm2"))), _with("SELECT id, round(list_sum(list_transform(v, lambda x: x*x)), 6) AS norm2 FROM b"))
_add("normalized", _on_rows(lambda r: r.select("id", F.posexplode(V.normalized(F.col("vec"))).alias("dim", "x")).withColumn("x", F.round("x", 6))), _with(
    "SELECT id, unnest(range(64))::INT AS dim, round(unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x*x))), 6) AS x FROM b"
))
_add("centered", _on_rows(lambda r: transforms.Center.fit(r).apply(r).select("id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))), _with(
    ", e AS (SELECT id, unnest(range(64))::INT AS dim, unnest(v) AS x FROM b) SELECT id, dim, round(x - avg(x) OVER (PARTITION BY dim), 6) AS x FROM e"
))
_add("remapped", _on_rows(lambda r: transforms.Remap((5, -1, 0), 64).apply(r).select("id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))), _with(
    "SELECT id, unnest([0, 1, 2])::INT AS dim, round(unnest([v[6], 0.0::DOUBLE, v[1]]), 6) AS x FROM b"
))
_add("matrix_stats", _on_rows(lambda r: _rounded(stats.per_dimension(r).drop("n_inf"), "min", "max", "mean", "std")), _with(
    ", e AS (SELECT unnest(range(64))::INT AS dim, unnest(v) AS x FROM b) SELECT dim, count(*) AS n, 0::BIGINT AS n_nan, count(*) FILTER (x = 0) AS n_zero, round(min(x), 6) AS min, "
    "round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM e GROUP BY dim"
))
_add("imbalance", _on_rows(lambda r: _rounded(stats.imbalance(r, "label"), "imbalance")), "WITH h AS (SELECT count(*)::DOUBLE AS h FROM embeddings GROUP BY label) SELECT round(count(*) * sum(h*h) / (sum(h)*sum(h)), 6) AS imbalance FROM h")
_add("bit_histogram", _on_rows(stats.bit_histogram), _with("SELECT unnest(range(64))::INT AS bit, unnest(list_transform(v, lambda x: (x >= 0)::INT)) AS b FROM b").replace("SELECT unnest(range(64))", ", e AS (SELECT unnest(range(64))", 1) + ") SELECT bit, sum(b)::BIGINT AS n FROM e GROUP BY bit")
_add("label_histogram", _on_rows(lambda r: stats.histogram(r, "label", 5)), "SELECT label AS bin, count(*) AS n FROM embeddings WHERE label BETWEEN 0 AND 4 GROUP BY 1")
_DOUBLED = "d AS (SELECT id, v FROM b UNION ALL SELECT id + 100000, v FROM b WHERE id < 50)"
_add("distinct_vectors", _on_rows(lambda r: stats.distinct_vectors(r.select("id", "vec").union(r.where("id < 50").select(F.col("id") + 100000, "vec"))).select("id", "copies")), _with(f", {_DOUBLED} SELECT min(id) AS id, count(*) AS copies FROM d GROUP BY v"))

_HAM = "list_sum(list_transform(range(1,65), lambda i: ((q.v[i] >= 0) <> (b.v[i] >= 0))::INT))::INT"


def _codes(r: DataFrame) -> DataFrame:
    return binary.codes(r, 64)


_add("hamming_knn", _on_rows(lambda r: binary.hamming_knn(_codes(_asked(r)), _codes(r), 10)), _with(
    f", s AS (SELECT qid, id, {_HAM} AS dist FROM q, b), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM s) SELECT qid, rank::INT AS rank, id, dist FROM r WHERE rank < 10"
))
_add("hamming_range", _on_rows(lambda r: binary.hamming_range(_codes(_asked(r)), _codes(r), 26)), _with(f"SELECT qid, id, {_HAM} AS dist FROM q, b WHERE {_HAM} < 26"))
_add("hamming_counts", _on_rows(lambda r: binary.hamming_counts(_codes(_asked(r)), _codes(r), 26)), _with(f"SELECT qid, count(*) AS n FROM q, b WHERE {_HAM} <= 26 GROUP BY qid"))
_add("hash_buckets", _on_rows(lambda r: binary.bucket_range(_codes(_asked(r)), _codes(r), 30, 8, 2)), _with(
    f"SELECT qid, id, {_HAM} AS dist FROM q, b WHERE {_HAM} < 30 AND {_HAM.replace('range(1,65)', 'range(1,9)')} <= 2"
))
_add("multi_hash", _on_rows(lambda r: binary.bucket_range(_codes(_asked(r)), _codes(r), 30, 8, 1, (0, 8))), _with(
    f"SELECT qid, id, {_HAM} AS dist FROM q, b WHERE {_HAM} < 30 AND ({_HAM.replace('range(1,65)', 'range(1,9)')} <= 1 OR {_HAM.replace('range(1,65)', 'range(9,17)')} <= 1)"
))

for _b in (4, 6, 8):
    _top = (1 << _b) - 1
    _add(
        f"sq{_b}_codes",
        _on_rows(lambda r, b=_b: (lambda s: r.select("id", F.posexplode(s.encode(F.col("vec"))).alias("dim", "code")))(codecs.ScalarQuantizer.fit(r, b))),
        _with(
            f", e AS (SELECT id, unnest(range(64))::INT AS dim, unnest(v) AS x FROM b), m AS (SELECT *, min(x) OVER (PARTITION BY dim) AS a, max(x) OVER (PARTITION BY dim) AS z FROM e) "
            f"SELECT id, dim, floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (x - a) / (z - a))) * {_top})::INT AS code FROM m"
        ),
    )
_PQ = (
    ", k AS (SELECT id AS c, v FROM b WHERE id < 16), s AS (SELECT b.id, m.m, k.c, list_sum(list_transform(range(1,9), lambda i: (b.v[m.m*8+i]-k.v[m.m*8+i])*(b.v[m.m*8+i]-k.v[m.m*8+i]))) AS d "
    "FROM b, k, (SELECT unnest(range(8)) AS m) m), p AS (SELECT id, m, arg_min(c, struct_pack(d := d, c := c)) AS code FROM s GROUP BY id, m)"
)


def _pq(r: DataFrame) -> tuple[codecs.ProductQuantizer, DataFrame]:
    pq = codecs.ProductQuantizer.from_rows(r.where("id < 16"), 8, 16)
    return pq, pq.encode(r)


_add("pq_codes", _on_rows(lambda r: _pq(r)[1].select("id", F.posexplode("code").alias("m", "code"))), _with(f"{_PQ} SELECT id, m::INT AS m, code::INT AS code FROM p"))
_add(
    "pq_adc", _on_rows(lambda r: (lambda p: _rounded(p[0].search(_asked(r), p[1], 10), "dist"))(_pq(r))),
    _with(
        f"{_PQ}, t AS (SELECT s.id AS qid, s.m, s.c AS code, s.d FROM s WHERE s.id % 20 = 0), a AS (SELECT qid, p.id, sum(d) AS dist FROM t JOIN p USING (m, code) GROUP BY qid, p.id), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) - 1 AS rank FROM a) SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM r WHERE rank < 10"
    ),
)
_add("row_minmax_codes", _on_rows(lambda r: r.select("id", F.posexplode(codecs.row_scaled(F.col("vec"))["code"]).alias("dim", "code"))), _with(
    "SELECT id, unnest(range(64))::INT AS dim, floor((unnest(v) - list_min(v)) / (list_max(v) - list_min(v)) * 255)::INT AS code FROM b"
))

_IVF = (
    f", c AS (SELECT id AS list_no, v FROM b WHERE id < 16), a AS (SELECT x.id, x.v, arg_min(b.list_no::INT, struct_pack(d := {_score_sql('l2', 'x.v')}, i := b.list_no)) AS list_no FROM b x, c b GROUP BY x.id, x.v), "
    f"pr AS (SELECT qid, list_no, row_number() OVER (PARTITION BY qid ORDER BY {_score_sql('l2')}, list_no) - 1 AS rank FROM q, c b), "
    f"h AS (SELECT pr.qid, b.id, b.list_no, pr.rank AS probe, {_score_sql('l2')} AS dist FROM pr JOIN a b ON b.list_no = pr.list_no JOIN q ON q.qid = pr.qid WHERE pr.rank < 4)"
)
_TOP = ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM h WHERE {}) SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM r WHERE rank < 10"


def _ivf(r: DataFrame) -> ivf.InvertedFile:
    return ivf.InvertedFile.build(r.select("id", "vec"), r.where("id < 16").select(F.col("id").cast("int").alias("list_no"), "vec"))


def _ivf_search(change):
    return _on_rows(lambda r: _rounded(change(_ivf(r), r).search(_asked(r), 10, 4), "dist"))


_PLACE = "SELECT id, row_number() OVER (ORDER BY list_no, id) - 1 AS p, row_number() OVER (PARTITION BY list_no ORDER BY id) - 1 AS lp, count(*) OVER (PARTITION BY list_no) AS n FROM a"
for _n, (_f, _s) in {
    "search": (lambda i, r: i, "true"),
    "ids_between": (lambda i, r: i.ids_between(100, 300), "id >= 100 AND id < 300"),
    "ids_modulo": (lambda i, r: i.ids_modulo(3, 1), "id % 3 = 1"),
    "elements_between": (lambda i, r: i.elements_between(50, 250), f"id IN (SELECT id FROM ({_PLACE}) WHERE p >= 50 AND p < 250)"),
    "list_share": (lambda i, r: i.list_share(3, 1), f"id IN (SELECT id FROM ({_PLACE}) WHERE lp >= floor(n * 1 / 3) AND lp < floor(n * 2 / 3))"),
    "lists_between": (lambda i, r: i.lists_between(2, 9), "list_no >= 2 AND list_no < 9"),
    "remove": (lambda i, r: i.remove(F.col("id") % 4 == 0), "id % 4 <> 0"),
    "merge": (lambda i, r: i.ids_modulo(2, 0).merge(i.ids_modulo(2, 1)), "true"),
    "update": (lambda i, r: i.ids_between(0, 200).merge(i.ids_between(200, 10**9)).update(r.where("id < 50").select("id", "vec")), "true"),
    "long_lists_dropped": (lambda i, r: i.without_long_lists(40), f"id IN (SELECT id FROM ({_PLACE}) WHERE n < 40)"),
    "capped_lists": (lambda i, r: i.capped(10), f"id IN (SELECT id FROM ({_PLACE}) WHERE lp < 10)"),
    "shard": (lambda i, r: i.shard(2, 1), "list_no % 2 = 1"),
}.items():
    _add(f"ivf_{_n}", _ivf_search(_f), _with(_IVF + _TOP.format(_s)))
_add("ivf_range", _on_rows(lambda r: _rounded(_ivf(r).range_search(_asked(r), 20.0, 4), "dist")), _with(_IVF + " SELECT qid, id, round(dist, 6) AS dist FROM h WHERE dist < 20"))
_add("ivf_list_sizes", _on_rows(lambda r: _ivf(r).sizes()), _with(_IVF + " SELECT list_no, count(*) AS size FROM a GROUP BY list_no"))
_add("ivf_max_codes", _on_rows(lambda r: _rounded(_ivf(r).search_budgeted(_asked(r), 10, 4, 60), "dist")), _with(
    _IVF + ", o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY probe, id) AS n FROM h)" + _TOP.replace("FROM h", "FROM o").format("n <= 60")
))
_add("ivf_residuals", _on_rows(lambda r: _ivf(r).residuals().select("list_no", "id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))), _with(
    _IVF + " SELECT a.list_no, a.id, unnest(range(64))::INT AS dim, round(unnest(a.v) - unnest(c.v), 6) AS x FROM a JOIN c ON a.list_no = c.list_no"
))


def _truth_and_found(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    return search.knn_join(_asked(r), r, 10), _ivf(r).search(_asked(r), 10, 4)


_TF = _with(_IVF + f", t AS ({_knn_sql('l2', 10)}), f AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM h)")
_add("recall_at_10", _on_rows(lambda r: _rounded(evaluate.recall_at(*_truth_and_found(r), 10), "recall")), f"{_TF} SELECT round(avg(CASE WHEN f.id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS recall FROM t LEFT JOIN f ON f.qid = t.qid AND f.id = t.id AND f.rank < 10 WHERE t.rank = 0")
_add("intersection_at_10", _on_rows(lambda r: _rounded(evaluate.intersection_at(*_truth_and_found(r), 10), "intersection")), f"{_TF} SELECT round(count(f.id) / (10.0::DOUBLE * (SELECT count(*) FROM q)), 6) AS intersection FROM t LEFT JOIN f ON f.qid = t.qid AND f.id = t.id AND f.rank < 10")
_add("range_precision_recall", _on_rows(lambda r: _rounded(evaluate.range_scores(search.range_join(_asked(r), r, 20.0), _ivf(r).range_search(_asked(r), 25.0, 4)), "precision", "recall")), _with(
    _IVF + f", t AS (SELECT qid, id FROM q, b WHERE {_score_sql('l2')} < 20), f AS (SELECT qid, id FROM h WHERE dist < 25), x AS (SELECT count(*) AS c FROM t JOIN f USING (qid, id)) "
    "SELECT round(c / (SELECT count(*) FROM f)::DOUBLE, 6) AS precision, round(c / (SELECT count(*) FROM t)::DOUBLE, 6) AS recall FROM x"
))


def _lloyd(r: DataFrame) -> DataFrame:
    first = [x["vec"] for x in r.where("id < 10").orderBy("id").collect()]
    c, sizes, _ = cluster.step(r, np.array(first))
    rows = [(i, int(n), d, float(round(x, 6))) for i, (n, v) in enumerate(zip(sizes, c, strict=True)) for d, x in enumerate(v)]
    return _rounded(r.sparkSession.createDataFrame(rows, "c int, n long, dim int, x double"), "x")


_add("kmeans_step", _on_rows(_lloyd), _with(
    f", a AS (SELECT x.id, x.v, arg_min(b.id, struct_pack(d := {_score_sql('l2', 'x.v')}, i := b.id)) AS c FROM b x, b WHERE b.id < 10 GROUP BY x.id, x.v), "
    "e AS (SELECT c, unnest(range(64))::INT AS dim, unnest(v) AS x FROM a) SELECT c::INT AS c, count(*) AS n, dim, round(avg(x), 6) AS x FROM e GROUP BY c, dim"
))


def _sums(r: DataFrame) -> DataFrame:
    first = np.array([x["vec"] for x in r.where("id < 32").orderBy("id").collect()])
    coded = additive.AdditiveQuantizer((first.reshape(2, 16, -1),), beam=1).encode(r)
    return coded.select("id", F.get("code", F.lit(0)).alias("c0"), F.get("code", F.lit(1)).alias("c1"))


_add("greedy_sum_codes", _on_rows(_sums), _with(
    f", a AS (SELECT x.id, x.v, arg_min(b.id, struct_pack(d := {_score_sql('l2', 'x.v')}, i := b.id)) AS c FROM b x, b WHERE b.id < 16 GROUP BY x.id, x.v), "
    "x AS (SELECT a.id, a.c, list_transform(range(1,65), lambda i: a.v[i]-k.v[i]) AS v FROM a JOIN b k ON k.id = a.c) "
    f"SELECT x.id, x.c::INT AS c0, (arg_min(b.id, struct_pack(d := {_score_sql('l2', 'x.v')}, i := b.id)) - 16)::INT AS c1 FROM x, b WHERE b.id >= 16 AND b.id < 32 GROUP BY x.id, x.c"
))
_IVFPQ = (
    f"{_IVF}, e AS (SELECT a.list_no, a.id, list_transform(range(1,65), lambda i: a.v[i]-c.v[i]) AS v FROM a JOIN c ON a.list_no = c.list_no), k AS (SELECT id AS c, v FROM e WHERE id < 16), "
    "part AS (SELECT unnest(range(8)) AS m), "
    "s AS (SELECT e.id, e.list_no, m, k.c, list_sum(list_transform(range(1,9), lambda i: (e.v[m*8+i]-k.v[m*8+i])*(e.v[m*8+i]-k.v[m*8+i]))) AS d FROM e, k, part), "
    "p AS (SELECT id, list_no, m, arg_min(c, struct_pack(d := d, c := c)) AS code FROM s GROUP BY id, list_no, m), "
    "qr AS (SELECT pr.qid, pr.list_no, list_transform(range(1,65), lambda i: q.v[i]-c.v[i]) AS v FROM pr JOIN q ON q.qid = pr.qid JOIN c ON c.list_no = pr.list_no WHERE pr.rank < 4), "
    "t AS (SELECT qid, list_no, m, k.c, list_sum(list_transform(range(1,9), lambda i: (qr.v[m*8+i]-k.v[m*8+i])*(qr.v[m*8+i]-k.v[m*8+i]))) AS d FROM qr, k, part), "
    "o AS (SELECT qid, list_no, m, arg_min(c, struct_pack(d := d, c := c)) AS own FROM t GROUP BY qid, list_no, m), "
    "g AS (SELECT t.qid, p.id, sum(t.d) AS dist, sum(bit_count(xor(p.code, o.own)))::INT AS bits FROM t JOIN p ON p.list_no = t.list_no AND p.m = t.m AND p.code = t.c "
    "JOIN o ON o.qid = t.qid AND o.list_no = t.list_no AND o.m = t.m GROUP BY t.qid, p.id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) - 1 AS rank FROM g WHERE {}) SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM r WHERE rank < 10"
)


def _coded(r: DataFrame) -> coded_lists.CodedLists:
    file = _ivf(r)
    return coded_lists.CodedLists.build(file, codecs.ProductQuantizer.from_rows(file.residuals(), 8, 16))


for _n, _screen, _s in (("ivf_pq_search", None, "true"), ("ivf_pq_screened", 15, "bits < 15")):
    _add(_n, _on_rows(lambda r, h=_screen: _rounded(_coded(r).search(_asked(r), 10, 4, h), "dist")), _with(_IVFPQ.format(_s)))
_add("product_cells", _on_rows(lambda r: _rounded(coded_lists.ProductCells(codecs.ProductQuantizer.from_rows(r.where("id < 16"), 2, 16)).probes(_asked(r), 20), "coarse")), _with(
    ", k AS (SELECT id AS c, v FROM b WHERE id < 16), s AS (SELECT q.qid, m, k.c, list_sum(list_transform(range(1,33), lambda i: (q.v[m*32+i]-k.v[m*32+i])*(q.v[m*32+i]-k.v[m*32+i]))) AS d "
    "FROM q, k, (SELECT unnest(range(2)) AS m)), g AS (SELECT x.qid, x.c + 16 * y.c AS list_no, x.d + y.d AS coarse FROM s x JOIN s y ON x.qid = y.qid AND x.m = 0 AND y.m = 1), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coarse, list_no) - 1 AS rank FROM g) SELECT qid, list_no, rank::INT AS rank, round(coarse, 6) AS coarse FROM r WHERE rank < 20"
))
_BITS = "((floor(({0}.v[i] - {1}) * 2 / 1.5)::BIGINT % 2 + 2) % 2)"
for _kind, _t in (("global", "0.0::DOUBLE"), ("centroid", "c.v[i]"), ("centroid_half", "(c.v[i] - 1.5::DOUBLE / 4)")):
    _add(
        f"spectral_{_kind}",
        _on_rows(lambda r, kind=_kind: spectral.SpectralLists.build(_ivf(r), 1.5, kind, 64).search(_asked(r), 10, 4)),
        _with(
            _IVF + f", s AS (SELECT pr.qid, a.id, list_sum(list_transform(range(1,65), lambda i: ({_BITS.format('q', _t)} <> {_BITS.format('a', _t)})::INT))::INT AS dist FROM pr JOIN q ON q.qid = pr.qid "
            "JOIN a ON a.list_no = pr.list_no JOIN c ON c.list_no = pr.list_no WHERE pr.rank < 4), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM s) "
            "SELECT qid, rank::INT AS rank, id, dist FROM r WHERE rank < 10"
        ),
    )
_add("sign_codes_decoded", _on_rows(lambda r: (lambda s: s.decode(s.encode(r)).select("id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6)))(sphere.SignMagnitude((0.0,) * 64, 1))), _with(
    ", e AS (SELECT id, v, list_sum(list_transform(v, lambda x: x*x)) / list_sum(list_transform(v, lambda x: abs(x))) AS f FROM b) "
    "SELECT id, unnest(range(64))::INT AS dim, round(unnest(list_transform(v, lambda x: CASE WHEN x > 0 THEN f ELSE -f END)), 6) AS x FROM e"
))
_add("median_hash_knn", _on_rows(lambda r: (lambda h: binary.hamming_knn(h.encode(_asked(r)), h.encode(r), 10))(codecs.SignHash.fit(r, 32))), _with(
    ", e AS (SELECT id, unnest(range(32))::INT AS dim, unnest(v[1:32]) AS x FROM b), m AS (SELECT dim, median(x) AS t FROM e GROUP BY dim), w AS (SELECT id, dim, x - t >= 0 AS bit FROM e JOIN m USING (dim)), "
    "s AS (SELECT x.id AS qid, y.id, sum((x.bit <> y.bit)::INT)::INT AS dist FROM w x JOIN w y USING (dim) WHERE x.id % 20 = 0 GROUP BY x.id, y.id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM s) SELECT qid, rank::INT AS rank, id, dist FROM r WHERE rank < 10"
))
_add("differing_codes", _on_rows(lambda r: (lambda c: binary.differing_knn(_asked(c), c, 10))(_pq(r)[1])), _with(
    f"{_PQ}, z AS (SELECT x.id AS qid, y.id, sum((x.code <> y.code)::INT)::INT AS dist FROM p x JOIN p y USING (m) WHERE x.id % 20 = 0 GROUP BY x.id, y.id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM z) SELECT qid, rank::INT AS rank, id, dist FROM r WHERE rank < 10"
))
_add("split_vectors", _on_rows(lambda r: search.split_search(_asked(r), [(r.select("id", F.slice("vec", a + 1, 32).alias("vec")).where("id % 20 <> 0"), a, 32) for a in (0, 32)]).select("qid", F.get("ids", F.lit(0)).alias("a"), F.get("ids", F.lit(1)).alias("b"))), _with(
    ", s AS (SELECT q.qid, m, b.id, list_sum(list_transform(range(1,33), lambda i: (q.v[m*32+i]-b.v[m*32+i])*(q.v[m*32+i]-b.v[m*32+i]))) AS d FROM q, b, (SELECT unnest(range(2)) AS m) WHERE b.id % 20 <> 0), "
    "o AS (SELECT qid, m, arg_min(id, struct_pack(d := d, i := id)) AS id FROM s GROUP BY qid, m) SELECT qid, max(id) FILTER (m = 0) AS a, max(id) FILTER (m = 1) AS b FROM o GROUP BY qid"
))
_add("refined_l2", _on_rows(lambda r: (lambda half: _rounded(search.refined(search.knn_join(_asked(half), half, 40), _asked(r), r, 10), "dist"))(r.select("id", F.slice("vec", 1, 16).alias("vec")))), _with(
    f", s AS (SELECT qid, id, {_score_sql('l2', d=16)} AS near, {_score_sql('l2')} AS dist FROM q, b), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY near, id) AS place FROM s), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM n WHERE place <= 40) SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM r WHERE rank < 10"
))
_add("masked_lists", _ivf_search(lambda i, r: i.lists_between(0, 8).masked_by(i.ids_modulo(2, 0))), _with(_IVF + _TOP.format("list_no < 8 OR id % 2 = 0")))
_add("repeated_codes", _on_rows(lambda r: stats.repeated_codes(_pq(r)[1].select("id", F.get("code", F.lit(0)).alias("c0"), F.get("code", F.lit(1)).alias("c1")), "c0", "c1")), _with(
    f"{_PQ}, w AS (SELECT x.id, x.code::INT AS c0, y.code::INT AS c1 FROM p x JOIN p y ON x.id = y.id AND x.m = 0 AND y.m = 1) SELECT c0, c1, count(*) AS n, min(id) AS first_id FROM w GROUP BY c0, c1 HAVING count(*) > 1"
))
_add("precision_recall_curve", _on_rows(lambda r: _rounded(evaluate.curve(
    search.range_join(_asked(r), r, 20.0), _ivf(r).range_search(_asked(r), 40.0, 4), r.sparkSession.createDataFrame([(5.0,), (15.0,), (25.0,), (35.0,)], "threshold double")), "precision", "recall")), _with(
    _IVF + f", t AS (SELECT qid, id FROM q, b WHERE {_score_sql('l2')} < 20), x AS (SELECT unnest([5.0, 15.0, 25.0, 35.0])::DOUBLE AS threshold), "
    "g AS (SELECT threshold, count(h.id) AS n, count(t.id) AS hits FROM x LEFT JOIN h ON h.dist < threshold AND h.dist < 40 LEFT JOIN t ON t.qid = h.qid AND t.id = h.id GROUP BY threshold) "
    "SELECT threshold, round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE hits::DOUBLE / n END, 6) AS precision, round(hits::DOUBLE / (SELECT count(*) FROM t), 6) AS recall FROM g"
))
_add("pareto_points", _on_rows(lambda r: evaluate.pareto(r.select(F.col("id").cast("string").alias("key"), F.col("label").cast("double").alias("perf"), F.pmod(F.col("id") * 37, F.lit(101)).cast("double").alias("t")))), (
    "WITH p AS (SELECT vec_id::VARCHAR AS key, label::DOUBLE AS perf, (vec_id * 37 % 101)::DOUBLE AS t FROM embeddings WHERE label > 0), "
    "o AS (SELECT *, min(t) OVER (ORDER BY perf DESC, t, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) SELECT key, perf, t FROM o WHERE best IS NULL OR t < best"
))
_add("window_knn", _on_rows(lambda r: _rounded(search.knn_join(_asked(r), window.last_slices(r.withColumn("slice", F.pmod("id", F.lit(5)).cast("int")), 2), 10), "dist")), _knn_sql("l2", 10, "id % 5 >= 3"))
_add("members_knn", _on_rows(lambda r: _rounded(search.knn_join(_asked(r), selectors.members(r, r.where("label = 3").select("id")), 10), "dist")), _knn_sql("l2", 10, "label = 3"))
_add("others_knn", _on_rows(lambda r: _rounded(search.knn_join(_asked(r), selectors.others(r, r.where("label = 3").select("id")), 10), "dist")), _knn_sql("l2", 10, "label <> 3"))
_add("described_flat", _on_rows(lambda r: _rounded(Index.of("Flat").train(r).add(r).search(_asked(r), 10), "dist")), _knn_sql("l2", 10))


def _with_null_rows(r: DataFrame) -> DataFrame:
    return r.select("id", "vec").union(r.select(F.col("id") + 100_000, F.lit(None).cast("array<double>")))


def _null_words(r: DataFrame) -> DataFrame:
    return _codes(r).union(r.select(F.col("id") + 100_000, F.lit(None).cast("array<bigint>")))


def _written_and_read(r: DataFrame) -> DataFrame:
    spark = r.sparkSession
    index = Index.of("IDMap,Flat").train(r).add(r)
    path = f"{spark.sparkContext.getCheckpointDir()}/nearfield/index-{uuid.uuid4().hex}"
    indexes.write(spark, path, index)
    return indexes.read(spark, path).search(_asked(r), 10)


_HAM_SQL = _with(
    f", s AS (SELECT qid, id, {_HAM} AS dist FROM q, b), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM s) SELECT qid, rank::INT AS rank, id, dist FROM r WHERE rank < 10"
)
# Null vectors are in the base and among the queries: the results are those without them.
_add("knn_null_rows", _on_rows(lambda r: (lambda x: _rounded(search.knn_join(_asked(x), x, 10), "dist"))(_with_null_rows(r))), _knn_sql("l2", 10))
_add("ivf_null_rows", _on_rows(lambda r: (lambda x: _rounded(_ivf(x).search(_asked(x), 10, 4), "dist"))(_with_null_rows(r))), _with(_IVF + _TOP.format("true")))
_add("candidates_null_rows", _on_rows(lambda r: (lambda x: _rounded(search.candidate_join(_asked(x).select(F.col("id").alias("qid")).join(x.where("id % 5 = 0").select("id")), _asked(x), x, 5), "dist"))(_with_null_rows(r))), _knn_sql("l2", 5, "id % 5 = 0"))
_add("hamming_null_rows", _on_rows(lambda r: binary.hamming_knn(_null_words(_asked(r)), _null_words(r), 10)), _HAM_SQL)
_add("written_index", _on_rows(lambda r: _rounded(_written_and_read(r), "dist")), _knn_sql("l2", 10))
_add("within_radius", _on_rows(lambda r: _rounded(search.within_radius(search.range_join(_asked(r), r, 30.0), 12.3456), "dist")), _with(f"SELECT qid, id, round({_score_sql('l2')}, 6) AS dist FROM q, b WHERE {_score_sql('l2')} < 12.3456"))
_add("chunked_knn", _on_rows(lambda r: _rounded(search.ranked(search._chunk_pairs(search._plain(_asked(r)), search._plain(r), "l2", 2.0, 10, None), 10).select("qid", "rank", "id", "dist"), "dist")), _knn_sql("l2", 10))
_add("hamming_matches", _on_rows(lambda r: binary.hamming_matches(_codes(_asked(r)), _codes(r), 25)), _with(f"SELECT qid, id FROM q, b WHERE {_HAM} <= 25"))
_add("hamming_self_count", _on_rows(lambda r: binary.hamming_self_count(_codes(r), 22)), _with(f"SELECT count(*) AS n FROM b q, b WHERE q.id < b.id AND {_HAM} <= 22"))
_add("binary_from_float", _on_rows(lambda r: binary.from_float(_codes(_asked(r)), _codes(r), 64, 10)), _HAM_SQL)
_HC = _HAM.replace("q.v", "x.v")
_add("binary_lists", _on_rows(lambda r: binary.BinaryLists.of(_codes(r.where("id < 16")).select(F.col("id").cast("int").alias("list_no"), "words"), 64).add(_codes(r)).search(_codes(_asked(r)), 10, 4)), _with(
    f", a AS (SELECT x.id, x.v, arg_min(b.id, struct_pack(d := {_HC}, i := b.id)) AS list_no FROM b x, b WHERE b.id < 16 GROUP BY x.id, x.v), "
    f"pr AS (SELECT q.qid, b.id AS list_no, row_number() OVER (PARTITION BY q.qid ORDER BY {_HAM}, b.id) - 1 AS rank FROM q, b WHERE b.id < 16), "
    f"s AS (SELECT q.qid, b.id, {_HAM} AS dist FROM pr JOIN q ON q.qid = pr.qid JOIN a b ON b.list_no = pr.list_no WHERE pr.rank < 4), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) - 1 AS rank FROM s) SELECT qid, rank::INT AS rank, id, dist FROM r WHERE rank < 10"
))
_add("argsorted", _on_rows(lambda r: r.select("id", F.posexplode(V.argsorted(F.col("vec"))).alias("rank", "place"))), _with(
    ", e AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS place FROM b) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY x, place) - 1)::INT AS rank, place::INT AS place FROM e"
))
_add("code_set", _on_rows(lambda r: stats.code_set(_pq(r)[1].select("id", F.get("code", F.lit(0)).alias("c0"), F.get("code", F.lit(1)).alias("c1")), "c0", "c1")), _with(
    f"{_PQ}, w AS (SELECT x.id, x.code::INT AS c0, y.code::INT AS c1 FROM p x JOIN p y ON x.id = y.id AND x.m = 0 AND y.m = 1) SELECT min(id) AS id, c0, c1 FROM w GROUP BY c0, c1"
))
_add("packed_codes", _on_rows(lambda r: _pq(r)[1].select("id", F.posexplode(V.unpacked_codes(V.packed_codes(F.col("code"), 5, 8), 5, 8)).alias("m", "code"))), _with(f"{_PQ} SELECT id, m::INT AS m, code::INT AS code FROM p"))
_add("ivf_probe_stats", _on_rows(lambda r: _ivf(r).stats(_asked(r), 4)), _with(
    _IVF + ", n AS (SELECT list_no, count(*) AS size FROM a GROUP BY list_no) SELECT count(DISTINCT qid) AS nq, count(*) AS nlist, sum(size)::BIGINT AS ndis FROM pr LEFT JOIN n USING (list_no) WHERE rank < 4"
))
_add("time_for", _on_rows(lambda r: evaluate.time_for(r.select(F.col("label").cast("double").alias("perf"), F.pmod(F.col("id") * 37, F.lit(101)).cast("double").alias("t")), 7.0)), "SELECT min((vec_id * 37 % 101)::DOUBLE) AS t FROM embeddings WHERE label >= 7")
_add("range_scores_average", _on_rows(lambda r: _rounded(evaluate.range_scores_average(search.range_join(_asked(r), r, 20.0), _ivf(r).range_search(_asked(r), 25.0, 4), _asked(r).select(F.col("id").alias("qid"))), "precision", "recall")), _with(
    _IVF + f", t AS (SELECT qid, id FROM q, b WHERE {_score_sql('l2')} < 20), f AS (SELECT qid, id FROM h WHERE dist < 25), n AS (SELECT q.qid, (SELECT count(*) FROM t WHERE t.qid = q.qid) AS t, "
    "(SELECT count(*) FROM f WHERE f.qid = q.qid) AS f, (SELECT count(*) FROM t JOIN f USING (qid, id) WHERE t.qid = q.qid) AS c FROM q) "
    "SELECT round(avg(CASE WHEN f = 0 THEN 1.0::DOUBLE ELSE c::DOUBLE / f END), 6) AS precision, round(avg(CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE c::DOUBLE / t END), 6) AS recall FROM n"
))
# Approximate searches: tests hold their recall against exact search, SQL can't follow their walks.
_add("nn_descent", _on_rows(lambda r: _rounded(graph.nn_descent(r, 8), "dist")))
for _kind in ("hnsw", "nsg"):
    _add(f"{_kind}_search", _on_rows(lambda r, kind=_kind: _rounded(graph.GraphIndex.build(r, kind, 16).search(_asked(r), 10, 64), "dist")))
# Trained on the rows themselves: tests hold errors, recall or cost.
for _n, _text in {"pca_ivf_flat": "PCA32,IVF16,Flat,RFlat", "opq_ivf_pq_refined": "OPQ16,IVF16,PQ16x8,RFlat", "rabitq_refined": "RaBitQ2,RFlat", "sphere_refined": "ZnLattice8x14_8,RFlat", "minmax_sq8": "MinMax,SQ8"}.items():
    _add(f"described_{_n}", _on_rows(lambda r, t=_text: _rounded(Index.of(t).train(r).add(r).search(_asked(r), 10, nprobe=14, factor=12.0), "dist")))
for _n, _text in {"flat": "BFlat", "ivf": "BIVF16", "graph_ivf": "BIVF16_HNSW8", "graph": "BHNSW16", "multi_hash": "BHash4x6"}.items():
    _add(f"described_binary_{_n}", _on_rows(lambda r, t=_text: BinaryIndex.of(t, 64).train(_codes(r)).add(_codes(r)).search(_codes(_asked(r)), 10, nprobe=12, ef=128, flip=2)))
_add("graph_of_codes", _on_rows(lambda r: _rounded(Index.of("HNSW16,SQ8").train(r).add(r).search(_asked(r), 10, ef=64), "dist")))
_add("two_level_clusters", _on_rows(lambda r: cluster.Clusters(cluster.two_level(r, 4, 16, 10), []).table(r.sparkSession)))
_add("progressive_clusters", _on_rows(lambda r: cluster.Clusters(cluster.progressive(r, 16, 4, 5), []).table(r.sparkSession)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
