"""Query sets above 100,000 rows: none is left out."""

import numpy as np
from pyspark.sql import functions as F

from nearfield.operators import binary, codecs

MANY = 100_500


def test_pq_answers_every_query(spark):
    pq = codecs.ProductQuantizer(np.array([[[0.0], [1.0]]]))
    rows = spark.createDataFrame([(7, [0]), (8, [1])], "id long, code array<int>")
    queries = spark.range(MANY).select("id", F.array((F.col("id") % 2).cast("double")).alias("vec"))
    coded = queries.select("id", F.array((F.col("id") % 2).cast("int")).alias("code"))
    for got in (pq.search(queries, rows, 1), pq.symmetric(coded, rows, 1)):
        assert got.agg(F.count("*"), F.countDistinct("qid"), F.sum("dist"), F.sum((F.col("id") != 7 + F.col("qid") % 2).cast("int"))).first() == (MANY, MANY, 0.0, 0)


def test_differing_codes_answer_every_query(spark):
    rows = spark.createDataFrame([(7, [0, 1]), (8, [1, 0])], "id long, code array<int>")
    queries = spark.range(MANY).select("id", F.array((F.col("id") % 2).cast("int"), (1 - F.col("id") % 2).cast("int")).alias("code"))
    got = binary.differing_knn(queries, rows, 1)
    assert got.agg(F.count("*"), F.countDistinct("qid"), F.sum("dist"), F.sum((F.col("id") != 7 + F.col("qid") % 2).cast("int"))).first() == (MANY, MANY, 0, 0)
    assert binary.differing_knn(queries.limit(0), rows, 1).count() == 0
