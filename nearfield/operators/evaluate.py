"""Evaluation of search results against ground truth, and of operating points against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at(truth: DataFrame, found: DataFrame, r: int) -> DataFrame:
    """The share of queries whose first true neighbour is among the first r found."""
    first = truth.where("rank = 0").select("qid", F.col("id").alias("t"))
    hit = found.where(F.col("rank") < r).select("qid", F.col("id").alias("t"), F.lit(1.0).alias("hit"))
    return first.join(hit, ["qid", "t"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def intersection_at(truth: DataFrame, found: DataFrame, r: int) -> DataFrame:
    """Shared ids of the first r, over queries times r; an id counts once."""
    t = truth.where(F.col("rank") < r).select("qid", "id").distinct()
    both = t.join(found.where(F.col("rank") < r).select("qid", "id").distinct(), ["qid", "id"])
    n = truth.select("qid").distinct().agg(F.count("*").alias("n"))
    return both.agg(F.count("*").alias("c")).crossJoin(n).select((F.col("c") / (F.col("n") * r)).alias("intersection"))


def range_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """precision and recall over all queries; 1 where nothing was found or there was nothing to find."""
    t, f = truth.select("qid", "id").distinct(), found.select("qid", "id").distinct()
    counts = t.withColumn("t", F.lit(1)).join(f.withColumn("f", F.lit(1)), ["qid", "id"], "full").agg(F.count("t").alias("t"), F.count("f").alias("f"), F.count(F.col("t") + F.col("f")).alias("both"))
    share = lambda n: F.when(F.col(n) == 0, F.lit(1.0)).otherwise(F.col("both") / F.when(F.col(n) != 0, F.col(n)))
    return counts.select(share("f").alias("precision"), share("t").alias("recall"))


def range_scores_average(truth: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """precision and recall of each query (qid of queries), averaged: 1 for a query where nothing was found, or nothing was
    there to find."""
    t, f = truth.select("qid", "id").distinct(), found.select("qid", "id").distinct()
    both = t.withColumn("t", F.lit(1)).join(f.withColumn("f", F.lit(1)), ["qid", "id"], "full").groupBy("qid").agg(F.count("t").alias("t"), F.count("f").alias("f"), F.count(F.col("t") + F.col("f")).alias("both"))
    each = queries.select("qid").distinct().join(both, "qid", "left").na.fill(0)
    share = lambda n: F.when(F.col(n) == 0, F.lit(1.0)).otherwise(F.col("both") / F.when(F.col(n) != 0, F.col(n)))
    return each.agg(F.avg(share("f")).alias("precision"), F.avg(share("t")).alias("recall"))


def differences_beyond_draws(truth: DataFrame, found: DataFrame) -> DataFrame:
    """qid, n of queries whose results (qid, id, dist) differ by more than the order or choice of equal scores: other
    scores, or another id at a score that is not the query's last."""
    def table(x: DataFrame) -> DataFrame:
        last = Window.partitionBy("qid")
        return x.select("qid", "id", "dist", (F.col("dist") == F.max("dist").over(last)).alias("end"))

    a, b = table(truth), table(found)
    scores = a.groupBy("qid", "dist").agg(F.count("*").alias("n")).join(b.groupBy("qid", "dist").agg(F.count("*").alias("m")), ["qid", "dist"], "full")
    ids = a.where("not end").select("qid", "id", "dist").withColumn("a", F.lit(1)).join(b.where("not end").select("qid", "id", "dist").withColumn("b", F.lit(1)), ["qid", "id", "dist"], "full")
    wrong = scores.where(~F.col("n").eqNullSafe(F.col("m"))).select("qid").unionByName(ids.where("a is null or b is null").select("qid"))
    return wrong.groupBy("qid").agg(F.count("*").alias("n"))


def time_for(points: DataFrame, perf: float) -> DataFrame:
    """One row, t: the least time of an operating point (key, perf, t) that reaches perf; null if none does."""
    return points.where(F.col("perf") >= perf).agg(F.min("t").alias("t"))


def curve(truth: DataFrame, found: DataFrame, thresholds: DataFrame) -> DataFrame:
    """threshold, precision, recall of the found rows with dist < threshold, for a small table of thresholds: that one is
    sent to the found rows, which are counted where they are joined. A repeated threshold counts once."""
    asked = thresholds.select("threshold").distinct()
    known = truth.select("qid", "id").distinct()
    low = found.select("qid", "id", "dist").join(F.broadcast(asked.agg(F.max("threshold").alias("most"))), F.col("dist") < F.col("most")).drop("most")
    marked = low.join(known.withColumn("hit", F.lit(1)), ["qid", "id"], "left").select("dist", F.coalesce("hit", F.lit(0)).alias("hit"))
    met = marked.join(F.broadcast(asked), F.col("dist") < F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    total = known.agg(F.count("*").alias("total"))
    by = asked.join(met.withColumnRenamed("threshold", "t"), F.col("threshold") == F.col("t"), "left").select("threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))
    out = by.crossJoin(F.broadcast(total))
    precision = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("hits") / F.when(F.col("n") != 0, F.col("n")))
    recall = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("hits") / F.when(F.col("total") != 0, F.col("total")))
    return out.select("threshold", precision.alias("precision"), recall.alias("recall"))


def pareto(points: DataFrame) -> DataFrame:
    """Points (key, perf, t) that no other beats: more perf for at most the time. perf 0 is never kept."""
    w = Window.orderBy(F.col("perf").desc(), F.col("t"), F.col("key")).rowsBetween(Window.unboundedPreceding, -1)  # operating points are few
    return points.where("perf > 0").withColumn("best", F.min("t").over(w)).where("best is null or t < best").drop("best")
