"""Connected components over an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum, aggregated before it is shuffled, and a join of the minima with the edges. A hub (a node
of more than HUB edges) would draw all its edges into one task of that join; the hubs' minima are few, so they are
broadcast behind a check of their size, and only the other nodes' edges are shuffled. Labels and edges stay in tables of
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import discard, small, staged

#: Edges of a node above which its edges are not shuffled by node.
HUB = 64


def with_least(rows: DataFrame, key: str, value: str, least: str, most: int | None = None) -> DataFrame:
    """rows with the least value of their key, whatever number of rows a key has. The rows are read more than once.
    most: a bound for the number of rows, if known."""
    every = staged(rows.groupBy(key).agg(F.min(value).alias(least), F.count("*").alias("rows_of_key")), "least", most=most)
    hubs = every.where(F.col("rows_of_key") > HUB).drop("rows_of_key")
    rest = rows
    if not hubs.isEmpty():
        few = small(hubs)
        at_hubs = rows.join(few, key)
        rest = rows.join(few.select(key), key, "left_anti")
    out = rest.join(every.where(F.col("rows_of_key") <= HUB).drop("rows_of_key"), key)
    return out if hubs.isEmpty() else out.unionByName(at_hubs)


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = with_least(both, "u", "v", "m", 2 * most).where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ends = with_least(down, "u", "v", "m", most).select("m", F.explode(F.array("u", "v")).alias("x"))
    return ends.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges (u, v: long) to (node, component): component is the smallest id reachable.

    Self links and repeated edges are harmless, edges with a null end are ignored, no edges give no rows. most: a bound for
    the number of edges, if known.
    """
    edges = edges.select("u", "v").where("u <> v")
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", most=most)
    mark = _mark(now)
    while mark[0]:
        large = staged(_large_star(now, mark[0]), "edges", most=mark[0])
        after = staged(_small_star(large, mark[0]), "edges", most=2 * mark[0])
        discard(now)
        discard(large)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
