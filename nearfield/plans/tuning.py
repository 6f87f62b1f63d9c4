"""Search parameters tried out: every combination timed, those that can't win left out, the undominated kept."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from nearfield.operators.evaluate import pareto

#: What each parameter may be tried at; all doublings, as results change with the logarithm of effort.
RANGES = {"nprobe": tuple(2**i for i in range(13)), "ef": tuple(2**i for i in range(2, 10)), "factor": tuple(2.0**i for i in range(7)), "screen": tuple(range(4, 65, 4))}


def combinations(ranges: dict[str, tuple]) -> list[dict]:
    """Every choice of one value for each parameter, the first name varying slowest."""
    return [dict(zip(ranges, values, strict=True)) for values in product(*ranges.values())]


def no_better(a: dict, b: dict) -> bool:
    """No parameter of a exceeds b's: effort, and so quality and time, are at most b's."""
    return all(a[n] <= b[n] for n in a)


def _open(tried: list[tuple[dict, float, float]], c: dict) -> bool:
    """Whether c may be a new best point: its quality is at most that of any tried point above it, its time at least
    that of any tried point below it."""
    top = min((p for x, p, _ in tried if no_better(c, x)), default=float("inf"))
    low = max((t for x, _, t in tried if no_better(x, c)), default=0.0)
    return not any(p >= top and t <= low for _, p, t in tried)


def explore(spark: SparkSession, run: Callable[..., DataFrame], score: Callable[[DataFrame], float], ranges: dict[str, tuple], most: int | None = None) -> DataFrame:
    """key, perf, t of the tried combinations that nothing beats. run(**parameters) is executed whole and timed;
    score(result) is its quality. Extremes go first, so that their bounds rule out many of the rest."""
    every, tried = combinations(ranges), []
    order = [0, len(every) - 1, *range(1, len(every) - 1)] if len(every) > 1 else [0]
    for i in order[:most]:
        if tried and not _open(tried, every[i]):
            continue
        began = time.perf_counter()
        found = run(**every[i]).persist()
        found.count()
        took = time.perf_counter() - began
        tried.append((every[i], float(score(found)), took))
        found.unpersist()
    rows = [(",".join(f"{n}={v}" for n, v in c.items()), p, t) for c, p, t in tried]
    return pareto(spark.createDataFrame(rows, "key string, perf double, t double"))


def timed(run: Callable[[], DataFrame], repeats: int = 3, most_seconds: float = 60.0) -> Iterator[float]:
    """Seconds of each run after a first unmeasured one."""
    run().write.format("noop").mode("overwrite").save()
    spent = 0.0
    for _ in range(repeats):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        spent += took
        yield took
        if spent > most_seconds:
            return
