"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on hashed n-grams of the whole text (three bytes, one word, two words), its byte shares and how its
words repeat gives each document its own evidence. Grouped aggregation turns that evidence into rates of hosts and of
paths below them; the spread of the rates beyond chance fits the strength of two Beta priors, so a sparse path shrinks
toward its host and a sparse host toward the global rate. A document's posterior odds are its own odds times the odds of
its path's posterior over the global odds; the site posteriors leave the document itself out, so that its evidence
counts once.

The table documents has no URL: op1_quality and the pipeline pass `source` as the host and `lang` as the path below it,
the only columns that group documents on two levels.

Defined results. Null text counts as empty, null host or path as ''. Without labels of both kinds the document
classifier says the global rate of what labels there are (or one half), and all documents stay. Rows are judged one
by one: repeated rows and ids get equal results, and a posterior equal to the threshold stays. For the fit, ids in a tie
of hashes go by id, and of rows that repeat an id the one with the smallest features counts, so a fit can be repeated.
Very long texts are read in blocks of BLOCK bytes, cut at white space where there is some; memory beside the text is
that of a block. All columns of the input pass through, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import bounded_batches, free_names, small, staged, whole

#: The classifier is fitted on at most so many labelled rows, those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
#: Documents whose posterior is below this are rejected.
THRESHOLD = 0.5
#: Bounds of a document's own probability and of the fitted prior strengths.
FLOOR, STRENGTH = 0.001, (1.0, 1e6)
#: Bytes looked at together, and how far back a block's end is moved to white space.
BLOCK, BACK = 1 << 18, 1 << 12
#: Buckets of each kind of n-gram, and how much more their many weights are held back than those of the other features.
GRAMS, GRAM_RIDGE = 256, 30.0
N_FEATURES = 129 + 3 * GRAMS + 8
_TOTALS = 5  # words, words equal to the one before, bytes of words, words without a letter or digit, doubled signs

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_ALNUM = np.array([bytes([i]).isalnum() or i > 127 for i in range(256)])
_PLACE = np.power(np.uint64(0xD6E8FEB86659FD93), np.arange(64, dtype=np.uint64))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(56)).astype(np.int64) % GRAMS


def _block_counts(x: np.ndarray, counts: np.ndarray) -> None:
    """Add a block's counts: bytes, three-byte grams, words, pairs of words, _TOTALS."""
    counts[:256] += np.bincount(x, minlength=256)
    low = _LOWER[x]
    if len(x) > 2:
        counts[256 : 256 + GRAMS] += np.bincount(_bucket(low[:-2] + (low[1:-1] << np.uint64(9)) + (low[2:] << np.uint64(18))), minlength=GRAMS)
    blank = _BLANK[x]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return
    inside = np.flatnonzero(~blank)
    first = np.repeat(starts, np.diff(np.append(np.searchsorted(inside, starts), len(inside))))
    terms = low[inside] * _PLACE[(inside - first) & 63]
    words = np.add.reduceat(terms, np.searchsorted(inside, starts))
    counts[256 + GRAMS : 256 + 2 * GRAMS] += np.bincount(_bucket(words), minlength=GRAMS)
    pairs = words[:-1] * np.uint64(3) + words[1:]
    counts[256 + 2 * GRAMS : 256 + 3 * GRAMS] += np.bincount(_bucket(pairs), minlength=GRAMS)
    signs = np.add.reduceat(_ALNUM[x[inside]].astype(np.int64), np.searchsorted(inside, starts)) == 0
    doubled = (x[1:] == x[:-1]) & ~_ALNUM[x[1:]] & ~blank[1:]
    counts[-_TOTALS:] += len(words), int((words[1:] == words[:-1]).sum()), len(inside), int(signs.sum()), int(doubled.sum())


def features(text: str) -> np.ndarray:
    """Root shares of n-grams and how few hold most of them, shares of ASCII bytes and others, of repeated words, words of
    signs and doubled signs, and how long words and text are."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts, at = np.zeros(256 + 3 * GRAMS + _TOTALS, np.int64), 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            gaps = np.flatnonzero(_BLANK[data[end - BACK : end]])
            end = end - BACK + int(gaps[-1]) + 1 if len(gaps) else end
        _block_counts(data[at:end], counts)
        at = end
    again, letters, signs, doubled = counts[1 - _TOTALS :].tolist()
    n, words = max(1, len(data)), max(1, int(counts[-_TOTALS]))
    grams = counts[256 : 256 + 3 * GRAMS].reshape(3, GRAMS)
    rooted = np.sqrt(grams / np.maximum(1, grams.sum(1, keepdims=True)))
    extra = [counts[128:256].sum() / n, again / words, math.log1p(letters / words) / 5, math.log1p(n) / 20, signs / words, doubled / words]
    return np.concatenate([counts[:128] / n, rooted.ravel(), np.sqrt((rooted**4).sum(1)), extra]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Weights of standardised features; the last is the intercept."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    fitted: bool

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 25) -> Model:
    """Ridge logistic regression by Newton steps."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.append(np.zeros(N_FEATURES), math.log(rate / (1 - rate))), False)
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
    w, penalty = np.zeros(N_FEATURES + 1), np.full(N_FEATURES + 1, float(ridge))
    penalty[128 : 128 + 3 * GRAMS] *= GRAM_RIDGE
    penalty[-1] = 1e-6
    for _ in range(steps):
        curve, slope = np.diag(penalty), -penalty * w
        for at in range(0, len(x), 1024):  # a few rows in doubles at a time
            z = np.hstack([(x[at : at + 1024] - mean) / scale, np.ones((len(x[at : at + 1024]), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve += (z * (p * (1 - p))[:, None]).T @ z
            slope += z.T @ (y[at : at + 1024] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, True)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(x, pa.binary())], names=["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> Model:
    """Fit on documents that `labels` (id_col, label_col 0/1) names; of several labels of one id, the lowest holds."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    sample = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).join(F.broadcast(sample), "id")
    made = rows.select("id", "y", "text").mapInArrow(_feature_rows, "id long, y double, x binary")
    got = made.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow()  # at most max_rows rows
    if not got.num_rows:
        return fit(np.zeros((0, N_FEATURES), np.float32), np.zeros(0))
    got = got.sort_by("id")
    x = np.empty((got.num_rows, N_FEATURES), np.float32)
    for i, v in enumerate(got.column("x")):
        x[i] = np.frombuffer(v.as_buffer(), np.float32)
    return fit(x, got.column("y").to_numpy())


def own_probability(model: Model, text: Column) -> Column:
    """The document's own probability of good quality."""

    @F.pandas_udf("double")
    def own(texts):
        import pandas as pd

        if not len(texts):
            return pd.Series([], dtype="float64")
        x = np.stack([features(t) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(model.logit(x), -30, 30)))).clip(FLOOR, 1 - FLOOR)

    return own(whole(text))


def _strength(sites: DataFrame, mu: Column, least: int = 2) -> Column:
    """Beta strength from the rates' variance beyond that of chance (moments, weighted by size)."""
    n, r = F.col("n"), F.col("s") / F.col("n")
    total, squares, k = F.sum(n), F.sum(n * n), F.count("*")
    within = F.avg(F.col("v"))
    between = (F.sum(n * (r - mu) * (r - mu)) - (k - 1) * within) / F.nullif(total - squares / total, F.lit(0.0))
    fitted = mu * (1 - mu) / F.greatest(between, F.lit(1e-9)) - 1
    return F.when(k >= least, F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), fitted))).otherwise(F.lit(STRENGTH[1]))


@dataclass(frozen=True)
class Priors:
    rate: float
    host_strength: float
    path_strength: float


def site_rates(judged: DataFrame) -> tuple[DataFrame, Priors]:
    """judged (host, path, p) to sites (host, path, n, s, host_n, host_s) and the fitted priors."""
    paths = judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = paths.withColumn("v", F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(1e-9)))
    paths = staged(paths.select("host", "path", "n", "s", "q", "v"), "quality-sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    hosts = hosts.withColumn("v", F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(1e-9)))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total["n"]:
        return paths.select("host", "path", "n", "s", F.col("n").alias("host_n"), F.col("s").alias("host_s")), Priors(0.5, STRENGTH[1], STRENGTH[1])
    mu = min(1 - FLOOR, max(FLOOR, total["s"] / total["n"]))
    by_host = hosts.agg(_strength(hosts, F.lit(mu)).alias("k")).first()["k"]
    by_path = paths.agg(_strength(paths, F.lit(mu)).alias("k")).first()["k"]
    sites = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    return sites.select("host", "path", "n", "s", "host_n", "host_s"), Priors(mu, float(by_host), float(by_path))


def _odds(p: Column) -> Column:
    return p / (1 - p)


def judged(docs: DataFrame, model: Model, host: Column, path: Column, threshold: float = THRESHOLD, text_col: str = "text", out_col: str = "judgement") -> DataFrame:
    """docs with out_col, a struct of p_doc, host_rate, path_rate, posterior and kept; a column of that name is replaced.

    Texts are scored twice, once for the site rates and once for the result, so that no text is shuffled: the rates of
    few sites are broadcast; more are joined by shuffle.
    """
    bounded_batches(docs.sparkSession)
    me, at = free_names([*docs.columns, out_col], "me", "site")
    site = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))]
    rows = docs.withColumn(me, F.struct(*site, own_probability(model, F.col(text_col)).alias("p")))
    sites, prior = site_rates(rows.select(f"{me}.*"))
    flat = [f"{at}_{c}" for c in sites.columns]
    out = rows.join(small(sites.toDF(*flat)), (F.col(f"{me}.host") == F.col(f"{at}_host")) & (F.col(f"{me}.path") == F.col(f"{at}_path")))
    p, held = F.col(f"{me}.p"), lambda c: F.least(F.lit(1 - FLOOR), F.greatest(F.lit(FLOOR), c))
    host_rate = held((F.col(f"{at}_host_s") - p + prior.host_strength * prior.rate) / (F.col(f"{at}_host_n") - 1 + prior.host_strength))
    path_rate = held((F.col(f"{at}_s") - p + prior.path_strength * host_rate) / (F.col(f"{at}_n") - 1 + prior.path_strength))
    odds = _odds(p) * _odds(path_rate) / (prior.rate / (1 - prior.rate))
    posterior = odds / (1 + odds)
    kept = posterior >= threshold if model.fitted else F.lit(True)
    told = F.struct(p.alias("p_doc"), host_rate.alias("host_rate"), path_rate.alias("path_rate"), posterior.alias("posterior"), kept.alias("kept"))
    return out.withColumn(out_col, told).drop(me, *flat)


def accepted(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose posterior reaches the threshold, with the columns of docs."""
    (told,) = free_names(docs.columns, "told")
    return judged(docs, train(docs, labels), host, path, threshold, out_col=told).where(F.col(f"{told}.kept")).drop(told)
