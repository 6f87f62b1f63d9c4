"""Rotations learnt on a bounded sample: ITQ and OPQ."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from nearfield.operators.additive import lloyd, sample_matrix
from nearfield.operators.transforms import Linear, pca, random_rotation


def _procrustes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The orthogonal a for which x @ a.T is nearest to y."""
    u, _, v = np.linalg.svd(y.T @ x)
    return u @ v


def itq(rows: DataFrame, d_out: int | None = None, iterations: int = 50, seed: int = 1234) -> Linear:
    """Centre, optionally reduce by PCA, and rotate so that signs lose least."""
    x = sample_matrix(rows, seed=seed)
    first = pca(rows, d_out) if d_out and d_out < x.shape[1] else Linear(np.eye(x.shape[1]), -x.mean(0))
    y = x @ first.a.T + first.b
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)
    a = random_rotation(y.shape[1], y.shape[1], seed).a
    for _ in range(iterations):
        a = _procrustes(y, np.where(y @ a.T >= 0, 1.0, -1.0))
    return Linear(a @ first.a, a @ first.b)


def opq(rows: DataFrame, m: int, nbits: int = 8, iterations: int = 20, d_out: int | None = None, seed: int = 1234) -> Linear:
    """A rotation after which product quantization in m sub-spaces loses least: codebooks and rotation in turn."""
    x, rng = sample_matrix(rows, seed=seed), np.random.default_rng(seed)
    d = d_out or x.shape[1]
    if d % m:
        raise ValueError("m must divide the dimension")
    a = random_rotation(x.shape[1], d, seed).a
    for _ in range(iterations):
        y, near = x @ a.T, []
        for part in np.split(y, m, 1):
            c = lloyd(part, min(1 << nbits, len(x)), 4, rng)
            near.append(c[((c * c).sum(1)[None] - 2 * part @ c.T).argmin(1)])
        u, _, v = np.linalg.svd(np.concatenate(near, 1).T @ x, full_matrices=False)
        a = u @ v
    return Linear(a)
