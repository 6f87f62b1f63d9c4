"""Trained models as Parquet tables of named arrays: one row per field, readable by any executor."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

from nearfield.operators import additive, codecs, coded_lists, sphere, transforms
from nearfield.plans import spec

#: What a table may name; nothing else is ever built from one.
KINDS = {c.__name__: c for c in (codecs.ScalarQuantizer, codecs.ProductQuantizer, codecs.SignHash, additive.AdditiveQuantizer, sphere.SphereCodec, sphere.SignMagnitude,
                                 transforms.Linear, transforms.Center, transforms.Remap, transforms.Normalize, transforms.Chain, transforms.Hadamard, coded_lists.ProductCells, spec.Spec, spec.Step, spec.BinarySpec)}
_SCHEMA = "name string, kind string, shape array<int>, numbers array<double>"


def _rows(name: str, v: Any) -> list[tuple]:
    if isinstance(v, np.ndarray):
        return [(name, "array", list(v.shape), [float(x) for x in v.ravel()])]
    if is_dataclass(v):
        if type(v).__name__ not in KINDS:
            raise ValueError(f"not a model: {type(v).__name__}")
        out = [(name, f"model {type(v).__name__}", None, None)]
        for f in fields(v):
            out += _rows(f"{name}/{f.name}", getattr(v, f.name))
        return out
    if isinstance(v, tuple) and v and not isinstance(v[0], (int, float, str)):
        return [(name, "tuple", [len(v)], None), *(r for i, x in enumerate(v) for r in _rows(f"{name}/{i}", x))]
    return [(name, f"json {json.dumps(v)}", None, None)]


def write(spark: SparkSession, path: str, model: Any) -> None:
    """A model of one of KINDS; nested ones too."""
    spark.createDataFrame(_rows("", model), _SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> Any:
    got = {r["name"]: r for r in spark.read.parquet(path).collect()}  # a row per field

    def made(name: str) -> Any:
        r = got[name]
        kind, _, rest = r["kind"].partition(" ")
        if kind == "array":
            return np.array(r["numbers"], np.float64).reshape(r["shape"])
        if kind == "tuple":
            return tuple(made(f"{name}/{i}") for i in range(r["shape"][0]))
        if kind == "model":
            cls = KINDS[rest]
            return cls(**{f.name: made(f"{name}/{f.name}") for f in fields(cls)})
        value = json.loads(rest)
        return tuple(value) if isinstance(value, list) else value

    return made("")
