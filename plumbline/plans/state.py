"""Storing what was fitted: transforms, profiles, forests and models, so that a later run or stream can go on with them.

A fitted object of this library is a handful of numbers; it is stored as one JSON text. Models of MLlib are stored
by MLlib itself. A stored path holds one object, and storing again replaces it.
"""

from __future__ import annotations

import dataclasses
import json
from typing import Any

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from plumbline.operators.anomaly import IsolationForest, ReferenceProfile
from plumbline.operators.features import Components, FeatureTransform, Imputer, Scaler
from plumbline.operators.boosting import BoostedTrees
from plumbline.operators.forest import Forest
from plumbline.operators.kernels import KernelMachine
from plumbline.operators.models import NearestModel
from plumbline.session import small_table

KINDS = {c.__name__: c for c in (Imputer, Scaler, Components, FeatureTransform, ReferenceProfile, IsolationForest, KernelMachine, BoostedTrees, Forest)}


def _plain(value: Any) -> Any:
    if dataclasses.is_dataclass(value):
        fields = {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
        return {"kind": type(value).__name__, "fields": fields}
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "dtype": value.dtype.str}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (tuple, list)):
        return {"tuple": [_plain(v) for v in value]}
    if isinstance(value, dict):
        return {"map": [[k, _plain(v)] for k, v in value.items()]}
    return value


def _object(value: Any) -> Any:
    if not isinstance(value, dict):
        return value
    if "kind" in value:
        return KINDS[value["kind"]](**{k: _object(v) for k, v in value["fields"].items()})
    if "array" in value:
        return np.array(value["array"], dtype=value["dtype"])
    if "tuple" in value:
        return tuple(_object(v) for v in value["tuple"])
    return {k: _object(v) for k, v in value["map"]}


def save_state(spark: SparkSession, fitted: object, path: str) -> None:
    """Store a fitted object of this library."""
    if type(fitted).__name__ not in KINDS:
        raise TypeError(f"cannot store a {type(fitted).__name__}; known: {', '.join(KINDS)}")
    small_table(spark, [(json.dumps(_plain(fitted)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> Any:
    """The stored object, equal to the one that was stored."""
    return _object(json.loads(spark.read.text(path, wholetext=True).first()["value"]))


def save_model(spark: SparkSession, model: Transformer | NearestModel | KernelMachine | BoostedTrees | Forest, path: str) -> None:
    """Store a model that ``models.fit`` gave."""
    if isinstance(model, NearestModel):
        _note(spark, path, {"kind": "nearest", "k": model.k, "classes": model.classes, "features": model.features})
        model.train.write.mode("overwrite").parquet(f"{path}/rows")
    elif isinstance(model, (KernelMachine, BoostedTrees, Forest)):
        _note(spark, path, {"kind": "arrays"})
        save_state(spark, model, f"{path}/arrays")
    else:
        _note(spark, path, {"kind": "single"})
        model.write().overwrite().save(f"{path}/model_0")


def _note(spark: SparkSession, path: str, note: dict[str, Any]) -> None:
    small_table(spark, [(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")


def load_model(spark: SparkSession, path: str) -> Any:
    """The stored model; it scores as the one that was stored."""
    note = json.loads(spark.read.text(f"{path}/note").first()["value"])
    if note["kind"] == "nearest":
        return NearestModel(spark.read.parquet(f"{path}/rows"), note["k"], note["classes"], note["features"])
    if note["kind"] == "arrays":
        return load_state(spark, f"{path}/arrays")
    return DefaultParamsReader.loadParamsInstance(f"{path}/model_0", spark)
