"""Sinks: raw tables, splits, logs, documents, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_raw(df: DataFrame, path: str) -> list[str]:
    """The features and ``target`` twice: the working table and the untouched snapshot of it."""
    places = [f"{path}/dataset.parquet", f"{path}/raw_dataset.parquet"]
    df.write.mode("overwrite").parquet(places[0])
    df.sparkSession.read.schema(df.schema).parquet(places[0]).write.mode("overwrite").parquet(places[1])
    return places


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so that reading one split does not touch the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def append_predictions(df: DataFrame, path: str) -> None:
    """Prediction-log records, one folder per day of the request."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def append_incidents(df: DataFrame, path: str) -> None:
    """Incident records as JSON lines."""
    df.write.mode("append").json(path)


def write_experiments(df: DataFrame, path: str) -> None:
    """Experiment documents as JSON lines, added to those already there."""
    df.write.mode("append").json(path)


def write_checksums(found: DataFrame, path: str) -> None:
    """Store a manifest (file, sha256)."""
    found.select("file", "sha256").write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A report table as JSON lines; reports have one row per metric."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)
