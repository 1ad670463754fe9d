"""Principal components of wide vectors, without a matrix of all pairs of dimensions anywhere.

A randomised range finder: a random set of a few directions is multiplied by the centred table and its transpose a few times, which turns it
towards the leading components. On that small basis the table is tall and skinny; its QR factors are found per task and
merged, and the small triangle gives components and variances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import col
from plumbline.session import materialise

#: Directions beyond the wanted ones, which make the leading ones accurate.
EXTRA = 10
#: Numbers of one batch of rows in a task.
CELLS = 4_000_000
#: Triangles that one task merges.
FAN_IN = 64


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _pieces(batches: Iterator[pa.RecordBatch], width: int, mean: np.ndarray) -> Iterator[np.ndarray]:
    """Centred rows, a bounded number at a time."""
    step = max(1, CELLS // width)
    for batch in batches:
        for s in range(0, batch.num_rows, step):
            yield _matrix(batch.slice(s, step), width) - mean


@dataclass(frozen=True)
class WideComponents:
    """``loadings`` (k, width) are unit rows, each with its largest entry positive; ``explained`` their shares of the whole variance."""

    mean: np.ndarray
    loadings: np.ndarray
    explained: np.ndarray
    n: int

    @staticmethod
    def fit(df: DataFrame, vector: str, k: int, rounds: int = 3, seed: int = 7) -> WideComponents:
        """Components of an array column. ``rounds`` are multiplications by the covariance; each is one pass.

        Rows without vector, with missing or infinite entries, or of another than the most frequent length take no part. What reaches the
        driver has as many numbers as the vectors times ``k`` + ``EXTRA``.
        """
        x = F.transform(col(vector), lambda v: v.cast("double"))
        fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        rows = df.select(x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0)).filter(fine)
        widths = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
        if widths is None:
            raise ValueError("no complete vectors to fit")
        width = widths["w"]
        rows = rows.filter(F.size("x") == width)
        k = min(k, width)
        size = min(width, k + EXTRA)

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums, squares = 0, np.zeros(width), 0.0
            for part in _pieces(batches, width, np.zeros(width)):
                n, sums, squares = n + len(part), sums + part.sum(axis=0), squares + float((part * part).sum())
            if n:
                values = np.append(sums, [n, squares])
                yield pa.RecordBatch.from_pydict({"i": pa.array(range(width + 2), pa.int32()), "v": values})

        found = np.zeros(width + 2)
        for i, v in rows.mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
            found[i] = v
        n = int(found[width])
        mean = found[:width] / n

        def turned(basis: np.ndarray) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros((width, size))
                for part in _pieces(batches, width, mean):
                    out += part.T @ (part @ basis)
                yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32())} | {f"c{j}": np.ascontiguousarray(out[:, j]) for j in range(size)})

            names = [f"c{j}" for j in range(size)]
            summed = rows.mapInArrow(run, ", ".join(["i int", *[f"{c} double" for c in names]])).groupBy("i").agg(*[F.sum(c) for c in names])
            table = summed.orderBy("i").toArrow()
            return np.column_stack([table.column(j + 1).to_numpy() for j in range(size)])

        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
        for _ in range(max(1, rounds)):
            basis = np.linalg.qr(turned(basis))[0]
        _, s, v = np.linalg.svd(_triangle(rows, width, mean, basis))
        loadings = (basis @ v.T[:, :k]).T
        top = loadings[np.arange(k), np.abs(loadings).argmax(axis=1)]
        loadings = loadings * np.where(top < 0, -1.0, 1.0)[:, None]
        spread = np.zeros(k)
        spread[: min(k, len(s))] = s[:k] ** 2
        # the squared entries less those of the mean: all variance, of which nothing was projected
        whole = max(found[width + 1] - n * float(mean @ mean), 0.0)
        return WideComponents(mean, loadings, spread / whole if whole else spread, n)

    def transform(self, df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
        """Kept columns and pc_00, ...; null where the vector is missing, incomplete or of another length."""
        width, loadings, mean = len(self.mean), self.loadings, self.mean

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            out: list[np.ndarray | None] = [None] * len(rows)
            ok = [i for i, r in enumerate(rows) if r is not None and len(r) == width]
            if ok:
                x = np.stack([np.asarray(rows.iloc[i], float) for i in ok])
                for i, scores in zip(ok, (x - mean) @ loadings.T, strict=True):
                    out[i] = scores if np.isfinite(scores).all() else None
            return pd.Series(out, dtype=object)

        scored = df.select(*[col(c) for c in keep], project(F.transform(col(vector), lambda v: v.cast("double"))).alias("_p"))
        parts: list[Column] = [F.get("_p", F.lit(j)).alias(f"pc_{j:02d}") for j in range(len(loadings))]
        return scored.select(*[col(c) for c in keep], *parts)


def _triangle(rows: DataFrame, width: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """R of the QR factors of all centred rows on the basis: one triangle per task, merged ``FAN_IN`` at a time."""
    size = basis.shape[1]
    schema = "part long, r array<double>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for part in _pieces(batches, width, mean):
            r = np.linalg.qr(np.vstack([r, part @ basis]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int64()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.asarray(v, float).reshape(-1, size) for v in pdf["r"]]), mode="r")
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "r": [r.ravel().tolist()]})

    table = materialise(rows.mapInArrow(first, schema).withColumn("part", F.spark_partition_id().cast("long")), "triangles")
    while (count := table.agg(F.max("part")).first()[0]) is not None and count > 0:
        table = materialise(table.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(merge, schema), "triangles")
    return np.asarray(table.first()["r"], float).reshape(-1, size)
