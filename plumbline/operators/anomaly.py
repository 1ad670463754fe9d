"""Out-of-distribution rows: reference bounds and an isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import any_of, clip, col, present
from plumbline.plans.ranks import exact_quantiles
from plumbline.session import materialise, small_table

Z_LIMIT = 4.5
TREE_ROWS = 256


@dataclass(frozen=True)
class ReferenceProfile:
    """Per feature: mean, population std + 1e-8, and the range widened by three of those stds."""

    cols: tuple[str, ...]
    mean: dict[str, float]
    std: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str]) -> ReferenceProfile:
        row = df.agg(
            *[
                f(present(col(c))).alias(f"{name}{i}")
                for i, c in enumerate(cols)
                for name, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))
            ]
        ).first()
        known = [(i, c) for i, c in enumerate(cols) if row[f"m{i}"] is not None]
        std = {c: row[f"s{i}"] + 1e-8 for i, c in known}
        return ReferenceProfile(
            tuple(c for _, c in known),
            {c: row[f"m{i}"] for i, c in known},
            std,
            {c: row[f"lo{i}"] - 3 * std[c] for i, c in known},
            {c: row[f"hi{i}"] + 3 * std[c] for i, c in known},
        )

    def table(self, df: DataFrame) -> DataFrame:
        """(feature, mean, std, low, high)."""
        rows = [(c, self.mean[c], self.std[c], self.low[c], self.high[c]) for c in self.cols]
        return small_table(df.sparkSession, rows, "feature string, mean double, std double, low double, high double")

    def z(self, c: str) -> Column:
        return F.abs((present(col(c)) - F.lit(self.mean[c])) / F.lit(self.std[c]))

    def outside(self, c: str) -> Column:
        v = present(col(c))
        hit = (self.z(c) > Z_LIMIT) | (v < F.lit(self.low[c])) | (v > F.lit(self.high[c]))
        return F.coalesce(hit, F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds oob (any feature outside), oob_features, oob_count and max_z. A missing value is not outside."""
        names = F.filter(
            F.array(*[F.when(self.outside(c), F.lit(c)) for c in self.cols]), lambda x: x.isNotNull()
        )
        scores = [F.coalesce(self.z(c), F.lit(0.0)) for c in self.cols]
        out = df.withColumns(
            {
                "oob": any_of([self.outside(c) for c in self.cols]),
                "oob_features": names,
                "max_z": scores[0] if len(scores) == 1 else F.greatest(*scores),
            }
        )
        return out.withColumn("oob_count", F.size("oob_features").cast("bigint"))


def anomaly_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return ReferenceProfile.fit(df, cols).table(df)


def bounds_check(df: DataFrame, reference: DataFrame, cols: Sequence[str]) -> DataFrame:
    return ReferenceProfile.fit(reference, cols).apply(df)


# --------------------------------------------------------------------------- isolation forest

TREE_SCHEMA_NAMES = ["tree", "feature", "cut", "left", "right", "size"]
TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, size array<int>"


def _average_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma
    return np.where(n > 2, 2.0 * harmonic - 2.0 * (n - 1.0) / np.maximum(n, 1.0), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator) -> tuple[list[int], list[float], list[int], list[int], list[int]]:
    """One isolation tree over the rows of ``x`` as parallel node lists."""
    feature: list[int] = []
    cut: list[float] = []
    left: list[int] = []
    right: list[int] = []
    size: list[int] = []
    deepest = math.ceil(math.log2(max(2, len(x))))
    pending = [(np.arange(len(x)), 0, -1, False)]
    while pending:
        rows, depth, parent, is_right = pending.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        feature.append(-1)
        cut.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(len(rows))
        if depth >= deepest or len(rows) < 2:
            continue
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        at = float(rng.uniform(lo[f], hi[f]))
        goes_left = x[rows, f] <= at
        feature[node], cut[node] = f, at
        pending.append((rows[~goes_left], depth + 1, node, True))
        pending.append((rows[goes_left], depth + 1, node, False))
    return feature, cut, left, right, size


@dataclass(frozen=True)
class IsolationForest:
    """Trees over small row samples. The fitted state is ``trees`` x at most 511 nodes."""

    cols: tuple[str, ...]
    nodes: tuple[tuple[np.ndarray, ...], ...]
    rows_per_tree: int
    offset: float

    @staticmethod
    def fit(
        df: DataFrame,
        cols: Sequence[str],
        keys: Sequence[str],
        trees: int = 50,
        contamination: float = 0.05,
        seed: int = 42,
    ) -> IsolationForest:
        """Each tree is built in its own task from ``TREE_ROWS`` rows: the first in its own hash order of the
        keys. The same rule holds for any table; rows whose hash lies beyond a bound that far more rows
        pass are left out early, and the bound is moved if it ever leaves a tree too few.

        The offset is the ``contamination`` quantile of the scores of all fitted rows.
        """
        complete = df.select(*keys, *cols).dropna(subset=list(cols))
        n = complete.count()
        wanted = min(n, TREE_ROWS)
        share = 8.0 * TREE_ROWS / max(1, n)
        values = [col(c).cast("double").alias(c) for c in cols]
        own = F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))
        while True:
            # a tree's order: the positive part of a hash of (row, tree)
            ranks = F.transform(
                F.sequence(F.lit(0), F.lit(trees - 1)),
                lambda t: F.struct(t.alias("tree"), F.shiftrightunsigned(F.xxhash64(F.col("_row"), t), 1).alias("h")),
            )
            bound = F.lit(min((1 << 63) - 1, int(share * (1 << 63))))
            near = F.filter(ranks, lambda r: r["h"] <= bound)
            drawn = complete.select(own.alias("_row"), *values).select("*", F.explode(near).alias("_t"))
            drawn = drawn.select("_t.tree", "_t.h", "_row", *[col(c) for c in cols])
            order = Window.partitionBy("tree").orderBy("h", "_row")
            tagged = drawn.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= TREE_ROWS).drop("_n", "_row")
            tagged = materialise(tagged, "forest-sample")
            sizes = [r["count"] for r in tagged.groupBy("tree").count().collect()]
            if share >= 1 or len(sizes) == trees and min(sizes) >= wanted:
                break
            share *= 8
        names = list(cols)

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            x = pdf.sort_values(["h", *names])[names].to_numpy(dtype=float)
            return pd.DataFrame([[tree, *_grow(x, np.random.default_rng([seed, tree]))]], columns=TREE_SCHEMA_NAMES)

        # a tree's group has at most TREE_ROWS rows
        rows = tagged.groupBy("tree").applyInPandas(build, TREE_SCHEMA).orderBy("tree").collect()
        nodes = tuple(tuple(np.asarray(r[k]) for k in TREE_SCHEMA_NAMES[1:]) for r in rows)
        per_tree = max(int(n[4][0]) for n in nodes)
        unfitted = IsolationForest(tuple(cols), nodes, per_tree, 0.0)
        scores = unfitted.score(complete).select("decision").persist()
        try:
            ((offset,),) = exact_quantiles(scores, ["decision"], [contamination])
        finally:
            scores.unpersist()
        return IsolationForest(tuple(cols), nodes, per_tree, offset)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds decision (below 0 is an outlier) and outlier."""
        nodes, rows, offset = self.nodes, self.rows_per_tree, self.offset

        @F.pandas_udf("double")
        def decision(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            norm = len(nodes) * max(float(_average_depth(rows)), 1e-12)
            for columns in batches:
                x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                depth = np.zeros(len(x))
                for feature, cut, left, right, size in nodes:
                    at = np.zeros(len(x), dtype=np.int64)
                    level = np.zeros(len(x))
                    while True:
                        inner = feature[at] >= 0
                        if not inner.any():
                            break
                        i, node = np.flatnonzero(inner), at[inner]
                        goes_left = x[i, feature[node]] <= cut[node]
                        at[i] = np.where(goes_left, left[node], right[node])
                        level[i] += 1
                    depth += level + _average_depth(size[at])
                yield pd.Series(-np.power(2.0, -depth / norm) - offset)

        scored = df.withColumn("decision", decision(*[present(col(c)) for c in self.cols]))
        return scored.withColumn("outlier", F.col("decision") < 0)


def anomaly_rows(df: DataFrame, profile: ReferenceProfile, forest: IsolationForest) -> DataFrame:
    """Per row: bounds and forest verdicts, and an anomaly flag of its own."""
    out = forest.score(profile.apply(df))
    return out.withColumn("is_anomaly", F.col("outlier") | (F.col("oob_count") > len(profile.cols) // 3))


def anomaly_report(rows: DataFrame, batch: str, cols: Sequence[str]) -> DataFrame:
    """Per batch: forest flag, features outside in any row, score clip(0.5 - mean decision), max z, verdict.

    Which features occur is one boolean per feature, so the state of a batch does not grow with it.
    """
    flagged = rows.groupBy(col(batch).alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_or("outlier").alias("isolation_forest_flag"),
        F.avg("decision").alias("decision_score"),
        F.max("max_z").alias("max_z_score"),
        *[F.bool_or(F.array_contains("oob_features", c)).alias(f"f{i}") for i, c in enumerate(cols)],
    )
    hit = [F.when(F.col(f"f{i}"), F.lit(c)) for i, c in enumerate(cols)]
    count = F.size("out_of_bounds_features").cast("bigint")
    return flagged.select(
        "batch",
        "rows",
        "isolation_forest_flag",
        "decision_score",
        "max_z_score",
        F.filter(F.array(*hit), lambda x: x.isNotNull()).alias("out_of_bounds_features"),
    ).withColumns(
        {
            "oob_count": count,
            "anomaly_score": clip(0.5 - F.col("decision_score"), 0.0, 1.0),
            "is_anomaly": F.col("isolation_forest_flag") | (count > len(cols) // 3),
        }
    )
