import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics


def _scored(spark, labels, scores):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, scores)], "label int, score double")


def _auc(labels, scores):
    pos = [s for a, s in zip(labels, scores) if a == 1]
    neg = [s for a, s in zip(labels, scores) if a == 0]
    return np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])


def test_auc_against_all_pairs(spark, rng):
    labels = rng.integers(0, 2, 200)
    scores = np.where(rng.random(200) < 0.34, 0.5, np.round(rng.random(200) * 0.6 + labels * 0.3, 1))
    df = _scored(spark, labels, scores)
    want = _auc(labels, scores)
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    turned = df.withColumn("score", -F.col("score"))
    assert metrics.roc_auc(turned).first()["auc"] == pytest.approx(1 - want, abs=1e-12)


def test_single_class(spark):
    df = _scored(spark, [1, 1, 1], [0.1, 0.2, 0.3])
    assert metrics.roc_auc(df).first()["auc"] == 0.5
    assert metrics.optimal_threshold(df).first()["threshold"] == 0.5


def test_rates_are_zero_on_zero_division(spark):
    row = metrics.binary_metrics(_scored(spark, [0, 0], [0.1, 0.2])).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_threshold_maximises_f1(spark, rng):
    labels = rng.integers(0, 2, 300)
    scores = np.clip(np.round(labels * 0.3 + rng.random(300) * 0.7, 2), 0, 1)
    best = (-1.0, 0.0)
    for t in sorted(set(scores)):
        tp, fp = ((scores >= t) & (labels == 1)).sum(), ((scores >= t) & (labels == 0)).sum()
        p, r = tp / (tp + fp), tp / (labels == 1).sum()
        f = 2 * p * r / (p + r + 1e-10)
        best = (f, t) if f > best[0] else best
    row = metrics.optimal_threshold(_scored(spark, labels, scores)).first()
    assert row["threshold"] == pytest.approx(min(max(best[1], 0.05), 0.95)) and row["f1"] == pytest.approx(best[0])


def test_threshold_is_clipped(spark):
    assert metrics.optimal_threshold(_scored(spark, [0, 1], [0.5, 0.99])).first()["threshold"] == 0.95


def test_curve_ends_at_full_recall(spark):
    rows = metrics.pr_curve(_scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])).orderBy("threshold").collect()
    assert [(r["tp"], r["fp"]) for r in rows] == [(2, 2), (2, 1), (1, 1), (1, 0)]
    assert rows[0]["recall"] == 1.0 and rows[-1]["precision"] == 1.0


def test_weighted_metrics_and_grid(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    row = metrics.weighted_metrics(df).first()
    assert row["accuracy"] == 0.5 and row["recall"] == 0.5
    assert row["precision"] == pytest.approx((2 * 0.5 + 0.5 + 0) / 4)
    grid = metrics.confusion_matrix(df)
    assert grid.count() == 9 and grid.agg(F.sum("n")).first()[0] == 4


def test_one_vs_rest(spark, rng):
    labels = rng.integers(0, 3, 150)
    scores = rng.random((150, 3)) + np.eye(3)[labels] * 0.4
    rows = [(int(a), *map(float, s)) for a, s in zip(labels, scores)]
    df = spark.createDataFrame(rows, "label int, p0 double, p1 double, p2 double")
    each = [_auc((labels == c).astype(int), scores[:, c]) for c in range(3)]
    columns = {0: "p0", 1: "p1", 2: "p2"}
    got = metrics.roc_auc_ovr(df, columns).first()["auc"]
    assert got == pytest.approx(np.average(each, weights=np.bincount(labels)), abs=1e-12)
    assert metrics.roc_auc_ovr(df, columns, average="macro").first()["auc"] == pytest.approx(np.mean(each), abs=1e-12)


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "label double, prediction double")
    row = metrics.regression_metrics(df).first()
    assert row["mae"] == pytest.approx(0.5) and row["rmse"] == pytest.approx(np.sqrt(1.25 / 3))
    assert row["r2"] == pytest.approx(1 - 1.25 / (14 / 3))


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "latency_ms double")
    assert tuple(metrics.latency_percentiles(df).first()) == (50.0, 95.0, 99.0)
