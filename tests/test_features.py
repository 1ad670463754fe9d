import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import components
from plumbline.operators import features as ft
from plumbline.plans import ranks


def _labelled(spark, n=400, rare=0.05):
    return spark.range(n).select("id", F.when(F.col("id") < n * rare, 1).otherwise(0).alias("target"))


def test_stratified_split_is_exact_disjoint_and_whole(spark):
    df = _labelled(spark)
    out = ft.split_stratified(df, "target", ["id"])
    assert out.count() == 400 and out.select("id").distinct().count() == 400
    sizes = {(r["split"], r["target"]): r["count"] for r in out.groupBy("split", "target").count().collect()}
    assert sizes == {
        ("test", 0): 76, ("test", 1): 4, ("val", 0): 38, ("val", 1): 2, ("train", 0): 266, ("train", 1): 14,
    }
    again = ft.split_stratified(df.repartition(7), "target", ["id"])
    assert out.exceptAll(again).count() == 0
    other = ft.split_stratified(df, "target", ["id"], seed=1)
    assert out.exceptAll(other).count() > 0


def test_split_sizes_round_up():
    assert ft.split_sizes(11) == (3, 1)
    assert ft.allocate({"a": 3, "b": 3}, 1) == {"a": 0, "b": 1}


def test_stratified_split_of_tiny_classes(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aabbbc")], "id int, c string")
    out = ft.split_stratified(df, "c", ["id"])
    assert out.count() == 6 and out.filter("split = 'test'").count() == 2


def test_random_and_sequential_split(spark):
    df = spark.range(103)
    sizes = {r["split"]: r["count"] for r in ft.split_random(df, ["id"]).groupBy("split").count().collect()}
    assert sizes == {"test": 21, "val": 11, "train": 71}
    tied = df.select("id", F.when(F.col("id") < 60, 1.0).otherwise(2.0).alias("t"))
    out = ft.split_sequential(tied, ["t", "id"])
    assert out.filter("split = 'train'").agg(F.max("id"), F.count("*")).first() == (81, 82)
    stamps = df.select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), "id")
    assert ft.split_sequential(stamps, ["ts"]).filter("split = 'train'").agg(F.max("id")).first()[0] == 81


def test_folds_are_balanced_per_class(spark):
    out = ft.kfold_assign(_labelled(spark), ["id"], "target")
    sizes = [r["count"] for r in out.groupBy("fold", "target").count().collect()]
    assert sorted(sizes) == [4] * 5 + [76] * 5
    loose = ft.hash_folds(spark.range(2000), ["id"]).groupBy("fold").count().collect()
    assert len(loose) == 5 and all(300 < r["count"] < 500 for r in loose)


def test_folds_write_no_column_that_is_not_kept(spark, monkeypatch):
    rows = _labelled(spark).withColumn("x", F.col("id") * 2)
    whole = {r["x"]: r["fold"] for r in ft.kfold_assign(rows, ["id"], "target").collect()}
    written = []
    monkeypatch.setattr(ranks, "materialise", lambda df, label, f=ranks.materialise: written.append((label, df.columns)) or f(df, label))
    some = ft.kfold_assign(rows, ["id"], "target", keep=["x"])
    assert some.columns == ["x", "fold"] and {r["x"]: r["fold"] for r in some.collect()} == whole
    assert set(dict(written)["numbered"]) == {"target", "x", "_range", "_place"}


def test_arrays_hold_the_numbers_of_vectors(spark):
    df = spark.createDataFrame([(1, 2.5, True), (3, -1.0, False)], "a int, b double, c boolean")
    got = [r["v"] for r in ft.to_array(df, ["a", "b", "c"], "v").collect()]
    assert got == [r["v"].toArray().tolist() for r in ft.to_vector(df, ["a", "b", "c"], "v").collect()]
    nested = ft.to_vector(df, ["a", "b"], "w")
    assert ft.to_array(nested, ["w", "c"], "v").select(ft.as_array(ft.to_array(nested, ["w", "c"], "v"), "v")).first()[0] == [1.0, 2.5, 1.0]
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="column 'b' has missing values"):
            ft.to_array(spark.createDataFrame([(1, bad)], "a int, b double"), ["a", "b"]).collect()


def test_scalers_against_numpy(spark, rng):
    x = rng.normal(3, 2, 200)
    df = spark.createDataFrame([(float(v), 4.0) for v in x], "x double, c double")
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    want = {
        "standard": (x - x.mean()) / x.std(),
        "minmax": (x - x.min()) / (x.max() - x.min()),
        "robust": (x - q2) / (q3 - q1),
    }
    for method, expected in want.items():
        out = ft.Scaler.fit(df, ["x", "c"], method).transform(df).collect()
        np.testing.assert_allclose(sorted(r["x"] for r in out), np.sort(expected), atol=1e-9)
        assert {r["c"] for r in out} == {0.0}


def test_imputer_is_fitted_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,), (None,)], "x double")
    other = spark.createDataFrame([(None,), (float("nan"),), (100.0,)], "x double")
    for strategy, fill in (("mean", 3.75), ("median", 2.0), ("most_frequent", 2.0)):
        out = [r["x"] for r in ft.Imputer.fit(train, ["x"], strategy).transform(other).collect()]
        assert out == [fill, fill, 100.0]
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert ft.Imputer.fit(four, ["x"]).fill == {"x": 2.5}
    with pytest.raises(ValueError, match="unknown strategy"):
        ft.Imputer.fit(four, ["x"], "zero")


def test_components_are_centred_orthogonal_and_signed(spark, rng):
    base = rng.normal(size=(300, 2)) @ np.array([[3.0, 1.0], [0.5, -1.0]]) + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in base], "a double, b double")
    fitted = ft.Components.fit(df, ["a", "b"], 2)
    out = np.array(fitted.transform(df, []).collect())
    np.testing.assert_allclose(out.mean(axis=0), 0, atol=1e-9)
    assert abs(np.corrcoef(out.T)[0, 1]) < 1e-9
    assert all(max(w, key=abs) > 0 for w in fitted.loadings)
    want = np.linalg.eigvalsh(np.cov(base.T))[::-1]
    np.testing.assert_allclose(out.var(axis=0, ddof=1), want, rtol=1e-9)


def test_feature_transform_drops_empty_features_and_standardises_train(spark, rng):
    rows = [(float(v) if i % 4 else None, None) for i, v in enumerate(rng.normal(2, 3, 100))]
    df = spark.createDataFrame(rows, "x double, empty double")
    fitted = ft.FeatureTransform.fit(df, ["x", "empty"])
    assert fitted.cols == ("x",)
    stats = fitted.transform(df).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)


def test_class_weights_come_from_train(spark):
    train = spark.createDataFrame([(int(i < 5),) for i in range(100)], "target int")
    weights = ft.class_weights(train)
    assert weights == {1: 10.0, 0: pytest.approx(100 / 190)}
    even = spark.createDataFrame([(i % 2,) for i in range(10)], "target int")
    assert set(ft.class_weights(even).values()) == {1.0}
    out = ft.with_class_weights(spark.createDataFrame([(0,), (1,), (2,)], "target int"), weights).collect()
    assert [round(r["weight"], 4) for r in out] == [0.5263, 10.0, 1.0]
    assert math.isclose(sum(weights[r[0]] for r in train.collect()), 100)


def _vectors(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(3)


def test_wide_components_are_those_of_the_exact_form(spark, rng, monkeypatch):
    x = rng.normal(size=(300, 30)) * np.linspace(5, 0.5, 30) + 100
    names = [f"f{i}" for i in range(30)]
    table = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names))
    exact = ft.Components.fit(table, names, 4)
    monkeypatch.setattr(components, "FAN_IN", 2)
    monkeypatch.setattr(components, "CELLS", 300)
    wide = components.WideComponents.fit(_vectors(spark, x), "v", 4, rounds=12)
    assert wide.n == 300 and np.allclose(wide.loadings, exact.loadings, atol=1e-6) and np.allclose(wide.explained, exact.explained, atol=1e-9)
    got = wide.transform(_vectors(spark, x), "v", ["id"]).orderBy("id").toPandas()
    assert np.allclose(got.iloc[:, 1:], (x - x.mean(0)) @ np.array(exact.loadings).T, atol=1e-4)


def test_components_of_twenty_thousand_columns(spark, rng):
    left, right = np.linalg.qr(rng.normal(size=(120, 3)))[0], np.linalg.qr(rng.normal(size=(20_000, 3)))[0]
    x = left * [900, 500, 200] @ right.T + rng.normal(size=(120, 20_000)) * 0.05
    wide = components.WideComponents.fit(_vectors(spark, x), "v", 3)
    centred = x - x.mean(0)
    s, v = np.linalg.svd(centred, full_matrices=False)[1:]
    assert np.allclose(np.abs(np.sum(wide.loadings * v[:3], axis=1)), 1, atol=1e-8)
    assert np.allclose(wide.explained, s[:3] ** 2 / (centred**2).sum(), rtol=1e-6)


def test_wide_components_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0, 2.0]), (2, [3.0, 1.0, 2.0]), (3, None), (4, [1.0, None, 2.0]), (5, [1.0]), (6, [float("nan"), 0.0, 0.0]), (7, [5.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    wide = components.WideComponents.fit(df, "v", 9)
    assert wide.n == 3 and wide.loadings.shape == (3, 3) and wide.explained.sum() == pytest.approx(1)
    got = {r["id"]: r["pc_00"] for r in wide.transform(df, "v", ["id"]).collect()}
    assert [k for k, v in got.items() if v is None] == [3, 4, 5, 6] and got[1] == pytest.approx(-got[7], abs=0.5)
    with pytest.raises(ValueError, match="no complete vectors"):
        components.WideComponents.fit(df.limit(0), "v", 1)
