import threading
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.catalog import evaluation
from plumbline.operators import features as ft
from plumbline.operators import boosting, forest, kernels, models, neighbour_join
from plumbline.session import at_once


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    rows = [(i, *map(float, r), int(r[0] + r[1] > 0), int(np.digitize(r[0], [-0.5, 0.5])), float(3 * r[0] - 2 * r[1])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, target int, three int, price double")
    return ft.split_stratified(df, "target", ["id"]).persist()


COLS = ["a", "b", "c"]
SMALL = {
    "random_forest": {"trees": 10}, "gradient_boosting": {"rounds": 5, "depth": 3}, "xgboost": {"rounds": 5, "depth": 3}, "decision_tree": {"depth": 6},
    "random_forest_regressor": {"trees": 10}, "gradient_boosting_regressor": {"rounds": 15, "depth": 3}, "xgboost_regressor": {"rounds": 8, "depth": 3},
    "decision_tree_regressor": {"depth": 6},
}


@pytest.mark.parametrize("name", [n for n in models.FACTORIES if n not in models.REGRESSORS])
def test_classifiers_learn(spark, learnable, name):
    model = models.fit(learnable.filter("split = 'train'"), name, COLS, params=SMALL.get(name))
    scored = models.batch_score(learnable.filter("split = 'test'"), model, COLS, vector=True)
    (found,) = models.evaluate(scored, "target", "classification")
    assert found["accuracy"] > 0.8 and found["f1"] > 0.8


@pytest.mark.parametrize("name", models.REGRESSORS)
def test_regressors_learn(spark, learnable, name):
    model = models.fit(learnable.filter("split = 'train'"), name, COLS, "price", SMALL.get(name))
    scored = models.batch_score(learnable.filter("split = 'test'"), model, COLS)
    assert models.evaluate(scored, "price", "regression")[0]["r2"] > 0.6


@pytest.mark.parametrize("name", ["logistic_regression", "gradient_boosting", "svm", "knn"])
def test_three_classes(spark, learnable, name):
    model = models.fit(learnable, name, COLS, "three", SMALL.get(name))
    (found,) = models.evaluate(models.batch_score(learnable, model, COLS, vector=True), "three", "classification")
    assert found["accuracy"] > 0.7
    assert found["roc_auc"] > 0.8


def _grown(x, g, h, rows, depth, p, rate):
    """A tree by trying every value of every feature, as nested (feature, cut, left, right) or a leaf value."""
    leaf = -rate * g[rows].sum() / (h[rows].sum() + p["l2"])
    best = (1e-12, None)
    for f in range(x.shape[1]) if depth else ():
        for c in np.unique(x[rows, f]):
            left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
            if not len(right) or min(h[left].sum(), h[right].sum()) < p["min_child"]:
                continue
            gain = 0.5 * sum(s * g[r].sum() ** 2 / (h[r].sum() + p["l2"]) for s, r in ((1, left), (1, right), (-1, rows))) - p["gamma"]
            if gain > best[0] * (1 + 1e-9):
                best = (gain, (f, c, left, right))
    if best[1] is None:
        return leaf
    f, c, left, right = best[1]
    return f, c, _grown(x, g, h, left, depth - 1, p, rate), _grown(x, g, h, right, depth - 1, p, rate)


def _nested(model, t, k, node=0):
    f = model.feature[t, k, node]
    if f < 0:
        return pytest.approx(model.value[t, k, node])
    return f, pytest.approx(model.cut[t, k, node]), _nested(model, t, k, 2 * node + 1), _nested(model, t, k, 2 * node + 2)


@pytest.mark.parametrize("kind, classes", [("squared", 0), ("binary", 2), ("softmax", 3)])
def test_boosted_trees_are_those_of_exhaustive_search(spark, rng, kind, classes):
    x = rng.integers(0, 12, (50, 3)).astype(float)
    score = x[:, 0] - x[:, 1] + rng.normal(size=50)
    y = score if not classes else (score > 0).astype(float) if classes == 2 else np.digitize(score, [-3, 3]).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, target double").repartition(3)
    p = {"rounds": 13, "depth": 3, "rate": 0.3, "min_child": 0.5}
    model = models.fit(df, "gradient_boosting" if classes else "gradient_boosting_regressor", COLS, "target", p, imbalance=0.0)
    p |= {"l2": 1.0, "gamma": 0.0}
    assert model.kind == kind and (np.diff(model.losses) < 0).all()
    margin = np.tile(model.base, (50, 1))
    for t in range(len(model.feature)):
        g, h, loss = boosting.derivatives(kind, margin, y, np.ones(50))
        assert loss / 50 == pytest.approx(model.losses[t])
        for k in range(len(model.base)):
            assert _grown(x, g[:, k], h[:, k], np.arange(50), 3, p, 0.3) == _nested(model, t, k)
        margin = model.base + replace(model, feature=model.feature[: t + 1], cut=model.cut[: t + 1], value=model.value[: t + 1]).margins(x)
    scored = models.batch_score(df, model, COLS, vector=True).collect()
    want = margin[:, 0] if not classes else margin[:, 0] > 0 if classes == 2 else margin.argmax(1)
    assert sorted(r["prediction"] for r in scored) == pytest.approx(sorted(map(float, want)))


@pytest.mark.parametrize("name, label", [("gradient_boosting", "target"), ("gradient_boosting_regressor", "price")])
def test_boosting_passes_do_not_grow_with_rows_of_the_same_bins(spark, rng, monkeypatch, name, label):
    x = rng.integers(0, 6, (3000, 2)).astype(float) + 0.0
    rows = [(*map(float, r), int(r[0] > r[1]), float(r[0] + rng.normal())) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, target int, price double").repartition(3)
    held = []
    monkeypatch.setattr(boosting.BoostedFit, "_blocks", lambda self, cells, n, base, f=boosting.BoostedFit._blocks: held.append(n) or f(self, cells, n, base))
    model = models.fit(df, name, ["a", "b"], label, {"rounds": 2, "depth": 2, "rate": 1.0, "l2": 0.0}, imbalance=0.0)
    assert held == [36]  # labels are told by the cell, or are averaged in it
    if label == "price":
        y = np.array([r[3] for r in rows])
        assert model.losses[0] == pytest.approx(((y - y.mean()) ** 2).mean() / 2)
        left = y - model.base - replace(model, feature=model.feature[:1], cut=model.cut[:1], value=model.value[:1]).margins(x)[:, 0]
        assert model.losses[1] == pytest.approx((left**2).mean() / 2)


def _forest_tree(x, y, times, rows, depth, least, classes):
    """A tree of drawn rows by trying every value of every feature, as nested (feature, cut, left, right) or leaf values."""

    def short(r):
        sums = np.bincount(y[r].astype(int), times[r], classes) if classes else (times[r] * y[r]).sum()
        return (np.square(sums).sum() / times[r].sum()) if times[r].sum() else 0.0

    weight = times[rows].sum()
    leaf = np.bincount(y[rows].astype(int), times[rows], classes) / weight if classes else [(times[rows] * y[rows]).sum() / weight]
    best = (1e-9, None)
    for f in range(x.shape[1]) if depth else ():
        for c in np.unique(x[rows, f]):
            left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
            if min(times[left].sum(), times[right].sum()) < least:
                continue
            gain = short(left) + short(right) - short(rows)
            if gain > best[0] * (1 + 1e-9):
                best = (gain, (f, c, left, right))
    if best[1] is None:
        return pytest.approx(list(leaf))
    f, c, left, right = best[1]
    return f, c, _forest_tree(x, y, times, left, depth - 1, least, classes), _forest_tree(x, y, times, right, depth - 1, least, classes)


def _forest_nested(model, node=0):
    if model.left[node] < 0:
        return model.value[node].tolist()
    return model.feature[node], model.cut[node], _forest_nested(model, model.left[node]), _forest_nested(model, model.left[node] + 1)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_a_forest_tree_is_that_of_exhaustive_search_on_its_draw(spark, rng, classes):
    x = np.array([(a, b, c) for a in range(6) for b in range(5) for c in range(3)], float)  # in the order of their cells
    score = x[:, 0] - x[:, 1] + rng.normal(size=len(x))
    y = score if not classes else np.digitize(score, [0.0] if classes == 2 else [-2.0, 2.0]).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, target double").repartition(3)
    p = {"trees": 1, "depth": 4, "min_split": 5}
    model = models.fit(df, "random_forest" if classes else "random_forest_regressor", COLS, "target", p, imbalance=0.0)
    times, _ = forest.drawn(42, 0, 0, np.ones(len(x)), None, None)
    labels = y if classes else y - y.mean()
    want = _forest_tree(x, labels, times, np.arange(len(x)), 4, 2, classes)
    if not classes:  # the model's means are those of the labels themselves
        model = replace(model, value=model.value - y.mean())
    assert _forest_nested(model) == want
    again = models.fit(df.repartition(2), "random_forest" if classes else "random_forest_regressor", COLS, "target", p, imbalance=0.0)
    assert again.left.tolist() == model.left.tolist() and again.cut.tolist() == model.cut.tolist()


@pytest.mark.parametrize("name, label", [("random_forest", "target"), ("random_forest_regressor", "price")])
def test_forest_passes_do_not_grow_with_rows_of_the_same_bins(spark, rng, monkeypatch, name, label):
    x = rng.integers(0, 6, (6000, 2)).astype(float)
    rows = [(*map(float, r), int(r[0] > r[1]), float(r[0] // 3)) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, target int, price double").repartition(3)
    held = []
    monkeypatch.setattr(forest.ForestFit, "_blocks", lambda self, cells, f=forest.ForestFit._blocks: held.append(cells.agg(F.count("n"), F.sum("n")).first()) or f(self, cells))
    model = models.fit(df, name, ["a", "b"], label, {"trees": 12}, imbalance=0.0)
    assert [tuple(h) for h in held] == [(36, 6000)]
    scored = models.batch_score(df, model, ["a", "b"]).select(label, "prediction").collect()
    assert np.mean([abs(r[0] - r[1]) for r in scored]) < 0.1
    assert model.trees == 12 and len({model.value[t, 0] for t in range(12)}) > 1


@pytest.mark.parametrize("name, label", [("random_forest", "three"), ("random_forest_regressor", "price")])
def test_rows_between_the_same_cuts_walk_the_trees_once(learnable, rng, monkeypatch, name, label):
    model = models.fit(learnable, name, COLS, label, {"trees": 4, "depth": 2}, imbalance=0.0)
    grid = np.unique(model.cut[model.left >= 0])
    x = np.concatenate([rng.normal(size=(3000, 3)), rng.choice(grid, (300, 3)), [[np.nan, -np.inf, np.inf], [0.0, -0.0, np.nan]]])
    tables = [x[:100], x[:0], x[100:]]
    want = [model.votes(t) for t in tables]
    walked = []
    monkeypatch.setattr(forest.Forest, "votes", lambda self, x, f=forest.Forest.votes: walked.append(len(x)) or f(self, x))
    cells = len({r.tobytes() for r in want[0]} | {r.tobytes() for r in want[2]})
    for most in (10**6, 1):
        monkeypatch.setattr(forest, "KNOWN_NUMBERS", most)
        walked.clear()
        for got, own in zip(model.votes_by_cell([*tables, tables[0]]), [*want, want[0]], strict=True):
            assert np.array_equal(got, own)
        assert len(walked) <= 2 if most > 1 else len(walked) == 3  # with room for them, the votes of all cells are kept
        assert cells <= sum(walked) < len(x) / 2
    alone = replace(model, left=np.full(len(model.left), -1))  # no tree has a split
    assert np.array_equal(next(alone.votes_by_cell([x])), alone.votes(x))


def test_draws_of_a_cell_are_those_of_its_rows(rng):
    y = rng.normal(size=40) + 3
    n, mean, squares = np.full(20_000, 40.0), np.full(20_000, y.mean()), np.full(20_000, ((y - y.mean()) ** 2).sum())
    times, sums = forest.drawn(7, 1, 2, n, mean, squares)
    rows = rng.poisson(1, (20_000, 40))
    for got, want in ((times, rows.sum(axis=1)), (sums, rows @ y)):
        assert got.mean() == pytest.approx(want.mean(), rel=0.01) and got.std() == pytest.approx(want.std(), rel=0.05)
    assert np.corrcoef(times, sums)[0, 1] == pytest.approx(np.corrcoef(rows.sum(axis=1), rows @ y)[0, 1], abs=0.02)
    alone, own = forest.drawn(7, 1, 2, np.ones(9), y[:9], np.zeros(9))
    assert own.tolist() == (alone * y[:9]).tolist() and not np.array_equal(alone, forest.drawn(7, 2, 2, np.ones(9), None, None)[0])


def test_forest_weights_blocks_and_passes(spark, learnable, monkeypatch):
    rare = learnable.filter("target = 0 OR id % 12 = 0")
    plain = models.fit(rare, "random_forest", COLS, params={"trees": 10, "depth": 3}, imbalance=0.0)
    weighted = models.fit(rare, "random_forest", COLS, params={"trees": 10, "depth": 3})
    assert weighted.value[:10, 1].mean() == pytest.approx(0.5, abs=0.15) and plain.value[:10, 1].mean() < 0.2
    monkeypatch.setattr(forest, "PASS_NUMBERS", 5000)  # a level in several passes
    parts = models.fit(rare, "random_forest", COLS, params={"trees": 10, "depth": 3})
    assert parts.left.tolist() == weighted.left.tolist() and parts.value == pytest.approx(weighted.value)
    monkeypatch.setattr(forest, "BLOCK_CELLS", 16)
    several = models.fit(learnable, "random_forest", COLS, params={"trees": 10})
    scored = models.batch_score(learnable, several, COLS, vector=True)
    assert models.evaluate(scored, "target", "classification")[0]["accuracy"] > 0.9


def test_forest_labels_are_checked(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, None)], "a double, target double")
    with pytest.raises(ValueError, match="1 labels are missing"):
        models.fit(df, "random_forest_regressor", ["a"])
    with pytest.raises(ValueError, match="no whole numbers"):
        models.fit(df.filter("a < 2"), "random_forest", ["a"])
    with pytest.raises(ValueError, match="no rows to fit"):
        models.fit(df.limit(0), "random_forest_regressor", ["a"])


@pytest.mark.parametrize("name, label", [("gradient_boosting", "three"), ("gradient_boosting_regressor", "price")])
def test_a_pass_grows_a_tree_if_one_block_has_all_cells(learnable, monkeypatch, name, label):
    passes = []
    monkeypatch.setattr(boosting.BoostedFit, "_sums", lambda *a, f=boosting.BoostedFit._sums: passes.append(1) or f(*a))
    one = models.fit(learnable, name, COLS, label, {"rounds": 3, "depth": 3})
    assert not passes
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    many = models.fit(learnable, name, COLS, label, {"rounds": 3, "depth": 3})
    assert len(passes) == 9
    assert one.feature.tolist() == many.feature.tolist() and one.cut.tolist() == many.cut.tolist()
    assert one.value == pytest.approx(many.value) and one.losses == pytest.approx(many.losses)


def test_derivatives_against_differences(rng):
    y, w = rng.integers(0, 3, 20).astype(float), rng.uniform(1, 2, 20)
    for kind, outputs in (("squared", 1), ("binary", 1), ("softmax", 3)):
        m, t = rng.normal(size=(20, outputs)), np.minimum(y, 1) if kind == "binary" else y
        g, h, _ = boosting.derivatives(kind, m, t, w)
        for k in range(outputs):
            up, down = m.copy(), m.copy()
            up[:, k] += 1e-5
            down[:, k] -= 1e-5
            slope = (boosting.derivatives(kind, up, t, w)[2] - boosting.derivatives(kind, down, t, w)[2]) / 2e-5
            assert g[:, k].sum() == pytest.approx(slope, rel=1e-5)
            bend = (boosting.derivatives(kind, up, t, w)[0] - boosting.derivatives(kind, down, t, w)[0])[:, k] / 2e-5
            assert h[:, k] == pytest.approx(bend * (2 if kind == "softmax" else 1), rel=1e-4, abs=1e-8)


def test_boosting_depth_is_checked(learnable):
    with pytest.raises(ValueError, match="depth is 13"):
        models.fit(learnable, "xgboost", COLS, params={"depth": 13})


def _rings(spark, rng, n=600):
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(np.arange(n) % 2, 1.0, 3.0) + rng.normal(size=n) * 0.3
    rows = [(i, float(r * np.cos(a)), float(r * np.sin(a)), i % 2, float(r * r)) for i, (a, r) in enumerate(zip(angle, radius))]
    return spark.createDataFrame(rows, "id int, a double, b double, target int, square double").repartition(3)


def test_kernel_separates_rings_that_a_line_cannot(spark, rng):
    train, test = _rings(spark, rng), _rings(spark, rng, 300)
    line = models.batch_score(test, models.fit(train, "logistic_regression", ["a", "b"]), ["a", "b"], vector=True)
    assert models.evaluate(line, "target", "classification")[0]["accuracy"] < 0.7
    scored = models.batch_score(test, models.fit(train, "svm", ["a", "b"]), ["a", "b"], vector=True).persist()
    (found,) = models.evaluate(scored, "target", "classification")
    assert found["accuracy"] >= 0.95 and found["roc_auc"] > 0.98
    p = [(r["probability"], r["target"]) for r in scored.collect()]
    assert abs(np.mean([a for a, _ in p]) - 0.5) < 0.05 and np.mean([(a - y) ** 2 for a, y in p]) < 0.05
    again = models.batch_score(test, models.fit(train, "svm", ["a", "b"]), ["a", "b"], vector=True)
    assert again.exceptAll(scored).count() == 0


def test_kernel_regression_follows_a_curve(spark, rng):
    train, test = _rings(spark, rng), _rings(spark, rng, 300)
    scored = models.batch_score(test, models.fit(train, "svm_regressor", ["a", "b"], "square"), ["a", "b"])
    assert models.evaluate(scored, "square", "regression")[0]["r2"] > 0.95


def test_newton_steps_reach_the_minimum(spark, rng):
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(t), 1.0) for r, t in zip(x, y)], "x array<double>, y double, w double").repartition(3)
    machine = kernels.KernelMachine(rng.normal(size=(2, 20)), rng.uniform(0, 6, 20), np.zeros((21, 1)), np.zeros(0), np.zeros(0), "features")
    z = machine.mapped(x)

    def slope(v, cost, target, epsilon):
        if epsilon is None:
            s = np.where(y == target, 1.0, -1.0)
            pull = -2 * cost * z.T @ (s * np.maximum(0, 1 - s * (z @ v)))
        else:
            r = y - z @ v
            pull = -2 * cost * z.T @ (np.sign(r) * np.maximum(0, np.abs(r) - epsilon))
        return np.append(v[:-1], 0) + pull

    for cost, target, epsilon in ((1.0, 1.0, None), (10.0, 0.0, None), (5.0, None, 0.1)):
        v = kernels.fit_weights(rows, machine, cost, target, epsilon)
        assert np.abs(slope(v, cost, target, epsilon)).max() < 1e-5 * (1 + cost)


@pytest.mark.parametrize("name, label", [("svm", "target"), ("svm_regressor", "square")])
def test_kernel_fits_start_near_their_end(spark, rng, monkeypatch, name, label):
    table = _rings(spark, rng, 4000)
    passes = []

    def counted(rows, run, f=kernels._sums):
        passes.append("few" not in str(rows._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]))
        return f(rows, run)

    monkeypatch.setattr(kernels, "_sums", counted)
    found = []
    for least in (10**9, 10):
        monkeypatch.setattr(kernels, "START_ROWS", least)
        passes.clear()
        found.append((models.fit(table, name, ["a", "b"], label), sum(passes)))
    (cold, many), (warm, less) = found
    assert np.abs(warm.weights - cold.weights).max() < 1e-6 * np.abs(cold.weights).max()
    assert warm.slopes == pytest.approx(cold.slopes, rel=1e-5) and less < many


def test_unknown_algorithm(learnable):
    with pytest.raises(ValueError, match="unknown algorithm 'xyz'"):
        models.fit(learnable, "xyz", COLS)


def test_imbalance_raises_the_rare_class(spark, learnable):
    rare = learnable.filter("target = 0 OR id % 12 = 0")
    plain = models.fit(rare, "logistic_regression", COLS, imbalance=0.0)
    weighted = models.fit(rare, "logistic_regression", COLS)
    count = [models.batch_score(rare, m, COLS).filter("prediction = 1").count() for m in (plain, weighted)]
    assert count[1] > count[0]


def test_scoring_with_threshold_and_without_model(spark, learnable):
    model = models.fit(learnable, "logistic_regression", COLS)
    low = models.batch_score(learnable, model, COLS, threshold=0.0)
    assert low.filter("prediction = 1").count() == low.count()
    row = models.batch_score(learnable, None, COLS).first()
    assert (row["prediction"], row["probability"], row["action_taken"]) == (0.0, 0.5, "heuristic_fallback")


def test_training_all_skips_what_fails(spark, learnable):
    results, fitted = models.train_all(learnable, ["logistic_regression", "no_such", "decision_tree"], COLS, params=SMALL)
    assert set(fitted) == {"logistic_regression", "decision_tree"}
    best = models.select_best(results).first()
    assert best["algorithm"] in fitted and best["metric"] == "test_f1"
    found = {(r["algorithm"], r["metric"]) for r in results.collect()}
    assert ("decision_tree", "baseline_test_f1") in found and ("logistic_regression", "optimal_threshold") in found
    assert ("decision_tree", "val_f1") in found and ("decision_tree", "training_time_sec") in found
    cells = [r["value"] for r in results.collect() if r["algorithm"] == "decision_tree" and r["metric"].startswith("confusion_")]
    assert sum(cells) == learnable.filter("split = 'test'").count()


def test_training_record_with_folds(spark, learnable):
    results, _ = models.train_all(learnable, ["logistic_regression"], COLS, keys=["id"], folds=3)
    found = {r["metric"]: r["value"] for r in results.collect()}
    assert found["cv_accuracy"] > 0.9 and found["val_roc_auc"] > 0.9


def test_folds_are_dealt_once_and_fitted_at_a_time(spark, learnable, monkeypatch):
    names, found, dealt, meet = ["logistic_regression", "decision_tree"], [], [], threading.Barrier(4)
    monkeypatch.setattr(models, "kfold_assign", lambda *a, f=models.kfold_assign: dealt.append(a) or f(*a))
    alone = models.fit
    for parallelism, fit in ((1, alone), (4, lambda *a: meet.wait(120) >= 0 and alone(*a))):  # four fits have to be under way
        monkeypatch.setattr(models, "fit", fit)
        results, fitted = models.train_all(learnable, names, COLS, params=SMALL, keys=["id"], folds=3, parallelism=parallelism)
        assert list(fitted) == names
        rows = results.filter("metric <> 'training_time_sec'").collect()
        found.append([(r["algorithm"], r["position"], r["metric"], pytest.approx(r["value"])) for r in rows])
    assert found[0] == found[1] and len(dealt) == 2
    assert {n for n, _, m, _ in found[1] if m == "cv_accuracy"} == set(names)


def test_calls_at_once_keep_their_order_and_their_errors(spark):
    meet = threading.Barrier(2)

    def rows(n):
        meet.wait(120)
        return spark.range(n).count()

    assert at_once(spark, [lambda: rows(5), lambda: rows(3)], 2) == [5, 3] and at_once(spark, [], 2) == []
    with pytest.raises(ZeroDivisionError):
        at_once(spark, [lambda: 1, lambda: 1 // 0], 2)


def test_cross_validation(spark, learnable):
    rows = models.cross_validate(learnable, "logistic_regression", COLS, ["id"], folds=3).collect()
    found = {r["metric"]: r["value"] for r in rows}
    assert found["cv_accuracy"] > 0.9 and found["cv_roc_auc"] > 0.95
    rows = models.cross_validate(learnable, "linear_regression", COLS, ["id"], "price", folds=3).collect()
    assert {r["metric"] for r in rows} == {"cv_rmse", "cv_mae", "cv_r2"}


def test_folds_of_repeated_keys_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i // 4, float(i % 7), float(i)) for i in range(80)]
    found = []
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "id int, a double, price double").coalesce(1)
        found.append(models.cross_validate(df, "linear_regression", ["a"], ["id"], "price", folds=3).collect())
    for a, b in zip(*found):
        assert a["metric"] == b["metric"] and a["value"] == pytest.approx(b["value"], rel=1e-9)


def test_classes_of_all_folds_are_counted_in_one_pass(learnable, monkeypatch):
    counted, given = [], []
    monkeypatch.setattr(models, "class_counts", lambda *a, f=models.class_counts: counted.append(1) or f(*a))
    monkeypatch.setattr(models, "_counts_without", lambda *a, f=models._counts_without: given.append((a[0], f(*a))) or given[-1][1])
    models.train_all(learnable, ["logistic_regression", "decision_tree"], COLS, keys=["id"], folds=3, params=SMALL)
    assert len(counted) == 2 and len(given) == 1
    folded, found = given[0]
    for k in range(3):
        assert found[k] == ft.class_counts(folded.filter(F.col("fold") != k))


def test_a_transform_is_fitted_on_kept_rows(spark, monkeypatch):
    levels = []
    monkeypatch.setattr(evaluation.FeatureTransform, "fit", staticmethod(lambda df, cols, f=ft.FeatureTransform.fit: levels.append(df) or (levels.append(df.is_cached) or f(df, cols))))
    df = spark.createDataFrame([(i, float(i), "train" if i < 8 else "test") for i in range(10)], "id int, a double, split string")
    got = evaluation._transformed(df, ["a"]).orderBy("id").collect()
    assert levels[1] and not levels[0].is_cached
    assert [r["a"] for r in got] == pytest.approx([(i - 3.5) / np.std(range(8)) for i in range(10)]) and got[9]["split"] == "test"


def test_first_algorithm_wins_ties(spark):
    rows = [("b", 1, "test_f1", 0.9), ("a", 0, "test_f1", 0.9), ("a", 0, "test_rmse", 2.0), ("b", 1, "test_rmse", 1.0)]
    df = spark.createDataFrame(rows, "algorithm string, position int, metric string, value double")
    assert models.select_best(df).first()["algorithm"] == "a"
    assert models.select_best(df, "rmse").first()["algorithm"] == "b"


@pytest.mark.parametrize("block_rows", [50_000, 37])
def test_neighbours_against_all_pairs(spark, rng, block_rows):
    x = np.round(rng.normal(size=(150, 4)), 1)
    x[100:] = x[0]  # a third of the rows are copies of one
    rows = [(i, r.tolist(), int(i % 3)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, y int")
    found = models.nearest(df, df, "id", "v", "y", 4, block_rows).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query"], r["distance"], r["id"])):
        got.setdefault(r["query"], []).append(r["id"])
    for i in range(150):
        d = ((x - x[i]) ** 2).sum(axis=1)
        assert got[i] == [int(j) for j in np.lexsort((np.arange(150), d))[:4]]


def _index(spark, x, k, block_rows):
    rows = [(i, r.tolist(), float(i)) for i, r in enumerate(x)]
    t = spark.createDataFrame(rows, "id bigint, x array<double>, y double")
    return neighbour_join.TrainIndex.fit(t, k, len(x), block_rows), t.select(F.col("id").alias("query"), "x")


def test_pivots_skip_most_pairs_of_clustered_rows(spark, rng):
    centres = rng.normal(size=(40, 8)) * 20
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))
    index, queries = _index(spark, x, 3, 100)
    found, visits = index.search(queries, len(x))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["distance"], r["id"])):
        got.setdefault(r["query"], []).append((r["id"], r["distance"]))
    for i in range(0, 4000, 37):
        d = ((x - x[i]) ** 2).sum(axis=1)
        best = np.lexsort((np.arange(4000), d))[:3]
        assert [g[0] for g in got[i]] == best.tolist() and [g[1] for g in got[i]] == pytest.approx(d[best].tolist())
    assert index.pairs(visits) < 0.25 * 4000**2


def test_train_rows_are_copied_for_their_own_visits_only(spark, rng, monkeypatch):
    monkeypatch.setattr(neighbour_join, "QUERY_ROWS", 100)
    centres = rng.normal(size=(40, 8)) * 20
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))
    index, queries = _index(spark, x, 3, 100)
    found, visits = index.search(queries, len(x))
    asked, held = index.facing(visits)
    paid = {(r["ring"], r["part"]): r["count"] for r in visits.groupBy("ring", "part").count().collect()}
    rows = {(r["ring"], r["part"]): r["count"] for r in index.rows.groupBy("ring", "part").count().collect()}
    assert held.count() == sum(-(-n // 100) * rows[at] for at, n in paid.items()) < 40 * 4000 / 4
    assert asked.count() == visits.count()
    assert found.groupBy("query").count().filter("count = 3").count() == 4000


@pytest.mark.parametrize("copies, width", [(1, 2), (1, 4), (40, 4), (1, 30)])
def test_rows_of_a_block_are_compared_by_leaves(rng, monkeypatch, copies, width):
    x = np.tile(np.round(rng.normal(size=(20_000 // copies, width)), 2), (copies, 1))
    q, ids = np.vstack([np.round(rng.normal(size=(3000, width)), 2), x[:1000]]), rng.permutation(len(x))
    q[7, 1] = np.nan
    compared = []
    monkeypatch.setattr(neighbour_join, "_rough", lambda a, b, *n, f=neighbour_join._rough: compared.append(len(a) * len(b)) or f(a, b, *n))
    limit = np.where(np.arange(len(q)) % 5, np.inf, 0.01)
    at, to, exact = neighbour_join.closest(q, x, ids, 3, limit)
    if width == 2:
        assert sum(compared) < 0.1 * len(q) * len(x)
    for i in range(0, len(q), 13):
        d = ((x - q[i]) ** 2).sum(axis=1)
        best = np.lexsort((ids, d))[:3]
        best = best[d[best] <= limit[i]]
        got = at == i
        if limit[i] < np.inf:
            got &= exact <= limit[i]
        assert to[got].tolist() == best.tolist() and exact[got] == pytest.approx(d[best])
    assert not (at == 7).any()


def test_missing_labels_have_no_vote(spark):
    train = spark.createDataFrame([(0.0, 0.0), (0.1, None), (0.2, 1.0), (9.0, 1.0), (9.1, None), (9.2, None), (9.3, None)], "a double, target double")
    near = models.fit(train, "knn", ["a"], params={"k": 3})
    scored = models.batch_score(spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 8.5)], "id int, a double"), near, ["a"])
    assert [(r["id"], r["prediction"], r["probability"]) for r in scored.orderBy("id").collect()] == [(1, 0.0, 0.5), (2, 0.0, 0.5), (3, 1.0, 1.0)]


def test_rings_of_equal_distances_have_parts(spark):
    angle = np.arange(600) / 600 * 2 * np.pi
    x = np.vstack([np.zeros((1, 2)), np.stack([np.cos(angle), np.sin(angle)], axis=1).round(12)])
    x[:, 0] += 5
    index, queries = _index(spark, x, 2, 20)
    assert max(r[0] for r in index.rows.groupBy("ring", "part").count().select("count").collect()) <= 120
    found, _ = index.search(queries, len(x))
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], set()).add(r["distance"])
    for i in range(0, 601, 29):
        d = np.sort(((x - x[i]) ** 2).sum(axis=1))[:2]
        assert sorted(got[i]) == pytest.approx(sorted(set(d.tolist())))


def test_neighbours_of_odd_tables(spark):
    schema = "id bigint, v array<double>, y int"
    train = spark.createDataFrame([(1, [0.0], 0), (2, None, 1), (None, [0.2], 1), (4, [9.0], 0), (5, [9.0], 1), (6, [9.0], 1)], schema)
    for block_rows in (50_000, 2):
        got = models.nearest(train, train, "id", "v", "y", 2, block_rows).collect()
        assert sorted((r["query"], r["id"]) for r in got) == [(1, 1), (1, 4), (4, 4), (4, 5), (5, 4), (5, 5), (6, 4), (6, 5)]
        assert models.nearest(train, train.limit(0), "id", "v", "y", 2, block_rows).count() == 0
        assert models.nearest(train.limit(0), train, "id", "v", "y", 2, block_rows).count() == 0


def test_votes_and_means(spark):
    train = spark.createDataFrame([(1, [0.0], 0), (2, [0.1], 1), (3, [0.2], 1), (4, [9.0], 0)], "id bigint, v array<float>, y int")
    query = spark.createDataFrame([(10, [0.1])], "id bigint, v array<float>")
    assert models.knn_classify(query, train, "id", "v", "y", 3).first()["prediction"] == 1.0
    assert models.knn_classify(query, train, "id", "v", "y", 4).first()["prediction"] == 0.0
    assert models.knn_regress(query, train, "id", "v", "y", 3).first()["prediction"] == pytest.approx(2 / 3)
    assert models.knn_regress(query, train, "id", "v", "y", 50).first()["prediction"] == pytest.approx(0.5)


def test_fold_column_is_not_needed(learnable):
    assert "fold" not in learnable.columns and learnable.filter(F.col("split") == "train").count() == 280
