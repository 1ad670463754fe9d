"""Training, scoring and selection on distributed MLlib estimators, and exact nearest neighbours."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    LinearRegression,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import col, total
from plumbline.operators import metrics
from plumbline.operators.features import class_counts, kfold_assign, to_array, to_vector, weights_of, with_class_weights
from plumbline.operators.boosting import BoostedFit, BoostedTrees
from plumbline.operators.forest import Forest, ForestFit
from plumbline.operators.kernels import KernelFit
from plumbline.operators.neighbour_join import nearest, nearest_lists
from plumbline.session import at_once, materialise, small_table

log = logging.getLogger(__name__)

# The default hyper-parameters. Of boosting: penalty of leaf values, least curvature of a leaf, least gain.
BOOSTING = {"l2": 1.0, "min_child": 1.0, "gamma": 0.0}
DEFAULTS: dict[str, dict[str, float]] = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
    "random_forest": {"trees": 100, "depth": 10, "min_split": 5},
    "gradient_boosting": {"rounds": 100, "rate": 0.1, "depth": 5} | BOOSTING,
    "xgboost": {"rounds": 100, "rate": 0.3, "depth": 6} | BOOSTING,
    "decision_tree": {"depth": 30},
    "svm": {"C": 1.0, "gamma": 0.0, "size": 200},
    "knn": {"k": 5},
    "linear_regression": {},
    "random_forest_regressor": {"trees": 100, "depth": 10, "min_split": 5},
    "gradient_boosting_regressor": {"rounds": 100, "rate": 0.1, "depth": 5} | BOOSTING,
    "xgboost_regressor": {"rounds": 100, "rate": 0.3, "depth": 6} | BOOSTING,
    "decision_tree_regressor": {"depth": 30},
    "svm_regressor": {"C": 1.0, "gamma": 0.0, "size": 200, "epsilon": 0.1},
    "knn_regressor": {"k": 5},
}
#: Fitted on arrays of numbers; MLlib's and the other estimators take vectors.
ON_ARRAYS = [n for n in DEFAULTS if n.startswith(("random_forest", "gradient_boosting", "xgboost"))]
REGRESSORS = ("linear_regression", *[n for n in DEFAULTS if n.endswith("_regressor")])
#: Share of the smallest class below which rare classes are weighted.
IMBALANCE = 0.20
#: Fits of folds and algorithms that run at a time.
FITS_AT_ONCE = 4


@dataclass(frozen=True)
class Fit:
    """What an estimator factory needs to know about the train table."""

    n: int
    classes: int
    seed: int
    features: str = "features"
    label: str = "target"
    weight: str | None = None

    def common(self) -> dict[str, object]:
        out: dict[str, object] = {"featuresCol": self.features, "labelCol": self.label}
        return out | ({"weightCol": self.weight} if self.weight else {})


def _logistic(f: Fit, p: Mapping[str, float]) -> Estimator:
    # the penalty is on the mean loss, so 1 / C is divided by the row count
    return LogisticRegression(
        regParam=1.0 / (p["C"] * f.n), maxIter=int(p["max_iter"]), standardization=False, **f.common()
    )


def _forest(regression: bool) -> Callable[[Fit, Mapping[str, float]], Estimator]:
    return lambda f, p: ForestFit(f.label, f.features, f.weight, 0 if regression else f.classes, f.seed, p)


def _boosting(regression: bool) -> Callable[[Fit, Mapping[str, float]], Estimator]:
    return lambda f, p: BoostedFit(f.label, f.features, f.weight, 0 if regression else f.classes, p)


class NearestModel:
    """The k nearest train rows vote on a class, or give the mean label."""

    def __init__(self, train: DataFrame, k: int, classes: int, features: str) -> None:
        self.train, self.k, self.classes, self.features = train, k, classes, features

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows are written first. Equal vectors are searched and vote once, and their votes find back by the vector."""
        rows = materialise(df, "queries")
        x = vector_to_array(F.col(self.features))
        found = nearest_lists(rows.select(x.alias("_x")), self.train, "_key", "_x", "_y", self.k)
        known = F.filter(F.col("found.label"), lambda y: y.isNotNull())

        def mean(total: Column) -> Column:
            return F.when(F.size(known) > 0, total / F.size(known))

        if not self.classes:
            prediction = mean(F.aggregate(known, F.lit(0.0), lambda a, y: a + y))
            votes = found.select(F.col("x").alias("_of"), prediction.alias("prediction"))
        else:
            p = F.array(*[mean(F.size(F.filter(known, partial(_equal, c)))) for c in range(self.classes)])
            votes = found.select(F.col("x").alias("_of"), p.alias("_p")).select(
                "_of", array_to_vector("_p").alias("probability"), (F.array_position("_p", F.array_max("_p")) - 1).cast("double").alias("prediction")
            )
        same = (F.xxhash64("_x") == F.xxhash64("_of")) & (F.col("_x") == F.col("_of"))  # numbers are sorted faster than vectors
        return rows.withColumn("_x", x).join(votes, same).drop("_x", "_of")


def _equal(value: float, column: Column) -> Column:
    return column == F.lit(float(value))


@dataclass(frozen=True)
class Nearest:
    """Keeps the train rows in a written table."""

    info: Fit
    k: int
    regression: bool

    def fit(self, table: DataFrame) -> NearestModel:
        rows = table.select(
            F.monotonically_increasing_id().alias("_key"),
            vector_to_array(F.col(self.info.features)).alias("_x"),
            F.col(self.info.label).alias("_y"),
        )
        classes = 0 if self.regression else self.info.classes
        return NearestModel(materialise(rows, "neighbours"), self.k, classes, self.info.features)


def _tree(cls: type) -> Callable[[Fit, Mapping[str, float]], Estimator]:
    return lambda f, p: cls(maxDepth=int(p["depth"]), seed=f.seed, **f.common())


FACTORIES: dict[str, Callable[[Fit, Mapping[str, float]], Estimator]] = {
    "logistic_regression": _logistic,
    "random_forest": _forest(False),
    "gradient_boosting": _boosting(False),
    "xgboost": _boosting(False),
    "decision_tree": _tree(DecisionTreeClassifier),
    "svm": lambda f, p: KernelFit(f.label, f.features, f.weight, f.classes, f.seed, p),
    "knn": lambda f, p: Nearest(f, int(p["k"]), False),
    "linear_regression": lambda f, p: LinearRegression(solver="normal", **f.common()),
    "random_forest_regressor": _forest(True),
    "gradient_boosting_regressor": _boosting(True),
    "xgboost_regressor": _boosting(True),
    "decision_tree_regressor": _tree(DecisionTreeRegressor),
    "svm_regressor": lambda f, p: KernelFit(f.label, f.features, f.weight, 0, f.seed, p),
    "knn_regressor": lambda f, p: Nearest(f, int(p["k"]), True),
}


def fit(
    train: DataFrame,
    algorithm: str,
    cols: Sequence[str],
    label: str = "target",
    params: Mapping[str, float] | None = None,
    seed: int = 42,
    imbalance: float = IMBALANCE,
    counts: Mapping[object, int] | None = None,
) -> Transformer:
    """Fit one algorithm on vectors of ``cols``. Rows of rare classes are weighted once, by the label
    counts of this table, if the smallest class share is below ``imbalance``. ``counts`` are its rows by class, if they are known."""
    if algorithm not in FACTORIES:
        raise ValueError(f"unknown algorithm '{algorithm}'; known: {', '.join(FACTORIES)}")
    table = train.select(*cols, col(label).cast("double").alias("target"))
    weight, classes, n = None, 0, 0
    if algorithm not in REGRESSORS:
        counts = class_counts(table, "target") if counts is None else counts
        # labels are codes from 0, and one that is not in these rows has a place all the same
        classes, n = max(len(counts), int(max(counts, default=0)) + 1), sum(counts.values())
        weights = weights_of(counts, imbalance)
        if any(w != 1.0 for w in weights.values()):
            table, weight = with_class_weights(table, weights), "weight"
    ready = (to_array if algorithm in ON_ARRAYS else to_vector)(table, cols)
    settings = DEFAULTS[algorithm] | dict(params or {})
    return FACTORIES[algorithm](Fit(n, classes, seed, weight=weight), settings).fit(ready)


def class_probability(scored: DataFrame) -> Column | None:
    """Probability of class 1, or null where the model gives none."""
    return vector_to_array(F.col("probability")).getItem(1) if "probability" in scored.columns else None


def batch_score(
    df: DataFrame,
    model: Transformer | None,
    cols: Sequence[str],
    threshold: float | None = None,
    vector: bool = False,
) -> DataFrame:
    """Adds prediction, probability and action_taken.

    Without a model: prediction 0, probability 0.5, ``heuristic_fallback``. With a threshold, the
    prediction of a two-class model is probability >= threshold. ``vector`` adds the probabilities of
    all classes as an array, if the model gives them.
    """
    if model is None:
        return df.withColumns(
            {
                "prediction": F.lit(0.0),
                "probability": F.lit(0.5),
                "action_taken": F.lit("heuristic_fallback"),
            }
        )
    scored = model.transform((to_array if isinstance(model, (BoostedTrees, Forest)) else to_vector)(df, cols))
    p = class_probability(scored)
    prediction = F.col("prediction")
    if threshold is not None and p is not None:
        prediction = (p >= threshold).cast("double")
    return scored.select(
        *[col(c) for c in df.columns],
        prediction.alias("prediction"),
        (p if p is not None else F.lit(None).cast("double")).alias("probability"),
        F.lit("inference_normal").alias("action_taken"),
        *([vector_to_array(F.col("probability")).alias("probabilities")] if vector and p is not None else []),
    )


Pairs = Sequence[tuple[float, float, int]]


def _rates(pairs: Pairs, binary: bool) -> dict[str, float]:
    """Accuracy, precision, recall, f1 from counted (label, prediction): of class 1, or support-weighted."""

    def share(a: float, b: float) -> float:
        return a / b if b else 0.0

    support: dict[float, int] = {}
    predicted: dict[float, int] = {}
    hits: dict[float, int] = {}
    for y, p, n in pairs:
        support[y] = support.get(y, 0) + n
        predicted[p] = predicted.get(p, 0) + n
        if y == p:
            hits[y] = hits.get(y, 0) + n
    n = sum(support.values())
    out = {"accuracy": share(sum(hits.values()), n), "precision": 0.0, "recall": 0.0, "f1": 0.0}
    for c, w in ([(1.0, n)] if binary else support.items()):
        h, s, p = hits.get(c, 0), support.get(c, 0), predicted.get(c, 0)
        for m, v in (("precision", share(h, p)), ("recall", share(h, s)), ("f1", share(2 * h, s + p))):
            out[m] += share(v * w, n)
    return out


def _counted(scored: DataFrame, label: str, thresholds: Sequence[float], by: str | None = None) -> list:
    """Counts of (group, label, prediction, verdict at each threshold): #classes^2 rows at most per group."""
    has_score = "probability" in scored.columns
    at = [(F.col("probability") >= t if has_score else F.lit(None)).cast("double") for t in thresholds]
    return (
        scored.groupBy(
            (col(by) if by else F.lit(0)).alias("g"),
            col(label).cast("double").alias("y"),
            F.col("prediction").cast("double").alias("p"),
            *[a.alias(f"t{i}") for i, a in enumerate(at)],
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )


def _at(rows: list, i: int, binary: bool) -> Pairs:
    """The counted pairs at threshold ``i``; a model without probabilities has its own predictions."""
    return [(r["y"], r[f"t{i}"] if binary and r[f"t{i}"] is not None else r["p"], r["n"]) for r in rows]


def _class_scores(classes: Sequence[float]) -> tuple[list[Column], dict[float, str]]:
    names = {c: f"p{int(c)}" for c in classes}
    return [F.get("probabilities", F.lit(int(c))).alias(n) for c, n in names.items()], names


def evaluate(scored: DataFrame, label: str, task: str, thresholds: Sequence[float] = (0.5,)) -> list[dict[str, float]]:
    """Metrics of a scored table (prediction and, if known, probability and probabilities), one record per
    threshold. All verdicts are counted in one pass."""
    if task == "regression":
        row = metrics.regression_metrics(scored, label).first()
        return [{m: row[m] for m in ("rmse", "mae", "r2")}] * len(thresholds)
    rows = _counted(scored, label, thresholds)
    classes = sorted({r["y"] for r in rows})
    binary = len(classes) <= 2
    auc = 0.5
    if "probabilities" in scored.columns and binary:
        auc = metrics.roc_auc(scored, label, "probability").first()["auc"]
    elif "probabilities" in scored.columns:
        columns, names = _class_scores(classes)
        auc = metrics.roc_auc_ovr(scored.select(label, *columns), names, label).first()["auc"]
    return [_rates(_at(rows, i, binary), binary) | {"roc_auc": auc} for i in range(len(thresholds))]


def cross_validate(
    train: DataFrame,
    algorithm: str,
    cols: Sequence[str],
    keys: Sequence[str],
    label: str = "target",
    folds: int = 5,
    params: Mapping[str, float] | None = None,
    seed: int = 42,
    parallelism: int = FITS_AT_ONCE,
) -> DataFrame:
    """(algorithm, metric, value): mean over the folds. Each fold is one fit, up to ``parallelism`` of them at a time; the folded table
    is kept, and the held-out rows of all folds are evaluated together. AUC of several classes is the macro form."""
    task = "regression" if algorithm in REGRESSORS else "classification"
    folded = _folded(train, cols, keys, label, folds, seed, task).persist()
    try:
        parts = at_once(
            train.sparkSession, [partial(_held_out, folded, k, algorithm, cols, label, params, seed) for k in range(folds)], parallelism
        )
    finally:
        folded.unpersist()
    found = [(algorithm, m, v) for m, v in _cross_validated(parts, label, task).items()]
    return small_table(train.sparkSession, found, "algorithm string, metric string, value double")


def _folded(train: DataFrame, cols: Sequence[str], keys: Sequence[str], label: str, folds: int, seed: int, task: str) -> DataFrame:
    """Features, label and fold of the rows; classes are dealt out evenly."""
    rows = train.select(*keys, *cols, label)
    dealt = kfold_assign(rows, keys, None if task == "regression" else label, folds, seed, [*cols, label])
    return dealt.select(*[col(c) for c in (*cols, label)], "fold")


def _counts_without(folded: DataFrame, label: str, folds: int) -> dict[int, dict[object, int]]:
    """For each fold, the rows of the others by class, of one pass."""
    found = folded.groupBy("fold", col(label).cast("double").alias("y")).count().filter("y is not null").collect()
    out: dict[int, dict[object, int]] = {k: {} for k in range(folds)}
    for fold, y, n in found:
        for k in range(folds):
            if k != fold:
                out[k][y] = out[k].get(y, 0) + n
    return out


def _held_out(
    folded: DataFrame, k: int, algorithm: str, cols: Sequence[str], label: str, params: Mapping[str, float] | None, seed: int,
    counts: Mapping[int, Mapping[object, int]] | None = None,
) -> DataFrame:
    """The rows of a fold, scored once by a model of the others and written; every metric reads them."""
    model = fit(folded.filter(F.col("fold") != k), algorithm, cols, label, params, seed, IMBALANCE, None if counts is None else counts[k])
    scored = batch_score(folded.filter(F.col("fold") == k), model, cols, vector=True)
    return materialise(scored.drop(*cols), "held-out")


def _cross_validated(parts: Sequence[DataFrame], label: str, task: str) -> dict[str, float]:
    """Means over the scored folds."""
    runs = _fold_metrics(reduce(DataFrame.unionByName, parts), label, task, len(parts))
    return {f"cv_{m}": float(np.mean([r[m] for r in runs])) for m in runs[0]}


def _fold_metrics(held: DataFrame, label: str, task: str, folds: int) -> list[dict[str, float]]:
    if task == "regression":
        return [evaluate(held.filter(F.col("fold") == k), label, task)[0] for k in range(folds)]
    rows = _counted(held, label, (0.5,), "fold")
    classes = sorted({r["y"] for r in rows})
    binary = len(classes) <= 2
    runs = [_rates(_at([r for r in rows if r["g"] == k], 0, binary), binary) for k in range(folds)]
    aucs = dict.fromkeys(range(folds), 0.5)
    if "probabilities" in held.columns and binary:
        per_fold = [F.when(F.col("fold") == k, F.col("probability")).alias(f"p{k}") for k in range(folds)]
        found = metrics.roc_auc_each(held.select(label, *per_fold), [f"p{k}" for k in range(folds)], label)
        aucs |= {int(r["feature"][1:]): r["auc"] for r in found.collect()}
    elif "probabilities" in held.columns:
        columns, names = _class_scores(classes)
        for k in range(folds):
            part = held.filter(F.col("fold") == k).select(label, *columns)
            aucs[k] = metrics.roc_auc_ovr(part, names, label, "macro").first()["auc"]
    return [r | {"roc_auc": aucs[k]} for k, r in enumerate(runs)]


def train_all(
    table: DataFrame,
    algorithms: Sequence[str],
    cols: Sequence[str],
    label: str = "target",
    split: str = "split",
    params: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = 42,
    keys: Sequence[str] = (),
    folds: int = 5,
    parallelism: int = FITS_AT_ONCE,
) -> tuple[DataFrame, dict[str, Transformer]]:
    """Fit every algorithm on the train rows, tune the threshold on validation, evaluate on test.

    Returns (algorithm, position, metric, value) and the models. Metrics have the prefix ``test_`` (at the
    tuned threshold), ``baseline_test_`` (at 0.5), ``val_`` and, if ``keys`` name a row so that folds can be
    dealt, ``cv_``. ``confusion_<label>_<prediction>`` counts test rows at the tuned threshold, and
    ``training_time_sec`` is the time of the fit, beside which others run unless ``parallelism``, the number of fits at a time,
    is 1. An algorithm that fails is logged and left out. Folds are dealt out once for all algorithms of a task.
    """
    spark, table = table.sparkSession, table.persist()
    names = list(algorithms)
    task_of = {n: "regression" if n in REGRESSORS else "classification" for n in names}
    own = params or {}
    rows: list[tuple[str, int, str, float]] = []
    models: dict[str, Transformer] = {}
    folded: dict[str, DataFrame | Exception] = {}
    counts: dict[str, dict[int, dict[object, int]]] = {}
    try:
        parts = {s: table.filter(col(split) == s) for s in ("train", "val", "test")}
        for task in dict.fromkeys(task_of.values()) if keys else ():
            dealt = _attempt(_folded, parts["train"], cols, keys, label, folds, seed, task)
            folded[task] = dealt.persist() if isinstance(dealt, DataFrame) else dealt
            if task == "classification" and isinstance(dealt, DataFrame):
                found = _attempt(_counts_without, dealt, label, folds)
                if isinstance(found, Exception):  # as the folds, they fail for every algorithm of the task
                    folded[task] = found
                    dealt.unpersist()
                else:
                    counts[task] = found
        calls = []
        for n in names:
            calls.append(partial(_attempt, _trained, parts, n, cols, label, own.get(n), seed, task_of[n]))
            if isinstance(folded.get(task_of[n]), DataFrame):
                calls += [partial(_attempt, _held_out, folded[task_of[n]], k, n, cols, label, own.get(n), seed, counts.get(task_of[n])) for k in range(folds)]
        done = iter(at_once(spark, calls, parallelism))
        outcomes = []
        for n in names:
            dealt = folded.get(task_of[n])
            held = [next(done) for _ in range(1 + (folds if isinstance(dealt, DataFrame) else 0))]
            outcomes.append([*held, *([dealt] if isinstance(dealt, Exception) else [])])
    finally:
        for dealt in (*folded.values(), table):
            if isinstance(dealt, DataFrame):
                dealt.unpersist()
    failed = [next((o for o in outcome if isinstance(o, Exception)), None) for outcome in outcomes]
    judged = [
        partial(_attempt, _cross_validated, outcome[1:], label, task_of[n]) if keys and not error else dict
        for n, outcome, error in zip(names, outcomes, failed, strict=True)
    ]
    for position, (n, outcome, error, cv) in enumerate(zip(names, outcomes, failed, at_once(spark, judged, parallelism), strict=True)):
        error = error or (cv if isinstance(cv, Exception) else None)
        if error:
            log.error("training %s failed: %s", n, error)
            continue
        models[n], found = outcome[0]
        rows += [(n, position, k, float(v)) for k, v in (found | cv).items()]
    schema = "algorithm string, position int, metric string, value double"
    return small_table(spark, rows, schema), models


def _attempt(call: Callable[..., object], *args: object) -> object:
    """What a call returns, or its error: one failing algorithm must not stop the others."""
    try:
        return call(*args)
    except Exception as exc:  # noqa: BLE001
        return exc


def _trained(
    parts: Mapping[str, DataFrame], name: str, cols: Sequence[str], label: str, params: Mapping[str, float] | None, seed: int, task: str
) -> tuple[Transformer, dict[str, float]]:
    """The model of the train rows, and its metrics on validation and test rows."""
    began = time.perf_counter()
    model = fit(parts["train"], name, cols, label, params, seed)
    took = time.perf_counter() - began
    threshold = 0.5
    held = _scored(parts["val"], model, cols, label)
    if task == "classification" and "probabilities" in held.columns:
        threshold = metrics.optimal_threshold(held, label, "probability").first()["threshold"]
    test = _scored(parts["test"], model, cols, label)
    tuned, base = evaluate(test, label, task, (threshold, 0.5))
    found = {f"test_{k}": v for k, v in tuned.items()} | {"optimal_threshold": threshold}
    found |= {f"baseline_test_{k}": v for k, v in base.items()}
    found |= {f"val_{k}": v for k, v in evaluate(held, label, task, (threshold,))[0].items()}
    found["training_time_sec"] = took
    if task == "classification":
        counted = _counted(test, label, (threshold,))
        binary = len({r["y"] for r in counted}) <= 2
        for y, p, n in _at(counted, 0, binary):
            cell = f"confusion_{int(y)}_{int(p)}"
            found[cell] = found.get(cell, 0) + n
    return model, found


def _scored(df: DataFrame, model: Transformer, cols: Sequence[str], label: str) -> DataFrame:
    """Label and scores as a written table, so that each metric reads numbers and none runs the model."""
    scored = batch_score(df.select(*cols, label), model, cols, vector=True)
    return materialise(scored.drop(*cols), "scored")


def select_best(results: DataFrame, metric: str = "f1", prefix: str = "test_") -> DataFrame:
    """One row (algorithm, metric, value): the best by one metric; the first algorithm wins ties."""
    sign = -1.0 if metric in ("rmse", "mae") else 1.0
    rank = F.struct((F.col("value") * sign).alias("v"), (-F.col("position")).alias("p"))
    best = results.filter(F.col("metric") == prefix + metric).agg(
        F.max_by(F.struct("algorithm", "metric", "value"), rank).alias("b")
    )
    return best.filter("b is not null").select("b.*")


# --------------------------------------------------------------------------- nearest neighbours


def knn_classify(
    queries: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 5
) -> DataFrame:
    """(query, prediction): majority label of the k nearest, the smallest label on ties."""
    votes = nearest(queries, train, key, vector, label, k).groupBy("query", "label").count()
    return votes.groupBy("query").agg(
        (-F.max(F.struct(F.col("count"), (-F.col("label")).alias("neg"))).getField("neg")).alias("prediction")
    )


def knn_regress(queries: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """(query, prediction): mean label of the k nearest."""
    return nearest(queries, train, key, vector, label, k).groupBy("query").agg(F.avg("label").alias("prediction"))
