"""From a raw table to a stored model and its experiment document in one call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import col
from plumbline.operators import anomaly, experiments, gates, models, prep, quality
from plumbline.operators.features import FeatureTransform, split_random, split_stratified
from plumbline.operators.quality import Thresholds
from plumbline.plans.state import save_model, save_state
from plumbline.session import materialise, small_table
from plumbline.sources import writers

# The algorithms that are trained unless others are named.
CLASSIFIERS = ("logistic_regression", "random_forest", "gradient_boosting")
REGRESSORS = ("linear_regression", "random_forest_regressor", "gradient_boosting_regressor")


@dataclass(frozen=True)
class Outcome:
    """What a run made: where its state lies, the rows of each split, metrics, gate rows and the document."""

    path: str
    splits: DataFrame
    results: DataFrame
    gates: DataFrame
    experiment: DataFrame


class Rejected(ValueError):
    """The table breaks an acceptance rule; the message names the rules."""


def run_pipeline(
    raw: DataFrame,
    target: str,
    key: str,
    path: str,
    experiment_id: str,
    created_at: str,
    algorithms: Sequence[str] | None = None,
    params: Mapping[str, Mapping[str, float]] | None = None,
    task: str | None = None,
    limits: Thresholds = Thresholds(),
    folds: int = 0,
    seed: int = 42,
) -> Outcome:
    """Accept, clean, split, transform, train, select, gate and store.

    ``key`` identifies a row. The task is found from the target unless given. A table that breaks a rule raises
    ``Rejected`` before anything is written. Below ``path`` afterwards: splits, transform, profile, model and the
    experiment document. With ``folds`` every algorithm is cross-validated too.
    """
    spark = raw.sparkSession
    table = prep.select_target(raw, target)
    if task is None:
        task = prep.detect_task_type(table, ["target"]).first()["task"]
    table = prep.drop_null_target(table, check=False)
    table = prep.regression_target(table) if task == "regression" else prep.encode_labels(table)
    features = [c for c in table.columns if c not in (key, "target")]
    verdict = quality.rejection_rules(table, features, "target", task, limits).first()
    if not verdict["passed"]:
        raise Rejected(f"table rejected: {', '.join(verdict['reasons'])}")
    cleaned = quality.clean(table, features, "target", key, limits)
    work, cols = cleaned.table, prep.numeric_columns(cleaned.table, cleaned.features)
    parts = split_random(work, [key], seed) if task == "regression" else split_stratified(work, "target", [key], seed)
    parts = materialise(parts, "pipeline-splits")
    train = parts.filter("split = 'train'")
    transform = FeatureTransform.fit(train, cols)
    cols = list(transform.cols)
    ready = materialise(transform.transform(parts).select(key, "target", "split", *[col(c) for c in cols]), "pipeline-ready")
    names = list(algorithms or (REGRESSORS if task == "regression" else CLASSIFIERS))
    results, fitted = models.train_all(ready, names, cols, params=params, seed=seed, keys=[key] if folds else (), folds=folds)
    if not fitted:
        raise RuntimeError("no algorithm could be trained")
    best = models.select_best(results, "r2" if task == "regression" else "f1").first()["algorithm"]
    test = ready.filter("split = 'test'")
    sides = ready.filter("split <> 'val'")
    checked = gates.run_gates([
        gates.data_integrity_gate(sides, cols, "target", F.col("split") == "train", continuous=task == "regression"),
        gates.adversarial_gate(test, fitted[best], cols, "target", [key], regression=task == "regression"),
    ])
    checked = materialise(checked.withColumn("experiment_id", F.lit(experiment_id)), "pipeline-gates")
    short = results.withColumn("metric", F.regexp_replace(F.regexp_replace("metric", "^baseline_test_", "baseline_"), "^test_", ""))
    run = small_table(
        spark,
        [(experiment_id, experiment_id, "v1", f"ds_{experiment_id}", f"{experiment_id}.parquet", task, created_at, "COMPLETED")],
        "experiment_id string, experiment_name string, model_version string, dataset_id string, file_name string, "
        "task_type string, created_at string, status string",
    )
    settings = {n: {k: str(v) for k, v in (models.DEFAULTS[n] | dict((params or {}).get(n, {}))).items()} for n in fitted}
    details = small_table(
        spark,
        [(experiment_id, n, f"{experiment_id}-{n}", f"{path}/model" if n == best else None, settings[n]) for n in fitted],
        "experiment_id string, algorithm string, run_id string, model_path string, hyperparams map<string,string>",
    )
    report = small_table(
        spark, [(experiment_id, True, [], list(cleaned.actions))], "experiment_id string, passed boolean, reasons array<string>, actions array<string>"
    )
    told = short.withColumn("experiment_id", F.lit(experiment_id))
    document = materialise(experiments.build_experiments(run, told, checked, details=details, quality=report), "pipeline-document")
    writers.write_splits(ready, f"{path}/splits")
    save_state(spark, transform, f"{path}/transform")
    save_state(spark, anomaly.ReferenceProfile.fit(ready.filter("split = 'train'"), cols), f"{path}/profile")
    save_model(spark, fitted[best], f"{path}/model")
    writers.write_experiments(document, f"{path}/experiments")
    sizes = ready.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return Outcome(path, sizes, results, checked.drop("experiment_id"), document)
