"""Experiment documents: flattening, summaries, comparison tables and the model registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metrics of a model record and their defaults.
MODEL_METRICS = {
    "accuracy": 0.0,
    "precision": 0.0,
    "recall": 0.0,
    "f1": 0.0,
    "roc_auc": 0.5,
    "rmse": 0.0,
    "mae": 0.0,
    "r2": 0.0,
    "latency_p50_ms": 0.0,
    "latency_p95_ms": 0.0,
    "latency_p99_ms": 0.0,
    "training_time_sec": 0.0,
    "optimal_threshold": 0.5,
    "baseline_f1": 0.0,
    "baseline_precision": 0.0,
    "baseline_recall": 0.0,
}

_METRICS = ", ".join(f"{m}: double" for m in MODEL_METRICS)
_HYPER = "hyperparams: map<string, string>, confusion_matrix: array<array<bigint>>"
_MODEL = f"struct<algorithm: string, run_id: string, model_path: string, {_HYPER}, metrics: struct<{_METRICS}>>"
_GATE = "struct<gate: string, passed: boolean, score: double, details: map<string, string>>"
# The fields of an experiment document.
EXPERIMENT_SCHEMA = (
    "experiment_id string, experiment_name string, model_version string, dataset_id string, created_at string, "
    "status string, error_message string, "
    "dataset struct<name: string, file_name: string, dataset_id: string, source: string, task_type: string>, "
    "data_quality struct<passed: boolean, reasons: array<string>, actions: array<string>>, "
    f"models map<string, {_MODEL}>, "
    f"best_model struct<algorithm: string, run_id: string, model_path: string, {_HYPER}, optimal_threshold: double, metrics: struct<{_METRICS}>>, "
    f"security struct<overall_passed: boolean, overall_score: double, gate_results: array<{_GATE}>>, "
    "deployment struct<stage: string, model_version: string, registered: boolean>, "
    "research_metrics struct<task_type: string, f1_score: double, r2_score: double, security_compliance: double>"
)


def _confusion() -> Column:
    """Rows by label and columns by prediction, from the counts ``confusion_<label>_<prediction>``; null if there are none."""
    counts = F.map_filter("m", lambda k, _: F.startswith(k, F.lit("confusion_")))
    codes = F.flatten(F.transform(F.map_keys(counts), lambda k: F.slice(F.split(k, "_"), 2, 2)))
    most = F.array_max(F.transform(codes, lambda c: c.cast("int")))
    every = F.sequence(F.lit(0), most)

    def cell(i: Column, j: Column) -> Column:
        return F.coalesce(F.element_at(counts, F.concat_ws("_", F.lit("confusion"), i.cast("string"), j.cast("string"))), F.lit(0.0)).cast("bigint")

    return F.when(F.size(counts) > 0, F.transform(every, lambda i: F.transform(every, lambda j: cell(i, j))))


def build_experiments(
    runs: DataFrame,
    results: DataFrame,
    gates: DataFrame,
    on: str = "experiment_id",
    details: DataFrame | None = None,
    quality: DataFrame | None = None,
) -> DataFrame:
    """Experiment documents from flat tables.

    ``details`` may add (id, algorithm, run_id, model_path, hyperparams), and ``quality`` (id, passed, reasons, actions); without
    it a table counts as passed. Results named ``confusion_<label>_<prediction>`` become a matrix.

    ``runs`` has one row per experiment (id, name, version, dataset fields, created_at, status),
    ``results`` (id, algorithm, position, metric, value) and ``gates`` (id and a gate record). The best
    model is the one with the highest f1, or r2 for a regression; the first one wins ties.
    """
    wide = results.groupBy(on, "algorithm").agg(
        F.min("position").alias("position"), F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m")
    )
    measured = F.struct(
        *[F.coalesce(F.col("m").getItem(k), F.lit(default)).alias(k) for k, default in MODEL_METRICS.items()]
    )
    kinds = {"run_id": "string", "model_path": "string", "hyperparams": "map<string,string>"}
    if details is None:
        wide = wide.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    else:
        wide = wide.join(details.select(on, "algorithm", *kinds), [on, "algorithm"], "left")
    model = F.struct("algorithm", *kinds, _confusion().alias("confusion_matrix"), measured.alias("metrics"))
    per_run = (
        wide.join(runs.select(on, "task_type"), on)
        .withColumn("model", model)
        .withColumn("s", F.when(F.col("task_type") == "regression", F.col("model.metrics.r2")).otherwise(F.col("model.metrics.f1")))
        .groupBy(on)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("algorithm", "model"))).alias("models"),
            F.max_by("model", F.struct("s", (-F.col("position")).alias("p"))).alias("best"),
        )
    )
    checked = gates.groupBy(on).agg(
        F.struct(
            F.bool_and("passed").alias("overall_passed"),
            F.avg(F.coalesce("score", F.lit(0.0))).alias("overall_score"),
            F.sort_array(F.collect_list(F.struct("gate", "passed", "score"))).alias("gate_results"),
        ).alias("security")
    )
    fine = F.struct(F.lit(True).alias("passed"), *[F.array().cast("array<string>").alias(c) for c in ("reasons", "actions")])
    if quality is not None:
        runs = runs.join(quality.select(on, F.struct("passed", "reasons", "actions").alias("data_quality")), on, "left")
    threshold = F.when(F.col("task_type") == "regression", 0.5).otherwise(F.col("best.metrics.optimal_threshold"))
    return (
        runs.join(per_run, on, "left")
        .join(checked, on, "left")
        .select(
            on,
            "experiment_name",
            "model_version",
            "dataset_id",
            "created_at",
            "status",
            F.struct("dataset_id", "file_name", "task_type").alias("dataset"),
            (fine if quality is None else F.coalesce("data_quality", fine)).alias("data_quality"),
            "models",
            F.when(
                F.col("best").isNotNull(),
                F.struct(
                    *[F.col(f"best.{c}").alias(c) for c in ("algorithm", *kinds, "confusion_matrix")],
                    threshold.alias("optimal_threshold"),
                    F.col("best.metrics").alias("metrics"),
                ),
            ).alias("best_model"),
            "security",
            F.struct(
                "task_type",
                F.coalesce("best.metrics.f1", F.lit(0.0)).alias("f1_score"),
                F.coalesce("best.metrics.r2", F.lit(0.0)).alias("r2_score"),
                F.coalesce("security.overall_score", F.lit(0.0)).alias("security_compliance"),
            ).alias("research_metrics"),
        )
    )


def experiment_flatten(docs: DataFrame) -> DataFrame:
    """One row per (experiment, algorithm); an absent metric has its default."""
    models = docs.select("experiment_id", F.explode("models").alias("algorithm", "m"))
    return models.select(
        "experiment_id",
        "algorithm",
        *[F.coalesce(F.col(f"m.metrics.{k}"), F.lit(v)).alias(k) for k, v in MODEL_METRICS.items()],
    )


def _filled(path: str) -> Column:
    """The field, with an empty string read as missing."""
    return F.nullif(F.col(path), F.lit(""))


def experiment_list(docs: DataFrame) -> DataFrame:
    """One summary row per document, newest first, with fallbacks for identifiers and absent figures."""
    summaries = docs.select(
        "experiment_id",
        "experiment_name",
        F.coalesce(
            _filled("dataset.dataset_id"),
            _filled("dataset_id"),
            F.concat(F.lit("ds_"), F.coalesce("dataset.name", F.lit("dataset"))),
        ).alias("dataset_id"),
        F.coalesce(_filled("dataset.file_name"), _filled("dataset.name"), F.lit("dataset.csv")).alias("dataset_name"),
        F.coalesce(_filled("model_version"), "deployment.model_version", F.lit("v1")).alias("model_version"),
        "created_at",
        "status",
        F.coalesce("dataset.task_type", F.lit("classification")).alias("task_type"),
        F.col("best_model.algorithm").alias("best_model"),
        F.coalesce("research_metrics.f1_score", F.lit(0.0)).alias("f1_score"),
        F.coalesce("research_metrics.r2_score", F.lit(0.0)).alias("r2_score"),
        F.coalesce("security.overall_score", F.lit(0.0)).alias("security_score"),
        *(["modified"] if "modified" in docs.columns else []),
    )
    return summaries.orderBy(*_newest_first(summaries))


def _newest_first(table: DataFrame) -> list[Column]:
    order = [F.desc("modified")] if "modified" in table.columns else []
    return [*order, F.desc("created_at"), F.desc("experiment_id")]


def recent_experiments(summaries: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` summaries."""
    return summaries.orderBy(*_newest_first(summaries)).limit(n)


def next_version(docs: DataFrame) -> DataFrame:
    """One row: ``by_count`` is v + (documents + 1), ``by_max`` is safe under deleted documents."""
    number = F.regexp_extract("model_version", r"^v(\d+)$", 1).try_cast("bigint")
    return docs.agg(
        F.concat(F.lit("v"), (F.count(F.lit(1)) + 1).cast("string")).alias("by_count"),
        F.concat(F.lit("v"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("by_max"),
    )


def experiment_kpis(summaries: DataFrame) -> DataFrame:
    """One row: total, completed, failed, mean security score x 100."""
    n = F.count(F.lit(1))
    return summaries.agg(
        n.alias("total"),
        F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        (F.coalesce(F.sum("security_score"), F.lit(0.0)) / F.greatest(n, F.lit(1)) * 100.0).alias("avg_security_pct"),
    )


def model_comparison(flat: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(experiment_id, algorithm, metric, value)."""
    return flat.unpivot(["experiment_id", "algorithm"], list(metrics), "metric", "value")


def registry_current(events: DataFrame, archive_existing: bool = True) -> DataFrame:
    """(model, version, stage): the stage each version is in after all transitions.

    ``events`` is append-only: (model, version, stage, event_time, event_id). With
    ``archive_existing`` a promotion archives the version that held the stage before.
    """
    at = F.struct("event_time", "event_id")
    last = events.groupBy("model", "version").agg(
        F.max(F.struct("event_time", "event_id", "stage")).alias("e")
    ).select("model", "version", F.col("e.stage").alias("stage"), F.struct("e.event_time", "e.event_id").alias("at"))
    if not archive_existing:
        return last.select("model", "version", "stage")
    # a version keeps an active stage only if no later transition of the model entered that stage
    holders = events.filter(F.col("stage").isin("Staging", "Production")).groupBy("model", "stage").agg(
        F.max(at).alias("latest")
    )
    return last.join(holders, ["model", "stage"], "left").select(
        "model",
        "version",
        F.when(F.col("latest").isNotNull() & (F.col("at") < F.col("latest")), "Archived").otherwise(F.col("stage")).alias("stage"),
    )


def registry_latest(current: DataFrame) -> DataFrame:
    """(model, stage, version): the highest version per model and stage."""
    return current.groupBy("model", "stage").agg(F.max("version").alias("version"))


def newest(docs: DataFrame, order: str = "created_at", key: str = "experiment_id") -> DataFrame:
    """The newest document, whole."""
    return docs.orderBy(F.desc(order), F.desc(key)).limit(1)
