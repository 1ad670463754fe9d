"""Prediction-log aggregates, response routing and late labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import col, present
from plumbline.operators.gates import equal_width_bins
from plumbline.operators.metrics import weighted_metrics
from plumbline.session import small_table

# Upper bounds of the latency histogram in seconds, and the statuses that are no error.
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
NO_ERROR = ("success", "anomaly_mitigated")

# The actions that logs and incident records hold.
FALLBACK = "fallback_conservative_prediction"
RETRAIN = "flag_retrain_quarantine"


def route(df: DataFrame, score: str = "anomaly_score", prediction: str = "prediction", limit: float = 0.75) -> DataFrame:
    """Adds triggered, action_taken, routed_prediction and routed_probability.

    A row whose score reaches the limit gets the safe prediction 1 with probability 1. A missing score
    is not below any limit, yet nothing was detected: it passes.
    """
    hit = F.coalesce(col(score) >= limit, F.lit(False))
    return df.withColumns(
        {
            "triggered": hit,
            "action_taken": F.when(hit, FALLBACK).otherwise("pass"),
            "routed_prediction": F.when(hit, F.lit(1).cast("double")).otherwise(col(prediction).cast("double")),
            "routed_probability": F.when(hit, F.lit(1.0)),
        }
    )


def incidents(routed: DataFrame, key: str, ts: str, score: str = "anomaly_score", limit: float = 0.75) -> DataFrame:
    """Incident records of the routed rows."""
    return routed.filter("triggered").select(
        F.concat(F.lit("inc_anom_"), col(key).cast("string")).alias("incident_id"),
        F.lit("input_anomaly").alias("type"),
        col(score).alias("anomaly_score"),
        F.lit(limit).alias("threshold"),
        F.col("action_taken").alias("action"),
        F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )


def drift_response(report: DataFrame, limit: float = 0.40) -> DataFrame:
    """(drift_score, triggered, action_taken) for a drift report row."""
    hit = F.col("drift_score") >= limit
    return report.select(
        "drift_score", hit.alias("triggered"), F.when(hit, RETRAIN).otherwise("pass").alias("action_taken")
    )


def drift_incidents(report: DataFrame, batch: str, ts: Column, limit: float = 0.40) -> DataFrame:
    """Incident records of the report rows whose drift reaches the limit; ``batch`` names them, ``ts`` dates them."""
    return report.filter(F.col("drift_score") >= limit).select(
        F.concat(F.lit("inc_drift_"), col(batch).cast("string")).alias("incident_id"),
        F.lit("data_drift").alias("type"),
        "drift_score",
        F.lit(limit).alias("threshold"),
        F.lit(RETRAIN).alias("action"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )


def is_error(status: str = "status") -> Column:
    return ~col(status).isin(*NO_ERROR)


def traffic_stats(
    log: DataFrame, ts: str = "ts", latency: str = "latency_ms", status: str = "status", by: Sequence[str] = ()
) -> DataFrame:
    """requests, avg_latency_ms, error_count, error_rate_pct, latest_activity; without traffic the mean
    is null and the error figures are 0."""
    n = F.count(F.lit(1))
    errors = F.count_if(is_error(status))
    return log.groupBy(*[col(c) for c in by]).agg(
        n.alias("total_requests"),
        F.round(F.avg(col(latency)), 2).alias("avg_latency_ms"),
        errors.alias("error_count"),
        F.when(n == 0, F.lit(0.0)).otherwise(F.round(errors * 100.0 / n, 2)).alias("error_rate_pct"),
        F.max(col(ts)).alias("latest_activity"),
    )


def requests_per_minute(log: DataFrame, ts: str = "ts") -> DataFrame:
    """(minute, requests)."""
    return log.groupBy(F.date_trunc("minute", col(ts)).alias("minute")).agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(log: DataFrame, latency: str = "latency_ms", per_second: float = 1000.0) -> DataFrame:
    """(le, cumulative count) at each bound and at infinity, with the sum in seconds and the count."""
    seconds = present(col(latency)) / per_second
    bounds = [(repr(b), seconds <= b) for b in LATENCY_BOUNDS] + [("+Inf", seconds.isNotNull())]
    one = log.agg(
        *[F.count_if(c).alias(f"b{i}") for i, (_, c) in enumerate(bounds)],
        F.sum(seconds).alias("s"),
        F.count(seconds).alias("n"),
    )
    rows = [
        F.struct(F.lit(name).alias("le"), F.col(f"b{i}").alias("requests"), F.col("s").alias("latency_sum"), F.col("n"))
        for i, (name, _) in enumerate(bounds)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def latency_bins(log: DataFrame, latency: str = "latency_ms", bins: int = 20) -> DataFrame:
    """(bin, low, high, n): at most ``bins`` equal-width bins of the latencies, never more than rows."""
    v = present(col(latency))
    lo, hi, n = log.agg(F.min(v), F.max(v), F.count(v)).first()
    if not n:
        return small_table(log.sparkSession, [], "bin int, low double, high double, n bigint")
    bins = min(bins, n)
    start, width = (lo, (hi - lo) / bins) if hi > lo else (lo - 0.5, 1.0 / bins)
    return (
        log.filter(v.isNotNull())
        .groupBy(equal_width_bins(v, lo, hi, bins).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.lit(start) + F.col("bin") * F.lit(width)).alias("low"),
            (F.lit(start) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
            "n",
        )
    )


def counters(
    log: DataFrame,
    status: str = "status",
    version: str = "model_version",
    prediction: str = "prediction",
    score: str = "anomaly_score",
    limit: float = 0.75,
) -> DataFrame:
    """(metric, labels, value): requests by status and version, predictions by label, anomalies by type,
    responses by action. Labels read ``name=value`` joined by commas.

    One pass counts the combinations, which are few; the four counters are sums over those.
    """
    flagged = F.coalesce(col(score) >= limit, F.lit(False))
    combos = log.groupBy(
        col(status).alias("s"), col(version).alias("v"), col(prediction).cast("string").alias("p"), flagged.alias("a")
    ).agg(F.count(F.lit(1)).alias("n"))

    def cell(metric: str, *labels: Column | str, when: Column | None = None) -> Column:
        made = F.struct(F.lit(metric).alias("metric"), F.concat(*labels).alias("labels"), F.col("n"))
        return made if when is None else F.when(when, made)

    cells = F.array(
        cell("inference_requests_total", F.lit("model_version="), F.col("v"), F.lit(",status="), F.col("s")),
        cell("predictions_total", F.lit("label="), F.col("p")),
        cell("anomalies_detected_total", F.lit("type=ood_input"), when=F.col("a")),
        cell("auto_responses_triggered_total", F.lit(f"action={FALLBACK}"), when=F.col("a")),
    )
    return (
        combos.select(F.explode(cells).alias("c"))
        .filter("c is not null")
        .select("c.*")
        .groupBy("metric", "labels")
        .agg(F.sum("n").alias("value"))
    )


def gauges(samples: DataFrame, metric: str, value: str, ts: str, labels: Sequence[str] = ()) -> DataFrame:
    """(metric, labels, value): the latest value per label set."""
    shown = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), col(c).cast("string")) for c in labels])
    return (
        samples.groupBy(shown.alias("labels"))
        .agg(F.max_by(col(value).cast("double"), col(ts)).alias("value"))
        .select(F.lit(metric).alias("metric"), "labels", "value")
    )


def recent_requests(log: DataFrame, ts: str, key: str, n: int = 20) -> DataFrame:
    """The last ``n`` log rows."""
    return log.orderBy(F.desc(ts), F.desc(key)).limit(n)


def label_join(log: DataFrame, truth: DataFrame, key: str = "request_id") -> DataFrame:
    """Late labels with the prediction they belong to; an unknown request is ignored, repeats are kept."""
    return log.join(truth, key)


def performance_drift(
    log: DataFrame, truth: DataFrame, key: str = "request_id", prediction: str = "prediction", label: str = "y_true"
) -> DataFrame:
    """One row: status, sample_count, current_accuracy, current_f1 (support-weighted).

    A request with several predictions counts with its first.
    """
    several = isinstance(log.schema[prediction].dataType, T.ArrayType)
    first = F.get(col(prediction), F.lit(0)) if several else col(prediction)
    joined = label_join(log.select(key, first.alias(prediction)), truth.select(key, label), key)
    m = weighted_metrics(joined, label, prediction)
    some = F.coalesce(F.col("n"), F.lit(0)) > 0
    return m.select(
        F.when(some, "evaluated").otherwise("unavailable_no_ground_truth").alias("status"),
        F.coalesce("n", F.lit(0)).alias("sample_count"),
        F.when(some, F.col("accuracy")).alias("current_accuracy"),
        F.when(some, F.col("f1")).alias("current_f1"),
    )
