"""The monitoring operators on streams. Every function takes a streaming table with an event time of
type timestamp; the ``drain`` helpers run one to the end of what is available and return the written table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import col
from plumbline.operators import drift, traffic
from plumbline.operators.anomaly import ReferenceProfile
from plumbline.session import remove, scratch_path
from plumbline.sources import readers

MIN_REQUESTS = 3


# --------------------------------------------------------------------------- queries


def stream_traffic(
    log: DataFrame, window: str = "1 minute", slide: str | None = None, delay: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Per tumbling or sliding window: requests, avg_latency_ms, errors. Rows later than ``delay`` are dropped."""
    at = F.window(col(ts), window, slide) if slide else F.window(col(ts), window)
    return (
        log.withWatermark(ts, delay)
        .groupBy(at.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg("latency_ms").alias("avg_latency_ms"),
            F.count_if(traffic.is_error()).alias("errors"),
        )
        .select("w.start", "w.end", "requests", "avg_latency_ms", "errors")
    )


def stream_anomaly_rate(
    log: DataFrame, flag: Column, window: str = "1 hour", delay: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Per window: rows, anomalies and their share."""
    return (
        log.withWatermark(ts, delay)
        .groupBy(F.window(col(ts), window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(flag).alias("anomalies"),
            F.avg(flag.cast("double")).alias("anomaly_rate"),
        )
        .select("w.start", "w.end", "rows", "anomalies", "anomaly_rate")
    )


def stream_counters(log: DataFrame, limit: float = 0.75) -> DataFrame:
    """Running (metric, labels, value). One stateful aggregate whose state is the label combinations."""
    flagged = F.coalesce(F.col("anomaly_score") >= limit, F.lit(False))

    def cell(metric: str, *labels: Column, when: Column = F.lit(True)) -> Column:
        return F.when(when, F.struct(F.lit(metric).alias("metric"), F.concat(*labels).alias("labels")))

    cells = F.array(
        cell(
            "inference_requests_total", F.lit("model_version="), F.col("model_version"), F.lit(",status="), F.col("status")
        ),
        cell("predictions_total", F.lit("label="), F.col("prediction").cast("string")),
        cell("anomalies_detected_total", F.lit("type=ood_input"), when=flagged),
        cell("auto_responses_triggered_total", F.lit(f"action={traffic.FALLBACK}"), when=flagged),
    )
    return (
        log.select(F.explode(cells).alias("c"))
        .filter("c is not null")
        .groupBy(F.col("c.metric").alias("metric"), F.col("c.labels").alias("labels"))
        .agg(F.count(F.lit(1)).alias("value"))
    )


def stream_score(
    log: DataFrame, score: Callable[[DataFrame], DataFrame], profile: ReferenceProfile | None = None
) -> DataFrame:
    """The batch scoring projection, with the bounds verdicts if a profile is given."""
    return score(profile.apply(log) if profile else log)


def stream_label_join(
    log: DataFrame,
    truth: DataFrame,
    key: str = "request_id",
    ts: str = "ts",
    label_ts: str = "label_ts",
    within: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Requests with labels that arrive up to ``within`` later. The bound lets both sides drop old state."""
    left = log.withWatermark(ts, delay).alias("l")
    right = truth.withWatermark(label_ts, delay).alias("r")
    at, late = F.col(f"l.{ts}"), F.col(f"r.{label_ts}")
    match = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (late >= at) & (late <= at + F.expr(f"INTERVAL {within}"))
    rest = [F.col(f"r.{c}") for c in truth.columns if c != key]
    return left.join(right, match).select("l.*", *rest)


# --------------------------------------------------------------------------- sinks


def drain_append(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Run to the end of the available input in append mode; returns what was written."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def drain_batches(
    df: DataFrame, label: str, write: Callable[[DataFrame, int, str], None], mode: str = "append", path: str | None = None
) -> str:
    """Run ``write(batch, id, folder)`` for each micro-batch; returns the folder.

    ``write`` must overwrite what an earlier try of the same batch id left.
    """
    path = path or scratch_path(df.sparkSession, label)
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/state")
        .foreachBatch(lambda batch, i: write(batch, i, path))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path


def drain_complete(df: DataFrame, label: str) -> DataFrame:
    """Run in complete mode; returns the last full result. For aggregates with few groups."""
    spark, last = df.sparkSession, [-1]

    def write(batch: DataFrame, i: int, folder: str) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={i}")
        if last[0] >= 0 and last[0] != i:
            remove(spark, f"{folder}/table/batch={last[0]}")
        last[0] = i

    path = drain_batches(df, label, write, "complete")
    if last[0] < 0:
        return small_table(spark, [], df.schema)
    return spark.read.schema(df.schema).parquet(f"{path}/table/batch={last[0]}")


def drain_latest(df: DataFrame, label: str, keys: Sequence[str] = ("start",), path: str | None = None) -> DataFrame:
    """Run a windowed aggregate in update mode; returns the last state of every window.

    So the windows that are still open when the input ends are there as well. Each micro-batch writes the
    windows it changed; rows that come after the watermark are not counted, as in append mode.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, i: int, folder: str) -> None:
        batch.withColumn("_batch", F.lit(i).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/table/batch_id={i}")

    folder = drain_batches(df, label, write, "update", path)
    schema = T.StructType([*df.schema.fields, T.StructField("_batch", T.LongType())])
    if not readers.exists(spark, f"{folder}/table"):
        return small_table(spark, [], df.schema)
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*[col(c) for c in rest]), F.col("_batch")).alias("_last")
    latest = spark.read.schema(schema).parquet(f"{folder}/table").groupBy(*[col(k) for k in keys]).agg(last)
    return latest.select(*[col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns])


def stream_route(log: DataFrame, limit: float = 0.75, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split a stream into (served requests, incidents), each written once per batch id."""
    spark = log.sparkSession

    def write(batch: DataFrame, i: int, folder: str) -> None:
        batch = batch.persist()
        routed = traffic.route(batch, limit=limit)
        routed.write.mode("overwrite").parquet(f"{folder}/served/batch={i}")
        traffic.incidents(routed, "request_id", "ts", limit=limit).write.mode("overwrite").json(
            f"{folder}/incidents/batch={i}"
        )
        batch.unpersist()

    folder = drain_batches(log, "route", write, path=path)
    shape = traffic.incidents(traffic.route(log, limit=limit), "request_id", "ts", limit=limit).schema
    served = spark.read.schema(traffic.route(log, limit=limit).schema).parquet(f"{folder}/served")
    return served, spark.read.schema(shape).json(f"{folder}/incidents")


_VERDICT = "status string, sample_count bigint, drift_score double, is_drifted boolean, drifted_features string"
DRIFT_SCHEMA = f"batch bigint, {_VERDICT}"


def _cell_counts(log: DataFrame, fitted: drift.EdgeReference, by: Sequence[Column] = (), ts: str | None = None) -> DataFrame:
    """Stateful counts (f, cell, n, total, grouping columns) of all rows so far; one state row per cell and group."""
    carry = [] if ts is None else [ts]
    cells = fitted.cells(log.select(*fitted.cols, *carry), carry, count_rows=True)
    return cells.groupBy(*by, "f", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _verdicts(counts: DataFrame, fitted: drift.EdgeReference, by: Sequence[str]) -> DataFrame:
    """One row per group of counts; fewer than ``MIN_REQUESTS`` rows are not judged."""
    keys = [F.col(c) for c in by]
    rows = counts.filter(F.col("f") == drift.ROWS).select(*keys, F.lit(1).alias("_g"), F.col("n").alias("sample_count"))
    judged = fitted.judge(counts.filter(F.col("f") != drift.ROWS), by)
    score = F.round(F.count_if("is_drifted") / F.lit(float(max(1, len(fitted.cols)))), 4)
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_drifted"), F.col("feature")))), ",")
    found = judged.groupBy(*keys).agg(score.alias("_score"), names.alias("_names")).withColumn("_g", F.lit(1))
    both = rows.join(found, ["_g", *by], "left")
    enough = F.col("sample_count") >= MIN_REQUESTS
    drift_score = F.when(enough, F.coalesce(F.col("_score"), F.lit(0.0)))
    return both.select(
        *keys,
        F.when(enough, "evaluated").otherwise("insufficient_samples").alias("status"),
        "sample_count",
        drift_score.alias("drift_score"),
        F.coalesce(drift_score >= 0.3, F.lit(False)).alias("is_drifted"),
        F.when(enough, F.coalesce("_names", F.lit(""))).otherwise("").alias("drifted_features"),
    )


def stream_drift(
    log: DataFrame, reference: DataFrame, cols: Sequence[str], path: str | None = None, cells: int = 500
) -> DataFrame:
    """After each micro-batch, the drift report over all requests so far; fewer than 3 are not judged.

    The state is a count for each cell between fixed edges of the reference (``drift.EdgeReference``): it grows with neither
    the stream nor the reference, and a micro-batch touches its own rows and the state only.
    """
    spark = log.sparkSession
    fitted = drift.EdgeReference.fit(reference, cols, cells)

    def write(counts: DataFrame, i: int, folder: str) -> None:
        report = _verdicts(counts, fitted, ()).select(F.lit(i).cast("bigint").alias("batch"), "*")
        report.write.mode("overwrite").parquet(f"{folder}/table/batch_id={i}")

    folder = drain_batches(_cell_counts(log, fitted), "drift", write, "complete", path)
    return spark.read.schema(DRIFT_SCHEMA).parquet(f"{folder}/table").select(*[f.split()[0] for f in DRIFT_SCHEMA.split(", ")])


def stream_drift_windows(
    log: DataFrame,
    reference: DataFrame,
    cols: Sequence[str],
    window: str = "1 hour",
    slide: str | None = None,
    delay: str = "10 minutes",
    ts: str = "ts",
    path: str | None = None,
    cells: int = 500,
) -> DataFrame:
    """(start, end, status, ...): the drift report of each tumbling or sliding window that had requests.

    After each micro-batch the windows that it changed are judged; the last verdict of a window counts. Rows later than ``delay`` are dropped.
    """
    spark = log.sparkSession
    fitted = drift.EdgeReference.fit(reference, cols, cells)
    at = F.window(col(ts), window, slide) if slide else F.window(col(ts), window)
    counts = _cell_counts(log.withWatermark(ts, delay), fitted, [at.alias("w")], ts)
    bounds = ("start", "end")

    def write(changed: DataFrame, i: int, folder: str) -> None:
        # update mode gives the cells that changed; the others of these windows come from the batches before
        flat = changed.select("w.start", "w.end", "f", "cell", "n", "total").withColumn("_batch", F.lit(i))
        flat.write.mode("overwrite").parquet(f"{folder}/cells/batch_id={i}")
        spread = spark.read.schema(flat.schema).parquet(f"{folder}/cells").filter(F.col("_batch") <= i)
        touched = flat.select(*bounds).distinct()
        rows = spread.join(touched, list(bounds), "left_semi").groupBy(*bounds, "f", "cell")
        latest = rows.agg(F.max_by(F.struct("n", "total"), "_batch").alias("_l")).select(*bounds, "f", "cell", "_l.n", "_l.total")
        report = _verdicts(latest, fitted, bounds).withColumn("_batch", F.lit(i))
        report.write.mode("overwrite").parquet(f"{folder}/table/batch_id={i}")

    folder = drain_batches(counts, "drift-windows", write, "update", path)
    schema = f"start timestamp, end timestamp, {_VERDICT}, _batch int"
    found = spark.read.schema(schema).parquet(f"{folder}/table")
    rest = [c for c in found.columns if c not in (*bounds, "_batch")]
    return found.groupBy(*bounds).agg(F.max_by(F.struct(*rest), "_batch").alias("_l")).select(*bounds, "_l.*")


def zone_free(closed: DataFrame) -> DataFrame:
    """Window bounds as zone-free timestamps, for comparison with a batch result."""
    return closed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
