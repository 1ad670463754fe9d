"""Queries over efficiency ranking, experiment documents, the registry and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import FEATURES, ctes, query, table, view
from plumbline.catalog.monitoring import bounds_sql, drift_sql
from plumbline.operators import anomaly, experiments, models, ranking
from plumbline.operators.features import Imputer
from plumbline.session import scratch_path
from plumbline.sources import readers, writers
from plumbline.streaming import monitors

IN, OUT = ["in_qty", "in_lines"], ["out_rev", "out_keep"]


def _round(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --------------------------------------------------------------------------- ranking

# one metrics record per nation of the suppliers
RECORDS = (
    "SELECT s_nationkey AS name, sum(s_acctbal) / CAST(1000 AS DOUBLE) AS training_time_sec, "
    "count(*) - 3 AS security_vulnerabilities, min(s_acctbal) / CAST(100 AS DOUBLE) AS mttr_minutes, "
    "max(s_acctbal) / CAST(100 AS DOUBLE) AS deployment_lead_time_hr, "
    "avg(CASE WHEN s_acctbal > 4000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS f1_score, "
    "avg(s_acctbal) / CAST(10000 AS DOUBLE) AS security_score, "
    "avg(CASE WHEN s_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS robustness_score, "
    "max(s_acctbal) / CAST(10000 AS DOUBLE) AS auto_recovery_rate FROM supplier GROUP BY s_nationkey"
)


@query(
    "dmu_prepare",
    f"WITH r AS ({RECORDS}) SELECT name AS dmu, round(greatest(0.1, training_time_sec), 6) AS in_0, "
    "round(greatest(CAST(0.1 AS DOUBLE), CAST(security_vulnerabilities + 1 AS DOUBLE)), 6) AS in_1, round(greatest(0.1, mttr_minutes), 6) AS in_2, "
    "round(greatest(0.1, deployment_lead_time_hr), 6) AS in_3, round(greatest(0.01, f1_score), 6) AS out_0, "
    "round(greatest(0.01, security_score), 6) AS out_1, round(greatest(0.01, robustness_score), 6) AS out_2, "
    "round(greatest(0.01, auto_recovery_rate), 6) AS out_3 FROM r",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(RECORDS.replace("FROM supplier", "FROM {src}"), src=table(spark, sf, "supplier"))
    out = ranking.dmu_prepare(rows)
    return _round(out, [c for c in out.columns if c != "dmu"])


COMPOSITE = (
    "mx AS (SELECT max(in_qty) + 1e-10 AS a, max(in_lines) + 1e-10 AS b, max(out_rev) + 1e-10 AS c, max(out_keep) + 1e-10 AS d FROM dmu), "
    "raw AS (SELECT dmu.*, (out_rev / c + out_keep / d) / 2 / greatest(1e-5, (in_qty / a + in_lines / b) / 2) AS rw FROM dmu, mx), "
    "comp AS (SELECT dmu, in_qty, in_lines, out_rev, out_keep, least(greatest(rw / max(rw) OVER (), 0), 1) AS score FROM raw)"
)


@query("composite_score", ctes(["dmu"], f"WITH {COMPOSITE} SELECT dmu, round(score, 6) AS composite_score FROM comp"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking.composite_score(view(spark, sf, "dmu"), IN, OUT)
    return _round(out.select("dmu", "composite_score"), ["composite_score"])


# Every vertex of each unit's weights. With v2 = (1 - v1 * in_qty) / in_lines the unknowns are u1, u2 and v1; a vertex is where
# three constraints meet: two or more of the undominated units', and bounds of 1e-4 on the four weights.
_LESS = " AND ".join([f"e.{c} <= d.{c}" for c in ("in_qty", "in_lines")] + [f"e.{c} >= d.{c}" for c in ("out_rev", "out_keep")])


def _det(*columns: str) -> str:
    """Determinant of the rows p, q, r of three columns."""
    a, b, c = columns
    return (
        f"(p.{a} * (q.{b} * r.{c} - q.{c} * r.{b}) - p.{b} * (q.{a} * r.{c} - q.{c} * r.{a}) + p.{c} * (q.{a} * r.{b} - q.{b} * r.{a}))"
    )


VERTICES = (
    f"f AS (SELECT * FROM dmu d WHERE NOT EXISTS (SELECT 1 FROM dmu e WHERE {_LESS} "
    "AND (e.in_qty < d.in_qty OR e.in_lines < d.in_lines OR e.out_rev > d.out_rev OR e.out_keep > d.out_keep))), "
    "c AS (SELECT k.dmu AS k, 4 + row_number() OVER (PARTITION BY k.dmu ORDER BY f.dmu) AS i, f.out_rev AS a1, f.out_keep AS a2, "
    "k.in_qty * f.in_lines / k.in_lines - f.in_qty AS a3, f.in_lines / k.in_lines AS b FROM dmu k, f "
    "UNION ALL SELECT dmu, 1, -1, 0, 0, -1e-4 FROM dmu UNION ALL SELECT dmu, 2, 0, -1, 0, -1e-4 FROM dmu "
    "UNION ALL SELECT dmu, 3, 0, 0, -1, -1e-4 FROM dmu UNION ALL SELECT dmu, 4, 0, 0, in_qty, 1 - 1e-4 * in_lines FROM dmu), "
    f"tri AS (SELECT p.k, {_det('a1', 'a2', 'a3')} AS d, {_det('b', 'a2', 'a3')} AS d1, {_det('a1', 'b', 'a3')} AS d2, {_det('a1', 'a2', 'b')} AS d3 "
    "FROM c p JOIN c q ON p.k = q.k AND p.i < q.i JOIN c r ON q.k = r.k AND q.i < r.i), "
    "z AS (SELECT k, d1 / d AS u1, d2 / d AS u2, d3 / d AS v1 FROM tri WHERE abs(d) > 1e-12), "
    "ok AS (SELECT z.k, z.u1, z.u2 FROM z WHERE NOT EXISTS "
    "(SELECT 1 FROM c WHERE c.k = z.k AND c.a1 * z.u1 + c.a2 * z.u2 + c.a3 * z.v1 > c.b + 1e-9)), "
    "eff AS (SELECT dmu.dmu, coalesce(least(greatest(max(u1 * out_rev + u2 * out_keep), 0), 1), 0) AS efficiency "
    "FROM dmu LEFT JOIN ok ON ok.k = dmu.dmu GROUP BY dmu.dmu)"
)


@query("dea_ccr", ctes(["dmu"], f"WITH {VERTICES} SELECT dmu, round(efficiency, 6) AS efficiency FROM eff"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ranking.dea_ccr(view(spark, sf, "dmu"), IN, OUT), ["efficiency"])


# with one input and one output the efficiency is the ratio over the best ratio
@query(
    "dea_ccr_ratio",
    ctes(["dmu"], "SELECT dmu, round((out_rev / in_qty) / max(out_rev / in_qty) OVER (), 6) AS efficiency FROM dmu"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ranking.dea_ccr(view(spark, sf, "dmu"), ["in_qty"], ["out_rev"]), ["efficiency"])


@query(
    "dea_rank",
    ctes(
        ["dmu"],
        f"WITH {COMPOSITE}, {VERTICES}, e AS (SELECT comp.dmu, round(efficiency, 4) AS eff, score FROM comp JOIN eff ON eff.dmu = comp.dmu), "
        "t AS (SELECT *, count(*) OVER () AS n FROM e), w AS (SELECT * FROM t WHERE eff = (SELECT max(eff) FROM e)) "
        "SELECT max(n) AS num_dmus, max(eff) AS best_efficiency, count(*) AS ties, "
        "(SELECT dmu FROM w ORDER BY score DESC, dmu LIMIT 1) AS best, "
        "CASE WHEN count(*) > 1 THEN 'dea_efficiency + composite_tiebreak' ELSE 'dea_efficiency' END AS ranking_method FROM w",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dmu")
    return ranking.dea_rank(ranking.composite_score(rows, IN, OUT).join(ranking.dea_ccr(rows, IN, OUT), "dmu"))


@query(
    "benchmark_report",
    "WITH m AS (SELECT c_mktsegment AS s, avg(c_acctbal) AS a, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1), "
    "u AS (SELECT s, 'balance' AS metric, a AS v FROM m UNION ALL SELECT s, 'customers', n FROM m) SELECT metric, "
    + ", ".join(
        f"round(max(v) FILTER (WHERE s = '{s}'), 4) AS \"{s}\""
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM u GROUP BY metric",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.avg("c_acctbal").alias("balance"), F.count(F.lit(1)).alias("customers")
    )
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    report = ranking.benchmark_report(rows, "c_mktsegment", ["balance", "customers"], segments)
    path = scratch_path(spark, "report")
    writers.write_report(report, path, ["metric"])
    return _round(spark.read.schema(report.schema).json(path), segments, 4)


# --------------------------------------------------------------------------- experiments
# one experiment per supplier, one model per return flag, figures from the lines

RUN = (
    "SELECT l_suppkey AS k, l_returnflag AS algorithm, round(avg(l_discount) * 10, 6) AS f1, round(avg(l_tax), 6) AS accuracy, "
    "round(avg(l_quantity), 4) AS training FROM lineitem GROUP BY 1, 2"
)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    measured = lines.groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("algorithm")).agg(
        F.round(F.avg("l_discount") * 10, 6).alias("test_f1"),
        F.round(F.avg("l_tax"), 6).alias("test_accuracy"),
        F.round(F.avg("l_quantity"), 4).alias("training_time_seconds"),
    )
    named = {"f1": "test_f1", "accuracy": "test_accuracy", "training_time_sec": "training_time_seconds"}
    results = (
        measured.select("k", "algorithm", *[F.col(c).alias(n) for n, c in named.items()])
        .unpivot(["k", "algorithm"], list(named), "metric", "value")
        .select(_id().alias("experiment_id"), "algorithm", F.ascii("algorithm").alias("position"), "metric", "value")
    )
    suppliers = table(spark, sf, "supplier")
    runs = suppliers.select(
        F.concat(F.lit("exp_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("experiment_id"),
        F.col("s_name").alias("experiment_name"),
        F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("model_version"),
        F.when(F.col("s_nationkey") > 12, F.concat(F.lit("ds_"), F.col("s_nationkey").cast("string"))).alias("dataset_id"),
        F.when(F.col("s_nationkey") > 6, F.concat(F.col("s_nationkey").cast("string"), F.lit(".csv"))).alias("file_name"),
        F.lit("classification").alias("task_type"),
        F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("Z")).alias("created_at"),
        F.when(F.col("s_acctbal") < 0, "FAILED").otherwise("COMPLETED").alias("status"),
    )
    key = F.concat(F.lit("exp_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("experiment_id")
    gates = suppliers.select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit("secrets_scan").alias("gate"), (F.col("s_acctbal") > 0).alias("passed"), F.lit(0.5).alias("score")),
                F.struct(F.lit("data_integrity").alias("gate"), F.lit(True).alias("passed"), (F.abs("s_acctbal") / 7000).alias("score")),
            )
        ).alias("g"),
    ).select("experiment_id", "g.*")
    return experiments.build_experiments(runs, results, gates)


def _id() -> Column:
    return F.concat(F.lit("exp_"), F.lpad(F.col("k").cast("string"), 6, "0"))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """The documents after a trip through the JSON sink."""
    path = scratch_path(spark, "experiments")
    writers.write_experiments(_documents(spark, sf), path)
    return readers.read_experiments(spark, path)


KEY_SQL = "'exp_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')"
BEST_SQL = (
    f"run AS ({RUN}), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f1 DESC, ascii(algorithm)) AS rn FROM run), "
    "best AS (SELECT k, algorithm, f1 FROM ranked WHERE rn = 1)"
)
SECURITY = "(0.5 + abs(s_acctbal) / 7000) / 2"
SUMMARY = (
    f"sm AS (SELECT {KEY_SQL} AS experiment_id, s_name AS experiment_name, "
    "CASE WHEN s_nationkey > 12 THEN 'ds_' || CAST(s_nationkey AS VARCHAR) ELSE 'ds_dataset' END AS dataset_id, "
    "CASE WHEN s_nationkey > 6 THEN CAST(s_nationkey AS VARCHAR) || '.csv' ELSE 'dataset.csv' END AS dataset_name, "
    "'v' || CAST(s_suppkey AS VARCHAR) AS model_version, '2024-01-01T00:00:' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || 'Z' AS created_at, "
    "CASE WHEN s_acctbal < 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'classification' AS task_type, "
    f"best.algorithm AS best_model, coalesce(best.f1, 0) AS f1_score, CAST(0 AS DOUBLE) AS r2_score, {SECURITY} AS security_score "
    "FROM supplier LEFT JOIN best ON best.k = s_suppkey)"
)


@query(
    "experiment_write",
    f"WITH {BEST_SQL} SELECT {KEY_SQL} AS experiment_id, CASE WHEN s_acctbal < 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, "
    "s_acctbal > 0 AS gates_passed, best.algorithm AS best_algorithm, "
    "CAST(coalesce((SELECT count(*) FROM run WHERE run.k = s_suppkey), 0) AS INTEGER) AS models FROM supplier LEFT JOIN best ON best.k = s_suppkey",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).select(
        "experiment_id",
        "status",
        F.col("security.overall_passed").alias("gates_passed"),
        F.col("best_model.algorithm").alias("best_algorithm"),
        F.coalesce(F.size("models"), F.lit(0)).alias("models"),
    )


@query(
    "experiment_read",
    f"SELECT {KEY_SQL} AS experiment_id, s_name AS experiment_name FROM supplier ORDER BY s_nationkey DESC, s_suppkey DESC LIMIT 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_experiment(_stored(spark, sf), "latest").select("experiment_id", "experiment_name")


@query(
    "experiment_flatten",
    f"WITH run AS ({RUN}) SELECT 'exp_' || lpad(CAST(k AS VARCHAR), 6, '0') AS experiment_id, algorithm, "
    + ", ".join(
        {"f1": "f1", "accuracy": "accuracy", "training_time_sec": "training"}.get(m, f"CAST({v} AS DOUBLE)") + f" AS {m}"
        for m, v in experiments.MODEL_METRICS.items()
    )
    + " FROM run",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.experiment_flatten(_stored(spark, sf))


@query(
    "experiment_list",
    f"WITH {BEST_SQL}, {SUMMARY} SELECT * REPLACE (round(security_score, 6) AS security_score) FROM sm",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(experiments.experiment_list(_stored(spark, sf)).drop("modified"), ["security_score"])


@query(
    "recent_experiments",
    f"WITH {BEST_SQL}, {SUMMARY} SELECT experiment_id, created_at FROM sm ORDER BY created_at DESC, experiment_id DESC LIMIT 10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    summaries = experiments.experiment_list(_stored(spark, sf)).drop("modified")  # one write, one file time
    return experiments.recent_experiments(summaries).select("experiment_id", "created_at")


@query(
    "next_version",
    "SELECT 'v' || CAST(count(*) + 1 AS VARCHAR) AS by_count, 'v' || CAST(max(s_suppkey) + 1 AS VARCHAR) AS by_max FROM supplier",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.next_version(_stored(spark, sf))


@query(
    "experiment_kpis",
    f"WITH {BEST_SQL}, {SUMMARY} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, "
    "count(*) FILTER (WHERE status = 'FAILED') AS failed, round(avg(security_score) * 100, 6) AS avg_security_pct FROM sm",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(experiments.experiment_kpis(experiments.experiment_list(_stored(spark, sf))), ["avg_security_pct"])


@query(
    "model_comparison",
    f"WITH run AS ({RUN}), u AS (SELECT k, algorithm, 'f1' AS metric, f1 AS value FROM run UNION ALL SELECT k, algorithm, 'accuracy', accuracy FROM run "
    "UNION ALL SELECT k, algorithm, 'roc_auc', CAST(0.5 AS DOUBLE) FROM run) "
    "SELECT 'exp_' || lpad(CAST(k AS VARCHAR), 6, '0') AS experiment_id, algorithm, metric, value FROM u",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    flat = experiments.experiment_flatten(_stored(spark, sf))
    return experiments.model_comparison(flat, ["f1", "accuracy", "roc_auc"])


# one registry transition per order: the customer's nation is the model, the customer the version
STAGES = (
    "SELECT c_nationkey AS model, c_custkey AS version, CASE o_orderstatus WHEN 'F' THEN 'Production' WHEN 'O' THEN 'Staging' ELSE 'None' END AS stage, "
    "o_orderdate AS event_time, o_orderkey AS event_id FROM orders JOIN customer ON o_custkey = c_custkey"
)
CURRENT = (
    f"ev AS ({STAGES}), own AS (SELECT *, row_number() OVER (PARTITION BY model, version ORDER BY event_time DESC, event_id DESC) AS rn FROM ev), "
    "hold AS (SELECT model, stage, version, row_number() OVER (PARTITION BY model, stage ORDER BY event_time DESC, event_id DESC) AS rn "
    "FROM ev WHERE stage IN ('Staging', 'Production')), "
    "cur AS (SELECT own.model, own.version, CASE WHEN own.stage IN ('Staging', 'Production') AND hold.version <> own.version THEN 'Archived' "
    "ELSE own.stage END AS stage FROM own LEFT JOIN hold ON hold.model = own.model AND hold.stage = own.stage AND hold.rn = 1 WHERE own.rn = 1)"
)


def _transitions(spark: SparkSession, sf: str) -> DataFrame:
    text = STAGES.replace("FROM orders JOIN customer", "FROM {o} JOIN {c}")
    return spark.sql(text, o=table(spark, sf, "orders"), c=table(spark, sf, "customer"))


@query("registry_current", f"WITH {CURRENT} SELECT model, version, stage FROM cur")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.registry_current(_transitions(spark, sf))


@query("registry_latest", f"WITH {CURRENT} SELECT model, stage, max(version) AS version FROM cur GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.registry_latest(experiments.registry_current(_transitions(spark, sf)))


# --------------------------------------------------------------------------- streams

def _log_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = readers.event_stream(spark, f"{sf}/events.parquet")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "anomaly_mitigated")
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("value").alias("latency_ms"),
        status.otherwise("success").alias("status"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("model_version"),
        F.when(F.col("value") > 35, 1).otherwise(0).alias("prediction"),
        F.least(F.lit(1.0), F.col("value") / 400.0).alias("anomaly_score"),
    )


def _line_stream(spark: SparkSession, sf: str) -> DataFrame:
    return readers.event_stream(spark, f"{sf}/lineitem.parquet", "l_shipdate").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key"),
        F.col("l_quantity").alias("f_qty"),
        F.col("l_extendedprice").alias("f_price"),
        F.nullif("l_discount", F.lit(0.0)).alias("f_disc"),
        F.col("l_tax").alias("f_tax"),
    )


@query(
    "stream_traffic",
    ctes(
        ["reqlog"],
        "WITH w AS (SELECT date_trunc('minute', ts) AS s, count(*) AS requests, round(avg(latency_ms), 6) AS avg_latency_ms, "
        "count(*) FILTER (WHERE status = 'error') AS errors FROM reqlog GROUP BY 1) "
        "SELECT s AS start, s + INTERVAL 1 MINUTE AS \"end\", requests, avg_latency_ms, errors FROM w",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    done = monitors.drain_latest(monitors.stream_traffic(_log_stream(spark, sf)), "traffic")
    return _round(monitors.zone_free(done), ["avg_latency_ms"])


@query(
    "stream_traffic_sliding",
    ctes(
        ["reqlog"],
        "WITH x AS (SELECT date_trunc('minute', ts) - to_minutes(i) AS s, latency_ms, status FROM reqlog, range(0, 5) r(i)), "
        "w AS (SELECT s, count(*) AS requests, round(avg(latency_ms), 6) AS avg_latency_ms, "
        "count(*) FILTER (WHERE status = 'error') AS errors FROM x GROUP BY 1) "
        "SELECT s AS start, s + INTERVAL 5 MINUTE AS \"end\", requests, avg_latency_ms, errors FROM w",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    windows = monitors.stream_traffic(_log_stream(spark, sf), "5 minutes", "1 minute")
    return _round(monitors.zone_free(monitors.drain_latest(windows, "sliding")), ["avg_latency_ms"])


@query(
    "stream_anomaly_rate",
    ctes(
        ["reqlog"],
        "WITH w AS (SELECT date_trunc('hour', ts) AS s, count(*) AS rows, count(*) FILTER (WHERE anomaly_score >= 0.25) AS anomalies, "
        "round(avg(CASE WHEN anomaly_score >= 0.25 THEN 1.0 ELSE 0.0 END), 6) AS anomaly_rate FROM reqlog GROUP BY 1) "
        "SELECT s AS start, s + INTERVAL 1 HOUR AS \"end\", rows, anomalies, anomaly_rate FROM w",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rates = monitors.stream_anomaly_rate(_log_stream(spark, sf), F.col("anomaly_score") >= 0.25)
    return _round(monitors.zone_free(monitors.drain_latest(rates, "rate")), ["anomaly_rate"])


COUNTERS = (
    "SELECT 'inference_requests_total' AS metric, 'model_version=' || model_version || ',status=' || status AS labels, count(*) AS value FROM reqlog GROUP BY 2 "
    "UNION ALL SELECT 'predictions_total', 'label=' || CAST(prediction AS VARCHAR), count(*) FROM reqlog GROUP BY 2 "
    "UNION ALL SELECT 'anomalies_detected_total', 'type=ood_input', count(*) FROM reqlog WHERE anomaly_score >= 0.75 HAVING count(*) > 0 "
    "UNION ALL SELECT 'auto_responses_triggered_total', 'action=fallback_conservative_prediction', count(*) FROM reqlog WHERE anomaly_score >= 0.75 HAVING count(*) > 0"
)


@query("stream_counters", ctes(["reqlog"], COUNTERS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return monitors.drain_complete(monitors.stream_counters(_log_stream(spark, sf)), "counters")


@query("stream_score")
def _(spark: SparkSession, sf: str) -> DataFrame:
    feat = view(spark, sf, "feat").select("row_key", "side", "target", *FEATURES)
    reference = feat.filter("side = 'ref'")
    imputer = Imputer.fit(reference, FEATURES)
    model = models.fit(imputer.transform(reference), "logistic_regression", FEATURES)
    profile = anomaly.ReferenceProfile.fit(imputer.transform(reference), FEATURES)
    stream = _line_stream(spark, sf)
    scored = monitors.stream_score(imputer.transform(stream), lambda df: models.batch_score(df, model, FEATURES), profile)
    out = scored.select("row_key", "prediction", F.round("probability", 6).alias("probability"), "oob", "action_taken")
    return monitors.drain_append(out, "score")


# a line through price by quantity, as scored on a stream
@query(
    "stream_score_linear",
    ctes(
        ["feat"],
        "WITH l AS (SELECT regr_slope(f_price, f_qty) AS b, regr_intercept(f_price, f_qty) AS a FROM feat) "
        "SELECT row_key, round(a + b * f_qty, 2) AS prediction, 'inference_normal' AS action_taken FROM feat, l",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    model = models.fit(view(spark, sf, "feat"), "linear_regression", ["f_qty"], "f_price")
    scored = monitors.stream_score(_line_stream(spark, sf), lambda df: models.batch_score(df, model, ["f_qty"]))
    return monitors.drain_append(scored.select("row_key", F.round("prediction", 2).alias("prediction"), "action_taken"), "line")


@query(
    "stream_label_join",
    "SELECT e.event_id AS request_id, CASE WHEN e.value > 35 THEN 1 ELSE 0 END AS prediction, "
    "CASE WHEN e.value > 30 THEN 1 ELSE 0 END AS y_true FROM events e WHERE e.value < 60",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = _log_stream(spark, sf).select("request_id", "ts", "prediction")
    # the label of a request arrives as many minutes later as its value says; after an hour it is too late
    truth = readers.event_stream(spark, f"{sf}/events.parquet").select(
        F.col("event_id").alias("request_id"),
        (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("label_ts"),
        F.when(F.col("value") > 30, 1).otherwise(0).alias("y_true"),
    )
    joined = monitors.stream_label_join(log, truth, within="59 minutes 59 seconds")
    return monitors.drain_append(joined.select("request_id", "prediction", "y_true"), "labels")


@query(
    "stream_route",
    ctes(
        ["reqlog"],
        "SELECT action_taken, count(*) AS requests, CAST(sum(p) AS DOUBLE) AS positive, max(inc) AS incidents FROM (SELECT "
        "CASE WHEN anomaly_score >= 0.75 THEN 'fallback_conservative_prediction' ELSE 'pass' END AS action_taken, "
        "CASE WHEN anomaly_score >= 0.75 THEN 1 ELSE prediction END AS p, "
        "(SELECT count(*) FROM reqlog WHERE anomaly_score >= 0.75) AS inc FROM reqlog) GROUP BY action_taken",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    served, incidents = monitors.stream_route(_log_stream(spark, sf))
    total = incidents.agg(F.count(F.lit(1)).alias("incidents"))
    routed = served.groupBy("action_taken").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("routed_prediction").alias("positive")
    )
    return routed.withColumn("_j", F.lit(1)).join(F.broadcast(total.withColumn("_j", F.lit(1))), "_j").drop("_j")


MONITORED = ["latency_ms", "anomaly_score"]
HIT = "p < 0.05 OR psi > 0.2"


# the requests that were no success are the reference for all requests
@query(
    "stream_drift",
    ctes(
        ["reqlog"],
        "WITH feat AS (SELECT latency_ms, anomaly_score, 'ref' AS side FROM reqlog WHERE status <> 'success' "
        "UNION ALL SELECT latency_ms, anomaly_score, 'cur' FROM reqlog), "
        f"{drift_sql(MONITORED)} SELECT CAST(0 AS BIGINT) AS batch, 'evaluated' AS status, (SELECT count(*) FROM reqlog) AS sample_count, "
        f"round(count(*) FILTER (WHERE {HIT}) / 2.0, 4) AS drift_score, count(*) FILTER (WHERE {HIT}) / 2.0 >= 0.3 AS is_drifted, "
        f"coalesce(string_agg(pv.feature, ',' ORDER BY pv.feature) FILTER (WHERE {HIT}), '') AS drifted_features "
        "FROM pv JOIN psi ON psi.feature = pv.feature",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    reference = view(spark, sf, "reqlog").filter("status <> 'success'").select(*MONITORED)
    return monitors.stream_drift(_log_stream(spark, sf).select(*MONITORED), reference, MONITORED)


@query(
    "stream_bounds",
    ctes(
        ["feat"],
        f"WITH b AS (WITH {bounds_sql('feat')}) SELECT row_key, oob, oob_count, max_z, CAST(0.5 AS DOUBLE) AS probability, "
        "'heuristic_fallback' AS action_taken FROM b",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    profile = anomaly.ReferenceProfile.fit(view(spark, sf, "feat").filter("side = 'ref'"), FEATURES)
    scored = monitors.stream_score(_line_stream(spark, sf), lambda df: models.batch_score(df, None, FEATURES), profile)
    columns = ["row_key", "oob", "oob_count", F.round("max_z", 6).alias("max_z"), "probability", "action_taken"]
    return monitors.drain_append(scored.select(*columns), "bounds")
