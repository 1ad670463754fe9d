"""Queries over gates, drift, anomalies and traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import FEATURES, ctes, query, table, view
from plumbline.operators import anomaly, drift, gates, models, traffic
from plumbline.operators.features import Imputer
from plumbline.session import scratch_path
from plumbline.sources import writers


def is_ref() -> Column:
    return F.col("side") == "ref"


def _round(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _gate(df: DataFrame, *details: str) -> DataFrame:
    """A gate row with the wanted details as columns."""
    return df.select(
        "gate", "passed", F.round("score", 6).alias("score"), *[F.col("details").getItem(d).alias(d) for d in details]
    )


# --------------------------------------------------------------------------- drift


def _cum(feature: str) -> str:
    """Distinct values of one feature with counts and running counts per side."""
    return (
        f"SELECT '{feature}' AS feature, v, r, c, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER () AS nr, "
        "sum(c) OVER () AS nc, lead(v) OVER w AS nx FROM "
        f"(SELECT {feature} AS v, count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'cur') AS c "
        f"FROM feat WHERE {feature} IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY v)"
    )


def _cum_sql(features: list[str]) -> str:
    return "cum AS (" + " UNION ALL ".join(_cum(f) for f in features) + ")"


CUM = _cum_sql(FEATURES)
GAP = "abs(cr / CAST(nr AS DOUBLE) - cc / CAST(nc AS DOUBLE))"
KS = f"ks AS (SELECT feature, max(nr) AS nr, max(nc) AS nc, max({GAP}) AS d, sum({GAP} * coalesce(nx - v, 0)) AS w FROM cum GROUP BY feature)"
LAMBDA = "(sqrt(nr * CAST(nc AS DOUBLE) / (nr + nc)) + 0.12 + 0.11 / sqrt(nr * CAST(nc AS DOUBLE) / (nr + nc))) * d"
TAIL = " + ".join(f"({2 if j % 2 else -2}) * exp(-2 * {j * j} * lam * lam)" for j in range(1, 5))
HEAD = " + ".join(f"exp(-{(2 * j - 1) ** 2} * pi() * pi() / 8 / (lam * lam))" for j in range(1, 5))
PVALUE = (
    f"pv AS (SELECT feature, d, w, CASE WHEN lam <= 0.04 THEN 1 ELSE least(greatest(CASE WHEN lam < 1.18 "
    f"THEN 1 - sqrt(2 * pi()) / lam * ({HEAD}) ELSE {TAIL} END, 0), 1) END AS p FROM (SELECT *, {LAMBDA} AS lam FROM ks))"
)


def _psi_sql(features: list[str]) -> str:
    edges = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, i, round(CASE WHEN i = 0 THEN q[i + 1] - 1e-4 WHEN i = 10 THEN q[i + 1] + 1e-4 ELSE q[i + 1] END, 9) AS e "
        f"FROM (SELECT quantile_cont({f}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM feat "
        f"WHERE side = 'ref' AND {f} IS NOT NULL), range(0, 11) t(i)"
        for f in features
    )
    return (
        f"edges AS ({edges}), bins AS (SELECT a.feature, a.i, a.e AS lo, b.e AS hi FROM edges a JOIN edges b ON a.feature = b.feature AND b.i = a.i + 1), "
        "cnt AS (SELECT bins.feature, bins.i, coalesce(sum(r), 0) AS r, coalesce(sum(c), 0) AS c FROM bins LEFT JOIN cum ON cum.feature = bins.feature "
        "AND v >= lo AND (v < hi OR (bins.i = 9 AND v <= hi)) GROUP BY bins.feature, bins.i), "
        "sh AS (SELECT cnt.feature, r / CAST(nr AS DOUBLE) + 1e-4 AS rp, c / CAST(nc AS DOUBLE) + 1e-4 AS cp FROM cnt JOIN ks ON ks.feature = cnt.feature), "
        "psi AS (SELECT feature, least(greatest(sum((cp - rp) * ln(cp / rp)), 0), 10) AS psi FROM sh GROUP BY feature)"
    )


PSI = _psi_sql(FEATURES)


def drift_sql(features: list[str]) -> str:
    """CTEs pv (feature, d, w, p) and psi (feature, psi) over a table feat with a column side."""
    return f"{_cum_sql(features)}, {KS}, {PVALUE}, {_psi_sql(features)}"


ALL_DRIFT = drift_sql(FEATURES)


def _feat(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "feat").select(*FEATURES, "side")


@query("ks_statistic", ctes(["feat"], f"WITH {CUM}, {KS} SELECT feature, CAST(nr AS BIGINT) AS n_ref, CAST(nc AS BIGINT) AS n_cur, round(d, 9) AS ks_statistic FROM ks"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(drift.ks_statistic(_feat(spark, sf), FEATURES, is_ref()), ["ks_statistic"], 9)


@query("ks_pvalue", ctes(["feat"], f"WITH {CUM}, {KS}, {PVALUE} SELECT feature, round(d, 9) AS ks_statistic, round(p, 6) AS p_value FROM pv"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.ks_test(_feat(spark, sf), FEATURES, is_ref()).select("feature", "ks_statistic", "p_value")
    return _round(_round(out, ["ks_statistic"], 9), ["p_value"])


# The exact law for small samples: steps of a random order of both, and the probability of each place never having been d apart.
# Balances of suppliers of the first twelve nations against the others'.
KS_SMALL = (
    "WITH RECURSIVE v AS (SELECT s_acctbal AS v, CASE WHEN s_nationkey < 12 THEN 1 ELSE 0 END AS r FROM supplier), "
    "c AS (SELECT v, sum(sum(r)) OVER (ORDER BY v) AS cr, sum(sum(1 - r)) OVER (ORDER BY v) AS cc FROM v GROUP BY v), "
    "z AS (SELECT (SELECT sum(r) FROM v) AS nr, (SELECT sum(1 - r) FROM v) AS nc), "
    "k AS (SELECT CAST(nr AS BIGINT) AS nr, CAST(nc AS BIGINT) AS nc, max(abs(cr / CAST(nr AS DOUBLE) - cc / CAST(nc AS DOUBLE))) AS d FROM c, z GROUP BY nr, nc), "
    "g AS (SELECT least(nr, nc) AS n, greatest(nr, nc) AS m, d, round(d * nr * nc) AS b FROM k), "
    "w AS (SELECT CAST(0 AS BIGINT) AS s, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS p FROM g "
    "UNION ALL SELECT w.s + 1, list_transform(range(0, g.n + 1), lambda i: CASE WHEN w.s + 1 - i >= 0 AND w.s + 1 - i <= g.m "
    "AND abs(i * g.m - (w.s + 1 - i) * g.n) < g.b THEN (w.p[i + 1] * (g.m - (w.s + 1 - i) + 1) + "
    "CASE WHEN i > 0 THEN w.p[i] * (g.n - i + 1) ELSE 0 END) / CAST(g.n + g.m - w.s AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) FROM w, g WHERE w.s < g.n + g.m) "
    "SELECT 's_acctbal' AS feature, k.nr AS n_ref, k.nc AS n_cur, round(k.d, 9) AS ks_statistic, round(1 - w.p[g.n + 1], 6) AS p_value "
    "FROM k, g, w WHERE w.s = g.n + g.m"
)


@query("ks_pvalue_small", KS_SMALL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.ks_test(table(spark, sf, "supplier"), ["s_acctbal"], F.col("s_nationkey") < 12)
    return _round(_round(out, ["ks_statistic"], 9), ["p_value"])


@query("wasserstein", ctes(["feat"], f"WITH {CUM}, {KS} SELECT feature, round(w, 6) AS wasserstein_distance FROM ks"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(drift.wasserstein(_feat(spark, sf), FEATURES, is_ref()), ["wasserstein_distance"])


@query("psi", ctes(["feat"], f"WITH {CUM}, {KS}, {PSI} SELECT feature, round(psi, 9) AS psi FROM psi"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(drift.psi(_feat(spark, sf), FEATURES, is_ref(), edge_digits=9), ["psi"], 9)


DRIFTED = "p < 0.05 OR psi > 0.2"


@query(
    "drift_features",
    ctes(
        ["feat"],
        f"WITH {ALL_DRIFT} SELECT pv.feature, round(d, 6) AS ks_statistic, round(p, 6) AS p_value, "
        f"round(w, 6) AS wasserstein_distance, round(psi, 6) AS psi, {DRIFTED} AS is_drifted FROM pv JOIN psi ON psi.feature = pv.feature",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.drift_features(_feat(spark, sf), FEATURES, is_ref(), edge_digits=9)
    return _round(out, ["ks_statistic", "p_value", "wasserstein_distance", "psi"])


REPORT = (
    f"rep AS (SELECT CAST(4 AS BIGINT) AS total_features, count(*) FILTER (WHERE {DRIFTED}) / CAST(4 AS DOUBLE) AS drift_score, "
    f"coalesce(string_agg(pv.feature, ',' ORDER BY pv.feature) FILTER (WHERE {DRIFTED}), '') AS drifted_features "
    "FROM pv JOIN psi ON psi.feature = pv.feature)"
)


@query(
    "drift_report",
    ctes(["feat"], f"WITH {ALL_DRIFT}, {REPORT} SELECT total_features, drift_score, drift_score >= 0.3 AS is_drifted, drifted_features FROM rep"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = drift.drift_features(_feat(spark, sf), FEATURES, is_ref(), edge_digits=9)
    report = drift.drift_report(found, len(FEATURES))
    return report.withColumn("drifted_features", F.array_join("drifted_features", ","))


@query(
    "drift_response",
    ctes(
        ["feat"],
        f"WITH {ALL_DRIFT}, {REPORT} SELECT drift_score, drift_score >= 0.4 AS triggered, "
        "CASE WHEN drift_score >= 0.4 THEN 'flag_retrain_quarantine' ELSE 'pass' END AS action_taken FROM rep",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = drift.drift_features(_feat(spark, sf), FEATURES, is_ref(), edge_digits=9)
    return traffic.drift_response(drift.drift_report(found, len(FEATURES)))


@query(
    "feature_health",
    ctes(
        ["feat"],
        f"WITH {ALL_DRIFT}, mis AS ("
        + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) - count({f}) AS missing FROM feat" for f in FEATURES)
        + f") SELECT pv.feature, missing, round(d, 6) AS ks_statistic, round(p, 6) AS p_value, round(w, 6) AS wasserstein_distance, "
        f"round(psi, 6) AS psi, {DRIFTED} AS is_drifted FROM pv JOIN psi ON psi.feature = pv.feature JOIN mis ON mis.feature = pv.feature",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.feature_health(_feat(spark, sf), FEATURES, is_ref(), edge_digits=9)
    return _round(out, ["ks_statistic", "p_value", "wasserstein_distance", "psi"])


# --------------------------------------------------------------------------- gates


def _js_sql(cells: str, eps: str) -> str:
    return (
        f"js AS (SELECT least(greatest(sum(0.5 * p * ln((p + 1e-10) / ((p + q) * 0.5 + 1e-10)) + "
        "0.5 * q * ln((q + 1e-10) / ((p + q) * 0.5 + 1e-10))), 0), 1) AS js, max(tr) AS n_ref, max(tc) AS n_cur FROM "
        f"(SELECT r / (CAST(sum(r) OVER () AS DOUBLE) + {eps}) AS p, c / (CAST(sum(c) OVER () AS DOUBLE) + {eps}) AS q, "
        f"CAST(sum(r) OVER () AS BIGINT) AS tr, CAST(sum(c) OVER () AS BIGINT) AS tc FROM ({cells})))"
    )


SIDES = "count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'cur') AS c"
LABEL_JS = _js_sql(f"SELECT target, {SIDES} FROM feat GROUP BY target", "0")


@query("label_js_divergence", ctes(["feat"], f"WITH {LABEL_JS} SELECT round(js, 9) AS js_divergence, n_ref, n_cur FROM js"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(gates.label_js_divergence(view(spark, sf, "feat"), "target", is_ref()), ["js_divergence"], 9)


VALUE_JS = _js_sql(
    f"SELECT b, {SIDES} FROM (SELECT side, least(floor((f_price - lo) / ((hi - lo) / 20)), 19) AS b FROM feat, "
    "(SELECT min(f_price) AS lo, max(f_price) AS hi FROM feat)) GROUP BY b",
    "1e-10",
)


@query("value_js_divergence", ctes(["feat"], f"WITH {VALUE_JS} SELECT round(js, 9) AS js_divergence, n_ref, n_cur FROM js"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(gates.value_js_divergence(view(spark, sf, "feat"), "f_price", is_ref()), ["js_divergence"], 9)


# a limit that the given table crosses; the default of 5 is crossed by no row
Z_LIMIT = 1.7
ZSCORE = (
    "st AS (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES)
    + " FROM feat WHERE side = 'ref'), "
    "z AS (SELECT {far} AS far FROM feat, st WHERE side = 'cur')"
)


def _far(limit: float) -> str:
    return " OR ".join(f"coalesce(abs(({f} - m_{f}) / (s_{f} + 1e-10)) > {limit}, FALSE)" for f in FEATURES)


@query(
    "zscore_anomaly_rate",
    ctes(
        ["feat"],
        f"WITH {ZSCORE.format(far=_far(Z_LIMIT))} SELECT count(*) AS n, count(*) FILTER (WHERE far) AS anomalies, "
        "round(avg(CASE WHEN far THEN 1.0 ELSE 0.0 END), 9) AS anomaly_rate FROM z",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(gates.zscore_anomaly_rate(_feat(spark, sf), FEATURES, is_ref(), Z_LIMIT), ["anomaly_rate"], 9)


INTEGRITY = (
    f"{LABEL_JS}, {ZSCORE.format(far=_far(5.0))}, rt AS (SELECT avg(CASE WHEN far THEN 1.0 ELSE 0.0 END) AS rate FROM z), "
    "ig AS (SELECT js <= 0.05 AND rate <= 0.10 AS passed, least(greatest(1 - js - 0.5 * rate, 0), 1) AS score FROM js, rt)"
)


@query(
    "data_integrity_gate",
    ctes(["feat"], f"WITH {INTEGRITY} SELECT 'data_integrity' AS gate, passed, round(score, 6) AS score FROM ig"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _gate(gates.data_integrity_gate(view(spark, sf, "feat"), FEATURES, "target", is_ref()))


@query("adversarial_gate")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat")
    filled = Imputer.fit(rows.filter(is_ref()), FEATURES).transform(rows)
    model = models.fit(filled.filter(is_ref()), "logistic_regression", FEATURES)
    gate = gates.adversarial_gate(filled.filter(~is_ref()), model, FEATURES, "target", ["row_key"])
    return _gate(gate, "n_samples", "clean_accuracy", "flat_share")


@query("checksum_scan")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return gates.checksum_scan(spark, sf, "*.parquet").drop("path", "file")


@query("checksum_gate")
def _(spark: SparkSession, sf: str) -> DataFrame:
    manifest = scratch_path(spark, "manifest")
    gates.verify_files(spark, sf, manifest, "*.parquet")  # stores every file
    return _gate(gates.verify_files(spark, sf, manifest, "*.parquet"), "matched", "changed", "missing", "new")


RULES = " UNION ALL ".join(
    f"SELECT doc_id, '{rule}' AS rule, '{severity}' AS severity, unnest(regexp_extract_all(text, '"
    + pattern.replace("'", "''")
    + "', 1)) AS secret FROM documents"
    for rule, severity, pattern in gates.SECRET_PATTERNS
)


@query("secret_findings", RULES)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return gates.secret_findings(table(spark, sf, "documents"), "text", ["doc_id"])


@query(
    "top_findings",
    f"WITH f AS ({RULES}) SELECT * FROM f WHERE severity = 'HIGH' ORDER BY doc_id, rule, secret LIMIT 10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = gates.secret_findings(table(spark, sf, "documents"), "text", ["doc_id"])
    return gates.top_findings(found, ["doc_id", "rule", "secret"])


SECRETS = (
    f"f AS ({RULES}), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'HIGH') AS h, "
    "count(*) FILTER (WHERE severity = 'MEDIUM') AS m FROM f), "
    "sg AS (SELECT h = 0 AS passed, least(greatest(1 - 0.2 * h - 0.05 * m, 0), 1) AS score, h, m, total FROM n)"
)


@query(
    "secrets_scan",
    f"WITH {SECRETS} SELECT 'secrets_scan' AS gate, passed, CAST(round(score, 6) AS DOUBLE) AS score, "
    "CAST(h AS VARCHAR) AS high_severity, CAST(m AS VARCHAR) AS medium_severity, CAST(total AS VARCHAR) AS total_issues FROM sg",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = gates.secret_findings(table(spark, sf, "documents"), "text", ["doc_id"])
    return _gate(gates.secrets_scan(found), "high_severity", "medium_severity", "total_issues")


# a finding in an English text counts as critical, any other as high
@query(
    "findings_gate",
    f"WITH f AS ({RULES}), s AS (SELECT CASE WHEN lang = 'en' THEN 'CRITICAL' ELSE 'high' END AS severity FROM f JOIN documents USING (doc_id)), "
    "n AS (SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'high') AS h FROM s) "
    "SELECT 'dependency_audit' AS gate, c <= 0 AND h <= 2 AS passed, CAST(round(least(greatest(1 - 0.5 * c - 0.1 * h, 0), 1), 6) AS DOUBLE) AS score, "
    "CAST(c AS VARCHAR) AS critical, CAST(h AS VARCHAR) AS high FROM n",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = gates.secret_findings(table(spark, sf, "documents"), "text", ["doc_id", "lang"])
    severity = F.when(F.col("lang") == "en", "CRITICAL").otherwise("high")
    return _gate(gates.findings_gate(found.withColumn("severity", severity)), "critical", "high")


@query(
    "gate_rollup",
    ctes(
        ["feat"],
        f"WITH {INTEGRITY}, {SECRETS}, u AS (SELECT passed, score FROM ig UNION ALL SELECT passed, CAST(score AS DOUBLE) FROM sg) "
        "SELECT count(*) AS gates, count(*) FILTER (WHERE passed) AS passed, bool_and(passed) AS overall_passed, "
        "round(avg(score), 6) AS overall_score FROM u",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = gates.secret_findings(table(spark, sf, "documents"), "text", ["doc_id"])
    rows = gates.run_gates(
        [
            gates.secrets_scan(found),
            gates.data_integrity_gate(view(spark, sf, "feat"), FEATURES, "target", is_ref()),
        ]
    )
    return _round(gates.gate_rollup(rows), ["overall_score"])


# --------------------------------------------------------------------------- anomalies

PROFILE = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg({f}) AS mean, stddev_pop({f}) + 1e-8 AS std, min({f}) - 3 * (stddev_pop({f}) + 1e-8) AS low, "
    f"max({f}) + 3 * (stddev_pop({f}) + 1e-8) AS high FROM feat WHERE side = 'ref'"
    for f in FEATURES
)


@query(
    "anomaly_profile",
    ctes(["feat"], "SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high "
    f"FROM ({PROFILE})"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").filter(is_ref())
    return _round(anomaly.anomaly_profile(rows, FEATURES), ["mean", "std", "low", "high"])


# the current rows with a tenth of them moved far out, so that the bounds have something to find
MOVED = (
    "SELECT row_key, CASE WHEN f_qty >= 46 THEN f_qty * 5 ELSE f_qty END AS f_qty, f_price, f_disc, "
    "CASE WHEN f_qty <= 2 THEN f_tax - 1 ELSE f_tax END AS f_tax FROM feat WHERE side = 'cur'"
)


def _moved(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(MOVED.replace("FROM feat", "FROM {src}"), src=view(spark, sf, "feat"))


def _outside(f: str) -> str:
    return f"coalesce(abs(({f} - m_{f}) / s_{f}) > 4.5 OR {f} < lo_{f} OR {f} > hi_{f}, FALSE)"


def bounds_sql(source: str) -> str:
    """CTE pr (the reference profile) and the verdict columns over a table ``source`` of features."""
    return (
        "pr AS (SELECT "
        + ", ".join(
            f"avg({f}) AS m_{f}, stddev_pop({f}) + 1e-8 AS s_{f}, min({f}) - 3 * (stddev_pop({f}) + 1e-8) AS lo_{f}, "
            f"max({f}) + 3 * (stddev_pop({f}) + 1e-8) AS hi_{f}"
            for f in FEATURES
        )
        + " FROM feat WHERE side = 'ref') SELECT row_key, "
        + " OR ".join(_outside(f) for f in FEATURES)
        + " AS oob, concat_ws(',', "
        + ", ".join(f"CASE WHEN {_outside(f)} THEN '{f}' END" for f in FEATURES)
        + ") AS oob_features, CAST("
        + " + ".join(f"({_outside(f)})::INT" for f in FEATURES)
        + " AS BIGINT) AS oob_count, round(greatest("
        + ", ".join(f"coalesce(abs(({f} - m_{f}) / s_{f}), 0)" for f in FEATURES)
        + f"), 6) AS max_z FROM {source}, pr"
    )


@query("bounds_check", ctes(["feat"], f"WITH mv AS ({MOVED}), {bounds_sql('mv')}"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = anomaly.bounds_check(_moved(spark, sf), view(spark, sf, "feat").filter(is_ref()), FEATURES)
    return out.select(
        "row_key", "oob", F.array_join("oob_features", ",").alias("oob_features"), "oob_count", F.round("max_z", 6).alias("max_z")
    )


def _reference(spark: SparkSession, sf: str) -> tuple[DataFrame, Imputer]:
    rows = view(spark, sf, "feat").filter(is_ref()).select("row_key", *FEATURES)
    imputer = Imputer.fit(rows, FEATURES)
    return imputer.transform(rows), imputer


@query("isolation_forest")
def _(spark: SparkSession, sf: str) -> DataFrame:
    reference, imputer = _reference(spark, sf)
    forest = anomaly.IsolationForest.fit(reference, FEATURES, ["row_key"])
    every = imputer.transform(view(spark, sf, "feat").select("row_key", *FEATURES))
    scored = forest.score(every).select("row_key", F.round("decision", 6).alias("decision"), "outlier")
    return scored


@query("anomaly_report")
def _(spark: SparkSession, sf: str) -> DataFrame:
    reference, imputer = _reference(spark, sf)
    profile = anomaly.ReferenceProfile.fit(reference, FEATURES)
    forest = anomaly.IsolationForest.fit(reference, FEATURES, ["row_key"])
    batches = imputer.transform(_moved(spark, sf)).withColumn("batch", F.split("row_key", "-")[2])
    report = anomaly.anomaly_report(anomaly.anomaly_rows(batches, profile, forest), "batch", FEATURES)
    return report.withColumn("out_of_bounds_features", F.array_join("out_of_bounds_features", ","))


# the part of the report that SQL can say: what leaves the bounds, by batch
@query(
    "anomaly_report_bounds",
    ctes(
        ["feat"],
        f"WITH mv AS ({MOVED}), {bounds_sql('mv').replace(') SELECT row_key, ', '), b AS (SELECT row_key, ', 1)}) "
        "SELECT split_part(row_key, '-', 3) AS batch, count(*) AS rows, max(max_z) AS max_z_score, concat_ws(',', "
        + ", ".join(f"CASE WHEN bool_or(contains(oob_features, '{f}')) THEN '{f}' END" for f in FEATURES)
        + ") AS out_of_bounds_features, CAST("
        + " + ".join(f"bool_or(contains(oob_features, '{f}'))::INT" for f in FEATURES)
        + " AS BIGINT) AS oob_count FROM b GROUP BY 1",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    profile = anomaly.ReferenceProfile.fit(view(spark, sf, "feat").filter(is_ref()), FEATURES)
    rows = profile.apply(_moved(spark, sf)).withColumns({"outlier": F.lit(False), "decision": F.lit(0.0), "batch": F.split("row_key", "-")[2]})
    report = anomaly.anomaly_report(rows, "batch", FEATURES)
    return report.select(
        "batch", "rows", F.round("max_z_score", 6).alias("max_z_score"), F.array_join("out_of_bounds_features", ",").alias("out_of_bounds_features"), "oob_count"
    )


# --------------------------------------------------------------------------- traffic


@query(
    "route_anomalies",
    ctes(
        ["reqlog"],
        "SELECT request_id, anomaly_score >= 0.75 AS triggered, "
        "CASE WHEN anomaly_score >= 0.75 THEN 'fallback_conservative_prediction' ELSE 'pass' END AS action_taken, "
        "CAST(CASE WHEN anomaly_score >= 0.75 THEN 1 ELSE prediction END AS DOUBLE) AS routed_prediction, "
        "CASE WHEN anomaly_score >= 0.75 THEN CAST(1 AS DOUBLE) END AS routed_probability FROM reqlog",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.route(view(spark, sf, "reqlog")).select(
        "request_id", "triggered", "action_taken", "routed_prediction", "routed_probability"
    )


INCIDENTS = (
    "SELECT 'inc_anom_' || CAST(request_id AS VARCHAR) AS incident_id, 'input_anomaly' AS type, anomaly_score, "
    "CAST(0.75 AS DOUBLE) AS threshold, 'fallback_conservative_prediction' AS action, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM reqlog WHERE anomaly_score >= 0.75"
)


@query("incident_log_append", ctes(["reqlog"], INCIDENTS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "incidents")
    found = traffic.incidents(traffic.route(view(spark, sf, "reqlog")), "request_id", "ts")
    for part in (F.col("anomaly_score") < 1.0, F.col("anomaly_score") >= 1.0):
        writers.append_incidents(found.filter(part), path)
    return spark.read.schema(found.schema).json(path)


@query(
    "prediction_log_append",
    ctes(["reqlog"], "SELECT CAST(ts AS DATE) AS day, status, model_version, count(*) AS n, round(sum(latency_ms), 4) AS latency FROM reqlog GROUP BY 1, 2, 3"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    log = view(spark, sf, "reqlog")
    for status in ("status = 'error'", "status <> 'error'"):
        writers.append_predictions(log.filter(status), path)
    return (
        spark.read.parquet(path)
        .groupBy("day", "status", "model_version")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_ms"), 4).alias("latency"))
    )


STATS = (
    "count(*) AS total_requests, round(avg(latency_ms), 2) AS avg_latency_ms, "
    "count(*) FILTER (WHERE status NOT IN ('success', 'anomaly_mitigated')) AS error_count, "
    "round(count(*) FILTER (WHERE status NOT IN ('success', 'anomaly_mitigated')) * CAST(100 AS DOUBLE) / count(*), 2) AS error_rate_pct, "
    "max(ts) AS latest_activity"
)


@query("traffic_stats", ctes(["reqlog"], f"SELECT {STATS} FROM reqlog"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.traffic_stats(view(spark, sf, "reqlog"))


@query("traffic_by_version", ctes(["reqlog"], f"SELECT model_version, {STATS} FROM reqlog GROUP BY model_version"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.traffic_stats(view(spark, sf, "reqlog"), by=["model_version"])


@query("requests_per_minute", ctes(["reqlog"], "SELECT date_trunc('minute', ts) AS minute, count(*) AS requests FROM reqlog GROUP BY 1"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.requests_per_minute(view(spark, sf, "reqlog")).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(
    "latency_histogram",
    ctes(
        ["reqlog"],
        " UNION ALL ".join(
            f"SELECT '{b}' AS le, count(*) FILTER (WHERE latency_ms / 1000.0 <= {b}) AS requests, "
            "round(sum(latency_ms / 1000.0), 6) AS latency_sum, count(*) AS n FROM reqlog"
            for b in traffic.LATENCY_BOUNDS
        )
        + " UNION ALL SELECT '+Inf', count(latency_ms), round(sum(latency_ms / 1000.0), 6), count(*) FROM reqlog",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(traffic.latency_histogram(view(spark, sf, "reqlog")), ["latency_sum"])


@query(
    "latency_bins",
    ctes(
        ["reqlog"],
        "WITH r AS (SELECT min(latency_ms) AS lo, max(latency_ms) AS hi FROM reqlog), "
        "b AS (SELECT CAST(least(floor((latency_ms - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi FROM reqlog, r) "
        "SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS low, round(lo + (bin + 1) * (hi - lo) / 20, 6) AS high, count(*) AS n "
        "FROM b GROUP BY bin, lo, hi",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(traffic.latency_bins(view(spark, sf, "reqlog")), ["low", "high"])


COUNTERS = (
    "SELECT 'inference_requests_total' AS metric, 'model_version=' || model_version || ',status=' || status AS labels, count(*) AS value FROM reqlog GROUP BY 2 "
    "UNION ALL SELECT 'predictions_total', 'label=' || CAST(prediction AS VARCHAR), count(*) FROM reqlog GROUP BY 2 "
    "UNION ALL SELECT 'anomalies_detected_total', 'type=ood_input', count(*) FROM reqlog WHERE anomaly_score >= 0.75 HAVING count(*) > 0 "
    "UNION ALL SELECT 'auto_responses_triggered_total', 'action=fallback_conservative_prediction', count(*) FROM reqlog WHERE anomaly_score >= 0.75 HAVING count(*) > 0"
)


@query("counters", ctes(["reqlog"], COUNTERS))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.counters(view(spark, sf, "reqlog"))


@query(
    "gauges",
    ctes(
        ["reqlog"],
        "SELECT 'data_drift_score' AS metric, 'model_version=' || model_version AS labels, "
        "arg_max(anomaly_score, ts) AS value FROM reqlog GROUP BY model_version UNION ALL "
        "SELECT 'security_gate_status', 'gate_name=' || status, arg_max(CAST(prediction AS DOUBLE), ts) FROM reqlog GROUP BY status",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = view(spark, sf, "reqlog")
    scores = traffic.gauges(log, "data_drift_score", "anomaly_score", "ts", ["model_version"])
    status = log.withColumn("gate_name", F.col("status"))
    return scores.unionByName(traffic.gauges(status, "security_gate_status", "prediction", "ts", ["gate_name"]))


@query("recent_requests", ctes(["reqlog"], "SELECT * FROM reqlog ORDER BY ts DESC, request_id DESC LIMIT 20"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.recent_requests(view(spark, sf, "reqlog"), "ts", "request_id")


@query(
    "label_join",
    ctes(["reqlog", "truth"], "SELECT r.request_id, prediction, y_true FROM reqlog r JOIN truth t ON r.request_id = t.request_id"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    joined = traffic.label_join(view(spark, sf, "reqlog"), view(spark, sf, "truth"))
    return joined.select("request_id", "prediction", "y_true")


@query(
    "performance_drift",
    ctes(
        ["reqlog", "truth"],
        "WITH j AS (SELECT prediction AS p, y_true AS y FROM reqlog r JOIN truth t ON r.request_id = t.request_id), "
        "k AS (SELECT c, (SELECT count(*) FROM j WHERE y = c) AS s, (SELECT count(*) FROM j WHERE p = c) AS pr, "
        "(SELECT count(*) FROM j WHERE p = c AND y = c) AS tp FROM (VALUES (0), (1)) v(c)) "
        "SELECT 'evaluated' AS status, CAST(sum(s) AS BIGINT) AS sample_count, round(sum(tp) / CAST(sum(s) AS DOUBLE), 6) AS current_accuracy, "
        "round(sum(s * CASE WHEN s + pr = 0 THEN 0 ELSE 2 * tp / CAST(s + pr AS DOUBLE) END) / sum(s), 6) AS current_f1 FROM k",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = traffic.performance_drift(view(spark, sf, "reqlog"), view(spark, sf, "truth"))
    return _round(out, ["current_accuracy", "current_f1"])
