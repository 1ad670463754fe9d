"""Queries over metrics, model training, scoring and selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import FEATURES, ctes, query, table, view
from plumbline.operators import metrics, models
from plumbline.operators.features import FeatureTransform, split_random, split_stratified
from plumbline.session import materialise, small_table


def _round(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


RATES = ["accuracy", "precision", "recall", "f1"]

# --------------------------------------------------------------------------- metrics


@query(
    "confusion_matrix",
    ctes(
        ["scored"],
        "WITH g AS (SELECT flag, guess, count(*) AS n FROM scored GROUP BY flag, guess), "
        "c AS (SELECT DISTINCT flag AS k FROM scored UNION SELECT DISTINCT guess FROM scored) "
        "SELECT a.k AS label, b.k AS prediction, coalesce(g.n, 0) AS n FROM c a CROSS JOIN c b "
        "LEFT JOIN g ON g.flag = a.k AND g.guess = b.k",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(view(spark, sf, "scored"), "flag", "guess")


def _binary_sql(threshold: str, source: str = "scored") -> str:
    counts = (
        f"SELECT count(*) AS n, count(*) FILTER (WHERE label = 1 AND score >= {threshold}) AS tp, "
        f"count(*) FILTER (WHERE label = 0 AND score >= {threshold}) AS fp, "
        f"count(*) FILTER (WHERE label = 1 AND score < {threshold}) AS fn, "
        f"count(*) FILTER (WHERE label = 0 AND score < {threshold}) AS tn FROM {source}"
    )
    return (
        "SELECT n, tp, fp, fn, tn, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, "
        "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision, "
        "round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall, "
        f"round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1 FROM ({counts})"
    )


@query("binary_metrics", ctes(["scored"], _binary_sql("0.5")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.binary_metrics(view(spark, sf, "scored")), RATES)


PER_CLASS = (
    "g AS (SELECT flag, guess, count(*) AS n FROM scored GROUP BY flag, guess), "
    "k AS (SELECT DISTINCT flag AS c FROM g UNION SELECT DISTINCT guess FROM g), "
    "p AS (SELECT c, coalesce(sum(n) FILTER (WHERE flag = c), 0) AS support, coalesce(sum(n) FILTER (WHERE guess = c), 0) AS predicted, "
    "coalesce(sum(n) FILTER (WHERE flag = c AND guess = c), 0) AS tp FROM k, g GROUP BY c), "
    "m AS (SELECT c, support, predicted, tp, CASE WHEN predicted = 0 THEN 0 ELSE tp / CAST(predicted AS DOUBLE) END AS precision, "
    "CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END AS recall, "
    "CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / CAST(support + predicted AS DOUBLE) END AS f1 FROM p)"
)


@query(
    "class_metrics",
    ctes(
        ["scored"],
        f"WITH {PER_CLASS} SELECT c AS class, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, "
        "CAST(predicted AS BIGINT) AS predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.class_metrics(view(spark, sf, "scored"), "flag", "guess"), RATES[1:])


@query(
    "weighted_metrics",
    ctes(
        ["scored"],
        f"WITH {PER_CLASS} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, "
        + ", ".join(f"round(sum({m} * support) / sum(support), 6) AS {m}" for m in RATES[1:])
        + " FROM m",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.weighted_metrics(view(spark, sf, "scored"), "flag", "guess"), RATES)


def _auc_sql(label: str, score: str, source: str) -> str:
    return (
        f"SELECT CAST(max(tp) AS BIGINT) AS positives, CAST(max(tn) AS BIGINT) AS negatives, "
        "sum(p * (below + n / CAST(2 AS DOUBLE))) / (max(tp) * CAST(max(tn) AS DOUBLE)) AS auc FROM "
        "(SELECT p, n, sum(n) OVER (ORDER BY v) - n AS below, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM "
        f"(SELECT {score} AS v, count(*) FILTER (WHERE {label}) AS p, count(*) FILTER (WHERE NOT {label}) AS n FROM {source} GROUP BY 1))"
    )


@query(
    "roc_auc",
    ctes(["scored"], f"SELECT positives, negatives, round(auc, 9) AS auc FROM ({_auc_sql('label = 1', 'score', 'scored')})"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.roc_auc(view(spark, sf, "scored")), ["auc"], 9)


OVR = {"A": "s_a", "N": "s_n", "R": "s_r"}


@query(
    "roc_auc_ovr",
    ctes(
        ["scored"],
        "SELECT count(*) AS classes, round(sum(auc * positives) / sum(positives), 9) AS auc, round(avg(auc), 9) AS macro_auc FROM ("
        + " UNION ALL ".join(_auc_sql(f"flag = '{c}'", s, "scored") for c, s in OVR.items())
        + ")",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "scored")
    weighted = metrics.roc_auc_ovr(rows, OVR, "flag")
    macro = metrics.roc_auc_ovr(rows, OVR, "flag", "macro").select("classes", F.col("auc").alias("macro_auc"))
    return _round(weighted.join(macro, "classes"), ["auc", "macro_auc"], 9)


@query(
    "regression_metrics",
    ctes(
        ["scored"],
        "SELECT count(*) AS n, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 4) AS rmse, "
        "round(avg(abs(y_true - y_pred)), 4) AS mae, "
        "round(1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true), 6) AS r2 FROM scored",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.regression_metrics(view(spark, sf, "scored"), "y_true", "y_pred")
    return _round(_round(out, ["rmse", "mae"], 4), ["r2"])


CURVE = (
    "w AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS allp FROM "
    "(SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM scored GROUP BY score)), "
    "c AS (SELECT score, tp, fp, tp / CAST(tp + fp AS DOUBLE) AS pr, tp / CAST(allp AS DOUBLE) AS rc FROM w)"
)


@query(
    "pr_curve",
    ctes(
        ["scored"],
        f"WITH {CURVE} SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
        "round(pr, 6) AS precision, round(rc, 6) AS recall FROM c",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.pr_curve(view(spark, sf, "scored")), ["precision", "recall"])


BEST = (
    f"{CURVE}, b AS (SELECT least(greatest(score, 0.05), 0.95) AS threshold, 2 * pr * rc / (pr + rc + 1e-10) AS f1 FROM c "
    "ORDER BY 2 * pr * rc / (pr + rc + 1e-10) DESC, score LIMIT 1)"
)


@query("optimal_threshold", ctes(["scored"], f"WITH {BEST} SELECT threshold, round(f1, 6) AS f1 FROM b"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.optimal_threshold(view(spark, sf, "scored")), ["f1"])


@query(
    "baseline_compare",
    ctes(
        ["scored"],
        f"WITH {BEST} SELECT 'baseline' AS variant, CAST(0.5 AS DOUBLE) AS threshold, accuracy, precision, recall, f1 "
        f"FROM ({_binary_sql('0.5')}) UNION ALL SELECT 'tuned', (SELECT threshold FROM b), accuracy, precision, recall, f1 "
        f"FROM ({_binary_sql('(SELECT threshold FROM b)')})",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "scored")
    tuned = metrics.optimal_threshold(rows).first()["threshold"]
    return _round(metrics.baseline_compare(rows, tuned), RATES)


@query(
    "latency_percentiles",
    ctes(
        ["reqlog"],
        "SELECT round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, "
        "round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM reqlog",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.latency_percentiles(view(spark, sf, "reqlog")), ["p50", "p95", "p99"])


# --------------------------------------------------------------------------- training and scoring
# trained on the rows of side 'ref', evaluated on the others


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf, "feat").select("row_key", "side", "target", F.col("f_price").alias("price"), *FEATURES)
    ready = FeatureTransform.fit(rows.filter("side = 'ref'"), FEATURES).transform(rows)
    return ready.filter("side = 'ref'"), ready.filter("side = 'cur'")


def _classifier(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        train, test = _sides(spark, sf)
        scored = models.batch_score(test.select("target", *FEATURES), models.fit(train, name, FEATURES), FEATURES, vector=True)
        (found,) = models.evaluate(materialise(scored.drop(*FEATURES), "scored"), "target", "classification")
        rows = [(name, m, round(float(v), 6)) for m, v in found.items()]
        return small_table(spark, rows, "algorithm string, metric string, value double")

    return run


def _regressor(name: str) -> Callable[[SparkSession, str], DataFrame]:
    cols = ["f_qty", "f_disc", "f_tax"]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        train, test = _sides(spark, sf)
        scored = models.batch_score(test, models.fit(train, name, cols, "price"), cols)
        (found,) = models.evaluate(scored, "price", "regression")
        rows = [(name, m, round(float(v), 6)) for m, v in found.items()]
        return small_table(spark, rows, "algorithm string, metric string, value double")

    return run


for _key, _name in {
    "fit_knn": "knn",
    "fit_logistic": "logistic_regression",
    "fit_random_forest": "random_forest",
    "fit_gradient_boosting": "gradient_boosting",
    "fit_decision_tree": "decision_tree",
    "fit_svm": "svm",
}.items():
    query(_key)(_classifier(_name))

for _key, _name in {
    "fit_random_forest_regressor": "random_forest_regressor",
    "fit_gradient_boosting_regressor": "gradient_boosting_regressor",
    "fit_decision_tree_regressor": "decision_tree_regressor",
    "fit_svr": "svm_regressor",
    "fit_knn_regressor": "knn_regressor",
}.items():
    query(_key)(_regressor(_name))


@query(
    "fit_linear",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, "
    "round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    model = models.fit(rows, "linear_regression", ["l_quantity"], "l_extendedprice")
    pair = (round(float(model.coefficients[0]), 3), round(float(model.intercept), 3))
    return small_table(spark, [pair], "slope double, intercept double")


# one round of depth one: the split of the two features that leaves the least squared error, and the means on both sides
@query(
    "fit_boosted_stump",
    "WITH c AS (SELECT 0 AS f, l_quantity AS v, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY l_quantity "
    "UNION ALL SELECT 1, l_discount, sum(l_extendedprice), count(*) FROM lineitem GROUP BY l_discount), "
    "t AS (SELECT sum(l_extendedprice) AS ts, count(*) AS tn FROM lineitem), "
    "u AS (SELECT f, v, sum(s) OVER (PARTITION BY f ORDER BY v) AS sl, sum(n) OVER (PARTITION BY f ORDER BY v) AS nl, ts, tn FROM c, t), "
    "b AS (SELECT * FROM u WHERE nl < tn ORDER BY power(sl - nl * ts / tn, 2) / nl + power(sl - nl * ts / tn, 2) / (tn - nl) DESC, f, v LIMIT 1) "
    "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key, "
    "round(CASE WHEN (CASE WHEN f = 0 THEN l_quantity ELSE l_discount END) <= v THEN sl / nl ELSE (ts - sl) / (tn - nl) END, 2) AS prediction FROM lineitem, b",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key")
    cols = ["l_quantity", "l_discount"]
    rows = table(spark, sf, "lineitem").select(key, *cols, "l_extendedprice")
    one = {"rounds": 1, "depth": 1, "rate": 1.0, "l2": 0.0}
    model = models.fit(rows, "gradient_boosting_regressor", cols, "l_extendedprice", one)
    scored = models.batch_score(rows.select("row_key", *cols), model, cols)
    return _round(scored.select("row_key", "prediction"), ["prediction"], 2)


DISTANCE = (
    "list_aggregate(list_transform(list_zip(q.embedding, t.embedding), "
    "lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])), 'sum')"
)
NEAREST = (
    f"d AS (SELECT q.vec_id AS query, t.vec_id AS id, t.label, {DISTANCE} AS distance FROM embeddings q CROSS JOIN embeddings t), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rn FROM d)"
)


@query("nearest", f"WITH {NEAREST} SELECT query, id, CAST(label AS DOUBLE) AS label, round(distance, 6) AS distance FROM k WHERE rn <= 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return _round(models.nearest(rows, rows, "vec_id", "embedding", "label"), ["distance"])


@query(
    "knn_classify",
    f"WITH {NEAREST}, v AS (SELECT query, label, count(*) AS n FROM k WHERE rn <= 5 GROUP BY query, label), "
    "r AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS best FROM v) "
    "SELECT query, CAST(label AS DOUBLE) AS prediction FROM r WHERE best = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return models.knn_classify(rows, rows, "vec_id", "embedding", "label")


@query(
    "knn_regress",
    f"WITH {NEAREST} SELECT query, round(avg(CAST(label AS DOUBLE)), 6) AS prediction FROM k WHERE rn <= 5 GROUP BY query",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return _round(models.knn_regress(rows, rows, "vec_id", "embedding", "label"), ["prediction"])


@query("cross_validate")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _sides(spark, sf)
    return _round(models.cross_validate(train, "logistic_regression", FEATURES, ["row_key"]), ["value"])


# a line through price by quantity, fitted without each fold in turn
@query(
    "cross_validate_linear",
    ctes(
        ["feat"],
        "WITH k AS (SELECT f_qty AS x, f_price / 1000 AS y, (row_number() OVER (ORDER BY md5('42:' || row_key), row_key) - 1) % 5 AS fold FROM feat), "
        "m AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT DISTINCT fold FROM k) f JOIN k ON k.fold <> f.fold GROUP BY f.fold), "
        "e AS (SELECT k.fold, sqrt(avg(power(y - a - b * x, 2))) AS rmse, avg(abs(y - a - b * x)) AS mae, "
        "1 - avg(power(y - a - b * x, 2)) / var_pop(y) AS r2 FROM k JOIN m ON m.fold = k.fold GROUP BY k.fold) "
        + " UNION ALL ".join(
            f"SELECT 'linear_regression' AS algorithm, 'cv_{m}' AS metric, round(avg({m}), 6) AS value FROM e" for m in ("rmse", "mae", "r2")
        ),
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", "f_qty", (F.col("f_price") / 1000).alias("price"))
    return _round(models.cross_validate(rows, "linear_regression", ["f_qty"], ["row_key"], "price"), ["value"])


def _transformed(parts: DataFrame, cols: list[str]) -> DataFrame:
    """All rows by a transform of the train rows, whose numbers are kept while it is fitted, so that they are split once for its passes."""
    train = parts.filter("split = 'train'").select(*cols).persist()
    try:
        return FeatureTransform.fit(train, cols).transform(parts)
    finally:
        train.unpersist()


@query("train_all")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", "target", *FEATURES)
    ready = _transformed(split_stratified(rows, "target", ["row_key"]), FEATURES)
    small = {"random_forest": {"trees": 20}, "gradient_boosting": {"rounds": 10}}
    names = ["logistic_regression", "random_forest", "gradient_boosting"]
    results, _ = models.train_all(ready, names, FEATURES, params=small, keys=["row_key"], folds=3)
    return _round(results.filter("metric <> 'training_time_sec'"), ["value"])


@query("train_all_regression")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["f_qty", "f_disc", "f_tax"]
    rows = view(spark, sf, "feat").select("row_key", "f_price", *cols)
    ready = _transformed(split_random(rows, ["row_key"]), cols)
    results, _ = models.train_all(ready, ["linear_regression", "decision_tree_regressor", "svm_regressor"], cols, "f_price")
    return _round(results.filter("metric <> 'training_time_sec'"), ["value"])


RESULTS = (
    "r AS (SELECT l_returnflag AS algorithm, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS position, "
    "round(avg(l_tax), 6) AS f1, round(sum(l_quantity) / count(*), 6) AS rmse, round(avg(l_discount), 6) AS r2 "
    "FROM lineitem GROUP BY l_returnflag)"
)


@query(
    "select_best",
    f"WITH {RESULTS}, u AS (SELECT 'f1' AS metric, algorithm, f1 AS value, row_number() OVER (ORDER BY f1 DESC, position) AS rn FROM r UNION ALL "
    "SELECT 'rmse', algorithm, rmse, row_number() OVER (ORDER BY rmse, position) FROM r UNION ALL "
    "SELECT 'r2', algorithm, r2, row_number() OVER (ORDER BY r2 DESC, position) FROM r) "
    "SELECT algorithm, 'test_' || metric AS metric, value FROM u WHERE rn = 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("algorithm")).agg(
        F.round(F.avg("l_tax"), 6).alias("test_f1"),
        F.round(F.sum("l_quantity") / F.count(F.lit(1)), 6).alias("test_rmse"),
        F.round(F.avg("l_discount"), 6).alias("test_r2"),
    )
    order = F.when(F.col("algorithm") == "A", 0).when(F.col("algorithm") == "N", 1).otherwise(2)
    results = wide.withColumn("position", order).unpivot(
        ["algorithm", "position"], ["test_f1", "test_rmse", "test_r2"], "metric", "value"
    )
    best = [models.select_best(results, m) for m in ("f1", "rmse", "r2")]
    return best[0].unionByName(best[1]).unionByName(best[2])


@query("batch_score")
def _(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _sides(spark, sf)
    model = models.fit(train, "logistic_regression", FEATURES)
    scored = models.batch_score(test.select("row_key", *FEATURES), model, FEATURES, threshold=0.4)
    return _round(scored.select("row_key", "prediction", "probability", "action_taken"), ["probability"])


@query(
    "batch_score_fallback",
    ctes(["feat"], "SELECT row_key, CAST(0 AS DOUBLE) AS prediction, CAST(0.5 AS DOUBLE) AS probability, "
    "'heuristic_fallback' AS action_taken FROM feat"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", *FEATURES)
    return models.batch_score(rows, None, FEATURES).select("row_key", "prediction", "probability", "action_taken")


@query(
    "batch_score_linear",
    "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key, "
    "round(a + b * l_quantity, 2) AS prediction, 'inference_normal' AS action_taken FROM lineitem, "
    "(SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key")
    rows = table(spark, sf, "lineitem").select(key, "l_quantity", "l_extendedprice")
    model = models.fit(rows, "linear_regression", ["l_quantity"], "l_extendedprice")
    scored = models.batch_score(rows.select("row_key", "l_quantity"), model, ["l_quantity"])
    return _round(scored.select("row_key", "prediction", "action_taken"), ["prediction"], 2)
