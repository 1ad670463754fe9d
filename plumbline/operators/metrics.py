"""Evaluation metrics as aggregates over (label, prediction, score)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip, col, ratio
from plumbline.plans.ranks import RankTable, exact_quantiles, ranged_row_number
from plumbline.session import materialise, small_table


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) over the full grid of labels and predictions, zeros included.

    Classes are numbered, and each class gets a row for every number, so the class list is nowhere whole.
    """
    pairs = df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = materialise(pairs, "confusion")
    classes = pairs.select(F.explode(F.array("label", "prediction")).alias("c")).filter("c is not null").distinct()
    numbered = ranged_row_number(classes, ["c"], "i")
    k = numbered.count()
    if k == 0:
        return pairs
    grid = (
        numbered.select(F.col("c").alias("label"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))).alias("i"))
        .join(numbered.withColumnRenamed("c", "prediction"), "i")
        .select("label", "prediction")
    )
    return grid.join(pairs, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def _binary(label: Column, positive: Column) -> list[Column]:
    y = label == 1
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & positive).alias("tp"),
        F.count_if(~y & positive).alias("fp"),
        F.count_if(y & ~positive).alias("fn"),
        F.count_if(~y & ~positive).alias("tn"),
    ]


def _rates(n: Column, tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    return [
        ratio(tp + tn, n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def binary_metrics(
    df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5
) -> DataFrame:
    """One row: n, tp, fp, fn, tn, accuracy, precision, recall, f1 of class 1 at score >= threshold."""
    counts = df.agg(*_binary(col(label), col(score) >= threshold))
    cells = [F.col(c) for c in ("n", "tp", "fp", "fn", "tn")]
    return counts.select(*cells, *_rates(*cells))


def baseline_compare(
    df: DataFrame, threshold: float, label: str = "label", score: str = "score", baseline: float = 0.5
) -> DataFrame:
    """The rates at the baseline threshold and at the tuned one, from one scan: (variant, threshold, rates)."""
    names = ("n", "tp", "fp", "fn", "tn")
    both = df.agg(
        *[
            e.alias(f"{c}{i}")
            for i, t in enumerate((baseline, threshold))
            for c, e in zip(names, _binary(col(label), col(score) >= t), strict=True)
        ]
    )
    rows = [
        F.struct(
            F.lit(name).alias("variant"),
            F.lit(float(t)).alias("threshold"),
            *_rates(*[F.col(f"{c}{i}") for c in names]),
        )
        for i, (name, t) in enumerate((("baseline", baseline), ("tuned", threshold)))
    ]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, support, tp, predicted, precision, recall, f1) from the counted pairs."""
    pairs = df.groupBy(col(label).alias("y"), col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    same = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.explode(
        F.array(
            F.struct(F.col("y").alias("class"), F.col("n").alias("support"), same.alias("tp"), F.lit(0).cast("bigint").alias("predicted")),
            F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted")),
        )
    )
    per = (
        pairs.select(sides.alias("s")).select("s.*").groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"))
    )
    return per.select(
        "class", "support", "tp", "predicted",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: n, accuracy and support-weighted precision, recall, f1."""
    per = class_metrics(df, label, prediction)
    n = F.sum("support")
    return per.agg(
        n.alias("n"),
        ratio(F.sum("tp"), n).alias("accuracy"),
        *[ratio(F.sum(F.col(m) * F.col("support")), n).alias(m) for m in ("precision", "recall", "f1")],
    )


def _auc_rows(ranks: RankTable) -> DataFrame:
    """(feature, positives, negatives, auc) from a rank table with weights pos and neg."""
    below = F.col("cum_neg") - F.col("neg")
    # exact integers: twice the Mann-Whitney statistic
    twice = F.sum((F.col("pos") * (2 * below + F.col("neg"))).cast("decimal(38,0)"))
    g = ranks.cumulated().groupBy("feature").agg(
        F.max("all_pos").alias("positives"), F.max("all_neg").alias("negatives"), twice.alias("twice")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    auc = F.when(pairs == 0, F.lit(0.5)).otherwise(F.col("twice").cast("double") / 2.0 / pairs)
    return g.select("feature", "positives", "negatives", auc.alias("auc"))


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row (positives, negatives, auc): Mann-Whitney with ties at one half; 0.5 with a single class."""
    weights = {"pos": _flag(col(label) == 1), "neg": _flag(col(label) != 1)}
    return _auc_rows(RankTable.build(df, [score], weights)).drop("feature")


def roc_auc_each(df: DataFrame, scores: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, positives, negatives, auc) of several score columns at once; a missing score is left out."""
    weights = {"pos": _flag(col(label) == 1), "neg": _flag(col(label) != 1)}
    return _auc_rows(RankTable.build(df, list(scores), weights))


def roc_auc_ovr(
    df: DataFrame, scores: Mapping[object, str], label: str = "label", average: str = "weighted"
) -> DataFrame:
    """One row (classes, auc): one-vs-rest AUC of a score column per class, weighted by prevalence
    (``weighted``) or not (``macro``)."""
    weights: dict[str, Sequence[Column]] = {
        "pos": [_flag(col(label) == F.lit(c)) for c in scores],
        "neg": [_flag(col(label) != F.lit(c)) for c in scores],
    }
    names = [str(c) for c in scores]
    per = _auc_rows(RankTable.build(df, list(scores.values()), weights, names))
    w = F.col("positives") if average == "weighted" else F.lit(1)
    return per.agg(F.count(F.lit(1)).alias("classes"), ratio(F.sum(F.col("auc") * w), F.sum(w)).alias("auc"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: n, rmse, mae, r2 (0 for a constant label, as then nothing is explained)."""
    y = col(label).cast("double")
    e = y - col(prediction).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(F.var_pop(y) == 0, F.when(F.avg(e * e) == 0, 1.0).otherwise(0.0))
        .otherwise(1.0 - F.avg(e * e) / F.var_pop(y))
        .alias("r2"),
    )


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tp, fp, precision, recall), one row per distinct score."""
    weights = {"pos": _flag(col(label) == 1), "neg": _flag(col(label) != 1)}
    c = RankTable.build(df, [score], weights).cumulated(descending=True)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return c.select(
        F.col("value").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        ratio(tp, tp + fp).alias("precision"),
        F.when(F.col("all_pos") == 0, F.lit(1.0)).otherwise(ratio(tp, F.col("all_pos"))).alias("recall"),
    )


def optimal_threshold(
    df: DataFrame, label: str = "label", score: str = "score", low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """One row (threshold, f1): the score that maximises F1, the lowest on ties, clipped; 0.5 unless binary."""
    curve = pr_curve(df, label, score)
    p, r = F.col("precision"), F.col("recall")
    curve = curve.withColumn("_f1", 2 * p * r / (p + r + 1e-10))
    best = curve.agg(
        F.max(F.struct(F.col("_f1").alias("f1"), (-F.col("threshold")).alias("neg"))).alias("b"),
        F.max("tp").alias("positives"),
        F.max("fp").alias("negatives"),
    )
    binary = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return best.select(
        F.when(binary, clip(-F.col("b.neg"), low, high)).otherwise(F.lit(0.5)).alias("threshold"),
        F.col("b.f1").alias("f1"),
    )


def percentiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """(prob, value): exact interpolated quantiles of one column."""
    (qs,) = exact_quantiles(df, [value], probs)
    return small_table(df.sparkSession, list(zip(map(float, probs), qs, strict=True)), "prob double, value double")


def latency_percentiles(df: DataFrame, value: str = "latency_ms") -> DataFrame:
    """One row p50, p95, p99."""
    (qs,) = exact_quantiles(df, [value], [0.5, 0.95, 0.99])
    return small_table(df.sparkSession, [tuple(qs)], "p50 double, p95 double, p99 double")
