"""Efficiency ranking: inputs to keep small, outputs to make large, one row per alternative (DMU)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip, col, total
from plumbline.operators.envelopment import dea_ccr

__all__ = ["benchmark_report", "composite_score", "dea_ccr", "dea_rank", "dmu_prepare"]

# Which columns of a metrics record are inputs and outputs, and their floors.
INPUTS = ("training_time_sec", "security_vulnerabilities", "mttr_minutes", "deployment_lead_time_hr")
OUTPUTS = ("f1_score", "security_score", "robustness_score", "auto_recovery_rate")
INPUT_FLOOR, OUTPUT_FLOOR = 0.1, 0.01


def dmu_prepare(df: DataFrame, name: str = "name") -> DataFrame:
    """(dmu, in_0 ..., out_0 ...): floored inputs and outputs; one is added to the vulnerability count."""

    def floored(c: str, floor: float) -> Column:
        v = col(c).cast("double") + (1.0 if c == "security_vulnerabilities" else 0.0)
        return F.greatest(F.lit(floor), v)

    return df.select(
        col(name).alias("dmu"),
        *[floored(c, INPUT_FLOOR).alias(f"in_{i}") for i, c in enumerate(INPUTS)],
        *[floored(c, OUTPUT_FLOOR).alias(f"out_{i}") for i, c in enumerate(OUTPUTS)],
    )


def composite_score(df: DataFrame, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Adds composite_score: mean(output / max) over mean(input / max), divided by the best, clipped."""
    both = [*inputs, *outputs]
    top = df.agg(*[F.max(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(both)]).first()
    share = {c: col(c).cast("double") / F.lit((top[i] or 0.0) + 1e-10) for i, c in enumerate(both)}
    mean_in = total([share[c] for c in inputs]) / float(len(inputs))
    mean_out = total([share[c] for c in outputs]) / float(len(outputs))
    raw = mean_out / F.greatest(F.lit(1e-5), mean_in)
    best = df.agg(F.max(raw)).first()[0] or 0.0
    return df.withColumn("composite_score", clip(raw / F.lit(best if best > 0 else 1.0), 0.0, 1.0))


def dea_rank(
    scored: DataFrame, key: str = "dmu", efficiency: str = "efficiency", composite: str = "composite_score"
) -> DataFrame:
    """One row (num_dmus, best, best_efficiency, ties, ranking_method): highest efficiency to 4 places,
    then highest composite, then smallest key."""
    e = F.round(col(efficiency), 4)
    groups = scored.groupBy(e.alias("e")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(col(composite)).alias("c"),
    )
    top = groups.agg(
        F.sum("n").alias("num_dmus"), F.max(F.struct("e", "n", "c")).alias("t")
    ).select("num_dmus", F.col("t.e").alias("best_efficiency"), F.col("t.n").alias("ties"), F.col("t.c").alias("c"))
    best = scored.join(
        F.broadcast(top),  # one row
        (e == F.col("best_efficiency")) & (col(composite) == F.col("c")),
    )
    return best.groupBy("num_dmus", "best_efficiency", "ties").agg(F.min(col(key)).alias("best")).withColumn(
        "ranking_method",
        F.when(F.col("ties") > 1, "dea_efficiency + composite_tiebreak").otherwise("dea_efficiency"),
    )


def benchmark_report(df: DataFrame, name: str, metrics: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(metric, one column per alternative): the metrics as rows. ``names`` are the columns to show."""
    rows = [F.struct(F.lit(m).alias("metric"), col(m).cast("double").alias("value")) for m in metrics]
    long = df.select(col(name).alias("name"), F.explode(F.array(*rows)).alias("r")).select("name", "r.*")
    return long.groupBy("metric").pivot("name", list(names)).agg(F.max("value"))
