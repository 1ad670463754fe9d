"""Scalar column expressions shared by the operators. All of them are native expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by exact name, also when the name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def order_hash(keys: Sequence[str], seed: int) -> Column:
    """Deterministic pseudo-random order: md5 of ``seed:key``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def present(value: Column) -> Column:
    """A double column in which NaN is null."""
    v = value.cast("double")
    return F.when(~F.isnan(v), v)


def finite(value: Column) -> Column:
    """A double column in which NaN and both infinities are null."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(math.inf)), v)


def is_infinite(value: Column) -> Column:
    return F.coalesce(F.abs(value) == F.lit(math.inf), F.lit(False))


def try_double(value: Column) -> Column:
    """Numeric reading of any column; what cannot be read is null."""
    return present(value.try_cast("double"))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def dataset_id(name: Column, content: Column | None = None) -> Column:
    """``ds_<stem>_<8 hex>``; the hash is of the content, or of the name where there is none."""
    last = F.regexp_extract(name, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(last, r"^(.+)\.[^.]+$", "$1")
    clean = F.btrim(F.regexp_replace(F.lower(stem), "[^a-zA-Z0-9_]", "_"), F.lit("_"))
    clean = F.when(clean == "", F.lit("dataset")).otherwise(clean)
    source = name if content is None else F.when(F.length(content) > 0, content).otherwise(name)
    return F.concat(F.lit("ds_"), clean, F.lit("_"), F.left(F.sha2(source, 256), F.lit(8)))


def ks_lambda(d: Column, n: Column, m: Column) -> Column:
    """The argument of Kolmogorov's limit law, with Stephens' finite-sample factor."""
    en = F.sqrt(n.cast("double") * m / (n.cast("double") + m))
    return (en + 0.12 + 0.11 / en) * d


def ks_pvalue(lam: Column) -> Column:
    """Two-sided two-sample Kolmogorov-Smirnov p-value; ``lam`` should be a column by name, as it
    occurs often. Each of the two series is used where four terms of it are exact to double precision.
    """
    tail = total([(2.0 if j % 2 else -2.0) * F.exp(-2.0 * j * j * lam * lam) for j in range(1, 5)])
    head = 1.0 - math.sqrt(2 * math.pi) / lam * total(
        [F.exp(-((2 * j - 1) ** 2) * (math.pi**2 / 8) / (lam * lam)) for j in range(1, 5)]
    )
    return F.when(lam <= 0.04, F.lit(1.0)).otherwise(clip(F.when(lam < 1.18, head).otherwise(tail), 0, 1))


#: Lattice points of the exact Kolmogorov-Smirnov law that one p-value may cost.
EXACT_CELLS = 4_000_000


def ks_is_small(n: Column, m: Column) -> Column:
    """Whether the exact law is affordable for samples of n and m values."""
    return F.least(n, m).cast("double") * (n + m) <= EXACT_CELLS


def ks_exact(d: Column, n: Column, m: Column) -> Column:
    """Exact two-sided two-sample p-value of the statistic ``d``, if all values differ.

    A random order of both samples is a lattice path from (0, 0) to (n, m). The fold goes along its steps with the
    probabilities of all places that a path may have reached without ever being ``d`` apart; what is left at the end
    never was. Arguments should be columns by name, as they occur often.
    """
    n, m = F.least(n, m).cast("bigint"), F.greatest(n, m).cast("bigint")
    band = F.round(d * n.cast("double") * m)
    start = F.transform(F.sequence(F.lit(0).cast("bigint"), n), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def step(reached: Column, s: Column) -> Column:
        left = (n + m - s + 1).cast("double")  # values that are still to come

        def place(own: Column, i: Column) -> Column:
            j = s - i
            before = F.coalesce(F.get(reached, i - 1), F.lit(0.0))
            inside = (j >= 0) & (j <= m) & (F.abs(i * m - j * n) < band)
            return F.when(inside, (own * (m - j + 1) + before * (n - i + 1)) / left).otherwise(F.lit(0.0))

        return F.transform(reached, place)

    end = F.aggregate(F.sequence(F.lit(1).cast("bigint"), n + m), start, step)
    return F.when(band <= 0, F.lit(1.0)).otherwise(clip(1.0 - F.element_at(end, -1), 0, 1))


def js_term(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """One cell's contribution to the Jensen-Shannon divergence of two share vectors."""
    m = (p + q) * 0.5
    return 0.5 * p * F.log((p + eps) / (m + eps)) + 0.5 * q * F.log((q + eps) / (m + eps))
