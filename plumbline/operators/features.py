"""Splits and train-fitted transforms.

A fitted state is a handful of numbers per feature; applying it is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import col, order_hash, present
from plumbline.plans.ranks import (
    exact_quantiles,
    hash_cuts,
    long_values,
    ranged_row_number,
    split_points,
)
from plumbline.session import materialise, small_table

INLINE_CLASSES = 1000


def split_sizes(n: int, test: float = 0.20, val: float = 0.10) -> tuple[int, int]:
    """(test rows, validation rows): both rounded up, the rest is for training."""
    n_test = math.ceil(test * n)
    n_val = math.ceil(val / (1.0 - test) * (n - n_test))
    return n_test, n_val


def allocate(counts: Mapping[object, int], held_out: int) -> dict[object, int]:
    """Held-out rows per class: the others are allotted by largest remainder, ties by class order."""
    n = sum(counts.values())
    stay = n - held_out
    order = sorted(counts)
    floors = {c: counts[c] * stay // n for c in order}
    rest = stay - sum(floors.values())
    for c in sorted(order, key=lambda c: (-(counts[c] * stay % n), order.index(c)))[:rest]:
        floors[c] += 1
    return {c: counts[c] - floors[c] for c in order}


def split_stratified(
    df: DataFrame, klass: str, keys: Sequence[str], seed: int = 42, test: float = 0.20, val: float = 0.10
) -> DataFrame:
    """Adds ``split``: per class, the first rows in hash order are test, the next validation, the rest train.

    ``keys`` must identify a row. Sizes are exact, yet no class is sorted: see ``hash_cuts``. Where there
    are more classes than ``INLINE_CLASSES``, they stay a table, and the rows are numbered in each class.
    """
    sizes = df.groupBy(col(klass).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    few = sizes.limit(INLINE_CLASSES + 1).collect()
    if len(few) > INLINE_CLASSES:
        return _split_many(df, klass, keys, seed, materialise(sizes, "class-sizes"), test, val)
    counts = {r["k"]: r["n"] for r in few}
    if None in counts:
        raise ValueError(f"class column '{klass}' has missing values")
    n = sum(counts.values())
    n_test, n_val = split_sizes(n, test, val)
    tests = allocate(counts, n_test)
    vals = allocate({c: counts[c] - tests[c] for c in counts}, n_val)
    return _apply_cuts(df, klass, keys, seed, {c: (tests[c], tests[c] + vals[c]) for c in counts})


def _allocated(sizes: DataFrame, n: int, held_out: int, name: str) -> DataFrame:
    """``allocate`` on a table (k, n): adds column ``name``."""
    stay = n - held_out
    exact = F.col("n").cast("decimal(38,0)") * F.lit(stay)
    shares = sizes.withColumn("_floor", F.floor(exact / F.lit(n)).cast("bigint")).withColumn("_rest", exact % F.lit(n))
    # classes whose remainder is large enough get one more row
    extra = stay - shares.agg(F.sum("_floor")).first()[0]
    ranked = ranged_row_number(shares.withColumn("_least", -F.col("_rest")), ["_least", "k"], "_nth")
    kept = F.col("_floor") + (F.col("_nth") <= extra).cast("bigint")
    return ranked.select(*sizes.columns, (F.col("n") - kept).alias(name))


def _split_many(df: DataFrame, klass: str, keys: Sequence[str], seed: int, sizes: DataFrame, test: float, val: float) -> DataFrame:
    if not sizes.filter("k is null").isEmpty():
        raise ValueError(f"class column '{klass}' has missing values")
    n = sizes.agg(F.sum("n")).first()[0]
    n_test, n_val = split_sizes(n, test, val)
    cuts = _allocated(sizes, n, n_test, "_tests")
    left = cuts.select("k", (F.col("n") - F.col("_tests")).alias("n"), "_tests")
    cuts = _allocated(left, n - n_test, n_val, "_vals").select("k", "_tests", "_vals")
    numbered = ranged_row_number(df.withColumn("_h", order_hash(keys, seed)), ["_h", *keys], "_rank", [klass])
    name = (
        F.when(F.col("_rank") <= F.col("_tests"), "test")
        .when(F.col("_rank") <= F.col("_tests") + F.col("_vals"), "val")
        .otherwise("train")
    )
    return numbered.join(cuts.withColumnRenamed("k", "_k"), col(klass) == F.col("_k")).select(*[col(c) for c in df.columns], name.alias("split"))


def split_random(
    df: DataFrame, keys: Sequence[str], seed: int = 42, test: float = 0.20, val: float = 0.10
) -> DataFrame:
    """The same sizes without classes."""
    n_test, n_val = split_sizes(df.count(), test, val)
    return _apply_cuts(df, None, keys, seed, {0: (n_test, n_test + n_val)})


def _apply_cuts(
    df: DataFrame, klass: str | None, keys: Sequence[str], seed: int, ranks: Mapping[object, tuple[int, int]]
) -> DataFrame:
    cuts = hash_cuts(df, klass, keys, seed, ranks)
    at = F.struct(
        order_hash(keys, seed).alias("h"), F.concat_ws("\u0001", *[col(k).cast("string") for k in keys]).alias("k")
    )
    if klass is None:
        (t, v), = cuts.values()
        return df.withColumn("split", _split_name(at, _cut(t), _cut(v)))
    kind = df.schema[klass].dataType.simpleString()
    rows = [(c, *(t or (None, None)), *(v or (None, None))) for c, (t, v) in cuts.items()]
    table = small_table(df.sparkSession, rows, f"_c {kind}, _th string, _tk string, _vh string, _vk string")
    if len(rows) <= INLINE_CLASSES:
        table = F.broadcast(table)
    joined = df.join(table, col(klass).eqNullSafe(F.col("_c")))
    test_cut = F.struct(F.col("_th").alias("h"), F.col("_tk").alias("k"))
    val_cut = F.struct(F.col("_vh").alias("h"), F.col("_vk").alias("k"))
    name = (
        F.when(F.col("_th").isNotNull() & (at <= test_cut), "test")
        .when(F.col("_vh").isNotNull() & (at <= val_cut), "val")
        .otherwise("train")
    )
    return joined.select(*[col(c) for c in df.columns], name.alias("split"))


def _cut(cut: tuple[str, str] | None) -> Column | None:
    return None if cut is None else F.struct(F.lit(cut[0]).alias("h"), F.lit(cut[1]).alias("k"))


def _split_name(at: Column, test_cut: Column | None, val_cut: Column | None) -> Column:
    is_test = F.lit(False) if test_cut is None else at <= test_cut
    is_val = F.lit(False) if val_cut is None else at <= val_cut
    return F.when(is_test, "test").when(is_val, "val").otherwise("train")


def split_sequential(df: DataFrame, order: Sequence[str], train: float = 0.80) -> DataFrame:
    """Adds ``split``: the first ``int(train * n)`` rows along ``order`` are train, the rest test.

    The boundary row is found column by column: the value at the wanted rank, then the same inside
    the rows tied with it. Only tied rows go on to the next column.
    """
    rank = int(train * df.count())
    bound: list[Column] = []
    ties = df
    before = F.lit(False)
    equal = F.lit(True)
    for c in order:
        if rank == 0:
            break
        value, below = _value_at_rank(ties, c, rank)
        before = before | (equal & (col(c) < F.lit(value)))
        equal = equal & (col(c) == F.lit(value))
        ties = ties.filter(col(c) == F.lit(value))
        rank -= below
        bound.append(equal)
    inside = before | (equal if bound else F.lit(False))
    return df.withColumn("split", F.when(inside, "train").otherwise("test"))


def _value_at_rank(df: DataFrame, c: str, rank: int) -> tuple[object, int]:
    """The value at a 1-based rank of a numeric or timestamp column, and how many rows are below it."""
    numeric = _numeric_view(df, c)
    work = df.select(numeric.alias("x"), col(c).alias("native"))
    splits = split_points(work, ["x"])
    cells = long_values(work, ["x"], splits, {"native": F.col("native")})
    seen = 0
    for r in sorted(cells.groupBy("bucket").count().collect(), key=lambda r: r["bucket"]):
        if rank <= seen + r["count"]:
            break
        seen += r["count"]
    else:
        raise ValueError(f"order column '{c}' has missing values")
    counts = cells.filter(F.col("bucket") == r["bucket"]).groupBy("bucket", "native").count()
    running = Window.partitionBy("bucket").orderBy("native").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        counts.withColumn("upto", F.sum("count").over(running))
        .filter((F.col("upto") >= rank - seen) & (F.col("upto") - F.col("count") < rank - seen))
        .first()
    )
    return hit["native"], seen + hit["upto"] - hit["count"]


def _numeric_view(df: DataFrame, c: str) -> Column:
    """A double that does not decrease along the column."""
    kind = df.schema[c].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.unix_micros(col(c).cast("timestamp")).cast("double")
    return col(c).cast("double")


def kfold_assign(
    df: DataFrame, keys: Sequence[str], klass: str | None = None, folds: int = 5, seed: int = 42, keep: Sequence[str] | None = None
) -> DataFrame:
    """Adds ``fold``: rank in hash order (per class) modulo ``folds``; fold sizes differ by one at most.

    Rows with one key are told apart by their other plain columns, so that folds do not depend on where rows lie. ``keep`` names the columns
    of the result, if not all, and the class; no others are written.
    """
    tagged = df.withColumn("_h", order_hash(keys, seed))
    rest = [f.name for f in df.schema if f.name not in (*keys, klass) and isinstance(f.dataType, T.AtomicType)]
    kept = [c for c in df.columns if keep is None or c in keep]
    unused = [c for c in tagged.columns if c not in (*kept, klass)]
    numbered = ranged_row_number(tagged, ["_h", *keys, *rest], "_rank", [klass] if klass else [], unused)
    return numbered.select(*[col(c) for c in kept], ((F.col("_rank") - 1) % folds).cast("int").alias("fold"))


def hash_folds(df: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` without a shuffle: hash modulo ``folds``; sizes are equal in expectation only."""
    digits = F.conv(F.left(order_hash(keys, seed), F.lit(12)), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(digits, F.lit(folds)).cast("int"))


# --------------------------------------------------------------------------- fitted transforms


@dataclass(frozen=True)
class Imputer:
    """Fill values per feature, fitted on the table given to :meth:`fit` (the train split)."""

    fill: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str], strategy: str = "median") -> Imputer:
        if strategy == "mean":
            row = df.agg(*[F.avg(present(col(c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
            fill = dict(zip(cols, row, strict=True))
        elif strategy == "median":
            fill = {c: q[0] for c, q in zip(cols, exact_quantiles(df, cols, [0.5]), strict=True)}
        elif strategy == "most_frequent":
            fill = _most_frequent(df, cols)
        else:
            raise ValueError(f"unknown strategy '{strategy}'; known: mean, median, most_frequent")
        return Imputer({c: v for c, v in fill.items() if v is not None})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(present(col(c)), F.lit(v)) for c, v in self.fill.items()})


def _most_frequent(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Most frequent value, the smallest on ties; counted per (column, value) before the maximum."""
    cells = [F.struct(F.lit(c).alias("c"), present(col(c)).alias("v")) for c in cols]
    counts = (
        df.select(F.explode(F.array(*cells)).alias("p")).select("p.*").filter("v is not null").groupBy("c", "v").count()
    )
    best = counts.groupBy("c").agg(F.max(F.struct("count", (-F.col("v")).alias("neg"))).alias("b"))
    return {r["c"]: -r["b"]["neg"] for r in best.collect()}


@dataclass(frozen=True)
class Scaler:
    """(value - centre) / width per feature; width 1 replaces a zero width."""

    centre: dict[str, float]
    width: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str], method: str = "standard") -> Scaler:
        if method == "robust":
            qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
            centre = {c: q[1] for c, q in zip(cols, qs, strict=True)}
            width = {c: q[2] - q[0] for c, q in zip(cols, qs, strict=True) if q[0] is not None}
        elif method in ("standard", "minmax"):
            low, span = (F.avg, F.stddev_pop) if method == "standard" else (F.min, None)
            row = df.agg(
                *[low(present(col(c))).alias(f"a{i}") for i, c in enumerate(cols)],
                *[
                    (span(present(col(c))) if span else F.max(present(col(c))) - F.min(present(col(c)))).alias(f"b{i}")
                    for i, c in enumerate(cols)
                ],
            ).first()
            centre = {c: row[f"a{i}"] for i, c in enumerate(cols)}
            width = {c: row[f"b{i}"] for i, c in enumerate(cols)}
        else:
            raise ValueError(f"unknown scaler '{method}'; known: standard, minmax, robust")
        known = [c for c in cols if centre[c] is not None]
        return Scaler({c: centre[c] for c in known}, {c: width[c] or 1.0 for c in known})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (present(col(c)) - F.lit(v)) / F.lit(self.width[c]) for c, v in self.centre.items()}
        )


@dataclass(frozen=True)
class Components:
    """Centred principal components; each has its largest-magnitude loading positive."""

    cols: tuple[str, ...]
    mean: dict[str, float]
    loadings: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str], k: int) -> Components:
        row = df.agg(*[F.avg(present(col(c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        mean = dict(zip(cols, row, strict=True))
        centred = df.select(*[(present(col(c)) - F.lit(mean[c])).alias(c) for c in cols])
        vectors = VectorAssembler(inputCols=list(cols), outputCol="v", handleInvalid="skip").transform(centred)
        model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors.select("v"))
        matrix = model.pc.toArray()
        signs = [1.0 if max(c, key=abs) >= 0 else -1.0 for c in matrix.T.tolist()]
        loadings = tuple(tuple(s * x for x in c) for s, c in zip(signs, matrix.T.tolist(), strict=True))
        return Components(tuple(cols), mean, loadings, tuple(model.explainedVariance.toArray().tolist()))

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        parts = []
        for j, weights in enumerate(self.loadings):
            terms = [
                (present(col(c)) - F.lit(self.mean[c])) * F.lit(w) for c, w in zip(self.cols, weights, strict=True)
            ]
            score = terms[0]
            for t in terms[1:]:
                score = score + t
            parts.append(score.alias(f"pc_{j:02d}"))
        return df.select(*[col(k) for k in keep], *parts)


@dataclass(frozen=True)
class FeatureTransform:
    """Impute, scale and optionally rotate; fitted on the train rows, applied to every split."""

    cols: tuple[str, ...]
    imputer: Imputer
    scaler: Scaler | None
    components: Components | None = None
    keep: tuple[str, ...] = field(default=())

    @staticmethod
    def fit(
        df: DataFrame,
        cols: Sequence[str],
        strategy: str = "median",
        scale: str = "standard",
        pca: int | None = None,
    ) -> FeatureTransform:
        imputer = Imputer.fit(df, cols, strategy)
        usable = [c for c in cols if c in imputer.fill]  # a feature without any value cannot be filled
        filled = imputer.transform(df)
        scaler = None if scale == "none" else Scaler.fit(filled, usable, scale)
        parts = Components.fit(scaler.transform(filled) if scaler else filled, usable, pca) if pca else None
        return FeatureTransform(tuple(usable), imputer, scaler, parts)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.imputer.transform(df)
        if self.scaler:
            out = self.scaler.transform(out)
        if self.components:
            out = self.components.transform(out, [c for c in df.columns if c not in self.cols])
        return out


def class_counts(df: DataFrame, target: str = "target") -> dict[object, int]:
    """Rows per class."""
    return {r[0]: r["count"] for r in df.groupBy(col(target)).count().collect() if r[0] is not None}


def weights_of(counts: Mapping[object, int], threshold: float = 0.20) -> dict[object, float]:
    """n / (k * class count), or all ones if no class share is below the threshold."""
    n, k = sum(counts.values()), len(counts)
    if not n or min(counts.values()) / n >= threshold:
        return dict.fromkeys(counts, 1.0)
    return {c: n / (k * m) for c, m in counts.items()}


def class_weights(train: DataFrame, target: str = "target", threshold: float = 0.20) -> dict[object, float]:
    """Balanced class weights of the train rows, if one of their classes is rare."""
    return weights_of(class_counts(train, target), threshold)


def with_class_weights(df: DataFrame, weights: Mapping[object, float], target: str = "target") -> DataFrame:
    """Adds ``weight``, one literal per class (1 for a class that was not in the train rows)."""
    if len(weights) > INLINE_CLASSES:
        kind = df.schema[target].dataType.simpleString()
        table = small_table(df.sparkSession, list(weights.items()), f"_c {kind}, _w double")
        joined = df.join(table, col(target) == F.col("_c"), "left")
        return joined.select(*[col(c) for c in df.columns], F.coalesce("_w", F.lit(1.0)).alias("weight"))
    value = F.lit(1.0)
    for c, w in weights.items():
        value = F.when(col(target) == F.lit(c), F.lit(w)).otherwise(value)
    return df.withColumn("weight", value)


def to_array(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    """Adds the columns as an array, by native expressions; a missing value is an error, as in :func:`to_vector`. Columns that are vectors
    themselves are put together by that."""
    if not all(isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)) for c in cols):
        return to_vector(df, cols, name)
    numbers = [(c, col(c).cast("double")) for c in cols]
    known = [F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit(f"column '{c}' has missing values")).cast("double")).otherwise(v) for c, v in numbers]
    return df.withColumn(name, F.array(*known))


def as_array(df: DataFrame, name: str) -> Column:
    """A column of vectors or arrays as arrays."""
    return col(name) if isinstance(df.schema[name].dataType, T.ArrayType) else vector_to_array(col(name))


def to_vector(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="error").transform(df)
