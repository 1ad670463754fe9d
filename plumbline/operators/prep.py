"""Target handling, encoding and scalar clean-up: projections and filters over one feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import col, finite, is_infinite, present, try_double
from plumbline.plans.ranks import ranged_row_number
from plumbline.session import materialise, small_table

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MAX_CATEGORIES = 1000
INLINE_CLASSES = 1000


def numeric_columns(df: DataFrame, among: Sequence[str] | None = None) -> list[str]:
    among = among if among is not None else df.columns
    return [c for c in among if isinstance(df.schema[c].dataType, T.NumericType)]


def categorical_columns(df: DataFrame, among: Sequence[str] | None = None) -> list[str]:
    among = among if among is not None else df.columns
    return [c for c in among if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))]


def select_target(df: DataFrame, target: str = "target") -> DataFrame:
    """The table with its ``target`` column called ``target``. A table without it is an error."""
    if target == "target" and target in df.columns:
        return df
    try:
        place = df.columns.index(target)
    except ValueError:
        raise ValueError(f"column '{target}' not found among {len(df.columns)}: {df.columns[:10]}") from None
    return df.toDF(*df.columns[:place], "target", *df.columns[place + 1 :])


def drop_null_target(df: DataFrame, target: str = "target", check: bool = True) -> DataFrame:
    """Keep rows that have a target. With ``check`` a table without any is an error."""
    field = df.schema[target].dataType
    value = present(col(target)) if isinstance(field, (T.FloatType, T.DoubleType)) else col(target)
    kept = df.filter(value.isNotNull())
    if check and kept.select(target).isEmpty():
        raise ValueError(f"target column '{target}' contains only missing values")
    return kept


def label_codes(df: DataFrame, target: str = "target") -> DataFrame:
    """(label, code): distinct labels as strings in code-point order, numbered from 0."""
    labels = df.select(col(target).cast("string").alias("label")).filter("label is not null").distinct()
    numbered = ranged_row_number(labels, ["label"], "n")
    return numbered.select("label", (F.col("n") - 1).cast("int").alias("code"))


def encode_labels(df: DataFrame, target: str = "target", check: bool = True) -> DataFrame:
    """Integer labels stay; any other label becomes its 0-based code. Fewer than two classes is an error."""
    if isinstance(df.schema[target].dataType, INTEGRAL):
        if check and df.select(target).distinct().limit(2).count() < 2:
            raise ValueError(f"classification target '{target}' needs at least 2 classes")
        return df
    codes = label_codes(df, target)
    head = codes.limit(INLINE_CLASSES + 1).collect()
    if check and len(head) < 2:
        raise ValueError(f"classification target '{target}' needs at least 2 classes, found {len(head)}")
    if len(head) <= INLINE_CLASSES:
        codes = F.broadcast(small_table(df.sparkSession, head, codes.schema))
    rest = [col(c) if c != target else F.col("code").alias(target) for c in df.columns]
    return df.join(codes, col(target).cast("string") == F.col("label"), "left").select(*rest)


def regression_target(df: DataFrame, target: str = "target", check: bool = True) -> DataFrame:
    """Numeric reading of the target; rows that cannot be read are dropped, none left is an error."""
    out = df.withColumn(target, try_double(col(target))).filter(col(target).isNotNull())
    if check and out.select(target).isEmpty():
        raise ValueError(f"regression target '{target}' contains no numeric values")
    return out


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as doubles; what cannot be read as a number is missing, not 0."""
    return df.withColumns({c: try_double(col(c)) for c in cols})


def _category_label(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(col(name), F.lit("True")).when(~col(name), F.lit("False"))
    return col(name).cast("string")


def categories(df: DataFrame, cols: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values of the columns that have at most ``limit``; the others are left out, and
    their values never reach the driver."""
    if not cols:
        return {}
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("c"), _category_label(df, c).alias("v")) for c in cols])
        ).alias("p")
    ).select("p.*")
    distinct = materialise(pairs.filter("v is not null").distinct(), "categories")
    sizes = {r["c"]: r["count"] for r in distinct.groupBy("c").count().collect()}
    found: dict[str, list[str]] = {c: [] for c in cols if sizes.get(c, 0) <= limit}
    for r in distinct.filter(F.col("c").isin(*found)).collect() if found else []:
        found[r["c"]].append(r["v"])
    for values in found.values():
        values.sort()
    return found


def wide_one_hot(df: DataFrame, name: str) -> DataFrame:
    """Replaces a column of many values by ``name_onehot``: one sparse vector with the same zeros and ones
    that a column per sorted category but the first would hold."""
    value = _category_label(df, name)
    labels = df.select(value.alias("_v")).filter("_v is not null").distinct()
    numbered = ranged_row_number(labels, ["_v"], "_i")
    size = numbered.count()
    rows = df.withColumn("_v", value).join(numbered, "_v", "left")  # AQE splits a hot value
    # the encoder drops its last index, so the first category gets that one, and a missing value as well
    place = F.when(F.col("_i") > 1, F.col("_i") - 2).otherwise(F.lit(size - 1)).cast("double")
    if size < 2:
        return df.drop(name)
    sizing = df.sparkSession.range(size - 1, size).select(F.col("id").cast("double").alias("_at"))
    encoder = OneHotEncoder(inputCol="_at", outputCol="_hot", dropLast=True).fit(sizing)
    hot = encoder.transform(rows.withColumn("_at", place))
    return hot.select(*[col(c) for c in df.columns if c != name], F.col("_hot").alias(f"{name}_onehot"))


def one_hot_drop_first(
    df: DataFrame,
    cols: Sequence[str],
    values: Mapping[str, Sequence[str]] | None = None,
    limit: int = MAX_CATEGORIES,
    vectors: Sequence[str] | None = None,
) -> DataFrame:
    """One 0/1 double column ``col_value`` per sorted category but the first; missing gives zeros.

    Columns named in ``vectors`` become one sparse vector ``col_onehot`` each instead, whatever their size; all others become
    columns. Only if ``vectors`` is not given, it is those with more than ``limit`` categories. A column form of more than
    ``limit`` columns is an error, as no plan can hold any number of columns.
    """
    values = values if values is not None else categories(df, [c for c in cols if c not in (vectors or ())], limit)
    vectors = [c for c in cols if c not in values] if vectors is None else vectors
    for c in vectors:
        df = wide_one_hot(df, c)
    cols = [c for c in cols if c not in vectors]
    if wide := [c for c in cols if c not in values]:
        raise ValueError(f"more than {limit} categories in {', '.join(wide)}: name them in vectors, or raise limit")
    dummies = [
        F.coalesce((_category_label(df, c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
        for c in cols
        for v in list(values[c])[1:]
    ]
    kept = [col(c) for c in df.columns if c not in set(cols)]
    if not kept and not dummies:
        raise ValueError("no feature columns remain after encoding")
    return df.select(*kept, *dummies)


def normalise_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes null in every floating column, so that one notion of missing remains."""
    cols = cols if cols is not None else df.columns
    floating = [c for c in cols if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floating}) if floating else df


def infinite_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Names of the columns that hold an infinity, from one aggregate."""
    row = df.agg(*[F.max(is_infinite(col(c).cast("double"))).alias(f"i{i}") for i, c in enumerate(cols)]).first()
    return [c for c, hit in zip(cols, row, strict=True) if hit]


def sanitise_inf(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinities (and NaN) become null."""
    return df.withColumns({c: finite(col(c)) for c in cols})


def drop_sparse_columns(
    df: DataFrame, cols: Sequence[str], max_missing: float = 0.80
) -> tuple[DataFrame, list[str]]:
    """Drop the columns whose missing share is above the limit; returns the table and their names."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(missing_safe(df, c)).alias(f"c{i}") for i, c in enumerate(cols)],
    ).first()
    n = row["n"]
    sparse = [c for i, c in enumerate(cols) if n and (n - row[f"c{i}"]) / n > max_missing]
    return df.drop(*sparse), sparse


def missing_safe(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null, whatever its type."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def winsorise(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip each column to its (lower, upper); missing stays missing."""
    return df.withColumns(
        {
            c: F.when(present(col(c)).isNotNull(), F.least(F.greatest(col(c).cast("double"), F.lit(lo)), F.lit(hi)))
            for c, (lo, hi) in bounds.items()
        }
    )


def outlier_counts(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> dict[str, int]:
    """Per column, how many values lie strictly outside its bounds."""
    if not bounds:
        return {}
    row = df.agg(
        *[
            F.count_if((present(col(c)) < lo) | (present(col(c)) > hi)).alias(f"o{i}")
            for i, (c, (lo, hi)) in enumerate(bounds.items())
        ]
    ).first()
    return dict(zip(bounds, row, strict=True))


def expand_vector(df: DataFrame, vector: str, size: int, keep: Sequence[str] = ()) -> DataFrame:
    """One double column ``feature_00`` ... per position of an array column."""
    return df.select(
        *[col(k) for k in keep],
        *[F.get(col(vector), F.lit(i)).cast("double").alias(f"feature_{i:02d}") for i in range(size)],
    )


def expand_vector_long(df: DataFrame, vector: str, keep: Sequence[str] = ()) -> DataFrame:
    """The same as rows (kept columns, feature, value), for many positions."""
    return df.select(*[col(k) for k in keep], F.posexplode(col(vector)).alias("i", "v")).select(
        *[col(k) for k in keep],
        F.concat(F.lit("feature_"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"),
        F.col("v").cast("double").alias("value"),
    )


def more_distinct_than(df: DataFrame, values: Mapping[str, Column], limit: int) -> dict[str, bool]:
    """Per name, whether its expression has more than ``limit`` distinct non-null values.

    A sketch settles the columns that are far above the limit; only the others are counted exactly,
    and those have few distinct values to shuffle.
    """
    names = list(values)
    rough = df.agg(*[F.approx_count_distinct(values[n], 0.02).alias(f"n{i}") for i, n in enumerate(names)]).first()
    over = {n: rough[i] > 2 * limit for i, n in enumerate(names)}
    near = [n for n in names if not over[n]]
    if near:
        # adding 0 makes one value of 0.0 and -0.0
        cells = [F.struct(F.lit(n).alias("c"), (values[n] + F.lit(0)).cast("string").alias("v")) for n in near]
        pairs = df.select(F.explode(F.array(*cells)).alias("p")).select("p.*").filter("v is not null").distinct()
        counted = {r["c"]: r["n"] for r in pairs.groupBy("c").agg(F.count("v").alias("n")).collect()}
        over.update({n: counted.get(n, 0) > limit for n in near})
    return over


def detect_task_type(df: DataFrame, cols: Sequence[str], limit: int = 15) -> DataFrame:
    """(column, task): numeric with more than ``limit`` distinct values means regression."""
    numeric = numeric_columns(df, cols)
    over = more_distinct_than(df, {c: missing_safe(df, c) for c in numeric}, limit) if numeric else {}
    rows = [(c, "regression" if over.get(c, False) else "classification") for c in cols]
    return small_table(df.sparkSession, rows, "column string, task string")


def continuous_columns(df: DataFrame, cols: Sequence[str], limit: int = 20) -> dict[str, tuple[bool, bool]]:
    """Per column (more than ``limit`` distinct values, any non-integer value)."""
    over = more_distinct_than(df, {c: present(col(c)) for c in cols}, limit)
    row = df.agg(
        *[F.bool_or(present(col(c)) != F.floor(present(col(c)))).alias(f"f{i}") for i, c in enumerate(cols)]
    ).first()
    return {c: (over[c], bool(row[i])) for i, c in enumerate(cols)}


def is_continuous(df: DataFrame, cols: Sequence[str], limit: int = 20) -> DataFrame:
    """(column, many_values, has_fraction, continuous): continuous if either holds."""
    rows = [(c, many, part, many or part) for c, (many, part) in continuous_columns(df, cols, limit).items()]
    return small_table(
        df.sparkSession,
        rows, "column string, many_values boolean, has_fraction boolean, continuous boolean"
    )
