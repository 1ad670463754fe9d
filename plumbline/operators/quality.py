"""Data-quality aggregates, acceptance rules and cleaning.

Every statistic family is one aggregate over all columns. Results that are collected have a size that
depends on the number of columns only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import col, finite, is_infinite, total
from plumbline.operators import prep
from plumbline.plans.ranks import exact_quantiles
from plumbline.session import materialise, small_table


@dataclass(frozen=True)
class Thresholds:
    """The acceptance limits and their defaults."""

    min_rows: int = 20
    min_features: int = 2
    max_missing_ratio: float = 0.50
    max_column_missing_ratio: float = 0.80
    imbalance_threshold: float = 0.20
    outlier_std_dev: float = 4.0
    deduplicate: bool = True
    handle_outliers: bool = True
    one_hot_vectors: tuple[str, ...] = ()


def _missing(df: DataFrame, name: str) -> Column:
    return prep.missing_safe(df, name).isNull()


def _as_rows(row: DataFrame, cells: Sequence[Column]) -> DataFrame:
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, rows, missing, infinite), one row per column, from one aggregate."""
    numeric = set(prep.numeric_columns(df, cols))
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.count_if(is_infinite(col(c).cast("double"))).alias(f"f{i}") for i, c in enumerate(cols) if c in numeric],
    )
    return _as_rows(
        one,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col("n").alias("rows"),
                F.col(f"m{i}").alias("missing"),
                (F.col(f"f{i}") if c in numeric else F.lit(0).cast("bigint")).alias("infinite"),
            )
            for i, c in enumerate(cols)
        ],
    )


def missing_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: total_missing, missing_ratio over rows x columns, columns with any missing, passed."""
    p = profile(df, cols)
    return p.agg(
        F.sum("missing").alias("total_missing"),
        (F.sum("missing").cast("double") / F.greatest(F.sum("rows"), F.lit(1))).alias("missing_ratio"),
        F.array_sort(F.collect_list(F.when(F.col("missing") > 0, F.col("column")))).alias("columns_missing"),
        (F.sum("missing") == 0).alias("passed"),
    )


def _keys(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    return [prep.missing_safe(df, c).alias(c) for c in cols]


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row (rows, duplicates): rows minus distinct rows. Equal rows combine before the shuffle."""
    groups = df.select(*_keys(df, cols)).groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )


def deduplicate(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """One row per distinct combination of ``cols``: the one with the smallest ``key``."""
    rest = [c for c in df.columns if c not in set(cols) and c != key]
    carried = F.struct(col(key).alias("k"), *[col(c).alias(f"r{i}") for i, c in enumerate(rest)])
    first = (
        df.select(*_keys(df, cols), carried.alias("_c")).groupBy(*[col(c) for c in cols]).agg(F.min("_c").alias("_c"))
    )
    back = {key: F.col("_c.k"), **{c: F.col(f"_c.r{i}") for i, c in enumerate(rest)}}
    return first.select(*[back[c].alias(c) if c in back else col(c) for c in df.columns])


def class_balance(df: DataFrame, target: str = "target", threshold: float = 0.10) -> DataFrame:
    """(class, n, share, min_share, passed); a continuous target gives one passing row with a note."""
    groups = df.filter(~_missing(df, target)).groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    if not isinstance(df.schema[target].dataType, prep.INTEGRAL) or groups.limit(21).count() > 20:
        return small_table(
            df.sparkSession,
            [(None, None, None, None, True, "continuous target")],
            "class string, n bigint, share double, min_share double, passed boolean, note string",
        )
    totals = groups.agg(F.sum("n").alias("t"), F.min("n").alias("lo"))
    # at most 20 classes on the left and one row on the right
    return (
        groups.withColumn("_j", F.lit(1))
        .join(F.broadcast(totals.withColumn("_j", F.lit(1))), "_j")
        .select(
            F.col("class").cast("string").alias("class"),
            "n",
            (F.col("n") / F.col("t")).alias("share"),
            (F.col("lo") / F.col("t")).alias("min_share"),
            ((F.col("lo") / F.col("t")) >= threshold).alias("passed"),
            F.lit(None).cast("string").alias("note"),
        )
    )


def infer_rules(df: DataFrame, target: str = "target") -> dict[str, tuple[str, bool]]:
    """Per column (check, nullable): ``finite`` for floats, ``integer``, ``any``; the target is not nullable."""
    rules: dict[str, tuple[str, bool]] = {}
    for f in df.schema.fields:
        floating = isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))
        whole = isinstance(f.dataType, (*prep.INTEGRAL, T.BooleanType))
        if f.name == target:
            rules[f.name] = ("float" if floating else "integer", False)
        else:
            rules[f.name] = ("finite" if floating else "integer" if whole else "any", True)
    return rules


def _violations(df: DataFrame, rules: dict[str, tuple[str, bool]]) -> list[tuple[str, str, Column]]:
    out: list[tuple[str, str, Column]] = []
    for c, (check, nullable) in rules.items():
        if check == "finite":
            out.append((c, "finite", is_infinite(col(c).cast("double"))))
        if check == "integer" and isinstance(df.schema[c].dataType, T.StringType):
            bad = col(c).isNotNull() & col(c).try_cast("bigint").isNull()
            out.append((c, "integer", bad))
        if not nullable:
            out.append((c, "not_null", _missing(df, c)))
    return out


def validate_schema(df: DataFrame, rules: dict[str, tuple[str, bool]]) -> DataFrame:
    """(column, check, violations, passed) for every rule, from one aggregate."""
    checks = _violations(df, rules)
    one = df.agg(*[F.count_if(bad).alias(f"v{i}") for i, (_, _, bad) in enumerate(checks)])
    return _as_rows(
        one,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(check).alias("check"),
                F.col(f"v{i}").alias("violations"),
                (F.col(f"v{i}") == 0).alias("passed"),
            )
            for i, (c, check, _) in enumerate(checks)
        ],
    )


def failing_rows(df: DataFrame, rules: dict[str, tuple[str, bool]], key: str) -> DataFrame:
    """(column, check, key, value), one row per violation."""
    checks = _violations(df, rules)
    cells = [
        F.when(
            bad,
            F.struct(F.lit(c).alias("column"), F.lit(check).alias("check"), col(c).cast("string").alias("value")),
        )
        for c, check, bad in checks
    ]
    hits = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return df.select(col(key).alias("key"), F.explode(hits).alias("h")).select("h.column", "h.check", "key", "h.value")


@dataclass(frozen=True)
class TableCounts:
    """What the acceptance rules need to know of a table: numbers per column and per class summary."""

    rows: int
    missing: dict[str, int]
    infinite: dict[str, int]
    target_rows: int
    target_numbers: int
    target_variance: float | None
    classes: int
    smallest_class: int | None

    @staticmethod
    def of(df: DataFrame, features: Sequence[str], target: str) -> TableCounts:
        """One aggregate over the columns and one over the classes."""
        numeric = [c for c in features if c in set(prep.numeric_columns(df, features))]
        value = prep.missing_safe(df, target)
        number = prep.try_double(value)
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.count(value).alias("y"),
            F.count(number).alias("y_num"),
            F.var_pop(number).alias("y_var"),
            *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(features)],
            *[F.count_if(is_infinite(col(c).cast("double"))).alias(f"f{i}") for i, c in enumerate(numeric)],
        ).first()
        # distinct classes are counted where they are, not collected
        classes = (
            df.select(value.alias("c")).filter("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("s"))
            .agg(F.count(F.lit(1)).alias("k"), F.min("s").alias("smallest")).first()
        )
        return TableCounts(
            row["n"],
            {c: row[f"m{i}"] for i, c in enumerate(features)},
            {c: row[f"f{i}"] for i, c in enumerate(numeric)},
            row["y"],
            row["y_num"],
            row["y_var"],
            classes["k"],
            classes["smallest"],
        )

    def missing_ratio(self) -> float:
        return sum(self.missing.values()) / max(1, self.rows * max(1, len(self.missing)))

    def reasons(self, task: str, limits: Thresholds) -> list[str]:
        """Names of the rejection rules that fire."""
        out = []
        if self.rows < limits.min_rows:
            out.append("min_rows")
        if len(self.missing) < limits.min_features:
            out.append("min_features")
        out += self._target_reason(task, limits)
        if self.missing_ratio() > limits.max_missing_ratio:
            out.append("missing_ratio")
        shares = [m / max(1, self.rows) for m in self.missing.values()]
        if shares and min(shares) > limits.max_column_missing_ratio:
            out.append("all_columns_sparse")
        return out

    def _target_reason(self, task: str, limits: Thresholds) -> list[str]:
        if self.rows == 0:
            return ["target_empty"]
        if self.target_rows == 0:
            return ["target_all_missing"]
        if (self.rows - self.target_rows) / self.rows > limits.max_missing_ratio:
            return ["target_missing_ratio"]
        if task == "classification":
            return ["few_classes"] if self.classes < 2 else ["small_class"] if self.smallest_class < 2 else []
        if self.target_numbers == 0:
            return ["target_not_numeric"]
        return ["target_constant"] if self.target_variance == 0.0 else []


def rejection_rules(
    df: DataFrame,
    features: Sequence[str],
    target: str = "target",
    task: str = "classification",
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """One row: passed, n_rows, n_features, missing_ratio, reasons (names of the rules that fired).

    Rules: min_rows, min_features, target_empty, target_all_missing, target_missing_ratio,
    few_classes / small_class (classification), target_not_numeric / target_constant (regression),
    missing_ratio, all_columns_sparse. The target rules exclude one another in that order.
    """
    counts = TableCounts.of(df, features, target)
    reasons = counts.reasons(task, limits)
    row = (not reasons, counts.rows, len(features), counts.missing_ratio(), reasons)
    schema = "passed boolean, n_rows bigint, n_features bigint, missing_ratio double, reasons array<string>"
    return small_table(df.sparkSession, [row], schema)


@dataclass(frozen=True)
class Bounds:
    column: str
    n: int
    q1: float | None
    q3: float | None
    lower: float | None
    upper: float | None


def fit_outlier_bounds(df: DataFrame, cols: Sequence[str], k: float = 4.0) -> list[Bounds]:
    """Per column with at least 4 finite values: quartiles and the clipping bounds."""
    if not cols:
        return []
    clean = df.select(*[finite(col(c)).alias(c) for c in cols])
    row = clean.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.avg(col(c)).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(col(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    out = []
    for i, (c, (q1, q3)) in enumerate(zip(cols, exact_quantiles(clean, cols, [0.25, 0.75]), strict=True)):
        n = row[f"n{i}"]
        if n < 4:
            out.append(Bounds(c, n, q1, q3, None, None))
            continue
        reach = 3.0 * (q3 - q1)
        if reach > 0:
            out.append(Bounds(c, n, q1, q3, q1 - reach, q3 + reach))
        else:
            spread = k * max(row[f"s{i}"], 1e-6)
            out.append(Bounds(c, n, q1, q3, row[f"a{i}"] - spread, row[f"a{i}"] + spread))
    return out


def outlier_bounds(df: DataFrame, cols: Sequence[str], k: float = 4.0) -> DataFrame:
    """(column, n, q1, q3, lower, upper)."""
    rows = [(b.column, b.n, b.q1, b.q3, b.lower, b.upper) for b in fit_outlier_bounds(df, cols, k)]
    return small_table(
        df.sparkSession,
        rows, "column string, n bigint, q1 double, q3 double, lower double, upper double"
    )


@dataclass
class Cleaned:
    """A cleaned table, its feature names, and what was done to it."""

    table: DataFrame
    features: list[str]
    actions: list[str] = field(default_factory=list)
    bounds: list[Bounds] = field(default_factory=list)


def clean(
    df: DataFrame, features: Sequence[str], target: str, key: str, limits: Thresholds = Thresholds()
) -> Cleaned:
    """Missing targets, sparse columns, duplicates, one-hot, infinities, outliers - in this order.

    Text columns named in ``limits.one_hot_vectors``, and those with more categories than a plan can have columns
    (``prep.MAX_CATEGORIES``), become one sparse vector feature ``col_onehot``; ``actions`` names them. The duplicate-free table is written once; every later statistic reads that copy.
    """
    actions: list[str] = []
    have = ~_missing(df, target)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(have).alias("y"),
        *[F.count_if(have & _missing(df, c)).alias(f"m{i}") for i, c in enumerate(features)],
    ).first()
    if row["n"] > row["y"]:
        actions.append(f"rows without target dropped: {row['n'] - row['y']}")
    sparse = [
        c for i, c in enumerate(features) if row["y"] and row[f"m{i}"] / row["y"] > limits.max_column_missing_ratio
    ]
    kept = [c for c in features if c not in sparse]
    if sparse:
        actions.append(f"sparse columns dropped: {', '.join(sparse)}")
    work = prep.normalise_missing(df.filter(have).select(col(key), *[col(c) for c in kept], col(target)))
    if limits.deduplicate:
        work = materialise(deduplicate(work, kept, key), "distinct")
        removed = row["y"] - work.count()
        if removed:
            actions.append(f"duplicate rows removed: {removed}")
    texts = prep.categorical_columns(work, kept)
    if texts:
        named = [c for c in texts if c in limits.one_hot_vectors]
        values = prep.categories(work, [c for c in texts if c not in named])
        wide = [c for c in texts if c not in values]
        work = prep.one_hot_drop_first(work, texts, values, vectors=wide)
        kept = [c for c in kept if c not in texts] + [f"{c}_{v}" for c in texts if c in values for v in values[c][1:]]
        kept += [f"{c}_onehot" for c in wide if f"{c}_onehot" in work.columns]  # one value alone leaves no column
        actions.append(f"columns one-hot encoded: {', '.join(texts)}")
        if wide:
            actions.append(f"of these as one sparse vector each: {', '.join(wide)}")
    numeric = prep.numeric_columns(work, kept)
    infinite = prep.infinite_columns(work, numeric) if numeric else []
    if infinite:
        work = prep.sanitise_inf(work, infinite)
        actions.append(f"columns with infinities set to missing: {', '.join(infinite)}")
    bounds: list[Bounds] = []
    if limits.handle_outliers and numeric:
        bounds = fit_outlier_bounds(work, numeric, limits.outlier_std_dev)
        limits_by_column = {b.column: (b.lower, b.upper) for b in bounds if b.lower is not None}
        outside = prep.outlier_counts(work, limits_by_column)
        hit = {c: limits_by_column[c] for c, n in outside.items() if n}
        if hit:
            work = prep.winsorise(work, hit)
            actions.append(f"outlier values capped: {sum(outside.values())}")
    return Cleaned(work, kept, actions, bounds)


def quality_row(df: DataFrame, cols: Sequence[str], phase: str) -> DataFrame:
    """(phase, rows, features, duplicate_rows, total_missing, missing_ratio to 4 places)."""
    k = len(cols)
    missing = total([_missing(df, c).cast("int") for c in cols]).cast("bigint") if k else F.lit(0)
    groups = (
        df.select(*_keys(df, cols), missing.alias("_m"))
        .groupBy(*[col(c) for c in cols])
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_m").alias("_m"))
    )
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("total_missing"),
    ).select(
        F.lit(phase).alias("phase"),
        "rows",
        F.lit(k).cast("bigint").alias("features"),
        "duplicate_rows",
        "total_missing",
        F.round(
            F.col("total_missing").cast("double") / F.greatest(F.col("rows") * max(1, k), F.lit(1)), 4
        ).alias("missing_ratio"),
    )


def clean_report(
    df: DataFrame, features: Sequence[str], target: str, key: str, limits: Thresholds = Thresholds()
) -> DataFrame:
    """``quality_row`` before and after :func:`clean`."""
    done = clean(df, features, target, key, limits)
    return quality_row(df, features, "before").unionByName(quality_row(done.table, done.features, "after"))


def validate(
    df: DataFrame,
    features: Sequence[str],
    target: str = "target",
    task: str = "classification",
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """One row: rejection_passed, schema_passed, missing_ok, overall_passed and the two warnings.

    Duplicates and class imbalance only warn. The rules share one aggregate over the columns and one over
    the classes; only the duplicates need another pass.
    """
    table = df.select(*[col(c) for c in features], col(target))
    counts = TableCounts.of(table, features, target)
    reasons = counts.reasons(task, limits)
    rules = infer_rules(table, target)
    finite_ok = not any(counts.infinite.get(c, 0) for c, (check, _) in rules.items() if check == "finite")
    schema_ok = finite_ok and counts.target_rows == counts.rows
    cells = counts.rows * (len(features) + 1)
    ratio = (sum(counts.missing.values()) + counts.rows - counts.target_rows) / max(1, cells)
    continuous = counts.classes > 20 or not isinstance(table.schema[target].dataType, prep.INTEGRAL)
    balanced = continuous or not counts.classes or (
        counts.smallest_class / counts.target_rows >= limits.imbalance_threshold
    )
    missing_ok = ratio <= limits.max_missing_ratio
    row = (not reasons, reasons, schema_ok, ratio, missing_ok, balanced, not reasons and schema_ok and missing_ok)
    verdict = small_table(
        df.sparkSession,
        [row],
        "rejection_passed boolean, reasons array<string>, schema_passed boolean, missing_ratio double, "
        "missing_ok boolean, balance_passed boolean, overall_passed boolean",
    ).withColumn("_j", F.lit(1))
    duplicates = duplicate_count(table, [*features, target]).select("duplicates", F.lit(1).alias("_j"))
    return duplicates.join(F.broadcast(verdict), "_j").drop("_j")  # one row on each side
