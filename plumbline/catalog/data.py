"""Queries over sources and sinks, scalar preparation, data quality, splits and transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import FEATURES, REGISTRY, ctes, query, table, view
from plumbline.functions.scalars import dataset_id
from plumbline.operators import features as ft
from plumbline.operators import prep, quality
from plumbline.operators.components import WideComponents
from plumbline.session import scratch_path, small_table
from plumbline.sources import readers, writers

KEY = ["row_key"]


def _round(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --------------------------------------------------------------------------- sources and sinks


@query("read_parquet", "SELECT * FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_parquet(spark, f"{sf}/customer.parquet")


@query(
    "read_csv",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
    "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "N/A").otherwise(F.col("c_mktsegment"))
    balance = F.when(F.col("c_acctbal") < 0, "NaN").otherwise(F.col("c_acctbal").cast("string"))
    rows = table(spark, sf, "customer").withColumns({"c_mktsegment": segment, "c_acctbal": balance})
    rows.write.csv(path, header=True)
    return readers.read_csv(spark, path)


@query("read_json", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    return readers.read_json(spark, path).select("event_id", "user_id", "event_type", "value")


@query(
    "read_table",
    "SELECT f.fmt, count(*) AS n, round(sum(s_acctbal), 2) AS balance, count(DISTINCT s_nationkey) AS nations "
    "FROM supplier, (VALUES ('csv'), ('json'), ('parquet')) f(fmt) GROUP BY f.fmt",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "formats")
    rows = table(spark, sf, "supplier")
    rows.write.csv(f"{path}.csv", header=True)
    rows.write.json(f"{path}.JSON")
    rows.write.parquet(f"{path}.parquet")
    out = None
    for ext in ("csv", "JSON", "parquet"):
        one = readers.read_table(spark, f"{path}.{ext}").agg(
            F.lit(ext.lower()).alias("fmt"),
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("s_acctbal"), 2).alias("balance"),
            F.countDistinct("s_nationkey").alias("nations"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "write_raw",
    ctes(
        ["feat"],
        "SELECT f.copy, count(*) AS n, CAST(sum(target) AS BIGINT) AS ones, round(sum(f_price), 2) AS price "
        "FROM feat, (VALUES ('dataset'), ('raw_dataset')) f(copy) GROUP BY f.copy",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    places = writers.write_raw(view(spark, sf, "feat").select(*FEATURES, "target"), scratch_path(spark, "raw"))
    parts = [
        spark.read.parquet(p).agg(
            F.lit(name).alias("copy"),
            F.count(F.lit(1)).alias("n"),
            F.sum("target").alias("ones"),
            F.round(F.sum("f_price"), 2).alias("price"),
        )
        for name, p in zip(("dataset", "raw_dataset"), places, strict=True)
    ]
    return parts[0].unionByName(parts[1])


# --------------------------------------------------------------------------- scalar preparation


@query("select_target", ctes(["feat"], "SELECT row_key, f_qty, c_flag AS target FROM feat"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", "f_qty", "c_flag")
    return prep.select_target(rows, "c_flag")


@query("drop_null_target", ctes(["dirty"], "SELECT row_key, f_qty, target FROM dirty WHERE target IS NOT NULL"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.drop_null_target(view(spark, sf, "dirty").select("row_key", "f_qty", "target"))


@query(
    "encode_labels",
    ctes(
        ["feat"],
        "WITH codes AS (SELECT c_flag, CAST(row_number() OVER (ORDER BY c_flag) - 1 AS INTEGER) AS target "
        "FROM (SELECT DISTINCT c_flag FROM feat)) SELECT row_key, codes.target FROM feat JOIN codes USING (c_flag)",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", F.col("c_flag").alias("target"))
    return prep.encode_labels(rows)


TEXT_PRICE = "CASE WHEN f_qty > 40 THEN 'n/a' ELSE CAST(CAST(f_qty AS BIGINT) AS STRING) END"


@query(
    "regression_target",
    ctes(["feat"], f"SELECT row_key, target FROM (SELECT row_key, TRY_CAST({TEXT_PRICE} AS DOUBLE) AS target FROM feat) "
    "WHERE target IS NOT NULL"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", F.expr(TEXT_PRICE).alias("target"))
    return prep.regression_target(rows)


@query("coerce_numeric", ctes(["feat"], f"SELECT row_key, TRY_CAST({TEXT_PRICE} AS DOUBLE) AS f_text FROM feat"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", F.expr(TEXT_PRICE).alias("f_text"))
    return prep.coerce_numeric(rows, ["f_text"])


@query(
    "one_hot_drop_first",
    ctes(
        ["feat"],
        "SELECT row_key, CAST(coalesce(c_flag = 'N', FALSE) AS DOUBLE) AS \"c_flag_N\", "
        "CAST(coalesce(c_flag = 'R', FALSE) AS DOUBLE) AS \"c_flag_R\", "
        "CAST(coalesce(c_status = 'O', FALSE) AS DOUBLE) AS \"c_status_O\" FROM feat",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", "c_flag", "c_status")
    return prep.one_hot_drop_first(rows, ["c_flag", "c_status"])


NAN_VIEW = "SELECT row_key, CASE WHEN f_qty <= 3 THEN CAST('NaN' AS DOUBLE) WHEN f_qty > 45 THEN NULL ELSE f_qty END AS f_nan FROM feat"


@query(
    "normalise_missing",
    ctes(["feat"], f"SELECT row_key, CASE WHEN NOT isnan(f_nan) THEN f_nan END AS f_nan FROM ({NAN_VIEW})"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(NAN_VIEW.replace("FROM feat", "FROM {src}"), src=view(spark, sf, "feat"))
    return prep.normalise_missing(rows)


@query(
    "sanitise_inf",
    ctes(["dirty"], "SELECT row_key, f_qty, CASE WHEN NOT isinf(f_bad) THEN f_bad END AS f_bad FROM dirty"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dirty").select("row_key", "f_qty", "f_bad")
    return prep.sanitise_inf(rows, prep.infinite_columns(rows, ["f_qty", "f_bad"]))


@query("drop_sparse_columns", ctes(["dirty"], "SELECT row_key, f_qty, target FROM dirty"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dirty").select("row_key", "f_qty", "f_sparse", "target")
    return prep.drop_sparse_columns(rows, ["f_qty", "f_sparse"])[0]


BOUNDS = """SELECT lo, CASE WHEN q3 - q1 > 0 THEN q1 - 3 * (q3 - q1) ELSE a - 4 * greatest(s, 1e-6) END AS lower,
 CASE WHEN q3 - q1 > 0 THEN q3 + 3 * (q3 - q1) ELSE a + 4 * greatest(s, 1e-6) END AS upper, q1, q3, n FROM
 (SELECT 1 AS lo, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS a, stddev_samp(x) AS s,
 count(x) AS n FROM {src})"""


@query(
    "winsorise",
    ctes(
        ["dirty"],
        "WITH fin AS (SELECT row_key, CASE WHEN NOT isinf(f_bad) THEN f_bad END AS x FROM dirty), "
        f"b AS ({BOUNDS.format(src='fin')}) "
        "SELECT row_key, round(CASE WHEN x IS NOT NULL THEN least(greatest(x, b.lower), b.upper) END, 6) AS f_bad FROM fin, b",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = prep.sanitise_inf(view(spark, sf, "dirty").select("row_key", "f_bad"), ["f_bad"])
    (b,) = quality.fit_outlier_bounds(rows, ["f_bad"])
    return _round(prep.winsorise(rows, {"f_bad": (b.lower, b.upper)}), ["f_bad"])


WIDE = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS feature_{i:02d}" for i in range(64))


@query("expand_vector", f"SELECT vec_id, {WIDE} FROM embeddings")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.expand_vector(table(spark, sf, "embeddings"), "embedding", 64, ["vec_id"])


@query(
    "expand_vector_long",
    "SELECT vec_id, 'feature_' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS value "
    "FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.expand_vector_long(table(spark, sf, "embeddings"), "embedding", ["vec_id"])


STEM = (
    "trim(regexp_replace(lower(regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1')), "
    "'[^a-zA-Z0-9_]', '_', 'g'), '_')"
)


@query(
    "dataset_id",
    f"SELECT page_id, 'ds_' || CASE WHEN {STEM} = '' THEN 'dataset' ELSE {STEM} END || '_' || "
    "left(sha256(CASE WHEN length(html) > 0 THEN html ELSE url END), 8) AS by_content, "
    f"'ds_' || CASE WHEN {STEM} = '' THEN 'dataset' ELSE {STEM} END || '_' || left(sha256(url), 8) AS by_name FROM pages",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id",
        dataset_id(F.col("url"), F.col("html")).alias("by_content"),
        dataset_id(F.col("url")).alias("by_name"),
    )


TYPED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag"]


@query(
    "detect_task_type",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN {'TRUE' if c != 'l_returnflag' else 'FALSE'} AND "
        f"count(DISTINCT {c}) > 15 THEN 'regression' ELSE 'classification' END AS task FROM lineitem"
        for c in TYPED
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.detect_task_type(table(spark, sf, "lineitem"), TYPED)


@query(
    "is_continuous",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) > 20 AS many_values, bool_or({c} <> floor({c})) AS has_fraction, "
        f"count(DISTINCT {c}) > 20 OR bool_or({c} <> floor({c})) AS continuous FROM lineitem"
        for c in TYPED[:5]
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.is_continuous(table(spark, sf, "lineitem"), TYPED[:5])


# --------------------------------------------------------------------------- data quality

DIRTY = ["f_qty", "f_bad", "f_sparse", "c_flag"]


def _count_missing(cols: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
        + ("count(*) FILTER (WHERE isinf(f_bad))" if c == "f_bad" else "CAST(0 AS BIGINT)")
        + f" AS infinite FROM {source}"
        for c in cols
    )


@query("profile", ctes(["dirty"], _count_missing([*DIRTY, "target"], "dirty")))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.profile(view(spark, sf, "dirty"), [*DIRTY, "target"])


@query(
    "missing_report",
    ctes(
        ["dirty"],
        f"WITH p AS ({_count_missing([*DIRTY, 'target'], 'dirty')}) SELECT CAST(sum(missing) AS BIGINT) AS total_missing, "
        "round(sum(missing) / CAST(sum(rows) AS DOUBLE), 9) AS missing_ratio, "
        "string_agg(\"column\", ',' ORDER BY \"column\") FILTER (WHERE missing > 0) AS columns_missing, "
        "sum(missing) = 0 AS passed FROM p",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    report = quality.missing_report(view(spark, sf, "dirty"), [*DIRTY, "target"])
    return report.withColumns(
        {"missing_ratio": F.round("missing_ratio", 9), "columns_missing": F.array_join("columns_missing", ",")}
    )


TRIPLE = ["f_qty", "f_disc", "f_tax"]


@query(
    "duplicate_count",
    ctes(["feat"], "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM "
    "(SELECT count(*) AS n FROM feat GROUP BY f_qty, f_disc, f_tax, target)"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_count(view(spark, sf, "feat"), [*TRIPLE, "target"])


@query(
    "deduplicate",
    ctes(["feat"], "SELECT min(row_key) AS row_key, f_qty, f_disc, f_tax, arg_min(target, row_key) AS target FROM feat "
    "GROUP BY f_qty, f_disc, f_tax"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", *TRIPLE, "target")
    return quality.deduplicate(rows, TRIPLE, "row_key")


@query(
    "class_balance",
    ctes(
        ["feat"],
        "WITH g AS (SELECT CAST(target AS VARCHAR) AS class, count(*) AS n FROM feat GROUP BY target) "
        "SELECT class, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS share, "
        "round(min(n) OVER () / CAST(sum(n) OVER () AS DOUBLE), 9) AS min_share, "
        "min(n) OVER () / CAST(sum(n) OVER () AS DOUBLE) >= 0.2 AS passed FROM g",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(quality.class_balance(view(spark, sf, "feat"), "target", 0.20).drop("note"), ["share", "min_share"], 9)


# the inferred rule of every column next to the number of missing values it meets
@query(
    "infer_rules",
    ctes(
        ["dirty"],
        f"WITH p AS ({_count_missing(['row_key', *DIRTY, 'target'], 'dirty')}), "
        "r AS (SELECT * FROM (VALUES ('row_key', 'any', TRUE), ('f_qty', 'finite', TRUE), ('f_bad', 'finite', TRUE), "
        "('f_sparse', 'finite', TRUE), ('c_flag', 'any', TRUE), ('target', 'integer', FALSE)) v(\"column\", \"check\", nullable)) "
        "SELECT r.\"column\", \"check\", nullable, missing FROM r JOIN p ON p.\"column\" = r.\"column\"",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dirty")
    rules = [(c, check, nullable) for c, (check, nullable) in quality.infer_rules(rows, "target").items()]
    table_of_rules = small_table(spark, rules, "column string, check string, nullable boolean")
    return quality.profile(rows, rows.columns).select("column", "missing").join(F.broadcast(table_of_rules), "column")


@query(
    "validate_schema",
    ctes(
        ["dirty"],
        "WITH v AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{check}' AS \"check\", count(*) FILTER (WHERE {bad}) AS violations FROM dirty"
            for c, check, bad in (
                ("f_qty", "finite", "isinf(f_qty)"),
                ("f_bad", "finite", "isinf(f_bad)"),
                ("f_sparse", "finite", "isinf(f_sparse)"),
                ("target", "not_null", "target IS NULL"),
            )
        )
        + ") SELECT *, violations = 0 AS passed FROM v",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dirty").drop("row_key")
    return quality.validate_schema(rows, quality.infer_rules(rows, "target"))


@query(
    "failing_rows",
    ctes(
        ["dirty"],
        "SELECT 'f_bad' AS \"column\", 'finite' AS \"check\", row_key AS \"key\", 'Infinity' AS value FROM dirty WHERE isinf(f_bad) "
        "UNION ALL SELECT 'target', 'not_null', row_key, NULL FROM dirty WHERE target IS NULL",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dirty")
    return quality.failing_rows(rows, quality.infer_rules(rows, "target"), "row_key")


@query(
    "rejection_rules",
    ctes(
        ["dirty"],
        "WITH s AS (SELECT count(*) AS n, (count(*) - count(f_qty)) + (count(*) - count(f_bad)) + (count(*) - count(f_sparse)) AS m, "
        "count(target) AS y, count(*) - count(f_sparse) AS ms FROM dirty), "
        "c AS (SELECT count(*) AS k, min(s) AS smallest FROM (SELECT count(*) AS s FROM dirty WHERE target IS NOT NULL GROUP BY target)), "
        "u AS (SELECT 'three' AS features, n, CAST(3 AS BIGINT) AS k3, m / CAST(n * 3 AS DOUBLE) AS ratio, "
        "(n - y) / CAST(n AS DOUBLE) AS ty, k, smallest, ms, FALSE AS all_sparse FROM s, c UNION ALL "
        "SELECT 'sparse', n, CAST(1 AS BIGINT), ms / CAST(n AS DOUBLE), (n - y) / CAST(n AS DOUBLE), k, smallest, ms, "
        "ms / CAST(n AS DOUBLE) > 0.8 FROM s, c), "
        "r AS (SELECT features, n, k3, ratio, concat_ws(',', CASE WHEN n < 20 THEN 'min_rows' END, "
        "CASE WHEN k3 < 2 THEN 'min_features' END, CASE WHEN ty > 0.5 THEN 'target_missing_ratio' "
        "WHEN k < 2 THEN 'few_classes' WHEN smallest < 2 THEN 'small_class' END, "
        "CASE WHEN ratio > 0.5 THEN 'missing_ratio' END, CASE WHEN all_sparse THEN 'all_columns_sparse' END) AS reasons FROM u) "
        "SELECT features, reasons = '' AS passed, n AS n_rows, k3 AS n_features, round(ratio, 9) AS missing_ratio, reasons FROM r",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dirty")
    out = None
    for name, cols in (("three", ["f_qty", "f_bad", "f_sparse"]), ("sparse", ["f_sparse"])):
        one = quality.rejection_rules(rows, cols).select(
            F.lit(name).alias("features"),
            "passed",
            "n_rows",
            "n_features",
            F.round("missing_ratio", 9).alias("missing_ratio"),
            F.array_join("reasons", ",").alias("reasons"),
        )
        out = one if out is None else out.unionByName(one)
    return out


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "outlier_bounds",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, "
        f"round(upper, 6) AS upper FROM ({BOUNDS.format(src=f'(SELECT {c} AS x FROM lineitem)')})"
        for c in NUMBERS
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round(quality.outlier_bounds(table(spark, sf, "lineitem"), NUMBERS), ["q1", "q3", "lower", "upper"])


# duplicates are judged on the features that survive the sparse-column rule; f_sparse does not
CLEAN = (
    "kept AS (SELECT min(row_key) AS row_key, f_qty, f_bad, c_flag, arg_min(target, row_key) AS target FROM dirty "
    "WHERE target IS NOT NULL GROUP BY f_qty, f_bad, c_flag), "
    "enc AS (SELECT row_key, target, f_qty, CASE WHEN NOT isinf(f_bad) THEN f_bad END AS f_bad, "
    "CAST(c_flag = 'N' AS DOUBLE) AS d_n, CAST(c_flag = 'R' AS DOUBLE) AS d_r FROM kept), "
    + ", ".join(
        f"b{i} AS ({BOUNDS.format(src=f'(SELECT {c} AS x FROM enc)')})" for i, c in enumerate(("f_qty", "f_bad", "d_n", "d_r"))
    )
    + ", done AS (SELECT row_key, target, "
    + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, b{i}.lower), b{i}.upper) END AS {c}"
        for i, c in enumerate(("f_qty", "f_bad", "d_n", "d_r"))
    )
    + " FROM enc, b0, b1, b2, b3)"
)
CLEANED = ["f_qty", "f_bad", "f_sparse", "c_flag"]


@query(
    "clean",
    ctes(
        ["dirty"],
        f"WITH {CLEAN} SELECT row_key, target, round(f_qty, 6) AS f_qty, round(f_bad, 6) AS f_bad, "
        'round(d_n, 6) AS "c_flag_N", round(d_r, 6) AS "c_flag_R" FROM done',
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    done = quality.clean(view(spark, sf, "dirty"), CLEANED, "target", "row_key")
    return _round(done.table, done.features)


@query(
    "clean_report",
    ctes(
        ["dirty"],
        f"WITH {CLEAN}, "
        "q AS (SELECT 'before' AS phase, count(*) AS n, CAST(4 AS BIGINT) AS k, CAST(sum((f_sparse IS NULL)::INT) AS BIGINT) AS m FROM dirty "
        "GROUP BY f_qty, f_bad, f_sparse, c_flag UNION ALL "
        "SELECT 'after', count(*), CAST(4 AS BIGINT), CAST(sum((f_bad IS NULL)::INT) AS BIGINT) FROM done GROUP BY f_qty, f_bad, d_n, d_r) "
        "SELECT phase, CAST(sum(n) AS BIGINT) AS rows, max(k) AS features, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, "
        "CAST(sum(m) AS BIGINT) AS total_missing, round(sum(m) / CAST(sum(n) * 4 AS DOUBLE), 4) AS missing_ratio FROM q GROUP BY phase",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.clean_report(view(spark, sf, "dirty"), CLEANED, "target", "row_key")


@query(
    "validate",
    ctes(
        ["feat", "dirty"],
        "WITH f AS (SELECT 'feat' AS input, TRUE AS rejection_passed, '' AS reasons, TRUE AS schema_passed, "
        "(SELECT (count(*) - count(f_disc)) / CAST(count(*) * 5 AS DOUBLE) FROM feat) AS missing_ratio, "
        "(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM feat GROUP BY f_qty, f_price, f_disc, f_tax, target)) AS duplicates, "
        "(SELECT min(n) / CAST(sum(n) AS DOUBLE) >= 0.2 FROM (SELECT count(*) AS n FROM feat GROUP BY target)) AS balance_passed UNION ALL "
        "SELECT 'dirty', TRUE, '', (SELECT count(*) FILTER (WHERE isinf(f_bad)) = 0 AND count(*) = count(target) FROM dirty), "
        "(SELECT (count(*) - count(f_sparse) + count(*) - count(target)) / CAST(count(*) * 4 AS DOUBLE) FROM dirty), "
        "(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM dirty GROUP BY f_qty, f_bad, f_sparse, target)), "
        "(SELECT min(n) / CAST(sum(n) AS DOUBLE) >= 0.2 FROM (SELECT count(*) AS n FROM dirty WHERE target IS NOT NULL GROUP BY target))) "
        "SELECT input, rejection_passed, reasons, schema_passed, round(missing_ratio, 9) AS missing_ratio, missing_ratio <= 0.5 AS missing_ok, "
        "duplicates, balance_passed, rejection_passed AND schema_passed AND missing_ratio <= 0.5 AS overall_passed FROM f",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name, cols in (("feat", FEATURES), ("dirty", ["f_qty", "f_bad", "f_sparse"])):
        one = quality.validate(view(spark, sf, name), cols)
        parts.append(
            one.withColumns(
                {
                    "input": F.lit(name),
                    "reasons": F.array_join("reasons", ","),
                    "missing_ratio": F.round("missing_ratio", 9),
                }
            )
        )
    return parts[0].unionByName(parts[1])


# --------------------------------------------------------------------------- splits

HASHED = "h AS (SELECT row_key, target, md5('42:' || row_key) AS h FROM feat)"
SIZES = (
    "t AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM feat), "
    "t2 AS (SELECT n, n_test, CAST(ceil(CAST(0.125 AS DOUBLE) * (n - n_test)) AS BIGINT) AS n_val FROM t)"
)
ALLOCATE = (
    "c AS (SELECT target, count(*) AS k FROM feat GROUP BY target), "
    "a AS (SELECT target, k, (k * (n - n_test)) // n AS fl, (k * (n - n_test)) % n AS rem, n, n_test, n_val FROM c, t2), "
    "a2 AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, target) <= (n - n_test) - sum(fl) OVER () THEN 1 ELSE 0 END AS stay FROM a), "
    "a3 AS (SELECT target, k - stay AS k_test, stay, (stay * (n - n_test - n_val)) // (n - n_test) AS fl2, "
    "(stay * (n - n_test - n_val)) % (n - n_test) AS rem2, n - n_test - n_val AS n_train FROM a2), "
    "a4 AS (SELECT target, k_test, stay - (fl2 + CASE WHEN row_number() OVER (ORDER BY rem2 DESC, target) <= n_train - sum(fl2) OVER () THEN 1 ELSE 0 END) AS k_val FROM a3)"
)
STRATIFIED = (
    f"{HASHED}, {SIZES}, {ALLOCATE}, "
    "o AS (SELECT row_key, target, row_number() OVER (PARTITION BY target ORDER BY h, row_key) AS rn FROM h), "
    "s AS (SELECT row_key, o.target, CASE WHEN rn <= k_test THEN 'test' WHEN rn <= k_test + k_val THEN 'val' ELSE 'train' END AS split "
    "FROM o JOIN a4 ON o.target = a4.target)"
)


@query("split_stratified", ctes(["feat"], f"WITH {STRATIFIED} SELECT row_key, target, split FROM s"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ft.split_stratified(view(spark, sf, "feat").select("row_key", "target"), "target", KEY)


@query(
    "split_random",
    ctes(
        ["feat"],
        f"WITH {HASHED}, {SIZES}, o AS (SELECT row_key, row_number() OVER (ORDER BY h, row_key) AS rn FROM h) "
        "SELECT row_key, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM o, t2",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ft.split_random(view(spark, sf, "feat").select("row_key"), KEY)


@query(
    "split_sequential",
    "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY value, event_id) <= floor(0.8 * (SELECT count(*) FROM events)) "
    "THEN 'train' ELSE 'test' END AS split FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ft.split_sequential(table(spark, sf, "events").select("event_id", "value"), ["value", "event_id"]).drop("value")


@query(
    "kfold_assign",
    ctes(
        ["feat"],
        f"WITH {HASHED} SELECT row_key, target, CAST((row_number() OVER (PARTITION BY target ORDER BY h, row_key) - 1) % 5 AS INTEGER) AS fold FROM h",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ft.kfold_assign(view(spark, sf, "feat").select("row_key", "target"), KEY, "target")


@query(
    "write_splits",
    ctes(["feat"], f"WITH {STRATIFIED} SELECT row_key, target, split FROM s WHERE split IN ('val', 'test')"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    rows = ft.split_stratified(view(spark, sf, "feat").select("row_key", "target"), "target", KEY)
    writers.write_splits(rows, path)
    return readers.read_splits(spark, path, ["val", "test"])


@query(
    "read_splits",
    ctes(["feat"], f"WITH {STRATIFIED} SELECT split, target, count(*) AS n FROM s GROUP BY split, target"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    rows = ft.split_stratified(view(spark, sf, "feat").select("row_key", "target"), "target", KEY)
    writers.write_splits(rows, path)
    return readers.read_splits(spark, path).groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- fitted transforms
# fitted on the rows of side 'ref', applied to all rows

FILLED = (
    "m AS (SELECT quantile_cont(f_disc, 0.5) AS md FROM feat WHERE side = 'ref'), "
    "x AS (SELECT row_key, side, f_qty, f_price, coalesce(f_disc, md) AS f_disc, f_tax FROM feat, m)"
)


@query(
    "impute",
    ctes(
        ["feat"],
        "WITH modes AS (SELECT f_disc FROM feat WHERE side = 'ref' AND f_disc IS NOT NULL GROUP BY f_disc "
        "ORDER BY count(*) DESC, f_disc LIMIT 1), m AS (SELECT avg(f_disc) AS a, quantile_cont(f_disc, 0.5) AS md, "
        "(SELECT f_disc FROM modes) AS mo FROM feat WHERE side = 'ref') "
        "SELECT row_key, round(coalesce(f_disc, a), 9) AS by_mean, round(coalesce(f_disc, md), 9) AS by_median, "
        "round(coalesce(f_disc, mo), 9) AS by_mode FROM feat, m",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", "side", "f_disc")
    train = rows.filter("side = 'ref'")
    fills = {
        name: ft.Imputer.fit(train, ["f_disc"], s).fill["f_disc"]
        for name, s in (("by_mean", "mean"), ("by_median", "median"), ("by_mode", "most_frequent"))
    }
    return rows.select(
        "row_key",
        *[F.round(F.coalesce("f_disc", F.lit(v)), 9).alias(name) for name, v in fills.items()],
    )


def _scaled(method: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = view(spark, sf, "feat").select("row_key", "side", *FEATURES)
        scaler = ft.Scaler.fit(rows.filter("side = 'ref'"), FEATURES, method)
        return _round(scaler.transform(rows).drop("side"), FEATURES)

    return run


def _scaled_sql(centre: str, width: str, source: str = "feat", fill: str = "") -> str:
    stats = ", ".join(f"{centre.format(c=c)} AS a_{c}, {width.format(c=c)} AS b_{c}" for c in FEATURES)
    cols = ", ".join(f"round(({c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END, 6) AS {c}" for c in FEATURES)
    return ctes(
        ["feat"],
        f"WITH {fill}st AS (SELECT {stats} FROM {source} WHERE side = 'ref') SELECT row_key, {cols} FROM {source}, st",
    )


query("scale_standard", _scaled_sql("avg({c})", "stddev_pop({c})"))(_scaled("standard"))
query("scale_minmax", _scaled_sql("min({c})", "max({c}) - min({c})"))(_scaled("minmax"))
query(
    "scale_robust",
    _scaled_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
)(_scaled("robust"))


@query("feature_transform", _scaled_sql("avg({c})", "stddev_pop({c})", "x", FILLED + ", "))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", "side", *FEATURES)
    fitted = ft.FeatureTransform.fit(rows.filter("side = 'ref'"), FEATURES)
    return _round(fitted.transform(rows).drop("side"), FEATURES)


@query("pca")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "feat").select("row_key", "side", *FEATURES)
    fitted = ft.FeatureTransform.fit(rows.filter("side = 'ref'"), FEATURES, pca=2)
    return _round(fitted.transform(rows).drop("side"), ["pc_00", "pc_01"])


# two features: the components are the eigenvectors of a 2 x 2 covariance matrix
@query(
    "pca_plane",
    "WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_discount * 100) AS my, var_samp(l_quantity) AS a, var_samp(l_discount * 100) AS c, "
    "covar_samp(l_quantity, l_discount * 100) AS b FROM lineitem), "
    "e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM s), "
    "v AS (SELECT *, (l1 - c) / sqrt((l1 - c) * (l1 - c) + b * b) AS x1, b / sqrt((l1 - c) * (l1 - c) + b * b) AS y1, "
    "b / sqrt((l2 - a) * (l2 - a) + b * b) AS x2, (l2 - a) / sqrt((l2 - a) * (l2 - a) + b * b) AS y2 FROM e), "
    "w AS (SELECT mx, my, x1 * g1 AS x1, y1 * g1 AS y1, x2 * g2 AS x2, y2 * g2 AS y2 FROM (SELECT *, "
    "CASE WHEN (CASE WHEN abs(x1) >= abs(y1) THEN x1 ELSE y1 END) < 0 THEN -1 ELSE 1 END AS g1, "
    "CASE WHEN (CASE WHEN abs(x2) >= abs(y2) THEN x2 ELSE y2 END) < 0 THEN -1 ELSE 1 END AS g2 FROM v)) "
    "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key, "
    "round((l_quantity - mx) * x1 + (l_discount * 100 - my) * y1, 6) AS pc_00, "
    "round((l_quantity - mx) * x2 + (l_discount * 100 - my) * y2, 6) AS pc_01 FROM lineitem, w",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key")
    rows = table(spark, sf, "lineitem").select(key, "l_quantity", (F.col("l_discount") * 100).alias("pct"))
    parts = ft.Components.fit(rows, ["l_quantity", "pct"], 2).transform(rows, ["row_key"])
    return _round(parts, ["pc_00", "pc_01"])


# the same plane from the form for wide vectors
@query("pca_wide", REGISTRY["pca_plane"].sql)
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key")
    rows = table(spark, sf, "lineitem").select(key, F.array("l_quantity", F.col("l_discount") * 100).alias("v"))
    parts = WideComponents.fit(rows, "v", 2).transform(rows, "v", ["row_key"])
    return _round(parts, ["pc_00", "pc_01"])


@query(
    "class_weights",
    ctes(
        ["feat"],
        "WITH s AS (SELECT row_key, side, CASE WHEN f_qty <= 5 THEN 'few' WHEN f_qty <= 25 THEN 'some' ELSE 'many' END AS c_size FROM feat), "
        "c AS (SELECT c_size, count(*) AS k FROM s WHERE side = 'ref' GROUP BY c_size) "
        "SELECT row_key, s.c_size, round(CASE WHEN (SELECT min(k) / CAST(sum(k) AS DOUBLE) FROM c) < 0.2 "
        "THEN (SELECT sum(k) FROM c) / CAST(3 * k AS DOUBLE) ELSE 1 END, 9) AS weight FROM s JOIN c ON s.c_size = c.c_size",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("f_qty") <= 5, "few").when(F.col("f_qty") <= 25, "some").otherwise("many")  # a tenth are few
    rows = view(spark, sf, "feat").withColumn("c_size", size)
    weighted = ft.with_class_weights(rows.select("row_key", "c_size"), ft.class_weights(rows.filter("side = 'ref'"), "c_size"), "c_size")
    return _round(weighted, ["weight"], 9)
