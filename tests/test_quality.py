import pytest
from pyspark.sql import functions as F

from plumbline.operators import prep, quality
from plumbline.operators.quality import Thresholds

INF = float("inf")
NAN = float("nan")


def _reasons(df, features, task="classification", limits=Thresholds()):
    row = quality.rejection_rules(df, features, "target", task, limits).first()
    assert row["passed"] == (not row["reasons"])
    return row["reasons"]


def test_clean_table_is_accepted(spark, rng):
    rows = [(*map(float, rng.normal(size=4)), i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, target int")
    assert _reasons(df, ["a", "b", "c", "d"]) == []
    assert quality.validate(df, ["a", "b", "c", "d"]).first()["overall_passed"]


def test_too_few_rows_and_features(spark):
    assert _reasons(spark.createDataFrame([(1.0, 2.0, 0), (2.0, 1.0, 1), (3.0, 0.0, 1)], "a double, b double, target int"), ["a", "b"])[:1] == ["min_rows"]
    one = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "a double, target int")
    assert _reasons(one, ["a"]) == ["min_features"]


def test_mostly_missing(spark):
    rows = [(1.0 if i < 5 else None, NAN if i < 30 else 2.0, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, target int")
    assert "missing_ratio" in _reasons(df, ["a", "b"])
    assert "all_columns_sparse" in _reasons(df.withColumn("b", F.lit(None).cast("double")), ["a", "b"])


@pytest.mark.parametrize(
    ("targets", "task", "reason"),
    [
        ([1] * 30, "classification", "few_classes"),
        ([0] * 29 + [1], "classification", "small_class"),
        ([None] * 30, "classification", "target_all_missing"),
        ([None] * 16 + [0, 1] * 7, "classification", "target_missing_ratio"),
        ([3] * 30, "regression", "target_constant"),
        ([], "classification", "target_empty"),
    ],
)
def test_target_rules(spark, targets, task, reason):
    rows = [(float(i), float(i * i), t) for i, t in enumerate(targets)]
    df = spark.createDataFrame(rows, "a double, b double, target int")
    assert reason in _reasons(df, ["a", "b"], task)


def test_target_without_numbers(spark):
    df = spark.createDataFrame([(float(i), 1.0, "x") for i in range(30)], "a double, b double, target string")
    assert _reasons(df, ["a", "b"], "regression") == ["target_not_numeric"]


def test_duplicates_and_missing(spark):
    twice = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert quality.duplicate_count(twice, ["a", "b"]).first()["duplicates"] == 1
    gaps = spark.createDataFrame([(1.0, 3.0), (NAN, 4.0)], "a double, b double")
    row = quality.missing_report(gaps, ["a", "b"]).first()
    assert (row["total_missing"], row["missing_ratio"], row["columns_missing"], row["passed"]) == (1, 0.25, ["a"], False)


def test_missing_values_are_equal_for_duplicates(spark):
    df = spark.createDataFrame([(NAN, 1), (None, 2), (NAN, 3), (1.0, 4)], "a double, k int")
    assert quality.duplicate_count(df, ["a"]).first()["duplicates"] == 2
    assert sorted(r["k"] for r in quality.deduplicate(df, ["a"], "k").collect()) == [1, 4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, target int")
    assert quality.duplicate_count(df, ["a"]).first().asDict() == {"rows": 0, "duplicates": 0}
    assert quality.missing_report(df, ["a"]).first()["missing_ratio"] == 0.0


def test_class_balance(spark):
    skewed = spark.createDataFrame([(int(i == 0),) for i in range(100)], "target int")
    even = spark.createDataFrame([(int(i < 40),) for i in range(100)], "target int")
    assert not quality.class_balance(skewed).first()["passed"]
    assert quality.class_balance(even).first()["passed"]
    many = spark.createDataFrame([(i,) for i in range(30)], "target int")
    assert quality.class_balance(many).first()["note"] == "continuous target"


def test_schema_violations_are_all_reported(spark):
    df = spark.createDataFrame([(1.0, INF, 1), (-INF, 2.0, None), (INF, 3.0, 0)], "a double, b double, target int")
    rules = quality.infer_rules(df)
    assert rules == {"a": ("finite", True), "b": ("finite", True), "target": ("integer", False)}
    found = {(r["column"], r["check"]): r["violations"] for r in quality.validate_schema(df, rules).collect()}
    assert found == {("a", "finite"): 2, ("b", "finite"): 1, ("target", "not_null"): 1}
    assert quality.failing_rows(df.withColumn("k", F.lit(1)), rules, "k").count() == 4


def test_cleaning_the_dirty_table(spark, rng):
    rows = [
        (i, float(rng.normal()), 999999.0 if i == 3 else float(rng.normal()), 1.0 if i < 4 else None, "AB"[i % 2], i % 2)
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, "k int, f double, outlier double, junk double, cat string, target int")
    done = quality.clean(df, ["f", "outlier", "junk", "cat"], "target", "k")
    assert done.features == ["f", "outlier", "cat_B"]
    out = done.table.agg(F.max("outlier"), F.count("*"), F.sum("cat_B")).first()
    assert out[0] < 999999.0 and out[1] == 40 and out[2] == 20.0
    assert [a.split(":")[0] for a in done.actions] == [
        "sparse columns dropped", "columns one-hot encoded", "outlier values capped",
    ]


def test_rare_dummies_are_capped_like_any_number(spark):
    rows = [(i, "b" if i == 0 else "a", float(i), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, cat string, x double, target int")
    done = quality.clean(df, ["cat", "x"], "target", "k")
    assert 0.0 < done.table.agg(F.max("cat_b")).first()[0] < 1.0


def test_outlier_bounds_of_a_constant_column_and_few_values(spark):
    df = spark.createDataFrame([(5.0, float(i) if i < 3 else None) for i in range(10)], "c double, few double")
    rows = {r["column"]: r for r in quality.outlier_bounds(df, ["c", "few"]).collect()}
    assert rows["c"]["lower"] == pytest.approx(5 - 4e-6) and rows["c"]["upper"] == pytest.approx(5 + 4e-6)
    assert rows["few"]["lower"] is None


def test_one_hot_of_missing_and_boolean(spark):
    df = spark.createDataFrame([("b", True), ("a", False), (None, None)], "c string, t boolean")
    out = prep.one_hot_drop_first(df, ["c", "t"])
    assert out.columns == ["c_b", "t_True"]
    assert sorted(map(tuple, out.collect())) == [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)]


def test_one_hot_of_many_categories_is_a_sparse_vector(spark):
    rows = [(i, None if i % 10 == 0 else f"v{i % 51:02}") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, c string")
    wide = prep.one_hot_drop_first(df, ["c"], limit=50)
    assert wide.columns == ["id", "c_onehot"]
    narrow = prep.one_hot_drop_first(df, ["c"], limit=51)
    names = narrow.columns[1:]
    want = {r["id"]: [r[n] for n in names] for r in narrow.collect()}
    assert all(r["c_onehot"].toArray().tolist() == want[r["id"]] for r in wide.collect())


def test_one_hot_form_is_chosen_by_name(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}", f"w{i % 60}") for i in range(120)], "id int, c string, d string")
    assert prep.one_hot_drop_first(df, ["c", "d"], limit=50, vectors=["d"]).columns == ["id", "d_onehot", "c_v1", "c_v2"]
    assert prep.one_hot_drop_first(df, ["c"], limit=50, vectors=["c"]).columns == ["id", "d", "c_onehot"]
    with pytest.raises(ValueError, match="more than 50 categories in d"):
        prep.one_hot_drop_first(df, ["c", "d"], limit=50, vectors=[])


@pytest.mark.parametrize("categories", [1001, 100_000])
def test_cleaning_columns_of_many_categories(spark, categories):
    n = max(3000, categories)
    wide = F.concat(F.lit("v"), F.lpad((F.col("id") % categories).cast("string"), 6, "0"))
    df = spark.range(n).select("id", wide.alias("wide"), F.concat(F.lit("c"), F.col("id") % 3).alias("few"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 2).alias("y"))
    done = quality.clean(df, ["wide", "few", "x"], "y", "id")
    assert done.features == ["x", "few_c1", "few_c2", "wide_onehot"] and done.table.count() == n
    assert "of these as one sparse vector each: wide" in done.actions
    row = done.table.filter("id = 5").first()
    assert (row["wide_onehot"].size, row["wide_onehot"].indices.tolist(), row["few_c2"]) == (categories - 1, [4], 1.0)
    report = {r["phase"]: r for r in quality.clean_report(df, ["wide", "few", "x"], "y", "id").collect()}
    assert (report["before"]["features"], report["after"]["features"], report["after"]["rows"]) == (3, 4, n)


def test_cleaning_with_a_named_vector(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}", "same", float(i), i % 2) for i in range(60)], "id int, c string, d string, x double, y int")
    done = quality.clean(df, ["c", "d", "x"], "y", "id", quality.Thresholds(one_hot_vectors=("c", "d")))
    assert done.features == ["x", "c_onehot"]


def test_codes_of_many_labels_with_one_prefix(spark):
    df = spark.range(3000).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("target"))
    codes = {r["label"]: r["code"] for r in prep.label_codes(df).collect()}
    assert codes == {v: i for i, v in enumerate(sorted(f"user_{i}" for i in range(3000)))}


def test_signed_zeros_are_one_value(spark):
    df = spark.createDataFrame([(float(i % 3) * s,) for i in range(30) for s in (0.0, -0.0, 1.0)], "x double")
    assert prep.more_distinct_than(df, {"x": F.col("x")}, 3) == {"x": False}


def test_select_target_keeps_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert prep.select_target(df, "b").columns == ["a", "target", "c"]


def test_target_errors(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, t string")
    with pytest.raises(ValueError, match="not found.*'a', 't'"):
        prep.select_target(df, "label")
    with pytest.raises(ValueError, match="only missing"):
        prep.drop_null_target(spark.createDataFrame([(NAN,), (None,)], "target double"))
    with pytest.raises(ValueError, match="at least 2 classes"):
        prep.encode_labels(df, "t")
    with pytest.raises(ValueError, match="no numeric"):
        prep.regression_target(df, "t")


def test_labels_in_code_point_order(spark):
    df = spark.createDataFrame([("é",), ("b",), ("Z",), ("a",), ("b",)], "target string")
    codes = {r["label"]: r["code"] for r in prep.label_codes(df).collect()}
    assert codes == {"Z": 0, "a": 1, "b": 2, "é": 3}


def test_task_and_continuity(spark):
    df = spark.range(100).select(
        F.col("id").cast("double").alias("many"), (F.col("id") % 3).alias("few"), ((F.col("id") % 3) / 2).alias("half"),
        F.col("id").cast("string").alias("text"),
    )
    tasks = {r["column"]: r["task"] for r in prep.detect_task_type(df, df.columns).collect()}
    assert tasks == {"many": "regression", "few": "classification", "half": "classification", "text": "classification"}
    found = prep.continuous_columns(df, ["many", "few", "half"])
    assert found == {"many": (True, False), "few": (False, False), "half": (False, True)}
