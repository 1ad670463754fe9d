"""Stored state, the whole run, numbering and splits without class-sized collects, and CSV with line breaks."""

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import anomaly, drift, metrics, models
from plumbline.operators import features as ft
from plumbline.plans import state, workflow
from plumbline.plans.ranks import ranged_row_number
from plumbline.sources import readers
from plumbline.streaming import monitors

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    data = [(i, *map(float, r), int(r[0] + r[1] > 0), int(np.digitize(r[0], [-0.5, 0.5])), float(3 * r[0] - 2 * r[1])) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id int, a double, b double, c double, target int, three int, price double").persist()


def test_states_come_back_equal(spark, rows, tmp_path):
    fitted = [
        ft.Imputer.fit(rows, COLS),
        ft.Scaler.fit(rows, COLS),
        ft.Components.fit(rows, COLS, 2),
        ft.FeatureTransform.fit(rows, COLS, pca=2),
        anomaly.ReferenceProfile.fit(rows, COLS),
    ]
    for i, one in enumerate(fitted):
        state.save_state(spark, one, str(tmp_path / str(i)))
        assert state.load_state(spark, str(tmp_path / str(i))) == one
    forest = anomaly.IsolationForest.fit(rows, COLS, ["id"], trees=5)
    state.save_state(spark, forest, str(tmp_path / "forest"))
    again = state.load_state(spark, str(tmp_path / "forest"))
    scores = lambda f: sorted(map(tuple, f.score(rows).select("id", "decision").collect()))
    assert scores(again) == scores(forest)
    with pytest.raises(TypeError, match="cannot store"):
        state.save_state(spark, object(), str(tmp_path / "x"))


@pytest.mark.parametrize(("name", "label"), [("logistic_regression", "target"), ("gradient_boosting", "three"), ("knn", "three"), ("linear_regression", "price")])
def test_models_come_back_equal(spark, rows, tmp_path, name, label):
    params = {"rounds": 3, "depth": 2} if name == "gradient_boosting" else None
    model = models.fit(rows, name, COLS, label, params)
    state.save_model(spark, model, str(tmp_path / "model"))
    again = state.load_model(spark, str(tmp_path / "model"))
    scores = lambda m: sorted(map(tuple, models.batch_score(rows, m, COLS).select("id", "prediction", "probability").collect()))
    assert scores(again) == scores(model)


def test_whole_run(spark, rows, tmp_path):
    raw = rows.drop("three", "price").withColumn("kind", F.when(F.col("id") % 3 == 0, "x").otherwise("y")).withColumnRenamed("target", "outcome")
    out = workflow.run_pipeline(raw, "outcome", "id", str(tmp_path), "exp_1", "2024-01-01T00:00:00Z", ["logistic_regression", "decision_tree"], {"decision_tree": {"depth": 4}})
    assert {r["split"]: r["n"] for r in out.splits.collect()} == {"train": 210, "val": 30, "test": 60}
    doc = readers.read_experiments(spark, f"{tmp_path}/experiments").first()
    assert doc["best_model"]["algorithm"] in ("logistic_regression", "decision_tree") and doc["best_model"]["metrics"]["f1"] > 0.8
    assert {g["gate"] for g in doc["security"]["gate_results"]} == {"data_integrity", "adversarial_robustness"}
    assert set(doc["models"]) == {"logistic_regression", "decision_tree"}
    transform = state.load_state(spark, f"{tmp_path}/transform")
    model = state.load_model(spark, f"{tmp_path}/model")
    test = readers.read_splits(spark, f"{tmp_path}/splits", ["test"])
    assert models.batch_score(test, model, transform.cols).filter("prediction = target").count() > 45


def test_run_rejects_before_writing(spark, rows, tmp_path):
    with pytest.raises(workflow.Rejected, match="min_rows"):
        workflow.run_pipeline(rows.limit(5), "target", "id", str(tmp_path / "none"), "exp", "now")
    assert not (tmp_path / "none").exists()


def test_run_of_a_regression(spark, rows, tmp_path):
    out = workflow.run_pipeline(rows.select("id", *COLS, "price"), "price", "id", str(tmp_path), "exp_2", "2024-01-01T00:00:00Z", ["linear_regression"])
    assert out.experiment.first()["dataset"]["task_type"] == "regression"
    assert {r["metric"] for r in out.results.collect()} >= {"test_r2", "val_r2", "baseline_test_r2"}


def test_numbers_in_each_part(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, "b").alias("p"), F.md5(F.col("id").cast("string")).alias("h"))
    got = ranged_row_number(df, ["h"], "n", ["p"]).collect()
    want = {}
    for r in got:
        want.setdefault(r["p"], []).append((r["h"], r["n"]))
    assert set(want) == {"hot", "b", None}
    for pairs in want.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_split_of_many_classes_is_that_of_few(spark, monkeypatch):
    df = spark.range(4000).select("id", (F.col("id") * F.col("id") % 97).alias("k"))
    few = {r["id"]: r["split"] for r in ft.split_stratified(df, "k", ["id"]).collect()}
    monkeypatch.setattr(ft, "INLINE_CLASSES", 5)
    many = {r["id"]: r["split"] for r in ft.split_stratified(df, "k", ["id"]).collect()}
    assert many == few


def test_split_with_a_class_per_few_rows(spark):
    df = spark.range(30_000).select("id", F.concat(F.lit("class_"), (F.col("id") % 10_000).cast("string")).alias("k"))
    sizes = {r["split"]: r["count"] for r in ft.split_stratified(df, "k", ["id"]).groupBy("split").count().collect()}
    assert sizes == {"test": 6000, "val": 3000, "train": 21_000}


def test_confusion_of_many_classes(spark):
    df = spark.range(3000).select((F.col("id") % 150).alias("label"), (F.col("id") * 7 % 150).alias("prediction"))
    out = metrics.confusion_matrix(df)
    assert out.count() == 150 * 150 and out.agg(F.sum("n")).first()[0] == 3000


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text\n1,"first line\nsecond ""line"""\n2,plain\n')
    got = [tuple(r) for r in readers.read_csv(spark, str(path)).orderBy("id").collect()]
    assert got == [(1, 'first line\nsecond "line"'), (2, "plain")]
    with pytest.raises(ValueError, match="line break"):
        readers.read_csv(spark, str(path), multiline=False)


def test_csv_types_are_those_of_all_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("x\n" + "\n".join(["1"] * 2000) + "\nword\n")
    assert dict(readers.read_csv(spark, str(path)).dtypes) == {"x": "string"}


def test_reference_is_fitted_once(spark, rows):
    current = rows.select(*[(F.col(c) + (2 if c == "a" else 0)).alias(c) for c in COLS])
    fitted = drift.FittedReference.fit(rows, COLS)
    both = drift.both_sides(rows, current, COLS)
    want = sorted(map(str, drift.drift_features(both, COLS, F.col("_ref")).collect()))
    for _ in range(2):
        assert sorted(map(str, fitted.features(current).collect())) == want
    assert {r["feature"] for r in fitted.features(current.drop("c")).collect()} == {"a", "b"}


def test_open_windows_are_there_at_the_end(spark, tmp_path):
    import datetime as dt

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=40 * i), float(i), "success") for i in range(12)]
    spark.createDataFrame(rows, "request_id long, ts timestamp, latency_ms double, status string").write.parquet(str(tmp_path / "log"))
    done = monitors.drain_latest(monitors.stream_traffic(readers.event_stream(spark, str(tmp_path / "log"))), "t")
    assert done.agg(F.sum("requests")).first()[0] == 12 and done.count() == 8


def test_folder_without_a_setting():
    class Context:
        applicationId = "app-1"

        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):  # noqa: N802
            return self.folder

        def setCheckpointDir(self, folder):  # noqa: N802
            self.folder = folder

    class Session:
        conf = {}

        def __init__(self, master):
            self.sparkContext = Context(master)

    assert session.scratch_root(Session("local[2]")).endswith("plumbline-app-1")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session("spark://host:7077"))
    assert SparkSession is not None
