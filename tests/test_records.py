import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import envelopment, experiments, ranking
from plumbline.sources import commits, quoted_csv, readers, writers

COLUMNS = ["name", *ranking.INPUTS, *ranking.OUTPUTS]


def _dmus(spark, rng, n=60):
    rows = [(i, *map(float, rng.uniform(1, 10, 4))) for i in range(n)]
    return spark.createDataFrame(rows, "dmu int, i0 double, i1 double, o0 double, o1 double")


def _best_weights(points, k, steps=200):
    """Efficiency of one of many two-input, two-output units by a fine grid of weight directions."""
    x, y = points[:, :2], points[:, 2:]
    best = 0.0
    a = np.linspace(1e-4, 1 - 1e-4, steps)
    for v in a:
        inputs = x @ [v, 1 - v]
        u = np.stack([a, 1 - a])
        rate = (y @ u) / inputs[:, None]
        best = max(best, (rate[k] / rate.max(axis=0)).max())
    return best


def test_efficiency_against_a_grid(spark, rng):
    df = _dmus(spark, rng)
    points = np.array([r[1:] for r in df.orderBy("dmu").collect()])
    found = {r["dmu"]: r["efficiency"] for r in ranking.dea_ccr(df, ["i0", "i1"], ["o0", "o1"]).collect()}
    assert max(found.values()) == pytest.approx(1.0) and min(found.values()) > 0
    for k in range(0, 60, 7):
        assert found[k] == pytest.approx(_best_weights(points, k), abs=0.02)


@pytest.mark.parametrize("copies", [1, 3])
def test_pricing_rounds_give_the_same_as_one_set(spark, rng, monkeypatch, copies):
    df = _dmus(spark, rng, 150)
    for _ in range(copies - 1):
        df = df.unionByName(df)
    ins, outs = ["i0", "i1"], ["o0", "o1"]
    one = sorted(map(tuple, ranking.dea_ccr(df, ins, outs).collect()))
    monkeypatch.setattr(envelopment, "BLOCK_ROWS", 5)
    monkeypatch.setattr(envelopment, "PRICED", 40)
    monkeypatch.setattr(envelopment, "ADDED", 1)
    points = df.select("dmu", F.monotonically_increasing_id().alias("uid"), F.array(*ins).alias("x"), F.array(*outs).alias("y"))
    front = envelopment.frontier(points, (2, 2), strong_rows=2, block_rows=3)
    assert 1 <= len(front.strong) <= 2 and 3 < front.n_rest < 150 and len(front.boxes) > 1
    found = envelopment.efficiencies(points, front, stack=7).join(points, "uid").select("dmu", "efficiency")
    two = sorted(map(tuple, found.collect()))
    assert len(one) == len(two) and all(a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-7) for a, b in zip(one, two))


def test_frontier_holds_every_undominated_row(spark, rng):
    rows = [(rng.uniform(1, 10, 2).tolist(), rng.uniform(1, 10, 2).tolist()) for _ in range(600)]
    df = spark.createDataFrame([*rows, *rows[:50]], "x array<double>, y array<double>").repartition(6)
    front = envelopment.frontier(df, (2, 2), strong_rows=10, block_rows=20)
    rest = envelopment._costs(front.rest.toPandas())
    have = {tuple(r) for r in np.vstack([front.strong, rest]).round(12)}
    costs = np.array([[*x, *[-v for v in y]] for x, y in rows])
    want = {tuple(r) for r in costs[envelopment.undominated(costs)].round(12)}
    assert want <= have and len(have) < 400
    for block, low in [(b[0], b[1:]) for b in front.boxes]:
        own = envelopment._costs(front.rest.filter(F.col("block") == int(block)).toPandas())
        assert np.allclose(own.min(axis=0), low)


def test_stacked_programs_against_every_vertex(rng):
    for _ in range(5):
        x, y = rng.uniform(1, 10, (12, 2)), rng.uniform(1, 10, (12, 1))
        found, u, v = envelopment.solve_stacked(x, y, np.hstack([y, -x]), np.zeros((12, 0, 3)))
        assert ((u * y).sum(1) - found == pytest.approx(0)) and ((v * x).sum(1) == pytest.approx(1))
        assert ((u @ y.T - v @ x.T) < 1e-8).all() and (u > 1e-4 - 1e-9).all() and (v > 1e-4 - 1e-9).all()
        for k in range(12):  # with one output the best weights lie where two lines of v meet, or at a bound
            lines = np.stack([(x[:, 0] - x[:, 1] * x[k, 0] / x[k, 1]) / y[:, 0], x[:, 1] / x[k, 1] / y[:, 0]], axis=1)
            t = [1e-4, (1 - 1e-4 * x[k, 1]) / x[k, 0]]
            t += [(b[1] - a[1]) / (a[0] - b[0]) for a in lines for b in lines if abs(a[0] - b[0]) > 1e-12]
            t = np.array([s for s in t if t[0] <= s <= t[1]])
            best = (lines[:, :1] * t + lines[:, 1:]).min(axis=0).max() * y[k, 0]
            assert found[k] == pytest.approx(best, abs=1e-8)


def test_units_without_numbers_or_outputs(spark):
    schema = "dmu string, i double, o double"
    rows = [(None, 1.0, 1.0), ("a", None, 1.0), ("a", 2.0, 0.0), ("b", float("nan"), 1.0), ("c", 2.0, 1.0)]
    found = ranking.dea_ccr(spark.createDataFrame(rows, schema), ["i"], ["o"]).collect()
    got = sorted(((r["dmu"] or "", r["efficiency"]) for r in found), key=str)
    assert got == sorted([("", pytest.approx(1)), ("a", None), ("a", 0.0), ("b", None), ("c", pytest.approx(0.5))], key=lambda r: str((r[0], 1.0 if r[0] == "" else 0.5 if r[0] == "c" else r[1])))
    assert ranking.dea_ccr(spark.createDataFrame([], schema), ["i"], ["o"]).count() == 0
    assert ranking.dea_ccr(spark.createDataFrame([("a", None, None)], schema), ["i"], ["o"]).collect() == [("a", None)]


def test_copies_and_dominated_units(spark):
    rows = [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 1.0), (4, 4.0, 2.0)]
    df = spark.createDataFrame(rows, "dmu int, i double, o double")
    found = {r["dmu"]: r["efficiency"] for r in ranking.dea_ccr(df, ["i"], ["o"]).collect()}
    assert found == {1: pytest.approx(1), 2: pytest.approx(1), 3: pytest.approx(0.5), 4: pytest.approx(0.5)}


def test_huge_inputs_have_no_feasible_weights_unless_scaled(spark):
    rows = [(1, 20000.0, 20000.0, 1.0), (2, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "dmu int, a double, b double, o double")
    plain = {r["dmu"]: r["efficiency"] for r in ranking.dea_ccr(df, ["a", "b"], ["o"]).collect()}
    scaled = {r["dmu"]: r["efficiency"] for r in ranking.dea_ccr(df, ["a", "b"], ["o"], scale=True).collect()}
    assert plain[1] == 0.0 and plain[2] == pytest.approx(1.0, abs=1e-3)
    assert max(scaled.values()) == pytest.approx(1.0)


def test_three_workflows(spark):
    rows = [
        ("A", 10.0, 14.0, 180.0, 48.0, 0.80, 0.20, 0.45, 0.0),
        ("B", 12.0, 6.0, 45.0, 4.0, 0.82, 0.55, 0.60, 0.25),
        ("C", 15.0, 0.0, 0.5, 0.5, 0.83, 0.95, 0.85, 1.0),
    ]
    df = ranking.dmu_prepare(spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'name' else 'double'}" for c in COLUMNS)))
    ins, outs = [f"in_{i}" for i in range(4)], [f"out_{i}" for i in range(4)]
    assert df.filter("dmu = 'A'").select("in_1", "out_3").first() == (15.0, 0.01)
    scored = ranking.composite_score(df.join(ranking.dea_ccr(df, ins, outs), "dmu"), ins, outs)
    for r in scored.collect():
        assert 0 <= r["efficiency"] <= 1 and 0 <= r["composite_score"] <= 1
    best = ranking.dea_rank(scored).first()
    assert best["best"] == "C" and best["num_dmus"] == 3


def test_rank_names_its_method(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.99999, 0.9), ("c", 0.5, 1.0)], "dmu string, efficiency double, composite_score double")
    best = ranking.dea_rank(df).first()
    assert (best["best"], best["ties"], best["ranking_method"]) == ("b", 2, "dea_efficiency + composite_tiebreak")
    alone = ranking.dea_rank(df.filter("dmu <> 'b'")).first()
    assert (alone["best"], alone["ranking_method"]) == ("a", "dea_efficiency")


# ---------------------------------------------------------------- documents


def test_experiment_documents(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    full = {
        "experiment_id": "e1", "experiment_name": "n", "created_at": "2024-01-02T00:00:00Z", "status": "COMPLETED",
        "dataset": {"name": "cars", "dataset_id": ""}, "models": {"svm": {"algorithm": "svm", "metrics": {"f1": 0.7}}},
        "best_model": {"algorithm": "svm"}, "security": {"overall_score": 0.5}, "deployment": {"model_version": "v4"},
    }
    (folder / "a.json").write_text(json.dumps(full, indent=2))
    (folder / "b.json").write_text(json.dumps({"experiment_id": "e2", "status": "FAILED", "model_version": "v9", "created_at": "2024-01-03"}))
    (folder / "c.json").write_text("{ not json")
    docs = readers.read_experiments(spark, str(folder), multiline=True)
    rows = {r["experiment_id"]: r for r in experiments.experiment_list(docs).collect()}
    assert set(rows) == {"e1", "e2"}
    assert (rows["e1"]["dataset_id"], rows["e1"]["dataset_name"], rows["e1"]["model_version"]) == ("ds_cars", "cars", "v4")
    assert (rows["e2"]["dataset_id"], rows["e2"]["dataset_name"], rows["e2"]["f1_score"]) == ("ds_dataset", "dataset.csv", 0.0)
    flat = experiments.experiment_flatten(docs).collect()
    assert len(flat) == 1 and flat[0]["f1"] == 0.7 and flat[0]["roc_auc"] == 0.5
    assert readers.read_experiment(docs, "latest").first()["experiment_id"] == "e2"
    assert readers.read_experiment(docs, "e1").count() == 1 and readers.read_experiment(docs, "x").count() == 0
    assert experiments.next_version(docs).first() == ("v3", "v10")
    kpis = experiments.experiment_kpis(experiments.experiment_list(docs)).first()
    assert (kpis["total"], kpis["completed"], kpis["failed"], kpis["avg_security_pct"]) == (2, 1, 1, 25.0)


def test_documents_carry_settings_quality_and_confusion(spark, tmp_path):
    runs = spark.createDataFrame([("e", "n", "v1", "d", "f", "t", "COMPLETED", "classification")], "experiment_id string, experiment_name string, model_version string, dataset_id string, file_name string, created_at string, status string, task_type string")
    cells = {"f1": 0.8, "confusion_0_0": 5.0, "confusion_2_1": 3.0, "confusion_1_1": 7.0}
    results = spark.createDataFrame([("e", "svm", 0, k, v) for k, v in cells.items()] + [("e", "knn", 1, "f1", 0.7)], "experiment_id string, algorithm string, position int, metric string, value double")
    gates = spark.createDataFrame([("e", "g", True, 1.0)], "experiment_id string, gate string, passed boolean, score double")
    details = spark.createDataFrame([("e", "svm", "r1", "/m", {"C": "1.0"})], "experiment_id string, algorithm string, run_id string, model_path string, hyperparams map<string,string>")
    quality = spark.createDataFrame([("e", False, ["few rows"], ["one dropped"])], "experiment_id string, passed boolean, reasons array<string>, actions array<string>")
    docs = experiments.build_experiments(runs, results, gates, details=details, quality=quality)
    writers.write_experiments(docs, str(tmp_path / "d"))
    doc = readers.read_experiments(spark, str(tmp_path / "d")).first()
    assert doc["models"]["svm"]["hyperparams"] == {"C": "1.0"} and doc["models"]["knn"]["hyperparams"] is None
    assert doc["best_model"]["confusion_matrix"] == [[5, 0, 0], [0, 7, 0], [0, 3, 0]] and doc["models"]["knn"]["confusion_matrix"] is None
    assert (doc["best_model"]["run_id"], doc["best_model"]["model_path"]) == ("r1", "/m")
    assert doc["data_quality"].asDict() == {"passed": False, "reasons": ["few rows"], "actions": ["one dropped"]}
    assert experiments.build_experiments(runs, results, gates).first()["data_quality"]["passed"]


def test_writers_at_once_never_share_a_number(spark, tmp_path):
    folder = str(tmp_path / "events")

    def work(k):
        return [commits.register_version(spark, folder, "m/1", f"2024-01-01T00:00:{k:02}") for _ in range(10)]

    with ThreadPoolExecutor(8) as pool:
        versions = [v for found in pool.map(work, range(8)) for v in found]
    assert sorted(versions) == list(range(1, 81))
    events = commits.read_events(spark, folder)
    assert sorted(r["event_id"] for r in events.collect()) == list(range(1, 81))
    commits.commit_transition(spark, folder, "m/1", 7, "Production", "2024-01-02T00:00:00")
    commits.commit_transition(spark, folder, "m/1", 9, "Production", "2024-01-02T00:00:00")
    found = {r["version"]: r["stage"] for r in experiments.registry_current(commits.read_events(spark, folder)).collect()}
    assert found[9] == "Production" and found[7] == "Archived" and found[1] == "None" and len(found) == 80


def test_documents_committed_at_once_get_versions_of_their_own(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = [spark.createDataFrame([(f"e{k}", "v0")], "experiment_id string, model_version string") for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda d: commits.commit_experiment(d, path), docs))
    stored = {r["experiment_id"]: r["model_version"] for r in readers.read_experiments(spark, path).collect()}
    assert stored == {f"e{k}": v for k, v in enumerate(versions)} and sorted(versions) == [f"v{n}" for n in range(1, 7)]
    assert commits.put_if_absent(spark, f"{path}/_versions/0000000001.json", b"x") is False
    assert commits.last_number(spark, f"file://{path}/_versions") == 6


def test_registry(spark):
    rows = [("m", 1, "Staging", 1), ("m", 1, "Production", 2), ("m", 2, "Production", 3), ("m", 3, "Staging", 4), ("k", 1, "Production", 1)]
    df = spark.createDataFrame(rows, "model string, version int, stage string, event_time int").withColumn("event_id", F.col("event_time"))
    found = {(r["model"], r["version"]): r["stage"] for r in experiments.registry_current(df).collect()}
    assert found == {("m", 1): "Archived", ("m", 2): "Production", ("m", 3): "Staging", ("k", 1): "Production"}
    both = {(r["model"], r["version"]): r["stage"] for r in experiments.registry_current(df, False).collect()}
    assert both["m", 1] == "Production"


# ---------------------------------------------------------------- sources


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('i,gap,x,b,s,none\n1,1,0.5,True,"a, ""b""",NA\n2,NA,1e3,False,null,\n 3 ,3,-inf,True,n/a,None\n')
    df = readers.read_table(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "double", "boolean", "string", "double"]
    rows = df.orderBy("i").collect()
    assert tuple(rows[0]) == (1, 1.0, 0.5, True, 'a, "b"', None)
    assert tuple(rows[1]) == (2, None, 1000.0, False, None, None)
    assert tuple(rows[2]) == (3, 3.0, float("-inf"), True, None, None)


def _one_task(spark, path):
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


@pytest.mark.parametrize("size", [37, 400, 5000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, rng, size, end):
    texts = ["plain", "", '"two\nlines"', '"a, ""b"" c"', '""', '"\n\n"', "é日", '"ends with break\n"', '"""\n"""']
    for name in ("a.csv", "b.csv"):
        lines = [f"{i},{texts[rng.integers(len(texts))]},{texts[rng.integers(len(texts))]}" for i in range(300)]
        (tmp_path / name).write_text(end.join(["id,t,u", *lines]) + (end if name == "a.csv" else ""), newline="")
    found = quoted_csv.read_quoted(spark, str(tmp_path), size)
    want = _one_task(spark, str(tmp_path))

    def plain(df):  # the reader of one task keeps quoted nothing as an empty text
        return sorted((r["id"], r["t"] or "", r["u"] or "") for r in df.collect())

    assert found.columns == want.columns and plain(found) == plain(want) and found.count() == 600
    bytes_ = sum(f.stat().st_size for f in tmp_path.glob("*.csv"))
    parts = found.select(F.input_file_name()).distinct().count()
    assert parts > 10 if bytes_ > 40 * size else parts >= 1


def test_quoted_csv_that_needs_one_task(spark, tmp_path):
    (tmp_path / "stray").mkdir()
    (tmp_path / "stray" / "a.csv").write_text('id,t\n1,5" pipe\n2,"x\ny"\n')
    assert quoted_csv.read_quoted(spark, str(tmp_path / "stray"), 10) is None
    (tmp_path / "unlike").mkdir()
    for name, head in (("a.csv", "id,t"), ("b.csv", "t,id")):
        (tmp_path / "unlike" / name).write_text(f"{head}\n1,2\n")
    assert quoted_csv.read_quoted(spark, str(tmp_path / "unlike")) is None
    assert quoted_csv.read_quoted(spark, "viewfs://store/x") is None
    (tmp_path / "head.csv").write_text("id,t\n")
    assert quoted_csv.read_quoted(spark, str(tmp_path / "head.csv")).columns == ["id", "t"]


def test_types_of_a_table_with_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('i,x,s\n1,0.5,"a\nb"\n2,NA,"say ""hi"""\n3,1e3,null\n4,2\n')
    df = readers.read_table(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string"]
    assert [tuple(r) for r in df.orderBy("i").collect()] == [(1, 0.5, "a\nb"), (2, None, 'say "hi"'), (3, 1000.0, None), (4, 2.0, None)]


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported file format 'xlsx'.*csv, json, parquet"):
        readers.read_table(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "a.csv"))


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_table(spark, str(tmp_path / "a.json"), multiline=True).agg(F.sum("a")).first()[0] == 3


def test_splits_are_pruned(spark, tmp_path):
    df = spark.range(30).withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("id") % 3 + 1).cast("int")))
    writers.write_splits(df, str(tmp_path / "s"))
    test = readers.read_splits(spark, str(tmp_path / "s"), ["test"])
    assert test.count() == 10
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString() or "split#" in test._jdf.queryExecution().toString()
    assert len(test.inputFiles()) > 0


def test_logs_are_appended(spark, tmp_path):
    log = spark.createDataFrame([(1, "2024-01-01 10:00:00")], "request_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        writers.append_predictions(log, str(tmp_path / "log"))
        writers.append_incidents(log.select("request_id"), str(tmp_path / "inc"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert spark.read.json(str(tmp_path / "inc")).count() == 2
