import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import ks_exact, ks_lambda, ks_pvalue
from plumbline.operators import anomaly, drift, gates, models, traffic

COLS = [f"f{i}" for i in range(5)]
SCHEMA = ", ".join(f"{c} double" for c in COLS)


def _table(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], SCHEMA)


def _keyed(df):
    return df.withColumn("id", F.monotonically_increasing_id())


@pytest.fixture
def reference(spark, rng):
    return _table(spark, rng.normal(size=(200, 5)))


# ---------------------------------------------------------------- drift


def test_same_distribution_does_not_drift_and_shifted_does(spark, rng, reference):
    same = drift.both_sides(reference, _table(spark, rng.normal(size=(200, 5))), COLS)
    moved = drift.both_sides(reference, _table(spark, rng.normal(size=(200, 5)) + 5), COLS)
    quiet = drift.drift_report(drift.drift_features(same, COLS, F.col("_ref"), alpha=0.001), 5).first()
    loud = drift.drift_report(drift.drift_features(moved, COLS, F.col("_ref")), 5).first()
    assert not quiet["is_drifted"] or quiet["drift_score"] < 1
    assert loud["is_drifted"] and loud["drift_score"] == 1.0 and loud["drifted_features"] == COLS
    assert traffic.drift_response(drift.drift_report(drift.drift_features(moved, COLS, F.col("_ref")), 5)).first()["triggered"]


def test_distance_to_itself_is_zero_and_a_shift_is_its_size(spark, reference):
    same = drift.both_sides(reference, reference, COLS)
    for r in drift.drift_features(same, COLS, F.col("_ref")).collect():
        assert (r["ks_statistic"], r["psi"], r["wasserstein_distance"], r["p_value"]) == (0.0, 0.0, 0.0, 1.0)
    shifted = reference.select(*[(F.col(c) - 2.5).alias(c) for c in COLS])
    for r in drift.wasserstein(drift.both_sides(reference, shifted, COLS), COLS, F.col("_ref")).collect():
        assert r["wasserstein_distance"] == pytest.approx(2.5)


def test_absent_and_empty_features_are_skipped_but_counted(spark, reference):
    current = reference.select((F.col("f0") + 9).alias("f0"), F.lit(None).cast("double").alias("f1"))
    both = drift.both_sides(reference, current, COLS)
    found = drift.drift_features(both, ["f0", "f1"], F.col("_ref"))
    assert [r["feature"] for r in found.collect()] == ["f0"]
    report = drift.drift_report(found, len(COLS)).first()
    assert (report["total_features"], report["drift_score"], report["is_drifted"]) == (5, 0.2, False)


def test_pvalue_against_the_series(spark):
    rows = [(d, n, m) for d in (0.0, 0.01, 0.05, 0.1, 0.3, 1.0) for n, m in ((50, 80), (1000, 1000), (7, 9))]
    df = spark.createDataFrame(rows, "ks_statistic double, n_ref bigint, n_cur bigint")
    df = df.withColumn("lam", ks_lambda(*[F.col(c) for c in df.columns]))
    for r in df.withColumn("p_value", ks_pvalue(F.col("lam"))).collect():
        en = np.sqrt(r["n_ref"] * r["n_cur"] / (r["n_ref"] + r["n_cur"]))
        lam = (en + 0.12 + 0.11 / en) * r["ks_statistic"]
        j = np.arange(1, 2001)
        want = 1.0 if lam < 0.05 else 2 * np.sum((-1.0) ** (j - 1) * np.exp(-2 * j**2 * lam**2))
        assert r["p_value"] == pytest.approx(min(max(want, 0), 1), abs=1e-8)


# ---------------------------------------------------------------- gates


def _sides(spark, rng, shift, share):
    rows = [(*map(float, rng.normal(size=2)), int(i < 50), "ref") for i in range(100)]
    rows += [(*map(float, rng.normal(size=2) + shift), int(i < share), "cur") for i in range(100)]
    return spark.createDataFrame(rows, "a double, b double, target int, side string")


def test_integrity_gate(spark, rng):
    ref = F.col("side") == "ref"
    assert gates.data_integrity_gate(_sides(spark, rng, 0, 50), ["a", "b"], "target", ref).first()["passed"]
    bad = gates.data_integrity_gate(_sides(spark, rng, 15, 1), ["a", "b"], "target", ref).first()
    assert not bad["passed"] and float(bad["details"]["feature_anomaly_rate"]) == 1.0


def test_divergence_is_symmetric_and_takes_new_classes(spark):
    rows = [("x", "ref")] * 3 + [("y", "ref")] + [("y", "cur")] * 2 + [("z", "cur")]
    df = spark.createDataFrame(rows, "c string, side string")
    one = gates.label_js_divergence(df, "c", F.col("side") == "ref").first()["js_divergence"]
    two = gates.label_js_divergence(df, "c", F.col("side") == "cur").first()["js_divergence"]
    assert one == pytest.approx(two) and 0 < one <= np.log(2)


def test_value_divergence_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, "ref"), (1.0, "cur")], "v double, side string")
    assert gates.value_js_divergence(df, "v", F.col("side") == "ref").first()["js_divergence"] == pytest.approx(0, abs=1e-8)


def test_checksums_of_empty_nested_and_large_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    content = {"empty.bin": b"", "a/b.bin": b"x", "a/c/piece.bin": rng.bytes(9_000_000), "a.bin/d.bin": b"y"}
    for place, data in content.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(data)
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "e.bin").write_bytes(b"half")
    (tmp_path / "other.txt").write_bytes(b"z")
    with (tmp_path / "large.bin").open("wb") as f:  # zeros that take no disk
        f.truncate((2 << 30) + 5)
    zeros, h = bytes(1 << 20), hashlib.sha256()
    for _ in range(2 << 10):
        h.update(zeros)
    h.update(bytes(5))
    got = {r["file"]: r for r in gates.checksum_scan(spark, f"file://{tmp_path}/", "*.bin").collect()}
    want = {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in content.items()} | {"large.bin": ((2 << 30) + 5, h.hexdigest())}
    assert {k: (v["bytes"], v["sha256"]) for k, v in got.items()} == want
    assert got["a/b.bin"]["name"] == "b.bin" and got["a/b.bin"]["path"].endswith("/a/b.bin")
    one = gates.checksum_scan(spark, f"file:{tmp_path}/a/b.bin").collect()
    assert [(r["file"], r["bytes"]) for r in one] == [("b.bin", 1)]


def test_an_emptied_file_is_changed_and_a_new_empty_one_is_stored(spark, tmp_path):
    folder, manifest = tmp_path / "files", str(tmp_path / "manifest")
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"full")
    (folder / "b.bin").write_bytes(b"")
    assert gates.verify_files(spark, str(folder), manifest).first()["passed"]
    (folder / "a.bin").write_bytes(b"")
    row = gates.verify_files(spark, str(folder), manifest).first()
    assert not row["passed"]


def test_checksums(spark, tmp_path):
    (tmp_path / "model.bin").write_bytes(b"weights")
    (tmp_path / "other.bin").write_bytes(b"more")
    found = gates.checksum_scan(spark, str(tmp_path), "*.bin")
    hashes = {r["name"]: r["sha256"] for r in found.collect()}
    assert hashes["model.bin"] == hashlib.sha256(b"weights").hexdigest()
    stored = spark.createDataFrame([("model.bin", hashes["model.bin"])], "file string, sha256 string")
    first = gates.checksum_compare(found, stored)
    assert {r["file"]: r["status"] for r in first.collect()} == {"model.bin": "matched", "other.bin": "new"}
    assert gates.checksum_gate(first).first()["passed"]
    wrong = spark.createDataFrame([("model.bin", "0" * 64), ("gone.bin", "1" * 64)], "file string, sha256 string")
    row = gates.checksum_gate(gates.checksum_compare(found, wrong)).first()
    assert not row["passed"] and row["score"] == 0.0 and row["error"] == "file not found"


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    manifest = str(tmp_path / "manifest")
    root = tmp_path / "model"
    for folder, content in (("a", b"one"), ("b", b"two")):
        (root / folder).mkdir(parents=True)
        (root / folder / "part-00000").write_bytes(content)
    counts = lambda row: tuple(row["details"][k] for k in ("matched", "changed", "missing", "new"))
    first = gates.verify_files(spark, str(root), manifest).first()
    assert first["passed"] and counts(first) == ("0", "0", "0", "2")
    assert counts(gates.verify_files(spark, str(root), manifest).first()) == ("2", "0", "0", "0")
    (root / "a" / "part-00001").write_bytes(b"new")
    assert counts(gates.verify_files(spark, str(root), manifest).first()) == ("2", "0", "0", "1")
    (root / "b" / "part-00000").write_bytes(b"altered")
    (root / "a" / "part-00001").unlink()
    for _ in range(2):  # what was stored stays
        row = gates.verify_files(spark, str(root), manifest).first()
        assert not row["passed"] and counts(row) == ("1", "1", "1", "0")


def test_label_kind_is_found(spark):
    rows = [(float(i % 7), i / 9, i % 2, "ref" if i % 3 else "cur") for i in range(300)]
    df = spark.createDataFrame(rows, "f double, price double, y int, side string")
    assert gates.label_is_continuous(df, "price") and not gates.label_is_continuous(df, "y")
    found = gates.data_integrity_gate(df, ["f"], "price", F.col("side") == "ref").first()
    asked = gates.data_integrity_gate(df, ["f"], "price", F.col("side") == "ref", continuous=True).first()
    assert found == asked


def test_drift_incidents(spark):
    from plumbline.operators import traffic

    df = spark.createDataFrame([(1, 0.39), (2, 0.4)], "batch long, drift_score double")
    (row,) = traffic.drift_incidents(df, "batch", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")).collect()
    assert (row["incident_id"], row["type"], row["action"], row["timestamp"]) == ("inc_drift_2", "data_drift", "flag_retrain_quarantine", "2024-01-02T03:04:05Z")


def test_forest_samples_by_one_rule(spark):
    for n in (100, 256, 257, 40_000):
        df = spark.range(n).select("id", *[F.rand(i).alias(c) for i, c in enumerate(COLS)])
        forest = anomaly.IsolationForest.fit(df, COLS, ["id"], trees=12)
        assert len(forest.nodes) == 12 and {int(t[4][0]) for t in forest.nodes} == {min(n, 256)}


def test_secrets_are_found_anywhere_in_a_long_text(spark):
    token = "ab" * 20
    text = "word " * 50_000 + f'token = "{token}" and token = "{token}"'
    df = spark.createDataFrame([(1, text), (2, "password = 'x1'"), (3, "nothing")], "id int, text string")
    found = gates.secret_findings(df, "text", ["id"])
    assert sorted((r["id"], r["severity"]) for r in found.collect()) == [(1, "HIGH"), (1, "HIGH"), (2, "MEDIUM")]
    gate = gates.secrets_scan(found).first()
    assert not gate["passed"] and gate["score"] == pytest.approx(0.55)
    assert gates.secrets_scan(found.filter("id = 2")).first()["passed"]
    assert gates.top_findings(found, ["id"], 1).count() == 1


def test_findings_and_rollup(spark):
    df = spark.createDataFrame([("HIGH",), ("high",), ("low",)], "severity string")
    ok = gates.findings_gate(df)
    assert ok.first()["passed"] and ok.first()["score"] == pytest.approx(0.8)
    bad = gates.findings_gate(df.union(spark.createDataFrame([("critical",)], "severity string")))
    roll = gates.gate_rollup(gates.run_gates([ok, bad])).first()
    assert (roll["gates"], roll["passed"], roll["overall_passed"]) == (2, 1, False)
    assert roll["overall_score"] == pytest.approx((0.8 + 0.3) / 2)


def test_sample_in_hash_order_is_exact(spark):
    df = spark.range(5000)
    want = df.withColumn("h", F.md5(F.concat_ws(":", F.lit("42"), F.col("id").cast("string")))).orderBy("h").limit(20)
    got = {r["id"] for r in gates.first_by_hash(df, ["id"], 20).collect()}
    assert got == {r["id"] for r in want.collect()}


def test_robustness_gate(spark, rng):
    x = rng.normal(size=(300, 2))
    rows = [(i, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, target int")
    model = models.fit(df, "logistic_regression", ["a", "b"])
    small = gates.adversarial_gate(df, model, ["a", "b"], "target", ["id"], epsilon=1e-6).first()
    large = gates.adversarial_gate(df, model, ["a", "b"], "target", ["id"], epsilon=10.0).first()
    assert small["passed"] and small["details"]["adv_accuracy"] == small["details"]["clean_accuracy"]
    assert large["score"] < 0.6 and not large["passed"]
    tree = models.fit(df, "decision_tree", ["a", "b"], params={"depth": 3})
    flat = gates.adversarial_gate(df, tree, ["a", "b"], "target", ["id"]).first()
    assert float(flat["details"]["flat_share"]) > 0.9
    line = models.fit(df, "linear_regression", ["b"], "a")
    assert 0 <= gates.adversarial_gate(df, line, ["b"], "a", ["id"], regression=True).first()["score"] <= 1


# ---------------------------------------------------------------- anomalies


def test_far_point_is_flagged(spark, rng, reference):
    keyed = _keyed(reference)
    profile = anomaly.ReferenceProfile.fit(reference, COLS)
    forest = anomaly.IsolationForest.fit(keyed, COLS, ["id"])
    far = _table(spark, [[50.0] * 5, [0.0] * 5]).withColumn("batch", F.col("f0"))
    rows = anomaly.anomaly_rows(far, profile, forest).collect()
    assert rows[0]["is_anomaly"] and rows[0]["oob_count"] == 5 and rows[0]["outlier"]
    assert not rows[1]["is_anomaly"] and rows[1]["oob_features"] == []
    report = {r["batch"]: r for r in anomaly.anomaly_report(anomaly.anomaly_rows(far, profile, forest), "batch", COLS).collect()}
    assert report[50.0]["is_anomaly"] and report[50.0]["out_of_bounds_features"] == COLS
    assert report[50.0]["anomaly_score"] > report[0.0]["anomaly_score"]


def test_forest_flags_the_wanted_share(spark, rng):
    df = _keyed(_table(spark, rng.normal(size=(4000, 5))))
    forest = anomaly.IsolationForest.fit(df, COLS, ["id"], trees=20, contamination=0.05)
    assert forest.score(df).filter("outlier").count() == pytest.approx(200, abs=5)
    again = anomaly.IsolationForest.fit(df, COLS, ["id"], trees=20, contamination=0.05)
    assert again.offset == forest.offset
    missing = spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    assert forest.score(missing).first()["decision"] is not None


def test_missing_value_is_not_out_of_bounds(spark, reference):
    row = spark.createDataFrame([(None, 0.0, 0.0, 0.0, 99.0)], SCHEMA)
    out = anomaly.bounds_check(row, reference, COLS).first()
    assert out["oob_features"] == ["f4"] and out["oob"]


# ---------------------------------------------------------------- traffic


def test_no_traffic(spark):
    log = spark.createDataFrame([], "ts timestamp, latency_ms double, status string, prediction int, request_id int")
    row = traffic.traffic_stats(log).first()
    assert (row["total_requests"], row["avg_latency_ms"], row["error_count"], row["error_rate_pct"]) == (0, None, 0, 0.0)
    truth = spark.createDataFrame([], "request_id int, y_true int")
    assert traffic.performance_drift(log, truth).first()["status"] == "unavailable_no_ground_truth"
    assert traffic.latency_bins(log).count() == 0


def test_routing(spark):
    log = spark.createDataFrame([(1, 0.74, 0), (2, 0.75, 0), (3, None, 1)], "request_id int, anomaly_score double, prediction int")
    rows = {r["request_id"]: r for r in traffic.route(log).collect()}
    assert [rows[i]["triggered"] for i in (1, 2, 3)] == [False, True, False]
    assert rows[2]["routed_prediction"] == 1.0 and rows[2]["routed_probability"] == 1.0


def test_labels_use_the_first_prediction(spark):
    log = spark.createDataFrame([(1, [1, 0]), (2, [0, 0]), (3, [1])], "request_id int, prediction array<int>")
    truth = spark.createDataFrame([(1, 1), (2, 1), (9, 1), (1, 1)], "request_id int, y_true int")
    row = traffic.performance_drift(log, truth).first()
    assert (row["sample_count"], row["current_accuracy"]) == (3, pytest.approx(2 / 3))


def test_histogram_bounds_are_inclusive(spark):
    log = spark.createDataFrame([(1.0,), (5.0,), (5.1,), (2000.0,)], "latency_ms double")
    found = {r["le"]: r["requests"] for r in traffic.latency_histogram(log).collect()}
    assert (found["0.001"], found["0.005"], found["0.01"], found["1.0"], found["+Inf"]) == (1, 2, 3, 3, 4)


def test_gauge_is_the_latest(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 3), ("b", 5.0, 2)]
    df = spark.createDataFrame(rows, "g string, v double, ts int")
    found = {r["labels"]: r["value"] for r in traffic.gauges(df, "m", "v", "ts", ["g"]).collect()}
    assert found == {"g=a": 2.0, "g=b": 5.0}


def _paths_apart(n, m, d):
    """Share of all orders of n and m values whose statistic is at least d, by counting paths one by one."""
    far = total = 0
    for places in itertools.combinations(range(n + m), n):
        i = j = 0
        worst = 0
        for s in range(n + m):
            i, j = (i + 1, j) if s in places else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        total += 1
        far += worst >= round(d * n * m)
    return far / total


def test_exact_law_of_small_samples(spark):
    sizes = [(1, 1), (1, 4), (3, 3), (4, 6), (5, 7), (6, 6)]
    rows = [(n, m, k / (n * m)) for n, m in sizes for k in range(0, n * m + 1, max(1, n * m // 6))]
    df = spark.createDataFrame(rows, "n bigint, m bigint, d double")
    for r in df.withColumn("p", ks_exact(F.col("d"), F.col("n"), F.col("m"))).collect():
        assert r["p"] == pytest.approx(_paths_apart(r["n"], r["m"], r["d"]), abs=1e-12), r


def test_exact_law_meets_the_limit_law(spark):
    df = spark.createDataFrame([(400, 900, 0.05 + 0.01 * k) for k in range(6)], "n bigint, m bigint, d double")
    lam = ks_lambda(F.col("d"), F.col("n"), F.col("m"))
    got = df.withColumn("lam", lam).select(ks_exact(F.col("d"), F.col("n"), F.col("m")), ks_pvalue(F.col("lam"))).collect()
    assert all(abs(a - b) < 0.01 for a, b in got)


@pytest.mark.parametrize("shift, drifted", [(0.0, False), (5.0, True)])
def test_two_hundred_rows_are_judged_by_the_exact_law(spark, rng, shift, drifted):
    a, b = rng.normal(size=200), rng.normal(size=200) + shift
    df = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "x double, r boolean")
    found = drift.ks_test(df, ["x"], F.col("r")).first()
    h = round(found["ks_statistic"] * 200)
    # equal sizes have a closed form, by reflecting paths
    p = 2 * sum((-1) ** (j + 1) * math.comb(400, 200 + j * h) for j in range(1, 200 // h + 1)) / math.comb(400, 200)
    assert found["p_value"] == pytest.approx(p, abs=1e-10) and (found["p_value"] < 0.05) == drifted
