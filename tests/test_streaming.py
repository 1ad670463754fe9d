import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift, traffic
from plumbline.sources import readers
from plumbline.streaming import monitors

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "request_id bigint, ts timestamp, latency_ms double, status string, model_version string, prediction int, anomaly_score double"


def _row(i, minute, score=0.1):
    return (i, T0 + dt.timedelta(minutes=minute), float(i), "error" if i % 4 == 0 else "success", "v1", i % 2, score)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes each list of rows as one file; files become micro-batches in the order of writing."""

    def write(*batches):
        path = tmp_path / "log"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
            newest = max(path.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
            stamp = 1_700_000_000 + i
            __import__("os").utime(newest, (stamp, stamp))
        return str(path)

    return write


def _stream(spark, path):
    return readers.event_stream(spark, path, files_per_trigger=1)


def test_windows_equal_batch_after_a_sentinel_and_late_rows_are_dropped(spark, folder):
    rows = [_row(i, i / 2) for i in range(20)]
    late = [_row(100, 0), _row(101, 120)]
    path = folder(rows, [_row(200, 60)], [_row(201, 61)], late)
    done = monitors.drain_append(monitors.stream_traffic(_stream(spark, path)), "t")
    got = {r["start"]: (r["requests"], r["errors"]) for r in done.collect()}
    want = {}
    for r in [*rows, _row(200, 60), _row(201, 61)]:
        at = r[1].replace(second=0)
        n, e = want.get(at, (0, 0))
        want[at] = (n + 1, e + (r[3] == "error"))
    assert got == want


def test_sliding_windows_overlap(spark, folder):
    path = folder([_row(1, 10)], [_row(2, 60)])
    done = monitors.drain_append(monitors.stream_traffic(_stream(spark, path), "5 minutes", "1 minute"), "s")
    assert done.count() == 5 and {r["requests"] for r in done.collect()} == {1}


def test_anomaly_rate(spark, folder):
    path = folder([_row(1, 1, 0.9), _row(2, 2, 0.1)], [_row(3, 500)])
    done = monitors.drain_append(monitors.stream_anomaly_rate(_stream(spark, path), F.col("anomaly_score") > 0.5), "r")
    assert [(r["rows"], r["anomalies"], r["anomaly_rate"]) for r in done.collect()] == [(2, 1, 0.5)]


def test_counters_equal_batch(spark, folder):
    batches = [[_row(i + 10 * b, b, 0.8 if i == 3 else 0.1) for i in range(10)] for b in range(3)]
    path = folder(*batches)
    got = monitors.drain_complete(monitors.stream_counters(_stream(spark, path)), "c")
    want = traffic.counters(spark.read.parquet(path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.filter("metric = 'anomalies_detected_total'").first()["value"] == 3


def test_labels_join_within_the_bound(spark, folder, tmp_path):
    path = folder([_row(i, i) for i in range(5)])
    labels = [(i, T0 + dt.timedelta(minutes=i + (90 if i == 3 else 10)), 1) for i in range(4)]
    truth = str(tmp_path / "truth")
    spark.createDataFrame(labels, "request_id bigint, label_ts timestamp, y_true int").write.parquet(truth)
    stream = readers.event_stream(spark, truth)
    done = monitors.drain_append(monitors.stream_label_join(_stream(spark, path), stream), "l")
    assert sorted(r["request_id"] for r in done.collect()) == [0, 1, 2]


def test_routing_writes_each_batch_once(spark, folder, tmp_path):
    path = folder([_row(1, 1, 0.9), _row(2, 2)], [_row(3, 3, 0.8)])
    sink = str(tmp_path / "sink")
    for _ in range(2):  # the second run finds nothing new
        served, incidents = monitors.stream_route(_stream(spark, path), path=sink)
    assert served.count() == 3 and served.filter("triggered").count() == 2
    assert sorted(r["incident_id"] for r in incidents.collect()) == ["inc_anom_1", "inc_anom_3"]


def test_drift_of_all_requests_so_far(spark, folder):
    reference = spark.createDataFrame([_row(i, 0, i / 100) for i in range(100)], SCHEMA)
    batches = [[_row(1, 1), _row(2, 1)], [_row(i, 2, i / 50) for i in range(50)], [_row(i, 3, 5.0 + i) for i in range(50)]]
    path = folder(*batches)
    out = monitors.stream_drift(_stream(spark, path).select("anomaly_score"), reference, ["anomaly_score"])
    rows = {r["batch"]: r for r in out.collect()}
    assert [(rows[i]["status"], rows[i]["sample_count"]) for i in range(3)] == [("insufficient_samples", 2), ("evaluated", 52), ("evaluated", 102)]
    fitted = drift.EdgeReference.fit(reference, ["anomaly_score"])
    for i in (1, 2):
        so_far = spark.createDataFrame([r for b in batches[: i + 1] for r in b], SCHEMA)
        want = fitted.features(so_far).first()
        assert (rows[i]["drifted_features"] == "anomaly_score") == want["is_drifted"]
    assert rows[2]["is_drifted"] and not rows[1]["is_drifted"]


def test_drift_of_windows(spark, folder):
    reference = spark.createDataFrame([_row(i, 0, i / 100) for i in range(100)], SCHEMA)
    path = folder([_row(i, 1, i / 50) for i in range(25)], [_row(i, 2, i / 50) for i in range(25, 50)] + [_row(i, 70, 9.0) for i in range(30)], [_row(1, 130)])
    log = _stream(spark, path).select("ts", "anomaly_score")
    out = monitors.stream_drift_windows(log, reference, ["anomaly_score"], "1 hour", delay="3 hours").orderBy("start").collect()
    assert [(r["sample_count"], r["status"], r["is_drifted"]) for r in out] == [(50, "evaluated", False), (30, "evaluated", True), (1, "insufficient_samples", False)]
    sliding = monitors.stream_drift_windows(log, reference, ["anomaly_score"], "2 hours", "1 hour", "9 hours")
    assert sorted(r["sample_count"] for r in sliding.collect()) == [1, 31, 50, 80]


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_counts_at_edges_judge_like_all_values(spark, rng, digits):
    cols = ["a", "b"]
    ref, cur = rng.normal(size=(3000, 2)).round(digits), (rng.normal(size=(700, 2)) * [1.0, 1.2] + [0.0, 0.1]).round(digits)
    rows = [(*map(float, r), True) for r in ref] + [(*map(float, r), False) for r in cur] + [(None, float("nan"), False)]
    df = spark.createDataFrame(rows, "a double, b double, r boolean")
    exact = {r["feature"]: r for r in drift.drift_features(df, cols, F.col("r")).collect()}
    fitted = drift.EdgeReference.fit(df.filter("r"), cols, cells=200)
    assert fitted.counts.count() <= 2 * (2 * 211 + 1)
    for r in fitted.features(df.filter("not r")).collect():
        want = exact[r["feature"]]
        assert r["psi"] == pytest.approx(want["psi"], abs=1e-9)
        assert want["ks_statistic"] - 1 / 200 <= r["ks_statistic"] <= want["ks_statistic"] + 1e-12
        assert r["wasserstein_distance"] == pytest.approx(want["wasserstein_distance"], abs=0.02)
        if digits == 0:
            assert r["ks_statistic"] == pytest.approx(want["ks_statistic"]) and r["p_value"] == pytest.approx(want["p_value"])


def test_scoring_stream_equals_batch(spark, folder):
    path = folder([_row(i, i) for i in range(6)], [_row(9, 9)])
    score = lambda df: df.withColumn("p", F.col("latency_ms") * 2)
    done = monitors.drain_append(monitors.stream_score(_stream(spark, path), score), "p")
    want = score(spark.read.parquet(path))
    assert done.select(want.columns).exceptAll(want).count() == 0 and done.count() == 7


def test_scratch_tables_of_a_scope_are_removed(spark):
    import pathlib

    from plumbline.session import materialise, scratch_root, scratch_scope

    folder = pathlib.Path(scratch_root(spark).removeprefix("file:")) / "plumbline"
    kept = materialise(spark.range(3), "kept")
    with scratch_scope(spark):
        assert materialise(spark.range(5), "scoped").count() == 5
        assert list(folder.glob("scoped-*"))
    assert not list(folder.glob("scoped-*")) and kept.count() == 3
