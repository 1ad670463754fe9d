import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import order_hash
from plumbline.operators import drift
from plumbline.plans import ranks


def _values(rng):
    return {
        "spread": rng.normal(size=1000).tolist(),
        "ties": rng.integers(0, 4, 1000).astype(float).tolist(),
        "hot": [7.0 if i % 3 == 0 else float(i) for i in range(1000)],
        "gaps": [None if i % 5 == 0 else float("nan") if i % 7 == 0 else i / 3 for i in range(1000)],
        "one": [2.5] * 1000,
        "none": [None] * 1000,
    }


def _frame(spark, data):
    return spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data))


PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_equal_numpy_and_the_single_aggregate(spark, rng):
    data = _values(rng)
    df = _frame(spark, data)
    got = ranks.exact_quantiles(df, list(data), PROBS)
    simple = ranks.single_agg_quantiles(df, list(data), PROBS)
    for c, a, b in zip(data, got, simple):
        kept = [v for v in data[c] if v is not None and not math.isnan(v)]
        if not kept:
            assert a == [None] * len(PROBS) and b == a
            continue
        np.testing.assert_allclose(a, np.quantile(kept, PROBS), rtol=1e-12)
        np.testing.assert_allclose(a, b, rtol=1e-12)


@pytest.mark.parametrize("cuts", [[], [0.0], [-1e9, 1e9], [0.5, 1.0, 1.5, 2.0, 400.0]])
def test_split_points_do_not_change_results(spark, rng, cuts):
    data = {c: v for c, v in _values(rng).items() if c != "none"}
    df = _frame(spark, data)
    want = ranks.exact_quantiles(df, list(data), PROBS)
    assert ranks.exact_quantiles(df, list(data), PROBS, [cuts] * len(data)) == want
    table = ranks.RankTable.build(df, list(data), {"n": F.lit(1).cast("bigint")}, splits=[cuts] * len(data))
    for c, values in data.items():
        kept = sorted(v for v in values if v is not None and not math.isnan(v))
        rows = table.cumulated().filter(F.col("feature") == c).orderBy("value").collect()
        assert [r["cum_n"] for r in rows] == [sum(v <= r["value"] for v in kept) for r in rows]
        assert [r["next_value"] for r in rows] == [*[r["value"] for r in rows[1:]], None]
        assert table.quantiles(PROBS, "n")[c] == want[list(data).index(c)]


def test_cumulated_downwards(spark, rng):
    df = _frame(spark, {"x": rng.integers(0, 50, 500).astype(float).tolist()})
    rows = ranks.RankTable.build(df, ["x"], {"n": F.lit(1).cast("bigint")}).cumulated(True).collect()
    values = [r[0] for r in df.collect()]
    for r in rows:
        assert r["cum_n"] == sum(v >= r["value"] for v in values)
        assert r["next_value"] == max((v for v in values if v < r["value"]), default=None)


def test_ranged_row_number_is_row_number(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    df = df.withColumn("h", order_hash(["id"], 1))
    got = ranks.ranged_row_number(df, ["h"], "rn", ["k"])
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("h")))
    assert got.exceptAll(want).count() == 0 and got.count() == 2000


def test_ranged_row_number_numbers_null_groups(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), ("x", "a")], "k string, v string")
    got = ranks.ranged_row_number(df, ["v"], "rn", ["k"]).collect()
    assert sorted((r["k"] or "", r["v"], r["rn"]) for r in got) == [("", "a", 1), ("", "b", 2), ("x", "a", 1)]


@pytest.mark.parametrize("cells", [200_000, 0])
def test_ranged_row_number_deals_no_large_part_to_one_task(spark, monkeypatch, cells):
    monkeypatch.setattr(ranks, "MAX_CELLS", cells)  # 0: the shifts are joined by a shuffle
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 9, 1).alias("k"))
    df = df.withColumn("h", order_hash(["id"], 1)).repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ranks.ranged_row_number(df, ["h"], "rn", ["k"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for k in (1, None):
        assert [r["rn"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["h"])] == list(range(1, 18_001 if k else 2001))
    tasks = [r["task"] for r in got]
    assert max(map(tasks.count, set(tasks))) < 12_000  # by part, one task has 18,000


@pytest.mark.parametrize("ranked_rows", [1_000_000, 2])
def test_hash_cuts_are_the_rows_at_the_ranks(spark, monkeypatch, ranked_rows):
    monkeypatch.setattr(ranks, "RANKED_ROWS", ranked_rows)
    monkeypatch.setattr(ranks, "MAX_CELLS", 200_000 if ranked_rows > 2 else 0)
    df = spark.range(500).select("id", (F.col("id") % 2).alias("k"))
    cuts = ranks.hash_cuts(df, "k", ["id"], 42, {0: [0, 1, 100], 1: [250, 7]})
    for k, wanted in {0: [0, 1, 100], 1: [250, 7]}.items():
        hashes = [r[0] for r in df.filter(F.col("k") == k).select(order_hash(["id"], 42)).collect()]
        hashes.sort()
        assert [c and c[0] for c in cuts[k]] == [hashes[r - 1] if r else None for r in wanted]


def _brute(ref, cur):
    values = np.sort(np.concatenate([ref, cur]))
    f = np.searchsorted(np.sort(ref), values, side="right") / len(ref)
    g = np.searchsorted(np.sort(cur), values, side="right") / len(cur)
    return np.abs(f - g).max(), (np.abs(f - g)[:-1] * np.diff(values)).sum()


def test_distances_against_brute_force_with_a_hot_value(spark, rng):
    ref = np.concatenate([rng.normal(size=400), np.full(200, 0.25)])
    cur = np.concatenate([rng.normal(0.3, 2, size=300), np.full(100, 0.25)])
    rows = [(float(v), True) for v in ref] + [(float(v), False) for v in cur]
    df = spark.createDataFrame(rows, "x double, r boolean")
    d, w = _brute(ref, cur)
    found = drift.drift_features(df, ["x"], F.col("r")).first()
    assert found["ks_statistic"] == pytest.approx(d, abs=1e-12)
    assert found["wasserstein_distance"] == pytest.approx(w, abs=1e-9)
    assert drift.ks_statistic(df, ["x"], F.col("r")).first()["ks_statistic"] == pytest.approx(d, abs=1e-12)
    assert drift.wasserstein(df, ["x"], F.col("r")).first()["wasserstein_distance"] == pytest.approx(w, abs=1e-9)


def _psi(ref, cur):
    edges = np.percentile(ref, np.linspace(0, 100, 11))
    edges[0] -= 1e-4
    edges[-1] += 1e-4
    r = np.histogram(ref, edges)[0] / len(ref) + 1e-4
    c = np.histogram(cur, edges)[0] / len(cur) + 1e-4
    return float(np.clip(((c - r) * np.log(c / r)).sum(), 0, 10))


@pytest.mark.parametrize("kind", ["smooth", "tied", "outside"])
def test_psi_against_histograms(spark, rng, kind):
    ref = rng.normal(size=500) if kind != "tied" else rng.integers(0, 4, 500).astype(float)
    cur = {"smooth": rng.normal(0.5, 1, 300), "tied": rng.integers(0, 6, 300).astype(float), "outside": rng.normal(9, 1, 300)}
    rows = [(float(v), True) for v in ref] + [(float(v), False) for v in cur[kind]]
    df = spark.createDataFrame(rows, "x double, r boolean")
    got = drift.psi(df, ["x"], F.col("r")).first()["psi"]
    assert got == pytest.approx(_psi(ref, cur[kind]), abs=1e-9)
