"""Whitening against exact integers and a plain eigendecomposition."""

import math
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import whitening
from plumbline.llm.queries import QUERIES


def integers(vector):
    return tuple(math.floor(64 * float(np.float64(c))) + 1_000_000 for c in vector)


def check(rows, vectors, components=16):
    """``vectors``: (id, vector) of the rows that remain."""
    xs = [integers(v) for _, v in vectors]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    k = min(components, d)
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=object)
    exact = centred.T.dot(centred)  # n**3 times the covariance
    v = np.array([[int(c) / n**3 for c in row] for row in exact])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    want = defaultdict(int)
    for (i, _), x in zip(vectors, xs):
        want[i, sum((n * c - s) ** 2 for c, s in zip(x, sums))] += k
    got = defaultdict(int)
    by_component = defaultdict(list)
    for r in rows:
        got[r["vec_id"], r["deviation"]] += 1
        assert r["n"] == n and 1 <= r["component"] <= k
        by_component[r["component"]].append(r)
    assert got == want
    scored = {}
    for c, own in by_component.items():
        assert len(own) == len(vectors)
        if e[c - 1] <= 1e-14 * e[0]:
            assert {r["whitened"] for r in own} == {None}
            continue
        share = e[c - 1] / np.trace(v)
        assert all(abs(r["explained"] - share) <= 1e-5 * share for r in own)
        scored[c] = {r["vec_id"]: r["whitened"] for r in own}
    w = np.array([[scored[c][i] for c in sorted(scored)] for i, _ in {x: (i, x) for (i, _), x in zip(vectors, xs)}.values()])
    error = np.abs(np.cov(w.T, bias=True).reshape(len(scored), -1) - np.eye(len(scored))).max()
    limit = 1e-8 if e[len(scored) - 1] > 1e-6 * e[0] else 1e-4
    assert error < limit and all(r["identity_error"] < limit for r in rows)
    own = (centred / n).astype(float) @ q[:, : len(scored)] / np.sqrt(e[: len(scored)])
    mine = {x: i for (i, _), x in zip(vectors, xs)}
    for c in sorted(scored):  # same axis up to sign, where its eigenvalue stands alone
        apart = np.abs(np.delete(e, c - 1) - e[c - 1]).min(initial=np.inf)
        if apart > 1e-3 * e[0]:
            a = np.array([scored[c][mine[x]] for x in fit])
            assert min(np.abs(a - own[:, c - 1]).max(), np.abs(a + own[:, c - 1]).max()) < 1e-6


def test_whole_table(spark, sf):
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op13_whitening"](spark, sf).collect(), vectors)


CLASHING = "vec_id long, embedding array<double>, x string, id string, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], CLASHING).repartition(3)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(int(i), rng.normal(size=5).tolist()) for i in range(60)]
    hot = rng.normal(size=5).tolist()
    good += [(1000 + i, hot) for i in range(40)] + [(0, rng.normal(size=5).tolist()), (0, hot), (0, hot)]
    bad = [(5, None), (6, [1.0, None, 2.0, 3.0, 4.0]), (7, [1.0, math.nan, 2.0, 3.0, 4.0]), (8, [1.0, math.inf, 0.0, 0.0, 0.0]), (9, []), (10, [1.0, 2.0])]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, c) for i, _ in good for c in range(1, 6))
    unique = [(i, v) for i, v in good if i]
    check([r for r in whitening.whiten(frame(spark, unique + bad)).collect()], unique)
    null_ids = whitening.whiten(frame(spark, [(None, [1.0, 2.0]), (None, [3.0, 5.0]), (1, [0.0, 9.0])])).collect()
    assert sum(r["vec_id"] is None for r in null_ids) == 4


def test_no_variance_and_no_rows(spark):
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)}
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_vectors_than_dimensions_and_unlike_scales(spark):
    rng = np.random.default_rng(4)
    check(whitening.whiten(frame(spark, few := [(i, rng.normal(size=20).tolist()) for i in range(7)])).collect(), few)
    wide = [(i, (rng.normal(size=4) * [1e5, 1.0, 300.0, 20.0] + 1e6).tolist()) for i in range(90)]
    check(whitening.whiten(frame(spark, wide)).collect(), wide)


def test_numbers_beyond_64_bits(spark):
    big = [(i, [float(2**40 * i), float(-(2**41) * i * i), 1.0]) for i in range(12)]
    rows = whitening.whiten(frame(spark, big)).collect()
    n = 12
    xs = [integers(v) for _, v in big]
    sums = [sum(c) for c in zip(*xs)]
    for r in rows:
        exact = sum((n * c - s) ** 2 for c, s in zip(xs[r["vec_id"]], sums))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)
    assert all(r["identity_error"] < 1e-6 for r in rows) and whitening.whiten(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0])])).count() == 4


@pytest.mark.parametrize("rows, blocks", [(1, 8192), (64, 8192), (1000, 128), (777, 64)])
def test_planes_give_exact_products(rows, blocks, monkeypatch):
    rng = np.random.default_rng(rows)
    bits = np.array([1, 7, 30, 3])
    y = rng.integers(0, 1 << bits, (rows, 4)).astype(np.uint64)
    total = [[0] * 4 for _ in range(4)]
    sums = [0] * 4
    for at in range(0, rows, blocks):
        both, single = whitening.products(whitening.planes_of(y[at : at + blocks], bits), bits)
        for q in range(len(both)):
            for i in range(4):
                sums[i] += int(single[q][i]) << (16 * q)
                for j in range(4):
                    total[i][j] += int(both[q][i, j]) << (16 * q)
    exact = y.astype(object)
    assert total == exact.T.dot(exact).tolist() and sums == exact.sum(axis=0).tolist()
