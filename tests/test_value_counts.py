"""Order statistics from value counts against numpy."""

import math

import numpy as np
import pytest

from stockroom.functions import value_counts as vc
from stockroom.operators import drift


def numpy_psi(ref, cur, bins=10):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    if len(edges) <= 2:
        return 0.0
    r, c = np.histogram(ref, edges)[0], np.histogram(cur, edges)[0]
    r, c = np.where(r == 0, 1e-6, r / r.sum()), np.where(c == 0, 1e-6, c / c.sum())
    return float(((c - r) * np.log(c / r)).sum())


def numpy_ks(ref, cur):
    at = np.unique(np.concatenate([ref, cur]))
    return float(np.abs(np.searchsorted(np.sort(ref), at, "right") / len(ref) - np.searchsorted(np.sort(cur), at, "right") / len(cur)).max())


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    ref = {"smooth": rng.normal(0, 1, 700), "few": rng.integers(0, 4, 700).astype(float), "hot": np.where(rng.random(700) < 0.9, 5.0, rng.normal(0, 1, 700)), "same": np.ones(700)}
    cur = {"smooth": rng.normal(0.4, 2, 450), "few": rng.integers(1, 9, 450).astype(float), "hot": np.where(rng.random(450) < 0.5, 5.0, rng.normal(0, 1, 450)), "same": np.zeros(450)}
    frames = [spark.createDataFrame([*zip(*[map(float, side[c]) for c in side], strict=True), (None, float("nan"), None, None)], ", ".join(f"{c} double" for c in side)) for side in (ref, cur)]
    return ref, cur, frames


def test_quantiles_psi_and_ks_equal_numpy(samples):
    ref, cur, (left, right) = samples
    running = vc.running_counts(vc.value_counts(left, right, list(ref)))
    edges = {r.column: r.breakpoints for r in vc.breakpoints(running).collect()}
    psi = {r.column: r.psi for r in drift.psi_rows(running).collect()}
    ks = {r.column: r.value for r in vc.ks_distance(running).collect()}
    for c in ref:
        assert np.allclose(edges[c], np.unique(np.quantile(ref[c], np.linspace(0, 1, 11))), rtol=1e-12, atol=1e-12)
        assert math.isclose(psi[c], numpy_psi(ref[c], cur[c]), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(ks[c], numpy_ks(ref[c], cur[c]), rel_tol=1e-12)


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    rows = spark.createDataFrame([(float(v), float(w)) for v, w in zip(range(11), [0, 0, 0, 0, 0, 10, 10, 10, 10, 11, -1], strict=True)], "r double, c double")
    running = vc.running_counts(vc.paired_value_counts(rows, {"v": ("r", "c")}))
    found = sorted((r.bin, r.lower, r.upper, r.ref, r.cur) for r in vc.histogram(running, vc.breakpoints(running, 5)).collect())
    assert found == [(0, 0.0, 2.0, 2, 5), (1, 2.0, 4.0, 2, 0), (2, 4.0, 6.0, 2, 0), (3, 6.0, 8.0, 2, 0), (4, 8.0, 10.0, 3, 4)]


def test_empty_sides(spark):
    one = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    none = spark.createDataFrame([(None,)], "v double")
    assert drift.calculate_psi(none, one, "v") == 0.0
    report = {r.statistic: (r.value, r.drifted) for r in drift.dataset_drift_report(one, none, ["v"]).collect()}
    assert report["ks"] == (None, False)
    assert drift.quantile_breakpoints(none, "v") == []
    assert drift.quantile_breakpoints(one, "v", 2) == [1.0, 2.0, 3.0]


def test_hot_value_is_one_row_after_the_partial_aggregate(spark):
    hot = spark.range(0, 20_000, 1, 4).selectExpr("if(id % 3 = 0, 7.0, id * 1.0) as v")
    counts = vc.value_counts(hot, hot, ["v"])
    assert counts.where("value = 7").collect()[0].ref == 6668 - (1 if 7 % 3 == 0 else 0)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan
