"""Direct checks of helpers covered only indirectly elsewhere."""

import math

import numpy as np
from pyspark.sql import functions as F

from stockroom.functions import ols
from stockroom.operators import dashboard, drift, feature_store
from stockroom.plans import jobs
from stockroom.sources.tables import transactions

from .conftest import SF_SMOKE


def test_grouped_and_global_ols_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        x1 = rng.normal(size=40)
        x2 = rng.normal(size=40)
        y = 1.5 + g * x1 - 2.0 * x2 + rng.normal(scale=0.1, size=40)
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)]
    df = spark.createDataFrame(rows, "g int, x1 double, x2 double, y double")
    got = {r["g"]: r for r in ols.grouped_ols(df, ["g"], "y", ["x1", "x2"]).collect()}
    for g in range(3):
        sub = np.array([r[1:] for r in rows if r[0] == g])
        x = np.column_stack([np.ones(len(sub)), sub[:, 0], sub[:, 1]])
        beta = np.linalg.lstsq(x, sub[:, 2], rcond=None)[0]
        assert np.allclose([got[g]["intercept"], got[g]["coef_x1"], got[g]["coef_x2"]], beta, atol=1e-8)
    glob = ols.ols(df, "y", ["x1", "x2"])
    arr = np.array([r[1:] for r in rows])
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(arr)), arr[:, 0], arr[:, 1]]), arr[:, 2], rcond=None)[0]
    assert np.allclose([glob["intercept"], glob["x1"], glob["x2"]], beta, atol=1e-8)


def test_jensen_shannon_matches_formula(spark):
    ref = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)] * 1, "ch string")
    cur = spark.createDataFrame([("a",)] * 2 + [("b",)] * 2 + [("d",)] * 4, "ch string")
    got = drift.categorical_drift(ref, cur, ["ch"]).first()["value"]
    p = np.array([6, 3, 1, 0]) / 10
    q = np.array([2, 2, 0, 4]) / 8
    m = (p + q) / 2

    def kl(a, b):
        mask = a > 0
        return float(np.sum(a[mask] * np.log2(a[mask] / b[mask])))

    assert math.isclose(got, kl(p, m) / 2 + kl(q, m) / 2, rel_tol=1e-12)


def test_arg_max_row_first_on_ties(spark):
    df = spark.createDataFrame([("x", 5.0, 0, "p"), ("x", 5.0, 1, "q"), ("x", 3.0, 2, "r"), ("y", 1.0, 0, "s")], "k string, score double, ord int, tag string")
    got = {r["k"]: r["tag"] for r in dashboard.arg_max_row(df, ["k"], "score", "ord", ["tag"]).collect()}
    assert got == {"x": "p", "y": "s"}


def test_latest_per_entity(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, "d")], "e int, t int, v string")
    got = {r["e"]: r["v"] for r in feature_store.latest_per_entity(df, ["e"], ["t"]).collect()}
    assert got == {1: "b", 2: "d"}


def test_drift_report_shape_and_monitoring(spark):
    tx = transactions(spark, SF_SMOKE)
    cutoff = drift.median_transaction_date(tx)
    ref, cur = tx.where(F.col("date") <= cutoff), tx.where(F.col("date") > cutoff)
    rep = drift.dataset_drift_report(ref, cur, ["quantity", "discount_pct"], ["channel"]).collect()
    kinds = {(r["column"], r["statistic"]) for r in rep}
    assert kinds == {("quantity", "psi"), ("discount_pct", "psi"), ("quantity", "ks"), ("discount_pct", "ks"), ("channel", "jensen_shannon")}
    assert all(0 <= r["value"] <= 1 for r in rep if r["statistic"] == "ks")
    snap = jobs.monitoring_snapshot(spark, tx, churn_auc=0.95, latency_s=0.84)
    status = {r["metric"]: r["status"] for r in snap["table"].collect()}
    assert status["Churn AUC"] == "healthy" and status["API Latency (s)"] == "healthy"
    assert set(status) == {"PSI", "Demand MAPE", "Churn AUC", "API Latency (s)"}
    d = snap["decision"].first()
    assert d["should_retrain"] == (d["psi"] > 0.2 or d["mape"] > 15.0)
