"""Seasonal regression and double ML from sums of products, against direct solutions."""

import datetime as dt

import numpy as np
import pytest

from stockroom.functions import ols
from stockroom.operators import forecast, pricing


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(8)
    rows = []
    for sku, length in (("long", 400), ("mid", 60), ("short", 5), ("one", 1)):
        for n in range(length):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=n)
            rows.append((day, sku, "r", int(max(0, 40 + 0.1 * n + 10 * np.sin(2 * np.pi * n / 7) + rng.normal(0, 4))), float(rng.uniform(900, 950)), float(rng.uniform(0, 1)), int(n % 11 == 0), 0))
    return rows, spark.createDataFrame(rows, "date date, sku string, region string, quantity int, avg_price double, weather_index double, promotion_flag int, is_holiday int")


def direct(rows, ridge):
    """Ridge fit on the scaled design, solved as it stands."""

    day = np.array([(r[0] - dt.date(1970, 1, 1)).days for r in rows], float)
    reg = np.array([r[4:8] for r in rows], float)
    sd = reg.std(axis=0)
    z = (reg - reg.mean(axis=0)) / np.where(sd == 0, 1, sd)
    waves = [f(2 * np.pi * k * day / p) for k, p in ((1, 7), (2, 7), (3, 7), (1, 365.25), (2, 365.25)) for f in (np.sin, np.cos)]
    x = np.column_stack([np.ones_like(day), (day - day.min()) / max(day.max() - day.min(), 1), *waves, z])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0
    beta = np.linalg.solve(x.T @ x + penalty, x.T @ np.log1p([r[3] for r in rows]))
    return np.maximum(np.expm1(x @ beta), 0)


def test_seasonal_regression_equals_direct_ridge(series):
    rows, df = series
    found = forecast.seasonal_regression(df, horizon=4).collect()
    for sku in ("long", "mid", "short", "one"):
        own = [r for r in rows if r[1] == sku]
        got = {r.date: r.yhat for r in found if r.sku == sku and r.kind == "fit"}
        assert np.allclose([got[r[0]] for r in own], direct(own, 1.0), rtol=1e-6, atol=1e-6)
        ahead = sorted(r.date for r in found if r.sku == sku and r.kind == "forecast")
        assert ahead == [own[-1][0] + dt.timedelta(days=h) for h in (1, 2, 3, 4)]


def test_no_series_meets_in_one_task(series):
    _, df = series
    plan = forecast.series_coefficients(df.selectExpr("sku", "region", "cast(datediff(date, '1970-01-01') as double) as day", "1.0 as y"), forecast._terms([], 1, 0), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Pandas" not in plan


def test_residual_model_is_used_from_the_first_window_on(series):
    _, df = series
    used = {r.sku: r.residual_used for r in forecast.residual_hybrid(df, horizon=2).select("sku", "residual_used").distinct().collect()}
    assert used == {"long": True, "mid": True, "short": False, "one": False}
    short = df.where("sku = 'mid' and date < '2024-01-16'")  # 15 days: one window
    assert forecast.residual_hybrid(short, horizon=2).first().residual_used
    none = df.where("sku = 'short'")
    assert {r.residual_used for r in forecast.residual_hybrid(none, horizon=2).collect()} == {False}


def test_double_ml_and_backdoor_equal_direct_fits(spark):
    rng = np.random.default_rng(3)
    n = 500
    x = rng.normal(size=(n, 3))
    p = 900 + x @ [3.0, -2.0, 0.0] + rng.normal(size=n)
    q = 50 - 0.7 * p + x @ [1.0, 4.0, 2.0] + rng.normal(size=n)
    rows = [(i, *map(float, x[i]), float(p[i]), float(q[i])) for i in range(n)]
    df = spark.createDataFrame([*rows, (n, None, 0.0, 0.0, 1.0, 1.0)], "sku long, promotion_flag double, weather_index double, is_holiday double, avg_price double, quantity double")
    found = pricing.elasticity_dml(df, key_cols=("sku",), folds=3).first()
    folds = {r.sku: r.f for r in df.select("sku", pricing._fold(["sku"], 3, 42).alias("f")).collect()}
    fold = np.array([folds[i] for i in range(n)])
    design = np.column_stack([np.ones(n), x])
    rp, rq = np.empty(n), np.empty(n)
    for k in range(3):
        for y, r in ((p, rp), (q, rq)):
            r[fold == k] = (y - design @ np.linalg.lstsq(design[fold != k], y[fold != k], rcond=None)[0])[fold == k]
    assert np.isclose(found.level_effect, np.polyfit(rp, rq, 1)[0], rtol=1e-6)
    assert np.isclose(found.price_elasticity, found.level_effect * p.mean() / q.mean(), rtol=1e-9)
    direct_slope = np.linalg.lstsq(np.column_stack([design, p]), q, rcond=None)[0][-1]
    assert np.isclose(pricing.elasticity_backdoor(df).first().level_effect, direct_slope, rtol=1e-6)


def test_effects_without_data_or_variation(spark):
    schema = "sku long, promotion_flag int, avg_price double, quantity double"
    for rows in ([], [(1, None, 1.0, 1.0)], [(i, 0, 5.0, float(i)) for i in range(9)]):
        df = spark.createDataFrame(rows, schema)
        assert pricing.elasticity_dml(df, key_cols=("sku",)).first().level_effect is None
        assert pricing.elasticity_backdoor(df).first().level_effect is None
    assert ols.gram_matrices(spark.createDataFrame([], schema), ["avg_price"]) == {}


def test_price_search_with_the_callers_grid(spark):
    ts = spark.createDataFrame([(dt.date(2024, 1, d), "s", "r", 10, 100.0) for d in range(1, 9)], "date date, sku string, region string, quantity int, avg_price double")
    best = pricing.recommend_price(ts, -0.5, factors=[0.5, 1.0, 1.5, 3.0]).first()
    assert best.candidate_price == 150.0  # revenue 0.5 * 1.25, 1, 1.5 * 0.75, 0 of the base
