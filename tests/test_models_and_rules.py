"""Scalar rules, forecasting shapes and the model operators on small inputs."""

import math

from pyspark.sql import functions as F

from stockroom.functions import scalar
from stockroom.operators import churn, features, forecast, pricing, segment
from stockroom.sinks import writers
from stockroom.sources.tables import transactions

from .conftest import SF_SMOKE


def test_retention_ladder_inclusive_thresholds(spark):
    df = spark.createDataFrame([(0.8,), (0.79,), (0.6,), (0.4,), (0.39,)], "p double")
    got = [r[0] for r in df.select(scalar.retention_action("p")).collect()]
    assert got == [
        "Offer high-touch retention call with premium discount",
        "Trigger personalized incentive campaign",
        "Trigger personalized incentive campaign",
        "Send loyalty bundle recommendation",
        "Maintain standard nurture sequence",
    ]


def test_calendar_monday_zero_and_iso_week(spark):
    df = spark.createDataFrame([("2024-12-30",), ("2025-01-05",), ("2021-01-01",)], "d string").select(F.to_date("d").alias("d"))
    rows = df.select(*[c.alias(n) for n, c in scalar.calendar_columns("d").items()]).collect()
    assert [r["day_of_week"] for r in rows] == [0, 6, 4]
    assert [r["week_of_year"] for r in rows] == [1, 1, 53]
    assert [r["is_weekend"] for r in rows] == [0, 1, 0]


def test_eoq_and_safety_stock_guards(spark):
    df = spark.createDataFrame([(100, 2.0)], "d long, s double")
    r = df.select(scalar.eoq(F.col("d"), 50.0, 0.0).alias("e"), scalar.safety_stock(F.col("s"), 0).alias("ss")).first()
    assert math.isclose(r["e"], math.sqrt(2 * 100 * 50 / 1e-6))
    assert math.isclose(r["ss"], 1.65 * 2.0 * math.sqrt(1e-6))


def test_forecast_shapes(spark):
    daily = features.daily_rollup(transactions(spark, SF_SMOKE)).cache()
    series = daily.select("sku", "region").distinct().count()
    fc = forecast.seasonal_naive(daily, horizon=10)
    assert fc.count() == series * 10
    assert fc.where(F.col("daily_forecast") < 0).count() == 0
    ts = features.time_series_features(transactions(spark, SF_SMOKE))
    m3 = forecast.seasonal_regression(ts, horizon=5)
    assert m3.where(F.col("kind") == "forecast").count() == series * 5
    assert m3.where(F.col("yhat") < 0).count() == 0
    m4 = forecast.residual_hybrid(ts, horizon=5, max_iter=5)
    assert m4.count() == series * 5 and m4.where(F.col("daily_forecast") < 0).count() == 0
    one_row = spark.createDataFrame([("S", "R", __import__("datetime").date(2024, 1, 1), 5)], "sku string, region string, date date, quantity long")
    assert forecast.naive_mape(one_row).first()["mape"] == 0.0


def test_pricing_grid_and_best_price(spark):
    ts = features.time_series_features(transactions(spark, SF_SMOKE))
    grid = pricing.what_if_grid(ts, -1.2)
    assert grid.count() == ts.select("sku").distinct().count() * 8
    best = pricing.recommend_price(ts, -1.2).collect()
    for r in best:
        assert r["expected_revenue"] >= 0
    # linear demand: revenue(f) ~ f * (1 - e + e * f), best grid factor by brute force
    e = -1.2
    best_f = max(pricing.GRID_FACTORS, key=lambda f: f * max(1 - e + e * f, 0.0))
    for r in best:
        assert math.isclose(r["candidate_price"], r["base_price"] * best_f, rel_tol=1e-12)


def test_churn_model_scoring_and_explanation(spark):
    cf = features.customer_features(transactions(spark, SF_SMOKE))
    model = churn.fit_stacked(cf, max_iter=5, folds=2)
    scores = churn.predict(model, cf)
    assert scores.count() == cf.count()
    assert scores.where((F.col("churn_probability") < 0) | (F.col("churn_probability") > 1)).count() == 0
    ex = churn.explain(model, cf).collect()
    assert len(ex) == len(model.meta_inputs) and all(r["mean_abs_contribution"] >= 0 for r in ex)
    adhoc = churn.score_adhoc(model, spark, {"frequency": 3, "monetary": 1000.0}).first()
    assert adhoc["customer_id"] == "ad_hoc_customer" and 0 <= adhoc["churn_probability"] <= 1
    path = writers.shared_path(spark, "model_test", "meta")
    writers.save_model(model.meta, path)
    from pyspark.ml.classification import LogisticRegressionModel

    assert LogisticRegressionModel.load(path).coefficients.size == len(model.meta_inputs)


def test_segmentation_assigns_every_customer(spark):
    cf = features.customer_features(transactions(spark, SF_SMOKE))
    res = segment.segment_customers(cf, ks=range(6, 8), max_iter=10)
    assert res["assignments"].count() == cf.count()
    prof = res["profile"].collect()
    assert sum(r["customers"] for r in prof) == cf.count()
    assert res["algorithm"].split("_")[0] in ("kmeans", "gmm")
    sub = segment.segment_customers(cf, customer_ids=cf.select("customer_id").limit(60), ks=range(6, 7), gmm=False, max_iter=10)
    assert sub["assignments"].count() == 60


def test_permutation_importance_keeps_values_and_reports_drop(spark):
    cf = features.customer_features(transactions(spark, SF_SMOKE))
    model = churn.fit_stacked(cf, max_iter=5, folds=2)
    imp = churn.permutation_importance(model, cf, features=["frequency", "monetary"], buckets=4).collect()
    assert [r["feature"] for r in imp] == ["frequency", "monetary"]
    assert all(r["auc_drop"] is not None and -1 <= r["auc_drop"] <= 1 for r in imp)
    # the shift is a permutation: the multiset of values is unchanged
    from pyspark.sql import Window

    w = Window.partitionBy("b").orderBy(F.xxhash64("customer_id", F.lit(43)), "customer_id")
    t = cf.withColumn("b", F.pmod(F.xxhash64("customer_id", F.lit(42)), F.lit(4)))
    sh = t.withColumn("x", F.coalesce(F.lead("frequency", 1).over(w), F.first("frequency").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    assert sorted(r[0] for r in sh.select("x").collect()) == sorted(r[0] for r in cf.select("frequency").collect())


def test_service_calls(spark):
    import pytest

    from stockroom.plans import service

    tx = transactions(spark, SF_SMOKE)
    ts = features.time_series_features(tx)
    pair = ts.select("sku", "region").first()
    out = service.forecast_demand(ts, pair["sku"], pair["region"], 14)
    assert out["forecast"].count() == 14 and out["metrics"]["mape"] >= 0
    with pytest.raises(ValueError):
        service.forecast_demand(ts, "nope", "nowhere", 14)
    with pytest.raises(ValueError):
        service.forecast_demand(ts, pair["sku"], pair["region"], 91)
    inv = service.inventory_reorder(tx, sku=pair["sku"], lead_time_days=7, ordering_cost=120.0, holding_cost=6.0)
    assert inv.count() == 1
    w = service.price_what_if(ts, pair["sku"], 950.0, -1.0).first()
    assert w["candidate_price"] == 950.0 and w["expected_demand"] >= 0
