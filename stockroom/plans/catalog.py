"""Registry of named queries: (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the driver's tables (through the ``transactions`` view or
directly) over whole tables; nothing here subsets rows.
"""

from __future__ import annotations

import datetime as _dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators import inventory
from stockroom.plans import oracle_sql as sql
from stockroom.session import ScratchTable, free_shuffles, scratch_path
from stockroom.sources.tables import transactions

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


# --- inventory (M24 and parts) -------------------------------------------------------

@register("m24_inventory_by_part", sql.with_tx(sql.inventory_sql(), sku="part"))
def m24_inventory_by_part(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.recommend(transactions(spark, sf, sku="part"))


@register("m24_inventory_by_brand", sql.with_tx(sql.inventory_sql(7, 120.0, 6.0), sku="brand"))
def m24_inventory_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.recommend(transactions(spark, sf, sku="brand"), 7, 120.0, 6.0)


# --- feature tables (A1-A4, W1-W3, P13-P17) ------------------------------------------

from stockroom.operators import features  # noqa: E402


@register(
    "a1_daily_rollup",
    sql.with_tx(f", {sql.daily_sql()} SELECT date, sku, region, quantity, CAST(revenue AS DOUBLE) AS revenue, avg_price, promotion_flag, weather_index FROM daily"),
)
def a1_daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = features.daily_rollup(transactions(spark, sf))
    return d.withColumn("revenue", d["revenue"].cast("double"))


@register("w1_w2_time_series_features", sql.with_tx(f", {sql.ts_features_cte()} SELECT * FROM ts_features"))
def w1_w2_time_series_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.time_series_features(transactions(spark, sf))


@register("a2_w3_customer_features", sql.with_tx(f", {sql.customer_features_cte()} SELECT * FROM customer_features"))
def a2_w3_customer_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.customer_features(transactions(spark, sf))


# --- dashboard aggregates and scalar rules (A7-A13, P1-P10, P24, T2, T4, U2, U3) -----

from stockroom.functions import scalar, value_counts  # noqa: E402
from stockroom.operators import dashboard  # noqa: E402
from stockroom.sources.tables import table  # noqa: E402

_KPI_SQL = """SELECT CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units,
       count(DISTINCT customer_id) AS customers, CAST(sum(discount_pct) AS DOUBLE) / CAST(count(discount_pct) AS DOUBLE) AS avg_discount
FROM transactions"""


@register("a7_executive_kpis", sql.with_tx(_KPI_SQL))
def a7_executive_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.executive_kpis(transactions(spark, sf))


@register("p3_p4_filtered_kpis", sql.with_tx(_KPI_SQL + " WHERE sku = 'Brand#7' AND region = 'ASIA'"))
def p3_p4_filtered_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.executive_kpis(dashboard.apply_global_filters(transactions(spark, sf), "Brand#7", "ASIA"))


@register(
    "a8_revenue_trend",
    sql.with_tx("SELECT date, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity FROM transactions WHERE date IS NOT NULL GROUP BY date"),
)
def a8_revenue_trend(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.revenue_trend(transactions(spark, sf))


@register(
    "a9_revenue_by_region",
    sql.with_tx("SELECT region, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity FROM transactions WHERE region IS NOT NULL GROUP BY region"),
)
def a9_revenue_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.revenue_by_region(transactions(spark, sf))


@register(
    "a10_sku_volume_mix",
    sql.with_tx(
        """, per_sku AS (SELECT sku, CAST(sum(quantity) AS BIGINT) AS quantity FROM transactions WHERE sku IS NOT NULL GROUP BY sku)
SELECT sku, quantity, CAST(quantity AS DOUBLE) / CAST(sum(quantity) OVER () AS DOUBLE) AS share FROM per_sku"""
    ),
)
def a10_sku_volume_mix(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.sku_volume_mix(transactions(spark, sf))


@register(
    "a8_a10_grouping_sets",
    sql.with_tx(
        """SELECT * FROM (SELECT date, region, sku, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity,
       CASE grouping_id(date, region, sku) WHEN 3 THEN 'date' WHEN 5 THEN 'region' ELSE 'sku' END AS level
FROM transactions GROUP BY GROUPING SETS ((date), (region), (sku)))
WHERE CASE level WHEN 'date' THEN date IS NOT NULL WHEN 'region' THEN region IS NOT NULL ELSE sku IS NOT NULL END"""
    ),
)
def a8_a10_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.overview_grouping_sets(transactions(spark, sf))


@register("p7_sorted_skus", sql.with_tx("SELECT DISTINCT sku FROM transactions WHERE sku IS NOT NULL"))
def p7_sorted_skus(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.sorted_distinct(transactions(spark, sf), "sku")


@register("p7_regions_for_sku", sql.with_tx("SELECT DISTINCT region FROM transactions WHERE sku = 'Brand#3' AND region IS NOT NULL"))
def p7_regions_for_sku(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.regions_for_sku(transactions(spark, sf), "Brand#3")


@register(
    "p1_p2_p13_p14_calendar",
    sql.with_tx(
        f"""SELECT DISTINCT date, strftime(date, '%Y-%m-%d') AS iso_date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(week(date) AS INTEGER) AS week_of_year, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
       CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, {sql.holiday_sql()} AS is_holiday
FROM transactions"""
    ),
)
def p1_p2_p13_p14_calendar(spark: SparkSession, sf: str) -> DataFrame:
    days = transactions(spark, sf).select("date").distinct()
    days = days.withColumn("iso_date", scalar.to_iso_date("date")).withColumns(scalar.calendar_columns("date"))
    return features.add_holiday_flag(days)


@register(
    "j5_holiday_join",
    sql.with_tx(
        f""", d AS (SELECT date, count(*) AS lines FROM transactions GROUP BY date)
SELECT date, lines, {sql.holiday_sql()} AS is_holiday FROM d"""
    ),
)
def j5_holiday_join(spark: SparkSession, sf: str) -> DataFrame:
    """J5 with a real holiday dimension (country, date, name) joined by a checked broadcast."""

    d = transactions(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("lines"))
    years = table(spark, sf, "orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    cal = features.holiday_calendar(spark, int(years[0]), int(years[1]))
    return features.add_holiday_flag(d, cal)


@register(
    "p5_membership_semi_join",
    sql.with_tx(
        """SELECT customer_id, count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue FROM transactions
WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY customer_id"""
    ),
)
def p5_membership_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    tx = dashboard.filter_members(transactions(spark, sf), "customer_id", members)
    return tx.groupBy("customer_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("revenue").cast("double").alias("revenue"))


@register("p9_hash_pii", "SELECT c_custkey, sha256(c_name) AS name_hash FROM customer")
def p9_hash_pii(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", scalar.hash_pii("c_name").alias("name_hash"))


@register(
    "p10_chunked_batches",
    "SELECT c_custkey, c_nationkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 50) AS BIGINT) AS batch_id FROM customer",
)
def p10_chunked_batches(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return dashboard.chunked(c, 50, ["c_nationkey"], ["c_custkey"])


@register(
    "p6_a13_inventory_kpis",
    sql.with_tx(
        sql.inventory_sql().replace(
            "SELECT sku, abc_class",
            ", final AS (SELECT sku, abc_class",
        )
        + """)
SELECT CAST(count(*) FILTER (WHERE recommendation = 'Reorder now') AS BIGINT) AS reorder_now,
       round(sum(recommended_order_qty), 6) AS total_suggested_qty, round(avg(safety_stock), 6) AS avg_safety_stock,
       round(avg(reorder_point), 6) AS avg_reorder_point FROM final""",
        sku="part",
    ),
)
def p6_a13_inventory_kpis(spark: SparkSession, sf: str) -> DataFrame:
    k = inventory.inventory_kpis(inventory.recommend(transactions(spark, sf, sku="part")))
    return k.select("reorder_now", *[F.round(c, 6).alias(c) for c in ("total_suggested_qty", "avg_safety_stock", "avg_reorder_point")])


@register(
    "p6_reorder_now",
    sql.with_tx(
        sql.inventory_sql().replace("SELECT sku, abc_class", ", final AS (SELECT sku, abc_class")
        + ") SELECT sku, current_inventory, recommended_order_qty FROM final WHERE recommendation = 'Reorder now'",
        sku="part",
    ),
)
def p6_reorder_now(spark: SparkSession, sf: str) -> DataFrame:
    r = inventory.recommend(transactions(spark, sf, sku="part"))
    return r.where(F.col("recommendation") == "Reorder now").select("sku", "current_inventory", "recommended_order_qty")


@register(
    "a11_segment_profile_by_rfm",
    sql.with_tx(
        f""", {sql.customer_features_cte()}
SELECT rfm_score AS segment_id, count(customer_id) AS customers, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency,
       round(avg(monetary), 6) AS avg_monetary, avg(churn_label) AS avg_churn
FROM customer_features GROUP BY rfm_score"""
    ),
)
def a11_segment_profile_by_rfm(spark: SparkSession, sf: str) -> DataFrame:
    cf = features.customer_features(transactions(spark, sf)).withColumn("segment_id", F.col("rfm_score"))
    p = dashboard.segment_profile(cf)
    return p.withColumn("avg_monetary", F.round("avg_monetary", 6))


@register(
    "a12_p24_customer_kpis",
    sql.with_tx(
        f""", {sql.customer_features_cte()}
SELECT count(*) AS customers, round(avg(monetary), 6) AS avg_monetary, avg(rfm_score) AS avg_rfm,
       count(DISTINCT rfm_score) AS segments, CAST(sum(greatest(coalesce(rfm_score, 1), 1)) AS BIGINT) AS bubble_total
FROM customer_features"""
    ),
)
def a12_p24_customer_kpis(spark: SparkSession, sf: str) -> DataFrame:
    cf = features.customer_features(transactions(spark, sf))
    seg = cf.select("customer_id", F.col("rfm_score").alias("segment_id"))
    bubble = F.sum(dashboard.bubble_size(F.col("rfm_score"))).cast("bigint").alias("bubble_total")
    k = dashboard.customer_kpis(cf, seg, extra=[bubble])
    return k.withColumn("avg_monetary", F.round("avg_monetary", 6))


@register(
    "t2_top_customers_by_monetary",
    sql.with_tx(
        f""", {sql.customer_features_cte()}
SELECT customer_id, monetary FROM customer_features ORDER BY monetary DESC, customer_id LIMIT 15"""
    ),
)
def t2_top_customers_by_monetary(spark: SparkSession, sf: str) -> DataFrame:
    cf = features.customer_features(transactions(spark, sf))
    return dashboard.top_k(cf.select("customer_id", "monetary"), [F.col("monetary").desc(), F.col("customer_id")], 15)


@register(
    "u2_u3_time_split_overlap",
    sql.with_tx(
        """, c AS (SELECT date, count(*) AS n FROM transactions GROUP BY date),
cut AS (SELECT min(date) AS cutoff FROM (SELECT date, sum(n) OVER (ORDER BY date) AS cum FROM c) WHERE cum > (SELECT sum(n) FROM c) // 2)
SELECT customer_id FROM transactions, cut WHERE date <= cutoff
INTERSECT
SELECT customer_id FROM transactions, cut WHERE date > cutoff"""
    ),
)
def u2_u3_time_split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    from stockroom.operators import drift

    tx = transactions(spark, sf)
    cutoff = drift.median_transaction_date(tx)
    ref, cur = dashboard.time_split(tx, cutoff)
    return ref.select("customer_id").intersect(cur.select("customer_id"))


# --- drift (A16, A17, W11, M25-M27, P26) ----------------------------------------------

from stockroom.operators import drift  # noqa: E402


@register("m25_m27_observed_drift", sql.with_tx(sql.observed_drift_sql()))
def m25_m27_observed_drift(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.observed_drift_snapshot(transactions(spark, sf))
    return out.withColumn("psi", F.round("psi", 10))


@register(
    "p26_stress_test_psi",
    sql.with_tx(
        f""", {sql.customer_features_cte()},
pairs AS (SELECT monetary * 1.05 AS ref_value, monetary AS cur_value FROM customer_features),
{sql.psi_ctes('pairs', 'ref_value', 'cur_value')}
SELECT psi, bins_used FROM psi_value"""
    ),
)
def p26_stress_test_psi(spark: SparkSession, sf: str) -> DataFrame:
    cf = features.customer_features(transactions(spark, sf))
    return drift.stress_test_psi(cf).withColumn("psi", F.round("psi", 10))


@register(
    "w11_median_date",
    sql.with_tx(f", {sql.median_date_cte()} SELECT cutoff FROM cut"),
)
def w11_median_date(spark: SparkSession, sf: str) -> DataFrame:
    d = drift.median_transaction_date(transactions(spark, sf))
    return spark.createDataFrame([(d,)], "cutoff date")


# --- pricing (M18-M22, J6, P11, P12, W9, T4) ------------------------------------------

from stockroom.operators import pricing  # noqa: E402


def _ts(spark: SparkSession, sf: str) -> DataFrame:
    return features.time_series_features(transactions(spark, sf))


def _elasticity(ts: DataFrame) -> float:
    return round(float(pricing.elasticity_loglog(ts).first()["price_elasticity"]), 6)


@register(
    "m18_elasticity_loglog",
    sql.with_tx(f", {sql.ts_features_cte()} SELECT round({sql.elasticity_sql()}, 6) AS price_elasticity, count(*) AS observations FROM ts_features"),
)
def m18_elasticity_loglog(spark: SparkSession, sf: str) -> DataFrame:
    e = pricing.elasticity_loglog(_ts(spark, sf))
    return e.withColumn("price_elasticity", F.round("price_elasticity", 6))


@register(
    "m18_elasticity_by_sku",
    sql.with_tx(f", {sql.ts_features_cte()} SELECT sku, round({sql.elasticity_sql()}, 6) AS price_elasticity, count(*) AS observations FROM ts_features GROUP BY sku"),
)
def m18_elasticity_by_sku(spark: SparkSession, sf: str) -> DataFrame:
    e = pricing.elasticity_loglog(_ts(spark, sf), by=["sku"])
    return e.withColumn("price_elasticity", F.round("price_elasticity", 6))


_R6 = ["base_price", "candidate_price", "expected_demand", "expected_revenue"]


@register(
    "m21_what_if_grid",
    sql.with_tx(
        sql.what_if_sql()
        + " SELECT sku, grid_index, round(base_price, 6) AS base_price, round(candidate_price, 6) AS candidate_price,"
        " round(expected_demand, 6) AS expected_demand, round(expected_revenue, 6) AS expected_revenue, price_elasticity FROM sim2"
    ),
)
def m21_what_if_grid(spark: SparkSession, sf: str) -> DataFrame:
    ts = ScratchTable(_daily(spark, sf).select("date", "sku", "region", "quantity", "avg_price"), "pricing-rollup").df
    s = pricing.what_if_grid(ts, _elasticity(ts))
    return s.select("sku", "grid_index", *[F.round(c, 6).alias(c) for c in _R6], "price_elasticity")


@register(
    "m22_recommend_price",
    sql.with_tx(
        sql.what_if_sql()
        + """, best AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY expected_revenue DESC, grid_index) AS rk FROM sim2)
SELECT sku, round(base_price, 6) AS base_price, round(candidate_price, 6) AS candidate_price, round(expected_demand, 6) AS expected_demand,
       round(expected_revenue, 6) AS expected_revenue, price_elasticity FROM best WHERE rk = 1"""
    ),
)
def m22_recommend_price(spark: SparkSession, sf: str) -> DataFrame:
    ts = ScratchTable(_daily(spark, sf).select("date", "sku", "region", "quantity", "avg_price"), "pricing-rollup").df
    r = pricing.recommend_price(ts, _elasticity(ts))
    return r.select("sku", *[F.round(c, 6).alias(c) for c in _R6], "price_elasticity")


_EFFECT = ("level_effect", "mean_price", "mean_quantity", "price_elasticity")


@register("m19_elasticity_dml", sql.with_tx(f", {sql.ts_features_cte()}{sql.causal_effect_sql(pricing.CONFOUNDERS, 2)}"))
def m19_elasticity_dml(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.elasticity_dml(_ts(spark, sf)).select(*(F.round(c, 6).alias(c) for c in _EFFECT))


@register("m20_elasticity_backdoor", sql.with_tx(f", {sql.ts_features_cte()}{sql.causal_effect_sql(pricing.CONFOUNDERS, None)}"))
def m20_elasticity_backdoor(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.elasticity_backdoor(_ts(spark, sf)).select(*(F.round(c, 6).alias(c) for c in _EFFECT))


# --- forecasting (M1-M6, W7-W10, A14, A15, A19, U1) -----------------------------------

from stockroom.operators import forecast  # noqa: E402


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return features.daily_rollup(transactions(spark, sf))


@register("m1_w7_seasonal_naive_forecast", sql.with_tx(f", {sql.daily_sql()}, {sql.naive_forecast_ctes()} SELECT * FROM forecast"))
def m1_w7_seasonal_naive_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.seasonal_naive(_daily(spark, sf), horizon=30)


@register(
    "m5_naive_mape",
    sql.with_tx(
        f""", {sql.daily_sql()},
s AS (SELECT sku, region, date, CAST(quantity AS DOUBLE) AS y,
             coalesce(lag(CAST(quantity AS DOUBLE)) OVER (PARTITION BY sku, region ORDER BY date), CAST(quantity AS DOUBLE)) AS bl,
             row_number() OVER (PARTITION BY sku, region ORDER BY date DESC) AS rn FROM daily)
SELECT sku, region, round(avg(abs(y - bl) / greatest(abs(y), {forecast.EPS!r})) * 100, 10) AS mape, count(*) AS holdout_points
FROM s WHERE rn <= 14 GROUP BY sku, region"""
    ),
)
def m5_naive_mape(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.naive_mape(_daily(spark, sf)).withColumn("mape", F.round("mape", 10))


@register(
    "m2_a19_regressor_defaults",
    sql.with_tx(
        f""", {sql.daily_sql()},
t7 AS (SELECT *, row_number() OVER (PARTITION BY sku, region ORDER BY date DESC) AS rn FROM daily),
base AS (SELECT sku, region, round(avg(avg_price), 8) AS avg_price, round(avg(weather_index), 8) AS weather_index, max(date) AS last_date
         FROM t7 WHERE rn <= 7 GROUP BY sku, region),
modes AS (SELECT sku, region, p, row_number() OVER (PARTITION BY sku, region ORDER BY c DESC, p) AS k
          FROM (SELECT sku, region, CAST(round(promotion_flag) AS INTEGER) AS p, count(*) AS c FROM t7 WHERE rn <= 7 GROUP BY ALL))
SELECT b.sku, b.region, b.avg_price, b.weather_index, m.p AS promotion_flag, 0 AS is_holiday, b.last_date
FROM base b JOIN modes m ON b.sku = m.sku AND b.region = m.region AND m.k = 1"""
    ),
)
def m2_a19_regressor_defaults(spark: SparkSession, sf: str) -> DataFrame:
    d = forecast.regressor_defaults(_daily(spark, sf))
    return d.withColumn("avg_price", F.round("avg_price", 8)).withColumn("weather_index", F.round("weather_index", 8))


@register(
    "w10_sequence_windows",
    sql.with_tx(
        f""", {sql.daily_sql()},
w AS (SELECT sku, region, date, quantity AS target,
             list(quantity) OVER (PARTITION BY sku, region ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS l
      FROM daily)
SELECT sku, region, date, target, array_to_string(l, ',') AS lags FROM w WHERE len(l) = 14"""
    ),
)
def w10_sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = forecast.sequence_windows(_daily(spark, sf))
    return s.select("sku", "region", "date", "target", F.array_join(F.transform("lags", lambda x: x.cast("string")), ",").alias("lags"))


@register(
    "a14_forecast_kpis",
    sql.with_tx(
        f""", {sql.daily_sql()}, {sql.naive_forecast_ctes()},
lo AS (SELECT sku, region, CAST(arg_max(quantity, date) AS DOUBLE) AS last_observed_demand FROM daily GROUP BY sku, region),
fk AS (SELECT sku, region, avg(CASE WHEN st <= 7 THEN daily_forecast END) AS avg_next_7_days, arg_max(monthly_forecast, date) AS total_month
       FROM (SELECT *, row_number() OVER (PARTITION BY sku, region ORDER BY date) AS st FROM forecast) GROUP BY sku, region)
SELECT lo.sku, lo.region, last_observed_demand, round(avg_next_7_days, 8) AS avg_next_7_days, total_month
FROM lo JOIN fk ON lo.sku = fk.sku AND lo.region = fk.region"""
    ),
)
def a14_forecast_kpis(spark: SparkSession, sf: str) -> DataFrame:
    d = _daily(spark, sf)
    k = forecast.forecast_kpis(d, forecast.seasonal_naive(d, 30))
    return k.withColumn("avg_next_7_days", F.round("avg_next_7_days", 8))


@register(
    "u1_history_forecast_union",
    sql.with_tx(
        f""", {sql.daily_sql()}, {sql.naive_forecast_ctes()}
SELECT sku, region, date, CAST(quantity AS DOUBLE) AS value, 'Historical Demand' AS series FROM daily
UNION ALL
SELECT sku, region, date, daily_forecast AS value, 'Forecasted Demand' AS series FROM forecast"""
    ),
)
def u1_history_forecast_union(spark: SparkSession, sf: str) -> DataFrame:
    d = _daily(spark, sf)
    return dashboard.history_forecast_union(d, forecast.seasonal_naive(d, 30))


@register("m3_seasonal_regression_forecast")
def m3_seasonal_regression_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.seasonal_regression(_ts(spark, sf), horizon=30).where(F.col("kind") == "forecast")


@register(
    "m3_trend_forecast",
    sql.with_tx(
        f""", {sql.daily_sql()},
line AS (SELECT sku, region, max(date) AS last_date, regr_slope(ln(1 + quantity), datediff('day', DATE '1970-01-01', date)) AS b,
                regr_intercept(ln(1 + quantity), datediff('day', DATE '1970-01-01', date)) AS a FROM daily GROUP BY sku, region),
days AS (SELECT sku, region, date, 'fit' AS kind, CAST(quantity AS DOUBLE) AS quantity FROM daily
         UNION ALL SELECT sku, region, last_date + CAST(h AS INTEGER) AS date, 'forecast' AS kind, NULL AS quantity FROM line, range(1, 31) t(h))
SELECT d.*, round(greatest(exp(a + b * datediff('day', DATE '1970-01-01', date)) - 1, 0), 4) AS yhat
FROM days d JOIN line l ON d.sku = l.sku AND d.region = l.region"""
    ),
)
def m3_trend_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """M3 with its smallest design: the trend alone, no penalty."""

    fitted = forecast.seasonal_regression(_ts(spark, sf), horizon=30, ridge=0.0, regressors=[], weekly=0, yearly=0)
    return fitted.withColumn("yhat", F.round("yhat", 4))


@register("m4_residual_hybrid_forecast")
def m4_residual_hybrid_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.residual_hybrid(_ts(spark, sf), horizon=30)


@register("m5_backtest_mape")
def m5_backtest_mape(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.backtest_mape(_daily(spark, sf))


# --- validation, sources, sinks (V2-V5, S1, S3, S5, K1-K3) -----------------------------

import uuid as _uuid  # noqa: E402

from stockroom.operators import validation  # noqa: E402
from stockroom.sinks import writers  # noqa: E402
from stockroom.sources import readers  # noqa: E402

_V_RULES = [("not_null", "customer_id"), ("not_null", "sku"), ("non_negative", "quantity"), ("non_negative", "unit_price"), ("non_negative", "revenue")]


def _v_sql(rule: str, col: str) -> str:
    cond = f"{col} IS NULL" if rule == "not_null" else f"NOT coalesce({col} >= 0, false)"
    return (
        f"SELECT '{rule}' AS rule, '{col}' AS \"column\", count(*) AS checked, count(*) FILTER (WHERE {cond}) AS failed,"
        f" count(*) FILTER (WHERE {cond}) = 0 AS success FROM transactions"
    )


@register("v2_v4_validation_report", sql.with_tx("\nUNION ALL\n".join(_v_sql(r, c) for r, c in _V_RULES)))
def v2_v4_validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validation_report(transactions(spark, sf))


@register(
    "v5_quarantine_split",
    "SELECT CASE WHEN coalesce(l_quantity >= 0, false) AND coalesce(l_extendedprice >= 0, false) AND coalesce(l_discount >= 0, false)"
    " THEN 'valid' ELSE 'quarantine' END AS part, count(*) AS rows FROM lineitem GROUP BY 1",
)
def v5_quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    """V5 on raw line items with the same rule engine (non-negative money and quantity)."""

    rules = [("non_negative", c, ~F.coalesce(F.col(c) >= 0, F.lit(False))) for c in ("l_quantity", "l_extendedprice", "l_discount")]
    valid, quarantine = validation.split_valid(table(spark, sf, "lineitem"), rules=rules)
    both = valid.select(F.lit("valid").alias("part")).unionByName(quarantine.select(F.lit("quarantine").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "v5_quarantine_reasons",
    sql.with_tx(
        """, spoilt AS (SELECT CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE customer_id END AS customer_id, CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE sku END AS sku,
       CASE WHEN l_orderkey % 11 = 0 THEN -quantity ELSE quantity END AS quantity, unit_price, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE revenue END AS revenue FROM transactions),
r AS (SELECT concat_ws(',', CASE WHEN customer_id IS NULL THEN 'not_null:customer_id' END, CASE WHEN sku IS NULL THEN 'not_null:sku' END,
                       CASE WHEN NOT coalesce(quantity >= 0, false) THEN 'non_negative:quantity' END, CASE WHEN NOT coalesce(unit_price >= 0, false) THEN 'non_negative:unit_price' END,
                       CASE WHEN NOT coalesce(revenue >= 0, false) THEN 'non_negative:revenue' END) AS failed_rules FROM spoilt)
SELECT failed_rules, count(*) AS rows FROM r GROUP BY 1"""
    ),
)
def v5_quarantine_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """V5 on transactions of which some were spoilt: rows by the rules they fail (none: valid)."""

    key = F.col("l_orderkey")
    tx = transactions(spark, sf)
    spoilt = tx.withColumns(
        {
            "customer_id": F.when(key % 13 != 0, F.col("customer_id")),
            "sku": F.when(key % 29 != 0, F.col("sku")),
            "quantity": F.when(key % 11 == 0, -F.col("quantity")).otherwise(F.col("quantity")),
            "revenue": F.when(key % 17 != 0, F.col("revenue")),
        }
    )
    valid, quarantine = validation.split_valid(spoilt)
    both = valid.select(F.lit("").alias("failed_rules")).unionByName(quarantine.select(F.array_join("failed_rules", ",").alias("failed_rules")))
    return both.groupBy("failed_rules").agg(F.count(F.lit(1)).alias("rows"))


_EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
_TS_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_EVENT_OPTIONS = {"timestampFormat": _TS_FMT, "timestampNTZFormat": _TS_FMT}


@register(
    "s5_kafka_decode_events",
    "SELECT event_id, ts, user_id, event_type, value, props, CAST(event_id % 8 AS INTEGER) AS \"partition\", event_id AS \"offset\" FROM events",
)
def s5_kafka_decode_events(spark: SparkSession, sf: str) -> DataFrame:
    """S5 decode stage on Kafka-shaped rows built from the events table."""

    out = readers.decode_kafka(_kafka_rows(spark, sf), _EVENT_SCHEMA, _EVENT_OPTIONS).drop("topic", "timestamp")
    return out.withColumn("ts", F.col("ts").cast(table(spark, sf, "events").schema["ts"].dataType))


def _kafka_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a bounded batch read returns them: key and value binary, topic, partition, offset."""

    ev = table(spark, sf, "events")
    return ev.select(
        F.col("event_id").cast("string").cast("binary").alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in ev.columns]), _EVENT_OPTIONS).cast("binary").alias("value"),
        F.lit("events").alias("topic"),
        F.pmod(F.col("event_id"), F.lit(8)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
    )


@register(
    "s5_dead_letters",
    """SELECT "offset", CASE "offset" % 10 WHEN 3 THEN 'no value' WHEN 5 THEN 'empty value' WHEN 7 THEN 'not the schema' ELSE 'decoded' END AS outcome
FROM (SELECT event_id AS "offset" FROM events)""",
)
def s5_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """S5 where a part of the values is missing, blank or cut off: every offset comes out on one side."""

    tail = F.col("offset") % 10
    spoilt = F.when(tail == 5, F.lit("  ").cast("binary")).when(tail == 7, F.substring("value", 1, 20)).when(tail != 3, F.col("value"))
    raw = _kafka_rows(spark, sf).withColumn("value", spoilt)
    good = readers.decode_kafka(raw, _EVENT_SCHEMA, _EVENT_OPTIONS).select("offset", F.lit("decoded").alias("outcome"))
    return good.unionByName(readers.dead_letters(raw, _EVENT_SCHEMA, _EVENT_OPTIONS).select("offset", F.col("reason").alias("outcome")))


@register(
    "s6_csv_parquet_union",
    "SELECT o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total, count(CASE WHEN o_orderpriority >= '3' THEN o_custkey END) AS with_customer FROM orders GROUP BY o_orderpriority",
)
def s6_csv_parquet_union(spark: SparkSession, sf: str) -> DataFrame:
    """One part of the orders lies in CSV files without customers, the other in Parquet; read as feeds and put together."""

    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    paths = [scratch_path(spark, f"feed-{kind}") for kind in ("csv", "parquet")]
    orders.where("o_orderpriority < '3'").drop("o_custkey").write.option("header", True).csv(paths[0])
    orders.where("o_orderpriority >= '3'").write.parquet(paths[1])
    feeds = [readers.Feed("old", "csv", path=paths[0], schema="o_orderkey bigint, o_totalprice double, o_orderpriority string"), readers.Feed("new", "parquet", path=paths[1])]
    frames, _ = readers.read_feeds(spark, feeds)
    return readers.union_sources(list(frames.values())).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("total"), F.count("o_custkey").alias("with_customer")
    )


@register(
    "k7_downstream_datasets",
    """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), c AS (SELECT c_custkey FROM customer JOIN n ON c_nationkey = n_nationkey)
SELECT 'nation/' || n_nationkey AS dataset FROM n UNION ALL SELECT 'customer/' || c_custkey FROM c
UNION ALL SELECT 'order/' || o_orderkey FROM orders JOIN c ON o_custkey = c_custkey""",
)
def k7_downstream_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """K7: what lies downstream of a region when each nation, customer and order is written by a job that reads its parent."""

    def events(name: str, parent: str, key: str, parent_key: str, source: str) -> DataFrame:
        one = lambda prefix, c: F.array(F.concat(F.lit(f"{prefix}/"), F.col(c).cast("string")))
        return table(spark, sf, source).select(F.lit(name).alias("job_name"), F.col(key).cast("string").alias("run_id"), one(parent, parent_key).alias("inputs"), one(name, key).alias("outputs"))

    lineage = events("nation", "region", "n_nationkey", "n_regionkey", "nation")
    lineage = lineage.unionByName(events("customer", "nation", "c_custkey", "c_nationkey", "customer"))
    return writers.downstream_of(lineage.unionByName(events("order", "customer", "o_orderkey", "o_custkey", "orders")), "region/2")


_RUN_AT = _dt.datetime(2025, 1, 1)


@register("k4_feature_export", sql.with_tx(f", {sql.customer_features_cte()} SELECT *, TIMESTAMP '2025-01-01 00:00:00' AS event_timestamp FROM customer_features"))
def k4_feature_export(spark: SparkSession, sf: str) -> DataFrame:
    """K4: customer features written with the run's time, and read back."""

    path = writers.export_features(features.customer_features(transactions(spark, sf)), scratch_path(spark, "export"), _RUN_AT)
    return readers.read_parquet(spark, path).withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))


@register("k5_inventory_write", sql.with_tx(sql.inventory_sql(), sku="brand"))
def k5_inventory_write(spark: SparkSession, sf: str) -> DataFrame:
    """K5: recommendations written and read back."""

    return readers.read_parquet(spark, writers.write_result(inventory.recommend(transactions(spark, sf, sku="brand")), scratch_path(spark, "inventory")))


@register(
    "k6_run_log",
    sql.with_tx(
        """, f AS (SELECT count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue FROM transactions)
SELECT 'param' AS kind, 'source' AS key, 'transactions' AS value FROM f UNION ALL SELECT 'metric' AS kind, 'lines' AS key, CAST(CAST(lines AS DOUBLE) AS VARCHAR) AS value FROM f
UNION ALL SELECT 'metric' AS kind, 'revenue' AS key, CAST(revenue AS VARCHAR) AS value FROM f"""
    ),
)
def k6_run_log(spark: SparkSession, sf: str) -> DataFrame:
    """K6: parameters and metrics of a run, appended to the run log and read back."""

    found = transactions(spark, sf).agg(F.count("*").alias("lines"), F.sum("revenue").cast("double").alias("revenue")).first()
    path = scratch_path(spark, "run-log")
    writers.log_run(spark, path, "run", {"source": "transactions"}, found.asDict(), at=_RUN_AT)
    return readers.read_parquet(spark, path).select("kind", "key", "value")


@register(
    "s1_k1_csv_roundtrip",
    "SELECT o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderpriority",
)
def s1_k1_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + K1: write orders as CSV to the shared scratch folder, read back with a schema."""

    path = writers.shared_path(spark, "csv_orders", _uuid.uuid4().hex)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    orders.write.mode("overwrite").option("header", True).csv(path)
    back = readers.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string")
    return back.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("total")
    )


@register(
    "k3_silver_roundtrip",
    sql.with_tx("SELECT date, count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity FROM transactions GROUP BY date"),
)
def k3_silver_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K3: land bronze + silver (partitioned by date) and read silver back; partition pruning applies to later date filters."""

    run = _uuid.uuid4().hex
    bronze = writers.shared_path(spark, "bronze", run)
    silver = writers.shared_path(spark, "silver", run)
    tx = transactions(spark, sf).drop(*[c for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")])
    writers.land_bronze_silver(tx, bronze, silver)
    back = readers.read_parquet(spark, silver)
    return back.groupBy("date").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("bigint").alias("quantity")
    )


# --- churn and segmentation (M7-M17, A18, P18, T3) --------------------------------------

from stockroom.operators import churn, segment, tree_shapley  # noqa: E402
from stockroom.sinks import model_store  # noqa: E402


def _cf(spark: SparkSession, sf: str) -> DataFrame:
    return features.customer_features(transactions(spark, sf))


@register(
    "m7_stratified_split",
    sql.with_tx(
        f""", {sql.customer_features_cte()},
r AS (SELECT customer_id, churn_label,
             row_number() OVER (PARTITION BY churn_label ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id) AS rk,
             count(*) OVER (PARTITION BY churn_label) AS n FROM customer_features)
SELECT customer_id, churn_label, rk <= ceil(0.2 * n) AS is_valid FROM r"""
    ),
)
def m7_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return churn.stratified_split(_cf(spark, sf).select("customer_id", "churn_label"))


@register(
    "a18_auc_recency_vs_churn",
    sql.with_tx(
        f""", {sql.customer_features_cte()},
g AS (SELECT CAST(recency AS DOUBLE) AS s, count(*) FILTER (WHERE churn_label = 1) AS pos, count(*) FILTER (WHERE churn_label <> 1) AS neg
      FROM customer_features GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(CAST(pos AS HUGEINT) * (2 * below + neg)) AS DOUBLE)
       / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc FROM c"""
    ),
)
def a18_auc_recency_vs_churn(spark: SparkSession, sf: str) -> DataFrame:
    return churn.roc_auc(_cf(spark, sf), score="recency")


_MODELS: dict = {}


def _churn_model(spark: SparkSession, sf: str, **options):
    """Fit once per (session, input, options) and reuse across the churn queries."""

    key = (spark.sparkContext.applicationId, sf, *sorted(options.items()))
    if key not in _MODELS:
        cf = ScratchTable(_cf(spark, sf), "churn-customers").df  # the split, the fits and every scoring read it
        split = churn.stratified_split(cf).cache()
        model = churn.fit_stacked(split.where(~F.col("is_valid")).drop("is_valid"), **options)
        _MODELS[key] = (cf, split, model)
    return _MODELS[key]


@register("m8_m9_churn_scores")
def m8_m9_churn_scores(spark: SparkSession, sf: str) -> DataFrame:
    cf, _, model = _churn_model(spark, sf)
    return churn.predict(model, cf)


@register("m8_two_learner_scores")
def m8_two_learner_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M8 with both base learners, boosted trees and a forest, under one meta learner."""

    cf, _, model = _churn_model(spark, sf, kind="two")
    return churn.predict(model, cf)


_LADDER_SQL = " ".join(f"WHEN idle_share >= {least} THEN '{action}'" for least, action in scalar.RETENTION_ACTIONS)


@register(
    "p18_retention_ladder",
    sql.with_tx(
        f""", {sql.customer_features_cte()},
idle AS (SELECT customer_id, CAST(recency AS DOUBLE) / CAST(greatest(tenure_days, 1) AS DOUBLE) AS idle_share FROM customer_features)
SELECT customer_id, idle_share, CASE {_LADDER_SQL} ELSE '{scalar.RETENTION_DEFAULT}' END AS retention_action FROM idle"""
    ),
)
def p18_retention_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """P18 on the share of a customer's time that has passed since the last purchase."""

    idle = scalar.per_clipped(F.col("recency"), F.col("tenure_days")).alias("idle_share")
    return _cf(spark, sf).select("customer_id", idle).withColumn("retention_action", scalar.retention_action("idle_share"))


@register("m9_validation_auc")
def m9_validation_auc(spark: SparkSession, sf: str) -> DataFrame:
    _, split, model = _churn_model(spark, sf)
    scored = churn.predict(model, split.where(F.col("is_valid")).drop("is_valid"))
    return churn.roc_auc(scored, score="churn_probability")


@register("m10_churn_explanation")
def m10_churn_explanation(spark: SparkSession, sf: str) -> DataFrame:
    cf, _, model = _churn_model(spark, sf)
    return tree_shapley.explain(model, cf)


@register("m10_customer_contributions")
def m10_customer_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """M10 by customer and feature: what moves each customer's log-odds from the base."""

    cf, _, model = _churn_model(spark, sf)
    rows = tree_shapley.churn_contributions(model, cf)
    names = F.array(*map(F.lit, model.features))
    return rows.select("customer_id", "log_odds", "base_log_odds", F.inline(F.arrays_zip(names.alias("feature"), F.col("contributions").alias("contribution"))))


@register("k8_reloaded_churn_scores")
def k8_reloaded_churn_scores(spark: SparkSession, sf: str) -> DataFrame:
    """K8: scores of every customer by the stacked model after a round trip through the model store."""

    cf, _, model = _churn_model(spark, sf)
    return churn.predict(model_store.load(model_store.save(model, scratch_path(spark, "churn-model"))), cf)


@register("t3_retention_radar")
def t3_retention_radar(spark: SparkSession, sf: str) -> DataFrame:
    cf, _, model = _churn_model(spark, sf)
    return churn.retention_radar(churn.predict(model, cf), 15)


@register(
    "m11_standardize",
    sql.with_tx(
        f""", {sql.customer_features_cte()},
s AS (SELECT avg(CAST(frequency AS DOUBLE)) AS mf, stddev_pop(CAST(frequency AS DOUBLE)) AS sf_,
             avg(CAST(recency AS DOUBLE)) AS mr, stddev_pop(CAST(recency AS DOUBLE)) AS sr FROM customer_features)
SELECT customer_id, round((CAST(frequency AS DOUBLE) - mf) / CASE WHEN sf_ > 0 THEN sf_ ELSE 1.0 END, 8) AS z_frequency,
       round((CAST(recency AS DOUBLE) - mr) / CASE WHEN sr > 0 THEN sr ELSE 1.0 END, 8) AS z_recency
FROM customer_features, s"""
    ),
)
def m11_standardize(spark: SparkSession, sf: str) -> DataFrame:
    z = segment.standardize(_cf(spark, sf), ["frequency", "recency"])
    return z.select("customer_id", F.round("z_frequency", 8).alias("z_frequency"), F.round("z_recency", 8).alias("z_recency"))


def _segment_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customer features as a table: every candidate, the assignments and the profile read them."""

    return ScratchTable(_cf(spark, sf), "segment-customers").df


@register("m12_m16_segment_candidates")
def m12_m16_segment_candidates(spark: SparkSession, sf: str) -> DataFrame:
    table, _ = segment.candidate_models(_segment_customers(spark, sf))
    return table


DENSITY_RADII = (*segment.DBSCAN_RADII, 1.5)  # small tables have clusters at the widest only


@register(
    "m14_density_segments",
    sql.with_tx(f", {sql.customer_features_cte()}, {sql.standardized_ctes()}, {sql.density_segments_sql(DENSITY_RADII, segment.DBSCAN_MIN_SAMPLES)}").replace("WITH ", "WITH RECURSIVE ", 1),
)
def m14_density_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of every customer for each radius."""

    return segment.density_segments(_segment_customers(spark, sf), DENSITY_RADII)


@register("m17_segment_assignments")
def m17_segment_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """The segment of every customer under the best candidate."""

    found = segment.segment_customers(_segment_customers(spark, sf))
    return found["assignments"].select("customer_id", "segment_id", F.lit(found["algorithm"]).alias("algorithm"), F.lit(found["silhouette_score"]).alias("silhouette"))


@register("m17_a11_segment_profile")
def m17_a11_segment_profile(spark: SparkSession, sf: str) -> DataFrame:
    return segment.segment_customers(_segment_customers(spark, sf))["profile"]


# --- feature store (J7, J8, F1, F2) -------------------------------------------------------


from stockroom.operators import feature_store  # noqa: E402


def _asof_inputs(spark: SparkSession, sf: str):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf, "orders")
    req = li.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.col("o_custkey").alias("customer_id"), F.col("l_shipdate").alias("ts")
    )
    cust_day = orders.groupBy(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("event_timestamp")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("spend"), F.count(F.lit(1)).alias("orders")
    )
    return req, cust_day


@register(
    "j7_asof_customer_spend",
    f"""WITH {sql.asof_requests_sql()},
j AS (SELECT req.*, c.spend, c.orders, c.event_timestamp AS fts FROM req ASOF LEFT JOIN cust_day c
      ON req.customer_id = c.customer_id AND req.ts >= c.event_timestamp)
SELECT l_orderkey, l_linenumber, customer_id, ts,
       CASE WHEN fts >= ts - INTERVAL 30 DAY THEN spend END AS spend,
       CASE WHEN fts >= ts - INTERVAL 30 DAY THEN orders END AS orders,
       CASE WHEN fts >= ts - INTERVAL 30 DAY THEN fts END AS feature_ts
FROM j""",
)
def j7_asof_customer_spend(spark: SparkSession, sf: str) -> DataFrame:
    req, cust_day = _asof_inputs(spark, sf)
    return feature_store.asof_join(req, cust_day, "customer_id", "ts", "event_timestamp", ["spend", "orders"], _dt.timedelta(days=30))


def _bought(spark: SparkSession, sf: str, *sums) -> DataFrame:
    """(customer_id, sku, date, sums), a row for each that occurs, as a table: the fact table's joins run once for all that reads it."""

    keys = transactions(spark, sf).groupBy("customer_id", "sku", "date")
    bought = ScratchTable(keys.agg(*sums) if sums else keys.agg(F.lit(1)).select("customer_id", "sku", "date"), "feature-requests").df
    free_shuffles(spark)
    return bought


@register(
    "j8_feature_service",
    sql.with_tx(
        f""", req AS (SELECT DISTINCT customer_id, sku, CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR AS ts FROM transactions),
cust_day AS (SELECT customer_id, CAST(date AS TIMESTAMP) AS event_timestamp, CAST(sum(revenue) AS DOUBLE) AS spend FROM transactions GROUP BY 1, 2),
sku_day AS (SELECT sku, CAST(date AS TIMESTAMP) - INTERVAL 1 DAY AS event_timestamp, CAST(sum(quantity) AS BIGINT) AS units FROM transactions GROUP BY 1, 2),
a AS (SELECT req.*, c.spend, c.event_timestamp AS cts FROM req ASOF LEFT JOIN cust_day c ON req.customer_id = c.customer_id AND req.ts >= c.event_timestamp),
b AS (SELECT a.*, s.units, s.event_timestamp AS sts FROM a ASOF LEFT JOIN sku_day s ON a.sku = s.sku AND a.ts >= s.event_timestamp)
SELECT customer_id, sku, ts,
       CASE WHEN cts >= ts - INTERVAL 30 DAY THEN spend END AS customer_spend,
       CASE WHEN cts >= ts - INTERVAL 30 DAY THEN cts END AS customer_feature_ts,
       CASE WHEN sts >= ts - INTERVAL 7 DAY THEN units END AS sku_units,
       CASE WHEN sts >= ts - INTERVAL 7 DAY THEN sts END AS sku_feature_ts
FROM b"""
    ),
)
def j8_feature_service(spark: SparkSession, sf: str) -> DataFrame:
    bought = _bought(spark, sf, F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"))
    req = bought.select("customer_id", "sku", (F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("ts"))
    cust_day = bought.groupBy("customer_id", F.col("date").cast("timestamp_ntz").alias("event_timestamp")).agg(F.sum("revenue").cast("double").alias("spend"))
    sku_day = bought.groupBy("sku", (F.col("date").cast("timestamp_ntz") - F.expr("INTERVAL 1 DAYS")).alias("event_timestamp")).agg(
        F.sum("quantity").cast("bigint").alias("units")
    )
    return feature_store.feature_service(req, cust_day, sku_day, customer_cols=["spend"], sku_cols=["units"])


@register(
    "j8_declared_views",
    sql.with_tx(
        f""", {sql.customer_features_cte()}, {sql.ts_features_cte()},
run AS (SELECT CAST(max(date) AS TIMESTAMP) + INTERVAL 1 DAY AS seen FROM transactions),
req AS (SELECT DISTINCT customer_id, sku, CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR AS ts FROM transactions
        UNION ALL SELECT DISTINCT customer_id, sku, seen + INTERVAL 12 HOUR FROM transactions, run),
cust_view AS (SELECT customer_id, CAST(recency AS BIGINT) AS recency, CAST(frequency AS BIGINT) AS frequency, CAST(monetary AS FLOAT) AS monetary,
                CAST(rfm_score AS FLOAT) AS rfm_score, CAST(purchase_velocity AS FLOAT) AS purchase_velocity, CAST(avg_order_value AS FLOAT) AS avg_order_value,
                seen FROM customer_features, run),
ser AS (SELECT sku, region, CAST(rolling_qty_7 AS FLOAT) AS rolling_qty_7, CAST(rolling_qty_14 AS FLOAT) AS rolling_qty_14,
               CAST(rolling_qty_30 AS FLOAT) AS rolling_qty_30, CAST(lag_qty_1 AS FLOAT) AS lag_qty_1, CAST(lag_qty_7 AS FLOAT) AS lag_qty_7,
               CAST(lag_qty_14 AS FLOAT) AS lag_qty_14, CAST(avg_price AS FLOAT) AS avg_price, CAST(promotion_flag AS BIGINT) AS promotion_flag,
               CAST(date AS TIMESTAMP) AS seen FROM ts_features QUALIFY row_number() OVER (PARTITION BY sku, date ORDER BY region DESC) = 1),
j AS (SELECT req.customer_id, req.sku, req.ts, c.recency, c.frequency, c.monetary, c.rfm_score, c.purchase_velocity, c.avg_order_value, c.seen AS cat
      FROM req LEFT JOIN cust_view c ON req.customer_id = c.customer_id AND c.seen <= req.ts AND c.seen >= req.ts - INTERVAL 30 DAY),
k AS (SELECT j.*, s.region, s.rolling_qty_7, s.rolling_qty_14, s.rolling_qty_30, s.lag_qty_1, s.lag_qty_7, s.lag_qty_14, s.avg_price, s.promotion_flag,
             s.seen AS sat, s.seen >= j.ts - INTERVAL 7 DAY AS fresh FROM j ASOF LEFT JOIN ser s ON j.sku = s.sku AND j.ts >= s.seen)
SELECT customer_id, sku, ts, recency AS customer_recency, frequency AS customer_frequency, monetary AS customer_monetary, rfm_score AS customer_rfm_score,
       purchase_velocity AS customer_purchase_velocity, avg_order_value AS customer_avg_order_value, cat AS customer_feature_ts,
       CASE WHEN fresh THEN region END AS sku_region, CASE WHEN fresh THEN rolling_qty_7 END AS sku_rolling_qty_7,
       CASE WHEN fresh THEN rolling_qty_14 END AS sku_rolling_qty_14, CASE WHEN fresh THEN rolling_qty_30 END AS sku_rolling_qty_30,
       CASE WHEN fresh THEN lag_qty_1 END AS sku_lag_qty_1, CASE WHEN fresh THEN lag_qty_7 END AS sku_lag_qty_7,
       CASE WHEN fresh THEN lag_qty_14 END AS sku_lag_qty_14, CASE WHEN fresh THEN avg_price END AS sku_avg_price,
       CASE WHEN fresh THEN promotion_flag END AS sku_promotion_flag, CASE WHEN fresh THEN sat END AS sku_feature_ts
FROM k"""
    ),
)
def j8_declared_views(spark: SparkSession, sf: str) -> DataFrame:
    """J8 on the declared views: each purchase, and each customer and sku at the run, with both views' fields."""

    days = _bought(spark, sf)
    run = F.lit(days.agg(F.max("date")).first()[0] + _dt.timedelta(days=1)).cast("timestamp_ntz")
    bought = days.select("customer_id", "sku", (F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("ts"))
    now = bought.select("customer_id", "sku").distinct().withColumn("ts", run + F.expr("INTERVAL 12 HOURS"))
    customers = feature_store.feature_view(_cf(spark, sf).withColumn("event_timestamp", run), feature_store.CUSTOMER_VIEW)
    free_shuffles(spark)
    series = feature_store.feature_view(_ts(spark, sf).withColumn("event_timestamp", F.col("date").cast("timestamp_ntz")), feature_store.SERIES_VIEW)
    return feature_store.feature_service(bought.unionByName(now), customers, series, sku_tie="region")


@register(
    "f1_customer_feature_view",
    sql.with_tx(
        f""", {sql.customer_features_cte()}
SELECT customer_id, CAST(recency AS BIGINT) AS recency, CAST(frequency AS BIGINT) AS frequency, CAST(monetary AS FLOAT) AS monetary,
       CAST(rfm_score AS FLOAT) AS rfm_score, CAST(purchase_velocity AS FLOAT) AS purchase_velocity, CAST(avg_order_value AS FLOAT) AS avg_order_value
FROM customer_features"""
    ),
)
def f1_customer_feature_view(spark: SparkSession, sf: str) -> DataFrame:
    return feature_store.feature_view(_cf(spark, sf), feature_store.CUSTOMER_VIEW)


@register(
    "f1_series_feature_view",
    sql.with_tx(
        f""", {sql.ts_features_cte()}
SELECT sku, region, CAST(rolling_qty_7 AS FLOAT) AS rolling_qty_7, CAST(rolling_qty_14 AS FLOAT) AS rolling_qty_14, CAST(rolling_qty_30 AS FLOAT) AS rolling_qty_30,
       CAST(lag_qty_1 AS FLOAT) AS lag_qty_1, CAST(lag_qty_7 AS FLOAT) AS lag_qty_7, CAST(lag_qty_14 AS FLOAT) AS lag_qty_14, CAST(avg_price AS FLOAT) AS avg_price,
       CAST(promotion_flag AS BIGINT) AS promotion_flag, CAST(date AS TIMESTAMP) AS event_timestamp FROM ts_features"""
    ),
)
def f1_series_feature_view(spark: SparkSession, sf: str) -> DataFrame:
    """the declared series view, a row per series and day."""

    return feature_store.feature_view(_ts(spark, sf).withColumn("event_timestamp", F.col("date").cast("timestamp_ntz")), feature_store.SERIES_VIEW)


@register(
    "f2_latest_series_features",
    sql.with_tx(
        f""", {sql.ts_features_cte()}
SELECT sku, region, arg_max(date, date) AS date, arg_max(quantity, date) AS quantity, arg_max(rolling_qty_7, date) AS rolling_qty_7,
       arg_max(lag_qty_1, date) AS lag_qty_1, arg_max(avg_price, date) AS avg_price FROM ts_features GROUP BY sku, region"""
    ),
)
def f2_latest_series_features(spark: SparkSession, sf: str) -> DataFrame:
    ts = _ts(spark, sf).select("sku", "region", "date", "quantity", "rolling_qty_7", "lag_qty_1", "avg_price")
    return feature_store.latest_per_entity(ts, ["sku", "region"], ["date"])


# --- monitoring (M29, V6, P23) ------------------------------------------------------------


def _psi_mape(spark: SparkSession, sf: str) -> tuple[float, float]:
    tx = transactions(spark, sf)
    psi = drift.observed_drift_snapshot(tx).select(F.round("psi", 10)).first()[0]
    mape = forecast.naive_mape(features.daily_rollup(tx)).agg(F.round(F.avg("mape"), 10)).first()[0]
    return float(psi), float(mape)


@register(
    "v6_m29_monitoring_status",
    sql.with_tx(
        sql.monitoring_ctes()
        + """
SELECT 'PSI' AS metric, psi AS value, CAST(0.2 AS DOUBLE) AS threshold, 'max' AS direction,
       CASE WHEN psi > 0.2 THEN 'alert' ELSE 'healthy' END AS status FROM pm
UNION ALL
SELECT 'Demand MAPE' AS metric, mape AS value, CAST(10.0 AS DOUBLE) AS threshold, 'max' AS direction,
       CASE WHEN mape > 10.0 THEN 'alert' ELSE 'healthy' END AS status FROM pm"""
    ),
)
def v6_m29_monitoring_status(spark: SparkSession, sf: str) -> DataFrame:
    psi, mape = _psi_mape(spark, sf)
    values = spark.createDataFrame([("PSI", psi), ("Demand MAPE", mape)], "metric string, value double")
    return drift.monitoring_table(values).select("metric", "value", "threshold", "direction", "status")


@register(
    "p23_retrain_decision",
    sql.with_tx(
        sql.monitoring_ctes()
        + """
SELECT psi, mape, (psi > 0.2 OR mape > 15.0) AS should_retrain,
       concat_ws('; ', CASE WHEN psi > 0.2 THEN printf('PSI exceeded threshold (%.3f > %.3f)', psi, 0.2) END,
                       CASE WHEN mape > 15.0 THEN printf('MAPE exceeded threshold (%.2f > %.2f)', mape, 15.0) END) AS reasons_text
FROM pm"""
    ),
)
def p23_retrain_decision(spark: SparkSession, sf: str) -> DataFrame:
    psi, mape = _psi_mape(spark, sf)
    d = drift.retrain_policy(spark.createDataFrame([(psi, mape)], "psi double, mape double"))
    return d.select("psi", "mape", "should_retrain", F.array_join("reasons", "; ").alias("reasons_text"))


@register("m26_drift_report", sql.with_tx(sql.drift_report_sql(["quantity", "unit_price", "discount_pct"], ["channel", "region"])))
def m26_drift_report(spark: SparkSession, sf: str) -> DataFrame:
    """M26 on the two halves of the history (split at the median transaction date)."""

    tx = transactions(spark, sf)
    ref, cur = dashboard.time_split(tx, drift.median_transaction_date(tx))
    report = drift.dataset_drift_report(ref, cur, ["quantity", "unit_price", "discount_pct"], ["channel", "region"])
    return report.withColumn("value", F.round("value", 10))


@register(
    "m26_ks_statistics",
    sql.with_tx(
        f""", {sql.median_date_cte()},
v AS (SELECT 'quantity' AS "column", CAST(quantity AS DOUBLE) AS value, date <= cutoff AS is_ref FROM transactions, cut
      UNION ALL SELECT 'discount_pct', CAST(discount_pct AS DOUBLE), date <= cutoff FROM transactions, cut),
n AS (SELECT "column", count(*) FILTER (WHERE is_ref) AS n_ref, count(*) FILTER (WHERE NOT is_ref) AS n_cur FROM v GROUP BY 1),
w AS (SELECT v."column", value, sum(CASE WHEN is_ref THEN n_cur ELSE -n_ref END) AS w FROM v JOIN n ON v."column" = n."column" GROUP BY 1, 2),
c AS (SELECT "column", sum(w) OVER (PARTITION BY "column" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM w)
SELECT c."column", 'numeric' AS kind, 'ks' AS statistic, CAST(max(abs(cum)) AS DOUBLE) / (CAST(max(n_ref) AS DOUBLE) * CAST(max(n_cur) AS DOUBLE)) AS value
FROM c JOIN n ON c."column" = n."column" GROUP BY c."column\""""
    ),
)
def m26_ks_statistics(spark: SparkSession, sf: str) -> DataFrame:
    tx = transactions(spark, sf)
    cutoff = drift.median_transaction_date(tx)
    ref = tx.where(F.col("date") <= F.lit(cutoff))
    cur = tx.where(F.col("date") > F.lit(cutoff))
    return drift.ks_statistics(ref, cur, ["quantity", "discount_pct"])


# --- single operators exposed on their own (M6, M23, M20, A16/A17) --------------------


@register(
    "m6_demand_one_pair",
    sql.with_tx(f", {sql.daily_sql()}, {sql.naive_forecast_ctes()} SELECT * FROM forecast WHERE sku = 'Brand#11' AND region = 'EUROPE'"),
)
def m6_demand_one_pair(spark: SparkSession, sf: str) -> DataFrame:
    """M6: scoring one (sku, region) pair = a filter on the all-pairs forecast
    (the filter is pushed below the forecast by Catalyst)."""

    fc = forecast.seasonal_naive(_daily(spark, sf), horizon=30)
    return fc.where((F.col("sku") == "Brand#11") & (F.col("region") == "EUROPE"))


@register(
    "m23_abc_xyz_classification",
    sql.with_tx(
        f""", {sql.sku_summary_sql()}
SELECT sku, CAST(annual_revenue AS DOUBLE) AS annual_revenue, annual_demand, revenue_rank, cum_share, abc_class, xyz_class FROM abcxyz""",
        sku="part",
    ),
)
def m23_abc_xyz_classification(spark: SparkSession, sf: str) -> DataFrame:
    c = inventory.abc_xyz_classification(transactions(spark, sf, sku="part"))
    return c.select("sku", F.col("annual_revenue").cast("double").alias("annual_revenue"), "annual_demand", "revenue_rank", "cum_share", "abc_class", "xyz_class")


@register(
    "m20_backdoor_one_confounder",
    sql.with_tx(
        f""", {sql.ts_features_cte()},
m AS (SELECT covar_pop(CAST(quantity AS DOUBLE), avg_price) AS syp, covar_pop(CAST(quantity AS DOUBLE), CAST(promotion_flag AS DOUBLE)) AS syz,
             var_pop(avg_price) AS spp, var_pop(CAST(promotion_flag AS DOUBLE)) AS szz, covar_pop(avg_price, CAST(promotion_flag AS DOUBLE)) AS spz,
             avg(avg_price) AS mean_price, avg(CAST(quantity AS DOUBLE)) AS mean_quantity FROM ts_features)
SELECT round((syp * szz - syz * spz) / (spp * szz - spz * spz), 6) AS level_effect, round(mean_price, 6) AS mean_price,
       round(mean_quantity, 6) AS mean_quantity,
       round((syp * szz - syz * spz) / (spp * szz - spz * spz) * mean_price / mean_quantity, 6) AS price_elasticity FROM m"""
    ),
)
def m20_backdoor_one_confounder(spark: SparkSession, sf: str) -> DataFrame:
    e = pricing.elasticity_backdoor(_ts(spark, sf), confounders=["promotion_flag"])
    return e.select(*[F.round(c, 6).alias(c) for c in ("level_effect", "mean_price", "mean_quantity", "price_elasticity")])


@register(
    "a16_a17_monetary_histogram",
    sql.with_tx(
        f""", {sql.customer_features_cte()},
{sql.psi_ctes('customer_features', 'monetary', 'monetary')}
SELECT CAST(h.bin AS INTEGER) AS bin, round(lo.b, 6) AS lower, round(hi.b, 6) AS upper, h.rc AS customers
FROM psi_hist h JOIN psi_bpr lo ON lo.j = h.bin JOIN psi_bpr hi ON hi.j = h.bin + 1"""
    ),
)
def a16_a17_monetary_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A16 + A17: decile breakpoints of customer monetary value and the histogram on them."""

    cf = features.customer_features(transactions(spark, sf))
    running = value_counts.running_counts(value_counts.paired_value_counts(cf, {"monetary": ("monetary", "monetary")}))
    bins = value_counts.histogram(running, value_counts.breakpoints(running))
    return bins.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), F.col("ref").alias("customers"))
