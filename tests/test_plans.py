"""Plan checks: the physical shapes the scale design relies on."""

import re

from pyspark.sql import functions as F

from stockroom.operators import features, forecast, inventory, pricing
from stockroom.sources.tables import table, transactions

from .conftest import SF_SMOKE


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimensions_are_broadcast_and_scans_pruned(spark):
    plan = _plan(transactions(spark, SF_SMOKE).select("date", "region", "quantity"))
    assert "BroadcastHashJoin" in plan
    # the lineitem scan reads only the columns the view needs, not l_returnflag etc.
    assert "l_returnflag" not in plan and "l_shipdate" not in plan


def test_filters_reach_the_parquet_scan(spark):
    df = table(spark, SF_SMOKE, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_orderpriority,1-URGENT\)", plan)


def test_pareto_window_is_range_partitioned(spark):
    df = inventory.abc_xyz_classification(transactions(spark, SF_SMOKE, sku="part"))
    plan = _plan(df)
    # the running sum over revenue order is partitioned by range id, not a single partition
    assert re.search(r"windowspecdefinition\(__range_id", plan)
    for line in plan.splitlines():
        if "Window [sum(annual_revenue" in line:
            assert "__range_id" in line


def test_top_n_per_key_uses_window_group_limit(spark):
    daily = features.daily_rollup(transactions(spark, SF_SMOKE))
    assert "WindowGroupLimit" in _plan(forecast.last_n(daily, 14))
    ts = features.time_series_features(transactions(spark, SF_SMOKE))
    assert "WindowGroupLimit" in _plan(pricing.tail_baseline(ts))


def test_rolling_features_share_one_window_shuffle(spark):
    plan = _plan(features.time_series_features(transactions(spark, SF_SMOKE)))
    window_exchanges = [l for l in plan.splitlines() if "Exchange hashpartitioning(sku" in l and "region" in l and "date" not in l]
    assert len(window_exchanges) == 1


def test_aggregates_are_partial_before_shuffle(spark):
    plan = _plan(features.daily_rollup(transactions(spark, SF_SMOKE)))
    assert "partial_sum" in plan
