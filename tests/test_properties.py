"""Property checks (SURVEY section 5 (c))."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockroom.functions.ordered import with_global_order
from stockroom.operators import features, inventory
from stockroom.sources.tables import transactions

from .conftest import SF_SMOKE


def test_rolling_one_is_identity(spark):
    daily = features.daily_rollup(transactions(spark, SF_SMOKE))
    r = features.with_rolling_and_lags(daily, windows=(1,), lags=(1,))
    assert r.where(F.col("rolling_qty_1") != F.col("quantity").cast("double")).count() == 0


def test_abc_shares_monotone_and_end_at_one(spark):
    c = inventory.abc_xyz_classification(transactions(spark, SF_SMOKE, sku="part")).select("revenue_rank", "cum_share", "abc_class").toPandas()
    c = c.sort_values("revenue_rank")
    assert c["cum_share"].is_monotonic_increasing
    assert abs(c["cum_share"].iloc[-1] - 1.0) < 1e-12
    order = {"A": 0, "B": 1, "C": 2}
    assert pd.Series([order[x] for x in c["abc_class"]]).is_monotonic_increasing


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(-3, 3)), min_size=1, max_size=60), st.integers(1, 7))
def test_global_order_equals_sorted(spark, rows, ranges):
    data = [(i, k, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k int, v int")
    out = with_global_order(df, [F.col("k").asc(), F.col("id").desc()], sum_of=F.col("v"), running_sum_col="cum", num_ranges=ranges).toPandas()
    ref = pd.DataFrame(data, columns=["id", "k", "v"]).sort_values(["k", "id"], ascending=[True, False]).reset_index(drop=True)
    ref["rn"] = range(1, len(ref) + 1)
    ref["cum"] = ref["v"].cumsum()
    m = ref.merge(out, on="id", suffixes=("", "_s"))
    assert len(m) == len(data)
    assert (m["rn"] == m["global_rn"]).all() and (m["cum"] == m["cum_s"]).all()
