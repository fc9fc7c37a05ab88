"""Inventory policy: A5, A6, J1, W4-W6, P19-P22, M23, M24.

The reference groups the fact table by sku twice (value/volatility summary and
demand summary) and joins the two; here both are one ``groupBy('sku')`` with a
partial (map-side) aggregate, so the fact table is scanned and shuffled once
and the shuffle carries one row per (map task, sku).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.functions.ordered import with_global_order
from stockroom.functions.scalar import eoq, safety_stock, sample_std_exact
from stockroom.sources.tables import line_order

INVENTORY_COLUMNS = [
    "sku", "abc_class", "xyz_class", "reorder_point", "recommended_order_qty",
    "safety_stock", "current_inventory", "recommendation",
]


def sku_summary(tx: DataFrame, order_by: Column | None = None) -> DataFrame:
    """A5 + A6 fused (J1): one row per sku.

    ``annual_revenue`` (exact decimal), ``annual_demand`` (total quantity of the
    history, not annualised, as in the reference), ``avg_demand`` (mean per
    transaction row), ``demand_std`` (sample std, 0 for one row), ``cv``
    (0 when the mean is 0) and ``current_inventory`` = inventory of the last
    row in ``order_by`` (default: date, then line identity).
    """

    order_by = order_by if order_by is not None else line_order(df=tx)
    q = F.col("quantity").cast("bigint")
    agg = (
        tx.where(F.col("sku").isNotNull())
        .groupBy("sku")
        .agg(
            F.coalesce(F.sum("revenue"), F.lit(0)).alias("annual_revenue"),
            F.count(q).alias("rows"),  # non-null quantities: pandas mean/std skip NaN
            F.coalesce(F.sum(q), F.lit(0)).alias("annual_demand"),
            F.sum(q * q).alias("_sum_sq"),
            # pandas "last" skips nulls: rows with a null value get a null ordering key
            F.max_by(F.col("inventory_on_hand"), F.when(F.col("inventory_on_hand").isNotNull(), order_by)).alias("current_inventory"),
        )
    )
    avg = F.try_divide(F.col("annual_demand").cast("double"), F.col("rows").cast("double"))
    std = sample_std_exact(F.col("rows"), F.col("annual_demand"), F.col("_sum_sq"))
    return (
        agg.withColumn("avg_demand", avg)
        .withColumn("demand_std", std)
        .withColumn("cv", F.coalesce(F.try_divide(F.col("demand_std"), F.col("avg_demand")), F.lit(0.0)))
        .drop("_sum_sq")
    )


def abc_class(cum_share: Column) -> Column:
    """<=0.8 A, <=0.95 B, else C (share includes the row itself)."""

    share = F.least(cum_share, F.lit(1.0))
    return F.when(share <= 0.8, "A").when(share <= 0.95, "B").otherwise("C")


def xyz_class(cv: Column) -> Column:
    """<=0.5 X, <=1.0 Y, else Z."""

    return F.when(cv <= 0.5, "X").when(cv <= 1.0, "Y").otherwise("Z")


def abc_xyz_classification(tx: DataFrame, order_by: Column | None = None, num_ranges: int | None = None) -> DataFrame:
    """Sku summary + Pareto share (W4) + ABC (W5) + XYZ.

    The cumulative revenue share is a global running sum in revenue-desc order
    (ties by sku), computed range-parallel by ``with_global_order``.
    """

    summary = sku_summary(tx, order_by)
    ranked = with_global_order(
        summary,
        [F.col("annual_revenue").desc(), F.col("sku").asc()],
        row_number_col="revenue_rank",
        sum_of=F.col("annual_revenue"),
        running_sum_col="cum_revenue",
        total_col="total_revenue",
        num_ranges=num_ranges,
    )
    share = F.col("cum_revenue").cast("double") / F.col("total_revenue").cast("double")
    return (
        ranked.withColumn("cum_share", share)
        .withColumn("abc_class", abc_class(F.col("cum_share")))
        .withColumn("xyz_class", xyz_class(F.col("cv")))
        .drop("cum_revenue", "total_revenue")
    )


def recommend(
    tx: DataFrame,
    lead_time_days: float = 7,
    ordering_cost: float = 150.0,
    holding_cost: float = 8.0,
    order_by: Column | None = None,
    per_day: bool = False,
    num_ranges: int | None = None,
) -> DataFrame:
    """Reorder recommendation per sku (P19-P22 on top of M23).

    ``per_day=False`` keeps the reference meaning of ``avg_daily_demand``
    (mean quantity per transaction row).  ``per_day=True`` uses total quantity
    divided by the number of distinct sale days instead.
    """

    classified = abc_xyz_classification(tx, order_by, num_ranges)
    if per_day:
        days = tx.where(F.col("sku").isNotNull()).groupBy("sku").agg(F.count_distinct("date").alias("_days"))
        classified = classified.join(days, "sku").withColumn(
            "avg_demand", F.col("annual_demand").cast("double") / F.col("_days").cast("double")
        ).drop("_days")
    ss = safety_stock(F.col("demand_std"), lead_time_days)
    reorder_point = F.col("avg_demand") * F.lit(float(lead_time_days)) + F.col("safety_stock")
    reorder = F.col("current_inventory") <= F.col("reorder_point")
    return (
        classified.withColumn("safety_stock", ss)
        .withColumn("reorder_point", reorder_point)
        .withColumn("recommendation", F.when(reorder, "Reorder now").otherwise("Inventory healthy"))
        .withColumn(
            "recommended_order_qty",
            F.when(reorder, eoq(F.col("annual_demand"), ordering_cost, holding_cost)).otherwise(F.lit(0.0)),
        )
        .select(*INVENTORY_COLUMNS)
    )


def inventory_kpis(recommendations: DataFrame) -> DataFrame:
    """A13 + P6: reorder count, total suggested quantity, mean safety stock and reorder point."""

    return recommendations.agg(
        F.count_if(F.col("recommendation") == "Reorder now").alias("reorder_now"),
        F.sum("recommended_order_qty").alias("total_suggested_qty"),
        F.avg("safety_stock").alias("avg_safety_stock"),
        F.avg("reorder_point").alias("avg_reorder_point"),
    )
