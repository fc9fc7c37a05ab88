"""Dashboard aggregates and helpers: A7-A14, P3-P7, P10, P24, T2-T4, U1-U3.

Each is a plain DataFrame plan; filters come first so Catalyst pushes them to
the scans, and aggregates run partial + final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stockroom.functions.ordered import with_global_order

ALL = "All"


def apply_global_filters(df: DataFrame, sku: str = ALL, region: str = ALL) -> DataFrame:
    """P3 + P4: equality filters, applied only when the choice is not "All"."""

    if sku != ALL and "sku" in df.columns:
        df = df.where(F.col("sku") == F.lit(sku))
    if region != ALL and "region" in df.columns:
        df = df.where(F.col("region") == F.lit(region))
    return df


def filter_members(df: DataFrame, key: str, members) -> DataFrame:
    """P5: membership filter.  ``members`` is a DataFrame of keys or a Python list of any
    length, which becomes one; either way a ``left_semi`` join."""

    if not isinstance(members, DataFrame):
        field = StructField(key, df.schema[key].dataType)
        members = df.sparkSession.createDataFrame([(member,) for member in members], StructType([field]))
    keys = members.select(F.col(members.columns[0]).alias(key)).distinct()
    return df.join(keys, key, "left_semi").select(*df.columns)


def sorted_distinct(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values (sort only at the sink)."""

    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def regions_for_sku(df: DataFrame, sku: str) -> DataFrame:
    """Regions with history for one sku."""

    return sorted_distinct(df.where(F.col("sku") == F.lit(sku)), "region")


def executive_kpis(tx: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """Revenue, units, distinct customers, mean discount (one row)."""

    customers = F.count_distinct("customer_id") if exact_distinct else F.approx_count_distinct("customer_id")
    return tx.agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("revenue"),
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("units"),
        customers.alias("customers"),
        (F.sum("discount_pct").cast("double") / F.count("discount_pct").cast("double")).alias("avg_discount"),
    )


def revenue_trend(tx: DataFrame) -> DataFrame:
    """Revenue and quantity per day."""

    return tx.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("bigint").alias("quantity")
    )


def revenue_by_region(tx: DataFrame) -> DataFrame:
    """Revenue and quantity per region."""

    return tx.where(F.col("region").isNotNull()).groupBy("region").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").cast("bigint").alias("quantity")
    )


def with_grand_total(df: DataFrame, value: str, out: str = "total") -> DataFrame:
    """Attach the grand total of ``value`` to every row.

    The total is a global aggregate (exactly one row), broadcast on a constant
    key: no single-partition window, no pair explosion.
    """

    total = df.agg(F.sum(value).alias(out)).withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").drop("__one")


def sku_volume_mix(tx: DataFrame) -> DataFrame:
    """A10: quantity per sku and its share of the total."""

    per_sku = tx.where(F.col("sku").isNotNull()).groupBy("sku").agg(F.sum("quantity").cast("bigint").alias("quantity"))
    return with_grand_total(per_sku, "quantity", "__total").select(
        "sku", "quantity", (F.col("quantity").cast("double") / F.col("__total").cast("double")).alias("share")
    )


def overview_grouping_sets(tx: DataFrame) -> DataFrame:
    """A8-A10 in one pass with GROUPING SETS (date), (region), (sku).

    ``level`` tells which set a row belongs to; one scan and one shuffle
    instead of three.  Rows without a date (region, sku) are left out of that set, as in A8-A10.
    """

    levels = {3: "date", 5: "region", 6: "sku"}  # bits of the columns that a set leaves out
    sets = tx.groupingSets([["date"], ["region"], ["sku"]], "date", "region", "sku").agg(
        F.sum("revenue").cast("double").alias("revenue"),
        F.sum("quantity").cast("bigint").alias("quantity"),
        F.grouping_id().alias("gid"),
    )
    named = sets.withColumn("level", F.element_at(F.create_map(*(F.lit(x) for pair in levels.items() for x in pair)), F.col("gid").cast("int")))
    return named.where(F.coalesce(*(F.when(F.col("level") == c, F.col(c).isNotNull()) for c in levels.values()))).drop("gid")


def segment_profile(labelled: DataFrame, segment_col: str = "segment_id") -> DataFrame:
    """Per segment count and mean recency, frequency, monetary, churn
    (noise label -1 stays a segment); sort by size at the sink."""

    return labelled.groupBy(segment_col).agg(
        F.count("customer_id").alias("customers"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary").alias("avg_monetary"),
        F.avg("churn_label").alias("avg_churn"),
    )


def customer_kpis(
    customers: DataFrame, assignments: DataFrame | None = None, segment_col: str = "segment_id", extra: list[Column] | None = None
) -> DataFrame:
    """A12 (+ J2): customers, mean monetary, mean RFM, distinct segments."""

    df = customers
    if assignments is not None:
        df = customers.join(assignments.select("customer_id", segment_col), "customer_id", "left")
    return df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("monetary").alias("avg_monetary"),
        F.avg("rfm_score").alias("avg_rfm"),
        F.count_distinct(segment_col).alias("segments"),
        *(extra or []),
    )


def bubble_size(rfm: Column) -> Column:
    """clip(fillna(rfm, 1), 1)."""

    return F.greatest(F.coalesce(rfm, F.lit(1)), F.lit(1))


def time_split(df: DataFrame, cutoff, date_col: str = "date") -> tuple[DataFrame, DataFrame]:
    """(date <= cutoff, date > cutoff)."""

    c = F.lit(cutoff)
    return df.where(F.col(date_col) <= c), df.where(F.col(date_col) > c)


def history_forecast_union(history: DataFrame, forecast: DataFrame, keys=("sku", "region")) -> DataFrame:
    """History (quantity) and forecast (daily_forecast) stacked with a series tag."""

    h = history.select(*keys, "date", F.col("quantity").cast("double").alias("value"), F.lit("Historical Demand").alias("series"))
    f = forecast.select(*keys, "date", F.col("daily_forecast").cast("double").alias("value"), F.lit("Forecasted Demand").alias("series"))
    return h.unionByName(f)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """``orderBy(...).limit(k)`` (planned as TakeOrderedAndProject: each
    task keeps k rows, the driver merges at most k x tasks)."""

    return df.orderBy(*order).limit(k)


def arg_max_row(df: DataFrame, group_cols: list[str], score: str, ordinal: str, payload: list[str]) -> DataFrame:
    """T4: per group, the row with the highest score; first ordinal wins ties."""

    best = F.max_by(F.struct(*[F.col(c) for c in [score, ordinal, *payload]]), F.struct(F.col(score), -F.col(ordinal)))
    out = df.groupBy(*group_cols).agg(best.alias("__best"))
    return out.select(*group_cols, *[F.col(f"__best.{c}").alias(c) for c in [score, ordinal, *payload]])


def chunked(df: DataFrame, size: int, partition_by: list[str], order_by: list[str], out: str = "batch_id") -> DataFrame:
    """P10: batch id ``floor((row_number - 1) / size)`` within each partition key.

    Row numbers come from the range-parallel global order on (partition key,
    order key), so a key holding a third of all rows is still split over many
    tasks; the per-key start offset is a small aggregate joined back.
    """

    order = [F.col(c).asc() for c in partition_by + order_by]
    ranked = with_global_order(df, order, row_number_col="__grn")
    starts = ranked.groupBy(*partition_by).agg(F.min("__grn").alias("__start"))
    return (
        ranked.join(starts, partition_by)
        .withColumn(out, F.floor((F.col("__grn") - F.col("__start")) / F.lit(size)).cast("bigint"))
        .drop("__grn", "__start")
    )
