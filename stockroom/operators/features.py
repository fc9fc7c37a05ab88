"""Feature tables: A1-A4, W1-W3, P13-P17, J3, J5, J9.

``time_series_features``: daily (date, sku, region) rollup with rolling means,
lags and calendar flags.  All window columns share one partition/order spec,
so Spark plans a single shuffle + sort for the whole set.

``customer_features``: one row per customer (RFM, tenure, velocity, one-hot
region/channel).  The quartile scores compare with the customers at three ranks of
each order, found by histogram refinement; nothing is sorted.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom.functions.scalar import calendar_columns, one_hot, per_clipped
from stockroom.functions.selection import select_ranks
from stockroom.session import ScratchTable, checked_broadcast
from stockroom.sources.tables import tie_columns

ROLLING_WINDOWS = (7, 14, 30)
LAGS = (1, 7, 14)
MOST_CATEGORIES = 2_000  # dummy columns of one feature; Spark hardly plans wider tables

# National fixed-date holidays of the default country (IN),
# as (month, day, name).  Movable feasts need a calendar table from the user.
DEFAULT_HOLIDAYS_IN = [
    (1, 26, "Republic Day"),
    (8, 15, "Independence Day"),
    (10, 2, "Gandhi Jayanti"),
]


def _mean(c: str | Column) -> Column:
    """Mean as one exact sum cast to double, divided by the count (order-free)."""

    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def daily_rollup(tx: DataFrame) -> DataFrame:
    """A1: (date, sku, region) -> quantity, revenue, avg_price, promotion_flag, weather_index.

    Null keys are left out (pandas ``groupby`` drops them).  Partial aggregation
    happens map-side, so the shuffle carries one row per key and map task.
    """

    return (
        tx.where(F.col("date").isNotNull() & F.col("sku").isNotNull() & F.col("region").isNotNull())
        .groupBy("date", "sku", "region")
        .agg(
            F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("quantity"),
            F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"),
            _mean("unit_price").alias("avg_price"),
            F.max("promotion_flag").alias("promotion_flag"),
            _mean("weather_index").alias("weather_index"),
        )
    )


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int, holidays=DEFAULT_HOLIDAYS_IN, country: str = "IN") -> DataFrame:
    """P14 dimension (country, date, name) for fixed-date holidays; 3 rows per year."""

    rows = [
        (country, _dt.date(y, m, d), name)
        for y in range(first_year, last_year + 1)
        for (m, d, name) in holidays
    ]
    return spark.createDataFrame(rows, "country string, date date, name string")


def holiday_flag_expr(d: Column, holidays=DEFAULT_HOLIDAYS_IN) -> Column:
    """P14 without a join: 1 when (month, day) is a fixed-date holiday."""

    md = F.month(d) * 100 + F.dayofmonth(d)
    return F.when(md.isin([m * 100 + dd for (m, dd, _) in holidays]), 1).otherwise(0)


def add_holiday_flag(df: DataFrame, holidays: DataFrame | None = None, date_col: str = "date", out: str = "is_holiday") -> DataFrame:
    """``is_holiday`` by a left join to a holiday dimension.

    The dimension is broadcast only after a bounded row count proves it small;
    without one, the fixed-date rule is applied as a column expression.
    """

    if holidays is None:
        return df.withColumn(out, holiday_flag_expr(F.col(date_col)))
    dim = checked_broadcast(holidays.select(F.col("date").alias("__hday")).distinct())
    return (
        df.join(dim, F.col(date_col) == F.col("__hday"), "left")
        .withColumn(out, F.when(F.col("__hday").isNotNull(), 1).otherwise(0))
        .drop("__hday")
    )


def with_rolling_and_lags(
    daily: DataFrame, keys=("sku", "region"), order: str = "date", windows=ROLLING_WINDOWS, lags=LAGS, calendar: bool = False
) -> DataFrame:
    """W1 + W2: rolling means (min_periods 1) and lags (null -> 0).

    The default frame counts rows, as the reference does (gaps in a series are
    skipped).  ``calendar=True`` uses a frame of ``n`` calendar days instead
    (``rangeBetween`` on the day number), which is what a 7-day mean usually means.
    """

    w = Window.partitionBy(*keys).orderBy(order)
    day_w = Window.partitionBy(*keys).orderBy(F.datediff(F.col(order), F.lit("1970-01-01")))
    cols: dict[str, Column] = {}
    for n in windows:
        frame = day_w.rangeBetween(-(n - 1), 0) if calendar else w.rowsBetween(-(n - 1), Window.currentRow)
        cnt = F.count(F.lit(1)).over(frame).cast("double")
        cols[f"rolling_qty_{n}"] = F.sum("quantity").over(frame).cast("double") / cnt
        cols[f"rolling_revenue_{n}"] = F.sum("revenue").over(frame).cast("double") / cnt
    for n in lags:
        cols[f"lag_qty_{n}"] = F.coalesce(F.lag("quantity", n).over(w).cast("double"), F.lit(0.0))
        cols[f"lag_revenue_{n}"] = F.coalesce(F.lag("revenue", n).over(w).cast("double"), F.lit(0.0))
    return daily.withColumns(cols)


TS_COLUMNS = (
    ["date", "sku", "region", "quantity", "revenue", "avg_price", "promotion_flag", "weather_index"]
    + [f"rolling_{m}_{n}" for n in ROLLING_WINDOWS for m in ("qty", "revenue")]
    + [f"lag_{m}_{n}" for n in LAGS for m in ("qty", "revenue")]
    + ["day_of_week", "week_of_year", "month", "quarter", "is_weekend", "is_holiday"]
)


def time_series_features(tx: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """The 26-column daily sku x region feature table."""

    daily = with_rolling_and_lags(daily_rollup(tx))
    daily = daily.withColumns(calendar_columns(F.col("date")))
    daily = add_holiday_flag(daily, holidays)
    return daily.withColumn("revenue", F.col("revenue").cast("double")).select(*TS_COLUMNS)


def _last_order(by: str, tx: DataFrame | None = None) -> Column:
    ties = [F.col(c) for c in tie_columns(tx)]
    if by == "sku":  # reference meaning: frame sorted by (sku, date), then file order
        return F.struct(F.col("sku"), F.col("date"), *ties)
    if by == "date":
        return F.struct(F.col("date"), *ties)
    raise ValueError("last_by must be 'sku' or 'date'")


def customer_rollup(tx: DataFrame, last_by: str = "sku") -> DataFrame:
    """A2 (+ J3 fused): one row per customer with first/last purchase dates."""

    order = _last_order(last_by, tx)
    return (
        tx.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.max("date").alias("last_purchase"),
            F.min("date").alias("first_purchase"),
            F.count(F.col("date")).alias("frequency"),
            F.coalesce(F.sum("revenue"), F.lit(0)).alias("monetary_exact"),
            _mean("revenue").alias("avg_order_value"),
            _mean("discount_pct").alias("avg_discount"),
            F.max("churned").alias("churn_label"),
            F.max_by(F.col("region"), F.when(F.col("region").isNotNull(), order)).alias("region"),
            F.max_by(F.col("channel"), F.when(F.col("channel").isNotNull(), order)).alias("preferred_channel"),
        )
    )


def snapshot_date(customers: DataFrame) -> _dt.date:
    """A3: max(date) + 1 day, as one scalar (read from the per-customer rollup)."""

    last = customers.agg(F.max("last_purchase")).first()[0]
    return last + _dt.timedelta(days=1)


def _vocabulary(df: DataFrame, col: str) -> list[str]:
    """The categories of a column, each of which becomes an output column; more than a table can hold are an error."""

    rows = df.where(F.col(col).isNotNull()).select(col).distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"{col} has more than {MOST_CATEGORIES} categories; give those that shall get a column")
    return sorted(r[0] for r in rows)


def rfm_scores(customers: DataFrame) -> DataFrame:
    """Add ``rfm_score``, the sum of the recency (descending), frequency and monetary quartile scores.

    ``rank(method='first', pct=True)`` cut at quartiles = ``ceil(4*rn/n)`` with
    ties in customer_id order.  Only the customers at three ranks of each order are
    looked for (``functions/selection.py``); every other customer compares with them.
    """

    n = customers.count()
    ranks = [quarter * n // 4 for quarter in (1, 2, 3)]
    orders = {
        "recency": F.coalesce(-F.col("recency"), F.lit(1)),  # recent last, unknown after them
        "frequency": F.col("frequency"),
        "monetary": F.col("monetary_exact"),
    }
    cuts = select_ranks(customers, orders, "customer_id", dict.fromkeys(orders, ranks), n)

    def score(name: str) -> Column:
        """1 plus the cuts a customer stands behind; a cut at rank 0 lies before all."""

        total = F.lit(1)
        for rank in ranks:
            if rank == 0:
                total = total + 1
            else:
                value, last = map(F.lit, cuts[name, rank])
                behind = (orders[name] > value) | ((orders[name] == value) & (F.col("customer_id") > last))
                total = total + behind.cast("int")
        return total

    return customers.withColumn("rfm_score", score("recency") + score("frequency") + score("monetary"))


def customer_features(
    tx: DataFrame,
    regions: list[str] | None = None,
    channels: list[str] | None = None,
    last_by: str = "sku",
    snapshot: _dt.date | None = None,
) -> DataFrame:
    """The per-customer feature table.

    The rollup is written once (it feeds the snapshot scalar, the quartile cuts
    and the vocabularies), so the fact table is scanned and shuffled once.
    """

    cust = ScratchTable(customer_rollup(tx, last_by), "customer-rollup").df
    snap = snapshot or snapshot_date(cust)
    snap_lit = F.lit(snap)
    cust = cust.withColumns(
        {
            "recency": F.datediff(snap_lit, F.col("last_purchase")),
            "tenure_days": F.datediff(snap_lit, F.col("first_purchase")),
        }
    )
    scored = rfm_scores(cust)
    regions = regions if regions is not None else _vocabulary(cust, "region")
    channels = channels if channels is not None else _vocabulary(cust, "preferred_channel")
    dummies = {**one_hot(F.col("region"), regions, "region"), **one_hot(F.col("preferred_channel"), channels, "preferred_channel")}
    base = scored.select(
        "customer_id",
        "frequency",
        F.col("monetary_exact").cast("double").alias("monetary"),
        "avg_order_value",
        "avg_discount",
        F.col("churn_label").cast("int").alias("churn_label"),
        F.col("recency").cast("int").alias("recency"),
        F.col("rfm_score").cast("int").alias("rfm_score"),
        F.col("tenure_days").cast("int").alias("tenure_days"),
        per_clipped(F.col("frequency"), F.col("tenure_days")).alias("purchase_velocity"),
        per_clipped(F.col("monetary_exact"), F.col("frequency")).alias("monetary_per_visit"),
        *[c.alias(n) for n, c in dummies.items()],
    )
    return base.fillna(0)
