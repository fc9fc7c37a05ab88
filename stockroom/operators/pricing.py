"""Price elasticity and what-if pricing: P11, P12, M18-M22, J6, T4, W9.

* M18 (default, the path the reference ships): one log-log OLS slope of
  ``log1p(quantity)`` on ``log(max(price, 0.01))``, via ``regr_slope`` (one
  aggregate).  A per-sku version groups first.
* M19 (double ML): residualise quantity and price on the confounders with
  cross-fitted OLS (fold by the md5 of the row key), then the slope of the
  residuals.  Reported both as a level effect (units per currency unit, what
  the reference calls elasticity) and as an elasticity at the means.
* M20 (backdoor): price coefficient of OLS quantity ~ price + confounders.
  M19 and M20 read the data once: sums of products per fold give every training fit
  (all folds less one) and the slope of the residuals.
* M21/M22: what-if demand and the revenue-maximising price on a fixed grid of
  8 factors, for every sku at once (grid broadcast: 8 rows).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockroom.functions import ols as _ols
from stockroom.functions.scalar import log_price, log_quantity

# The reference's grid is linspace(0.85, 1.20, 8); written as
# 0.85 + 0.05 * i so that the factor 1.10 is exact.
GRID_FACTORS = [0.85 + 0.05 * i for i in range(8)]
CONFOUNDERS = ["promotion_flag", "weather_index", "is_holiday"]


PRICE_COLUMNS = ("unit_price", "avg_price")


def resolve_price_column(df: DataFrame) -> str:
    """The first of ``PRICE_COLUMNS`` that ``df`` has."""

    found = next(filter(df.columns.__contains__, PRICE_COLUMNS), None)
    if found is None:
        raise KeyError(f"no price column: {' or '.join(PRICE_COLUMNS)} is needed, got {df.columns}")
    return found


def elasticity_loglog(ts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Log-log OLS slope (one row, or one row per ``by`` group)."""

    price = resolve_price_column(ts)
    slope = F.regr_slope(log_quantity("quantity"), log_price(price)).alias("price_elasticity")
    n = F.count(F.lit(1)).alias("observations")
    return ts.groupBy(*by).agg(slope, n) if by else ts.agg(slope, n)


def _fold(key_cols: list[str], folds: int, seed: int):
    key = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in key_cols), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def _effect(spark, slope: float | None, total) -> DataFrame:
    """One row: level effect, means of price and quantity, elasticity at the means."""

    n, price, quantity = (float(total[0, j]) for j in (0, -2, -1)) if total is not None else (0.0, 0.0, 0.0)
    means = (price / n, quantity / n) if n else (None, None)
    at_means = slope * means[0] / means[1] if slope is not None and means[1] else None
    return spark.createDataFrame([(slope, *means, at_means)], "level_effect double, mean_price double, mean_quantity double, price_elasticity double")


def elasticity_dml(ts: DataFrame, confounders: list[str] | None = None, key_cols=("date", "sku", "region"), folds: int = 2, seed: int = 42) -> DataFrame:
    """Partialling-out estimate with K-fold cross-fitting (OLS nuisance models).

    Rows with a null in a used column are left out; without variation of the price residual the effect is null.
    """

    xs = [c for c in (confounders or CONFOUNDERS) if c in ts.columns]
    grams = _ols.gram_matrices(ts, [*xs, resolve_price_column(ts), "quantity"], _fold(list(key_cols), folds, seed))
    if not grams:
        return _effect(ts.sparkSession, None, None)
    total = sum(grams.values())
    on, price, quantity = list(range(1 + len(xs))), len(total) - 2, len(total) - 1
    sums = 0.0  # sums of products of (1, price residual, quantity residual) over held-out folds
    for held in grams.values():
        train = total - held
        rows = np.zeros((3, len(total)))
        rows[0, 0] = 1.0
        rows[1], rows[2] = (_ols.partial_out(train, target, on) for target in (price, quantity))
        sums = sums + rows @ held @ rows.T
    spread = sums[1, 1] - sums[0, 1] ** 2 / sums[0, 0]
    slope = (sums[1, 2] - sums[0, 1] * sums[0, 2] / sums[0, 0]) / spread if spread > 0 else None
    return _effect(ts.sparkSession, None if slope is None else float(slope), total)


def elasticity_backdoor(ts: DataFrame, confounders: list[str] | None = None) -> DataFrame:
    """Coefficient of price in OLS quantity ~ price + confounders (level effect); nulls as in M19."""

    xs = [c for c in (confounders or CONFOUNDERS) if c in ts.columns]
    total = _ols.gram_matrices(ts, [*xs, resolve_price_column(ts), "quantity"]).get(0)
    if total is None:
        return _effect(ts.sparkSession, None, None)
    rest = _ols.partial_out(total, len(total) - 2, list(range(1 + len(xs))))  # price less what the confounders tell
    spread = float(rest @ total @ rest)
    slope = float(rest @ total[:, -1]) / spread if spread > 0 else None
    return _effect(ts.sparkSession, slope, total)


def tail_baseline(ts: DataFrame, n: int = 7) -> DataFrame:
    """W9 for the what-if lab: per sku, mean ``avg_price`` and ``quantity`` of
    the last ``n`` rows in (sku, region, date) order, i.e. the last days of the
    alphabetically last region, as in the reference.

    ``row_number <= n`` is planned with a WindowGroupLimit, which keeps only
    ``n`` rows per sku in every map task before the shuffle.
    """

    w = Window.partitionBy("sku").orderBy(F.col("region").desc(), F.col("date").desc())
    last = ts.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return last.groupBy("sku").agg(
        F.avg(F.col("avg_price").cast("double")).alias("base_price"), F.avg(F.col("quantity").cast("double")).alias("baseline_demand")
    )


def simulate(baseline: DataFrame, elasticity, candidate_col: str = "candidate_price") -> DataFrame:
    """Expected demand = baseline * (1 + e * (c - b) / max(b, 0.01)), clipped at 0."""

    e = F.lit(float(elasticity)) if isinstance(elasticity, (int, float)) else elasticity
    ratio = (F.col(candidate_col) - F.col("base_price")) / F.greatest(F.col("base_price"), F.lit(0.01))
    demand = F.greatest(F.col("baseline_demand") * (F.lit(1.0) + e * ratio), F.lit(0.0))
    return baseline.withColumns(
        {"expected_demand": demand, "price_elasticity": e}
    ).withColumn("expected_revenue", F.col("expected_demand") * F.col(candidate_col))


def price_grid(baseline: DataFrame, factors=GRID_FACTORS) -> DataFrame:
    """Every sku x every grid factor, by exploding a literal 8-element array
    (no join; the grid is part of the plan)."""

    grid = F.array(*[F.struct(F.lit(i).alias("grid_index"), F.lit(float(f)).alias("factor")) for i, f in enumerate(factors)])
    return (
        baseline.withColumn("__g", F.explode(grid))
        .select("*", "__g.grid_index", "__g.factor")
        .drop("__g")
        .withColumn("candidate_price", F.col("base_price") * F.col("factor"))
    )


def what_if_grid(ts: DataFrame, elasticity, factors=GRID_FACTORS) -> DataFrame:
    """M21 over all skus x grid candidates; ``ts`` needs date, sku, region, quantity and avg_price only."""

    return simulate(price_grid(tail_baseline(ts), factors), elasticity)


def recommend_price(ts: DataFrame, elasticity, factors=GRID_FACTORS) -> DataFrame:
    """Per sku, the grid candidate with the highest expected revenue (first on ties, T4).

    ``factors`` is the caller's grid, as multiples of the base price.
    """

    s = what_if_grid(ts, elasticity, factors)
    best = F.max_by(
        F.struct("candidate_price", "expected_demand", "expected_revenue", "grid_index"),
        F.struct(F.col("expected_revenue"), -F.col("grid_index")),
    )
    return s.groupBy("sku", "base_price", "price_elasticity").agg(best.alias("b")).select(
        "sku", "base_price", "b.candidate_price", "b.expected_demand", "b.expected_revenue", "price_elasticity"
    )
