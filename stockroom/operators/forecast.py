"""Demand forecasting: M1-M6, W7-W10, A14, A15, A19, U1.

Every function forecasts *all* (sku, region) series in one job; a single
series is a ``filter`` on the output.  Per-series work is bounded by the
series length (one row per calendar day), never by the fact table.

* M1 seasonal naive (the path the reference ships): the last 14 values,
  repeated cyclically over the horizon.
* M3 seasonal regression: per series, ridge OLS of ``log1p(y)`` on trend,
  weekly and yearly Fourier terms and the regressors, solved from one row of sums
  of products per series; forecast = ``expm1``, clipped at 0.
* M4 residual learner: one global linear autoregression on 14-lag windows of
  the M3 in-sample residuals (Spark ML), rolled out h steps with ``aggregate``.
  (The reference trains its residual net on raw quantity and adds it to the
  forecast, double counting the level; here it learns true residuals.)
* M5 naive MAPE of the lag-1 baseline on the last 14 points (reference meaning),
  plus ``backtest_mape`` for a true hold-out of the seasonal-naive model.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.session import ScratchTable, checked_broadcast

KEYS = ["sku", "region"]
SEASON = 14
EPS = float(np.finfo(np.float64).eps)


def last_n(ts: DataFrame, n: int, keys=KEYS, order: str = "date") -> DataFrame:
    """Last ``n`` rows per key (``rn`` = 1 is the latest); WindowGroupLimit keeps
    at most ``n`` rows per key and map task before the shuffle."""

    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return ts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def rolling_path_sums(df: DataFrame, value: str = "daily_forecast", keys=KEYS, order: str = "date") -> DataFrame:
    """Weekly (7) and monthly (30) rolling sums along the forecast path, partial at the start."""

    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns(
        {
            "weekly_forecast": F.sum(value).over(w.rowsBetween(-6, 0)),
            "monthly_forecast": F.sum(value).over(w.rowsBetween(-29, 0)),
        }
    )


def seasonal_naive(ts: DataFrame, horizon: int = 30, season: int = SEASON, keys=KEYS) -> DataFrame:
    """M1 (+ W7): daily/weekly/monthly forecast for every series.

    The last ``season`` values (by date) are gathered into an array of at most
    ``season`` elements per series; ``explode(sequence(1, h))`` builds the future
    and ``element_at(a, (i - 1) % size + 1)`` repeats the cycle, as NumPy's
    ``resize`` does.
    """

    recent = last_n(ts, season, keys)
    per = recent.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("date", F.col("quantity").cast("double").alias("q")))).alias("hist"),
        F.max("date").alias("last_date"),
    )
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    fut = per.select(*keys, "last_date", "hist", step).select(
        *keys,
        F.date_add("last_date", F.col("step")).alias("date"),
        F.element_at("hist", ((F.col("step") - 1) % F.size("hist")) + 1)["q"].alias("daily_forecast"),
    )
    return rolling_path_sums(fut, keys=keys)


def regressor_defaults(ts: DataFrame, n: int = 7, keys=KEYS) -> DataFrame:
    """M2: tail-7 mean price and weather, tail-7 mode of rounded promo (lowest on ties, A19), holiday 0."""

    tail = last_n(ts, n, keys)
    return tail.groupBy(*keys).agg(
        F.avg(F.col("avg_price").cast("double")).alias("avg_price"),
        F.avg(F.col("weather_index").cast("double")).alias("weather_index"),
        F.mode(F.round(F.col("promotion_flag")).cast("int"), True).alias("promotion_flag"),
        F.lit(0).alias("is_holiday"),
        F.max("date").alias("last_date"),
    )


def future_frame(ts: DataFrame, horizon: int = 30, keys=KEYS) -> DataFrame:
    """M2: one row per series and future day (max date + 1 ... + h) with the regressor defaults."""

    d = regressor_defaults(ts, keys=keys)
    return d.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn(
        "date", F.date_add("last_date", F.col("step"))
    ).drop("last_date")


def naive_mape(ts: DataFrame, holdout: int = SEASON, keys=KEYS) -> DataFrame:
    """M5 (W8 + W9 + A15): MAPE (%) of the lag-1 baseline, first value back-filled,
    on the last ``holdout`` points of each series.

    Only the last ``holdout + 1`` rows per series are needed: the extra row
    feeds the lag of the oldest hold-out point.
    """

    tail = last_n(ts, holdout + 1, keys)
    w = Window.partitionBy(*keys).orderBy("date")
    y = F.col("quantity").cast("double")
    b = F.coalesce(F.lag(y, 1).over(w), y)
    scored = tail.withColumn("__y", y).withColumn("__b", b).where(F.col("rn") <= holdout)
    ape = F.abs(F.col("__y") - F.col("__b")) / F.greatest(F.abs(F.col("__y")), F.lit(EPS))
    return scored.groupBy(*keys).agg((F.avg(ape) * 100).alias("mape"), F.count(F.lit(1)).alias("holdout_points"))


def backtest_mape(ts: DataFrame, horizon: int = SEASON, season: int = SEASON, keys=KEYS) -> DataFrame:
    """True hold-out MAPE of the seasonal-naive model: fit on all but the last
    ``horizon`` rows of each series, forecast them, compare by position."""

    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    ranked = ts.withColumn("__rn", F.row_number().over(w))
    train = ranked.where(F.col("__rn") > horizon).drop("__rn")
    test = ranked.where(F.col("__rn") <= horizon).withColumn(
        "step", F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    )
    fc = seasonal_naive(train, horizon, season, keys).withColumn(
        "step", F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    )
    j = test.join(fc.select(*keys, "step", "daily_forecast"), [*keys, "step"])
    y = F.col("quantity").cast("double")
    ape = F.abs(y - F.col("daily_forecast")) / F.greatest(F.abs(y), F.lit(EPS))
    return j.groupBy(*keys).agg((F.avg(ape) * 100).alias("backtest_mape"))


def sequence_windows(ts: DataFrame, length: int = SEASON, value: str = "quantity", keys=KEYS) -> DataFrame:
    """Supervised samples (previous ``length`` values -> next value); ``len - length`` per series."""

    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-length, -1)
    return (
        ts.withColumn("lags", F.collect_list(F.col(value)).over(w))
        .where(F.size("lags") == length)
        .select(*keys, "date", "lags", F.col(value).alias("target"))
    )


# ---- M3: seasonal regression per series ------------------------------------------------

REGRESSORS = ["avg_price", "weather_index", "promotion_flag", "is_holiday"]


def _terms(regressors: list[str], weekly: int, yearly: int) -> list[tuple[Column, bool]]:
    """(design column, whether it is a regressor) after the intercept; the first one is the day."""

    day = F.col("day").cast("double")
    waves = [(k, 7.0) for k in range(1, weekly + 1)] + [(k, 365.25) for k in range(1, yearly + 1)]
    seasons = [wave(day * F.lit(2 * math.pi * k / period)) for k, period in waves for wave in (F.sin, F.cos)]
    return [(day, False), *((c, False) for c in seasons), *((F.coalesce(F.col(c), F.lit(0.0)), True) for c in regressors)]


def series_coefficients(hist: DataFrame, terms: list[tuple[Column, bool]], ridge: float, keys=KEYS) -> DataFrame:
    """(keys, coefficients): ridge fit of ``y`` on 1 and ``terms`` per series.

    A series is one row of sums of products (partial sums per task, so a long one spans
    tasks); all its fits are solved from them in batches.  The penalty is on the day scaled to 0..1 and
    on standardised regressors, as sums of products can be rescaled: with columns x = T z it is
    the same fit, so coefficients come back for the columns as they are.
    """

    cells = [F.lit(1.0), *(c for c, _ in terms), F.col("y")]
    size = len(terms) + 1
    places = [(i, j) for i in range(size) for j in range(i, size + 1)]
    sums = hist.groupBy(*keys).agg(F.array(*(F.sum(cells[i] * cells[j]) for i, j in places)).alias("sums"), F.min("day").cast("double").alias("first"), F.max("day").cast("double").alias("last"))
    regressor = [n + 1 for n, (_, is_regressor) in enumerate(terms) if is_regressor]

    def solve(batches):
        for batch in batches:
            flat = np.array(batch.column("sums").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
            first, last = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            gram, target = np.zeros((len(flat), size, size)), np.zeros((len(flat), size))
            for n, (i, j) in enumerate(places):
                if j == size:
                    target[:, i] = flat[:, n]
                else:
                    gram[:, i, j] = gram[:, j, i] = flat[:, n]
            # z = (x - shift) / spread, written as rows of T over (1, x)
            shift, spread = np.zeros((len(flat), size)), np.ones((len(flat), size))
            shift[:, 1], spread[:, 1] = first, np.maximum(last - first, 1.0)
            for n in regressor:
                shift[:, n] = gram[:, 0, n] / gram[:, 0, 0]
                variance = gram[:, n, n] / gram[:, 0, 0] - shift[:, n] ** 2
                spread[:, n] = np.where(variance > 1e-12 * np.maximum(1.0, shift[:, n] ** 2), np.sqrt(np.maximum(variance, 0)), 1.0)
            to_z = np.zeros_like(gram)
            diagonal = np.arange(1, size)
            to_z[:, 0, 0] = 1.0
            to_z[:, diagonal, diagonal] = 1 / spread[:, 1:]
            to_z[:, 1:, 0] = -shift[:, 1:] / spread[:, 1:]
            inner = to_z @ gram @ to_z.transpose(0, 2, 1)
            inner[:, diagonal, diagonal] += ridge
            right = (to_z @ target[:, :, None])
            # a series too short for its terms has a singular matrix without a penalty: least norm
            beta = np.linalg.pinv(inner, hermitian=True) @ right
            found = (to_z.transpose(0, 2, 1) @ beta)[:, :, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(list(found), pa.list_(pa.float64()))], names=[*keys, "coefficients"])

    kinds = {f.name: f.dataType.simpleString() for f in hist.schema.fields}
    return sums.mapInArrow(solve, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", coefficients array<double>")


def seasonal_regression(ts: DataFrame, horizon: int = 30, ridge: float = 1.0, keys=KEYS, regressors=REGRESSORS, weekly: int = 3, yearly: int = 2) -> DataFrame:
    """M3: fitted values for the history and forecasts for the horizon, per series.

    log(1 + quantity) on a trend, ``weekly`` and ``yearly`` pairs of waves and the regressors (null: 0).
    Output: keys, date, kind ('fit' | 'forecast'), quantity (history only), yhat (0 at least; null
    where a series has no quantity at all).
    """

    keys, regressors = list(keys), list(regressors)
    columns = [F.col(c).cast("double").alias(c) for c in regressors]
    hist = ts.select(*keys, "date", F.col("quantity").cast("double").alias("quantity"), *columns)
    fut = future_frame(ts, horizon, keys).select(*keys, "date", F.lit(None).cast("double").alias("quantity"), *columns)
    both = hist.unionByName(fut).withColumn("day", F.datediff("date", F.lit("1970-01-01")).cast("double"))
    terms = _terms(regressors, weekly, yearly)
    known = both.where("quantity is not null").withColumn("y", F.log1p(F.greatest("quantity", F.lit(0.0))))
    fits = checked_broadcast(ScratchTable(series_coefficients(known, terms, ridge, keys), "series-fits").df)
    fitted = F.col("coefficients")[0] + sum(F.col("coefficients")[n + 1] * c for n, (c, _) in enumerate(terms))
    yhat = F.greatest(F.expm1(fitted), F.lit(0.0))
    kind = F.when(F.col("quantity").isNotNull(), "fit").otherwise("forecast")
    return both.join(fits, keys, "left").select(*keys, "date", kind.alias("kind"), "quantity", F.when(F.col("coefficients").isNotNull(), yhat).alias("yhat"))


# ---- M4: global residual autoregression --------------------------------------------------

def residual_hybrid(ts: DataFrame, horizon: int = 30, lags: int = SEASON, keys=KEYS, max_iter: int = 50) -> DataFrame:
    """M4: M3 forecast + h-step roll-out of a global linear AR model on residuals.

    Training samples are 14-lag windows of in-sample residuals from every
    series (W10), fitted by ``pyspark.ml`` LinearRegression (distributed).  The
    roll-out is a SQL ``aggregate`` over ``sequence(1, h)`` carrying the last
    14 residuals, so it runs per row in the JVM.  ``residual_used`` is false where
    a series has fewer residuals than that, or no series has a window: there the forecast is M3's.
    """

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    m3 = seasonal_regression(ts, horizon, keys=keys)
    m3 = ScratchTable(m3, "series-regression").df
    resid = m3.where(F.col("kind") == "fit").withColumn("resid", F.col("quantity") - F.col("yhat"))
    samples = sequence_windows(resid.withColumnRenamed("resid", "r"), lags, "r", keys)
    lag_cols = [F.col("lags")[i].alias(f"l{i}") for i in range(lags)]
    flat = samples.select(*lag_cols, F.col("target").alias("label"))
    assembler = VectorAssembler(inputCols=[f"l{i}" for i in range(lags)], outputCol="features")
    learned = not flat.isEmpty()  # the penalty makes the system solvable from one window on
    if not learned:
        coef, intercept = [0.0] * lags, 0.0
    else:
        model = LinearRegression(solver="normal", maxIter=max_iter, regParam=0.01, elasticNetParam=0.0).fit(assembler.transform(flat))
        coef, intercept = [float(c) for c in model.coefficients], float(model.intercept)

    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    last = resid.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= lags)
    state = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "resid"))).alias("s"))
    state = state.select(*keys, F.transform("s", lambda x: x["resid"]).alias("s")).where(F.size("s") == lags)

    coefs = F.array(*[F.lit(c) for c in coef])

    def step(acc: Column, _i: Column) -> Column:
        nxt = F.aggregate(F.zip_with(acc["s"], coefs, lambda a, b: a * b), F.lit(intercept), lambda a, x: a + x)
        return F.struct(F.concat(F.slice(acc["s"], 2, lags - 1), F.array(nxt)).alias("s"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    init = F.struct(F.col("s").alias("s"), F.array().cast("array<double>").alias("out"))
    rolled = state.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step)["out"].alias("res_path"))
    fc = m3.where(F.col("kind") == "forecast").withColumn(
        "step", F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    )
    out = fc.join(rolled, keys, "left").select(
        *keys,
        "date",
        F.greatest(F.col("yhat") + F.coalesce(F.element_at("res_path", F.col("step")), F.lit(0.0)), F.lit(0.0)).alias("daily_forecast"),
        (F.lit(learned) & F.col("res_path").isNotNull()).alias("residual_used"),
    )
    return rolling_path_sums(out, keys=keys)


def forecast_kpis(ts: DataFrame, forecast: DataFrame, keys=KEYS) -> DataFrame:
    """Last observed demand, mean of the first 7 forecast days, last monthly forecast."""

    last_obs = ts.groupBy(*keys).agg(F.max_by(F.col("quantity"), F.col("date")).cast("double").alias("last_observed_demand"))
    w = Window.partitionBy(*keys).orderBy("date")
    f = forecast.withColumn("__step", F.row_number().over(w))
    fk = f.groupBy(*keys).agg(
        F.avg(F.when(F.col("__step") <= 7, F.col("daily_forecast"))).alias("avg_next_7_days"),
        F.max_by(F.col("monthly_forecast"), F.col("date")).alias("total_month"),
    )
    return last_obs.join(fk, list(keys))
