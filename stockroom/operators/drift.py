"""Drift: A16, A17, W11, M25-M27, M29, P23, P26, V6.

PSI follows the reference formula: breakpoints = distinct linear-interpolated
deciles of the *reference* column; histogram bins ``[b_i, b_i+1)`` with the
last bin closed; values outside the range are dropped; empty bins count
1e-6; no renormalising; denominators are in-range counts.

All of them are read off counts of distinct values (``functions/value_counts.py``): many
columns go through one aggregate and one ordered pass, and a value that many rows share
is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.functions import value_counts as vc
from stockroom.functions.scalar import retrain_decision
from stockroom.session import ScratchTable, checkpointed

EMPTY_BIN = 1e-6
# Fixed monitoring limits (metric, threshold, direction: alert when value is
# below ("min") or above ("max") the threshold).
MONITOR_LIMITS = [
    ("Churn AUC", 0.90, "min"),
    ("PSI", 0.20, "max"),
    ("Demand MAPE", 10.0, "max"),
    ("API Latency (s)", 1.50, "max"),
]


def quantile_breakpoints(df: DataFrame, col: str, bins: int = 10) -> list[float]:
    """Distinct, sorted linear-interpolated quantiles of ``col`` (null and NaN left out)."""

    row = vc.breakpoints(vc.running_counts(vc.value_counts(df, df.limit(0), [col])), bins).first()
    return list(row.breakpoints) if row else []


def psi_rows(running: DataFrame, bins: int = 10) -> DataFrame:
    """(column, psi, bins_used) of every column with a reference value, from its running counts.

    Fewer than two bins give 0.
    """

    edges = ScratchTable(vc.breakpoints(running, bins), "psi-edges").df
    whole = Window.partitionBy("column")  # ``bins`` rows a column

    def share(side: str) -> Column:
        n, total = F.col(side).cast("double"), F.sum(side).over(whole).cast("double")
        return F.when(F.col(side) == 0, F.lit(EMPTY_BIN)).otherwise(n / total)

    shares = vc.histogram(running, edges).select("column", "bin", share("ref").alias("r"), share("cur").alias("c"))
    terms = shares.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("bin", ((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("term")))).alias("terms"))
    summed = terms.select("column", F.aggregate("terms", F.lit(0.0), lambda total, t: total + t.term).alias("sum"), F.size("terms").alias("used"))
    some = F.col("used") > 1
    joined = edges.join(summed, "column", "left")
    return joined.select("column", F.when(some, F.col("sum")).otherwise(0.0).alias("psi"), F.greatest(F.size("breakpoints") - 1, F.lit(0)).alias("bins_used"))


def calculate_psi(reference: DataFrame, current: DataFrame, ref_col: str, cur_col: str | None = None, bins: int = 10) -> float:
    """Population stability index of one column (one float); 0 without a reference value."""

    sides = [df.select(F.col(c).alias("value")) for df, c in ((reference, ref_col), (current, cur_col or ref_col))]
    row = psi_rows(vc.running_counts(vc.value_counts(*sides, ["value"])), bins).first()
    return float(row.psi) if row else 0.0


def psi_of_pairs(pairs: DataFrame, ref_col: str, cur_col: str, bins: int = 10) -> DataFrame:
    """M25 on aligned columns of one frame, as a one-row DataFrame (psi, bins_used)."""

    running = vc.running_counts(vc.paired_value_counts(pairs, {"value": (ref_col, cur_col)}))
    found = psi_rows(running, bins).agg(F.max("psi").alias("psi"), F.max("bins_used").alias("bins_used"))  # one row at most before it
    return found.select(F.coalesce("psi", F.lit(0.0)).alias("psi"), F.coalesce("bins_used", F.lit(0)).alias("bins_used"))


def median_transaction_date(tx: DataFrame, date_col: str = "date", count_col: str | None = None):
    """The date at position n//2 of the sorted transaction dates.

    Counts per date (one row per calendar day), a running sum over that small
    frame, and the first date whose cumulative count exceeds n//2.
    ``count_col`` lets a pre-aggregated frame (rows already counted) be used.
    """

    weight = F.col(count_col) if count_col else F.lit(1)
    per_day = tx.where(F.col(date_col).isNotNull()).groupBy(date_col).agg(F.sum(weight).alias("n"))
    w = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    cum = per_day.select(date_col, F.sum("n").over(w).alias("cum"), F.sum("n").over(everything).alias("total"))
    row = cum.where(F.col("cum") > F.floor(F.col("total") / 2)).agg(F.min(date_col)).first()
    return row[0]


def observed_drift_snapshot(tx: DataFrame, bins: int = 10) -> DataFrame:
    """Split at the median transaction date, monetary per customer on each
    side (A2 on each half), keep customers present on both sides (J4 / U2) and
    compute the PSI of monetary.

    The fact table is read once: a (customer, day) pre-aggregate (checkpointed)
    feeds both the median date (W11, from per-day counts) and the two halves,
    which come from ONE conditional aggregate (no second scan, no join); its value counts
    also tell how many customers there are on both sides.
    """

    spark = tx.sparkSession
    per_cd = checkpointed(
        tx.where(F.col("date").isNotNull())
        .groupBy("customer_id", "date")
        .agg(F.sum("revenue").alias("rev"), F.count(F.lit(1)).alias("n"))
    )
    cutoff = median_transaction_date(per_cd, count_col="n")
    before = F.col("date") <= F.lit(cutoff)
    common = (
        per_cd.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.sum(F.when(before, F.col("rev"))).alias("ref_monetary"),
            F.sum(F.when(~before, F.col("rev"))).alias("cur_monetary"),
            F.sum(F.when(before, F.col("n")).otherwise(0)).alias("ref_n"),
            F.sum(F.when(~before, F.col("n")).otherwise(0)).alias("cur_n"),
        )
        .where((F.col("ref_n") > 0) & (F.col("cur_n") > 0))
    )
    running = vc.running_counts(vc.paired_value_counts(common, {"monetary": ("ref_monetary", "cur_monetary")}))
    n_common = running.agg(F.sum("ref")).first()[0] or 0
    iso = cutoff.isoformat() if cutoff is not None else "n/a"
    if n_common == 0:
        return spark.createDataFrame(
            [(cutoff, 0, 0.0, f"No overlapping customers found across split at {iso}")],
            "cutoff date, common_customers long, psi double, message string",
        )
    return psi_rows(running, bins).select(
        F.lit(cutoff).alias("cutoff"),
        F.lit(n_common).cast("bigint").alias("common_customers"),
        F.col("psi"),
        F.lit(f"Observed drift from prior vs recent customer windows split at {iso}").alias("message"),
    )


def stress_test_psi(customers: DataFrame, col: str = "monetary", factor: float = 1.05, bins: int = 10) -> DataFrame:
    """PSI of ``col`` against the same column scaled by ``factor`` on the reference side."""

    pairs = customers.select((F.col(col) * F.lit(factor)).alias("ref_value"), F.col(col).alias("cur_value"))
    return psi_of_pairs(pairs, "ref_value", "cur_value", bins)


def _report_rows(values: DataFrame, statistic: str, threshold: float | None) -> DataFrame:
    rows = values.select("column", F.lit("numeric").alias("kind"), F.lit(statistic).alias("statistic"), "value")
    return rows if threshold is None else rows.withColumn("drifted", F.coalesce(F.col("value") > F.lit(threshold), F.lit(False)))


def ks_statistics(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """M26 numeric part: two-sample Kolmogorov-Smirnov D = max |F_ref(x) - F_cur(x)| per column,
    from integer products of running counts; null where a side has no value."""

    return _report_rows(vc.ks_distance(vc.running_counts(vc.value_counts(reference, current, columns))), "ks", None)


def numeric_drift(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, psi_threshold: float = 0.2, ks_threshold: float = 0.1) -> DataFrame:
    """M26 PSI and KS rows (column, kind, statistic, value, drifted), both from one set of running counts."""

    running = vc.running_counts(vc.value_counts(reference, current, columns))
    psi = _report_rows(psi_rows(running, bins).withColumnRenamed("psi", "value"), "psi", psi_threshold)
    return psi.unionByName(_report_rows(vc.ks_distance(running), "ks", ks_threshold))


def categorical_drift(reference: DataFrame, current: DataFrame, columns: list[str], threshold: float = 0.1) -> DataFrame:
    """M26 categorical part: Jensen-Shannon divergence (log base 2) of category shares."""

    def counts(df, side):
        return df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cat")) for c in columns])).alias("kv")
        ).select("kv.column", "kv.cat").where(F.col("cat").isNotNull()).groupBy("column", "cat").agg(F.count(F.lit(1)).alias(side))

    j = counts(reference, "r").join(counts(current, "c"), ["column", "cat"], "full").fillna(0, ["r", "c"])
    tot = Window.partitionBy("column")
    p = F.col("r").cast("double") / F.sum("r").over(tot)
    q = F.col("c").cast("double") / F.sum("c").over(tot)
    m = (p + q) / 2

    def kl(a, b):
        return F.when(a > 0, a * F.log2(a / b)).otherwise(F.lit(0.0))

    js = j.select("column", (kl(p, m) / 2 + kl(q, m) / 2).alias("t")).groupBy("column").agg(F.sum("t").alias("value"))
    return js.select("column", F.lit("categorical").alias("kind"), F.lit("jensen_shannon").alias("statistic"), "value").withColumn(
        "drifted", F.col("value") > F.lit(threshold)
    )


def dataset_drift_report(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str] = (), ks_threshold: float = 0.1) -> DataFrame:
    """One table (column, kind, statistic, value, drifted) replacing the HTML report."""

    report = numeric_drift(reference, current, numeric, ks_threshold=ks_threshold)
    return report.unionByName(categorical_drift(reference, current, list(categorical))) if categorical else report


def threshold_status(metrics: DataFrame) -> DataFrame:
    """V6: ``alert`` when a 'min' metric is below, or a 'max' metric above, its threshold (strict)."""

    alert = ((F.col("direction") == "min") & (F.col("value") < F.col("threshold"))) | (
        (F.col("direction") == "max") & (F.col("value") > F.col("threshold"))
    )
    return metrics.withColumn("status", F.when(alert, "alert").otherwise("healthy"))


def monitoring_table(metric_values: DataFrame) -> DataFrame:
    """Join measured (metric, value) rows to the fixed limits and apply V6."""

    spark = metric_values.sparkSession
    limits = spark.createDataFrame(MONITOR_LIMITS, "metric string, threshold double, direction string")
    return threshold_status(metric_values.join(F.broadcast(limits), "metric"))


def retrain_policy(psi_mape: DataFrame, psi_col: str = "psi", mape_col: str = "mape") -> DataFrame:
    """Add ``should_retrain`` and ``reasons`` to rows of (psi, mape)."""

    return psi_mape.withColumns(retrain_decision(F.col(psi_col), F.col(mape_col)))
