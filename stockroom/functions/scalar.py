"""Column expressions for the reference's scalar rules (P-series).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
SERVICE_LEVEL_Z = 1.65
RETENTION_ACTIONS = [
    (0.8, "Offer high-touch retention call with premium discount"),
    (0.6, "Trigger personalized incentive campaign"),
    (0.4, "Send loyalty bundle recommendation"),
]
RETENTION_DEFAULT = "Maintain standard nurture sequence"
RETRAIN_PSI_THRESHOLD = 0.2
RETRAIN_MAPE_THRESHOLD = 15.0


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_iso_date(c: Column | str) -> Column:
    """Date -> 'yyyy-MM-dd'."""

    return F.date_format(col_(c), "yyyy-MM-dd")


def hash_pii(c: Column | str) -> Column:
    """SHA-256 hex of the UTF-8 text."""

    return F.sha2(col_(c).cast("string"), 256)


def log_quantity(q: Column | str) -> Column:
    """log1p(quantity)."""

    return F.log1p(col_(q).cast("double"))


def log_price(p: Column | str) -> Column:
    """log(max(price, 0.01))."""

    return F.log(F.greatest(col_(p).cast("double"), F.lit(0.01)))


def day_of_week(d: Column | str) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``, never ``dayofweek``)."""

    return F.weekday(col_(d))


def calendar_columns(d: Column | str) -> dict[str, Column]:
    """day_of_week, ISO week, month, quarter, is_weekend."""

    d = col_(d)
    return {
        "day_of_week": F.weekday(d),
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "is_weekend": F.when(F.weekday(d) >= 5, 1).otherwise(0),
    }


def one_hot(c: Column | str, values: list[str], prefix: str) -> dict[str, Column]:
    """``get_dummies`` with a given vocabulary; null -> all zeros."""

    c = col_(c)
    return {f"{prefix}_{v}": F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)) for v in values}


def per_clipped(num: Column, den: Column) -> Column:
    """Num / max(den, 1) as double."""

    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def retention_action(p: Column | str) -> Column:
    """Action ladder at 0.8 / 0.6 / 0.4 (inclusive)."""

    p = col_(p)
    out = None
    for threshold, label in RETENTION_ACTIONS:
        out = (F.when(p >= threshold, label) if out is None else out.when(p >= threshold, label))
    return out.otherwise(RETENTION_DEFAULT)


def eoq(annual_demand: Column, ordering_cost: float, holding_cost: float) -> Column:
    """sqrt(2 * D * S / max(H, 1e-6))."""

    return F.sqrt(
        F.lit(2.0) * annual_demand.cast("double") * F.lit(float(ordering_cost)) / F.lit(max(float(holding_cost), 1e-6))
    )


def safety_stock(demand_std: Column, lead_time_days: float, z: float = SERVICE_LEVEL_Z) -> Column:
    """P20: z * sigma * sqrt(max(L, 1e-6))."""

    return F.lit(float(z)) * demand_std * F.sqrt(F.lit(max(float(lead_time_days), 1e-6)))


def sample_std_exact(n: Column, s: Column, ss: Column) -> Column:
    """Sample standard deviation from exact integer moments (n, sum, sum of squares).

    ``(n*ss - s^2) / (n*(n-1))`` is evaluated in DECIMAL(38,0), so the only
    rounding is the final conversion to double: the result does not depend on
    the order rows were added in, and equals any engine's exact evaluation.
    One row -> 0 (pandas NaN then ``fillna(0)``).
    """

    big = "decimal(38,0)"
    num = n.cast(big) * ss.cast(big) - s.cast(big) * s.cast(big)
    den = n.cast(big) * (n - F.lit(1)).cast(big)
    var = F.when(n > 1, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))
    return F.sqrt(var)


def retrain_decision(psi: Column, mape: Column) -> dict[str, Column]:
    """Retrain when PSI > 0.2 or MAPE > 15 (strict), with formatted reasons."""

    reasons = F.array_compact(
        F.array(
            F.when(
                psi > RETRAIN_PSI_THRESHOLD,
                F.format_string("PSI exceeded threshold (%.3f > %.3f)", psi, F.lit(RETRAIN_PSI_THRESHOLD)),
            ),
            F.when(
                mape > RETRAIN_MAPE_THRESHOLD,
                F.format_string("MAPE exceeded threshold (%.2f > %.2f)", mape, F.lit(RETRAIN_MAPE_THRESHOLD)),
            ),
        )
    )
    return {"should_retrain": F.size(reasons) > 0, "reasons": reasons}
