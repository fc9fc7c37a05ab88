"""Validation: V1-V5.

All rules are evaluated in ONE aggregate over the frame (a single scan with
partial aggregation), then turned into report rows with ``inline``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reference's required columns and rules.
REQUIRED_COLUMNS = ["date", "customer_id", "sku", "region", "quantity", "unit_price", "revenue"]
NOT_NULL = ["customer_id", "sku"]
NON_NEGATIVE = ["quantity", "unit_price", "revenue"]


class ValidationError(ValueError):
    pass


def check_required_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> None:
    """V1: raise with the sorted names of missing columns (no Spark job)."""

    absent = sorted(c for c in required if c not in df.columns)
    if absent:
        raise ValidationError(f"Missing required columns: {', '.join(absent)}")


def rule_predicates(null_fails: bool = True, not_null=NOT_NULL, non_negative=NON_NEGATIVE) -> list[tuple[str, str, Column]]:
    """(rule, column, *failure* predicate) for V2 and V3.

    ``null_fails=True`` follows the shipped fallback (a null fails ``>= 0``);
    ``False`` ignores nulls in range rules like an expectation library does.
    """

    rules = [("not_null", c, F.col(c).isNull()) for c in not_null]
    rules += [("non_negative", c, ~F.coalesce(F.col(c) >= 0, F.lit(not null_fails))) for c in non_negative]
    return rules


def valid_predicate(null_fails: bool = True) -> Column:
    ok = F.lit(True)
    for _, _, failed in rule_predicates(null_fails):
        ok = ok & ~failed
    return ok


def validation_report(df: DataFrame, null_fails: bool = True) -> DataFrame:
    """V2-V4: rows (rule, column, checked, failed, success) from one aggregate."""

    check_required_columns(df)
    rules = rule_predicates(null_fails)
    agg = df.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(p).alias(f"f{i}") for i, (_, _, p) in enumerate(rules)])
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.col("checked").alias("checked"), F.col(f"f{i}").alias("failed"))
            for i, (r, c, _) in enumerate(rules)
        ]
    )
    return agg.select(F.inline(rows)).withColumn("success", F.col("failed") == 0)


def validate(df: DataFrame, null_fails: bool = True) -> dict:
    """V4: {'success': bool, 'results': [rule rows]} (a handful of rows to the driver)."""

    rows = [r.asDict() for r in validation_report(df, null_fails).collect()]
    return {"success": all(r["success"] for r in rows), "results": rows}


def gate(df: DataFrame, null_fails: bool = True) -> dict:
    """V5: reject the whole batch when any rule fails."""

    result = validate(df, null_fails)
    if not result["success"]:
        broken = ", ".join(f"{r['rule']} of {r['column']} ({r['failed']} rows)" for r in result["results"] if not r["success"])
        raise ValidationError(f"batch rejected: {broken}")
    return result


def split_valid(df: DataFrame, null_fails: bool = True, rules: list[tuple[str, str, Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """V5 option: (valid rows, quarantined rows with the names of failed rules).

    ``rules`` are those of ``rule_predicates`` for the transactions layout, or the caller's for another.
    """

    rules = rule_predicates(null_fails) if rules is None else rules
    reasons = F.array_compact(F.array(*[F.when(p, F.lit(f"{r}:{c}")) for r, c, p in rules]))
    tagged = df.withColumn("__reasons", reasons)
    valid = tagged.where(F.size("__reasons") == 0).drop("__reasons")
    quarantine = tagged.where(F.size("__reasons") > 0).withColumnRenamed("__reasons", "failed_rules")
    return valid, quarantine
