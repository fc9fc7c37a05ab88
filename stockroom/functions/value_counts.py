"""Exact order statistics of many columns from counts of their distinct values.

Two samples (a reference and a current one) are reduced to one row per column and
distinct value with both counts, by a partial aggregate: a value that most rows share
costs a row per task.  One range-partitioned pass over these rows gives running counts per
column; quantiles, histograms, PSI and KS are all read off them.  No step gathers a
column or the rows of a value; per column some ``2 * (bins + 1)`` rows carry quantiles.

Null and NaN values are counted (``value`` null) and belong to no order statistic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.session import ScratchTable, checkpointed

EXACT = "decimal(38,0)"  # products of two counts do not fit a long


def _value(column: str) -> Column:
    v = F.col(column).cast("double")
    return F.when(~F.isnan(v), v)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("column", "value").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))


def _cells(entries: list[tuple[str, str, int, int]]) -> Column:
    """(name, column, reference rows, current rows) as rows of (column, value, ref, cur)."""

    cells = [F.struct(F.lit(name).alias("column"), _value(c).alias("value"), F.lit(ref).cast("long").alias("ref"), F.lit(cur).cast("long").alias("cur")) for name, c, ref, cur in entries]
    return F.inline(F.array(*cells))


def value_counts(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, ref, cur) of the same columns in two tables."""

    old = reference.select(_cells([(c, c, 1, 0) for c in columns]))
    return _counted(old.unionByName(current.select(_cells([(c, c, 0, 1) for c in columns]))))


def paired_value_counts(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """The same where both samples are columns of one table: name -> (reference column, current column)."""

    entries = [(name, c, int(c_is_ref), int(not c_is_ref)) for name, (r, c_) in pairs.items() for c, c_is_ref in ((r, True), (c_, False))]
    return _counted(rows.select(_cells(entries)))


def running_counts(counts: DataFrame) -> DataFrame:
    """Add cum_ref and cum_cur (counts up to and including the value) and n_ref and n_cur (per column)."""

    ranged = counts.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    rows = checkpointed(ranged.withColumn("range", F.spark_partition_id()))
    # rows of null values come first in their column and count nothing
    ref, cur = (F.when(F.col("value").isNotNull(), F.col(side)).otherwise(0) for side in ("ref", "cur"))
    per_range = rows.groupBy("column", "range").agg(F.sum(ref).alias("r"), F.sum(cur).alias("c"))  # ranges plus columns rows
    earlier = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    offsets = per_range.select(
        "column",
        "range",
        F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("r0"),
        F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"),
        F.sum("r").over(whole).alias("n_ref"),
        F.sum("c").over(whole).alias("n_cur"),
    )
    upto = Window.partitionBy("range", "column").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(F.broadcast(offsets), ["column", "range"])
    summed = joined.withColumns({"cum_ref": F.sum(ref).over(upto) + F.col("r0"), "cum_cur": F.sum(cur).over(upto) + F.col("c0")})
    return ScratchTable(summed.select("column", "value", "ref", "cur", "cum_ref", "cum_cur", "n_ref", "n_cur"), "running-counts").df


def breakpoints(running: DataFrame, bins: int = 10) -> DataFrame:
    """(column, breakpoints): distinct, sorted quantiles k / bins of the reference, linear between ranks."""

    fraction = lambda k: k.cast("double") / F.lit(float(bins))
    position = lambda k: fraction(k) * (F.col("n_ref") - 1)

    def held(rank) -> Column:
        """The k whose rank (from 0) falls on this value."""

        inside = lambda k: (rank(position(k)) >= F.col("cum_ref") - F.col("ref")) & (rank(position(k)) < F.col("cum_ref"))
        return F.filter(F.sequence(F.lit(0), F.lit(bins)), inside)

    low = F.transform(held(F.floor), lambda k: F.struct(k.alias("k"), F.col("value").alias("low"), F.lit(None).cast("double").alias("high")))
    high = F.transform(held(F.ceil), lambda k: F.struct(k.alias("k"), F.lit(None).cast("double").alias("low"), F.col("value").alias("high")))
    picked = running.where("value is not null and ref > 0").select("column", "n_ref", F.inline(F.concat(low, high)))
    ends = picked.groupBy("column", "k", "n_ref").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    at = position(F.col("k"))
    between = F.when(F.floor(at) == F.ceil(at), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at)))
    return ends.groupBy("column").agg(F.array_sort(F.collect_set(between)).alias("breakpoints"))  # bins + 1 values a column


def histogram(running: DataFrame, edges: DataFrame) -> DataFrame:
    """(column, bin, lower, upper, ref, cur) for every bin [lower, upper) of ``edges``, the last
    one closed; values outside are left out.  Columns with fewer than two edges have no bin."""

    edges = F.broadcast(edges)  # a row per column
    size = F.size("breakpoints")
    last = F.col("breakpoints")[size - 1]
    within = running.join(edges, "column").where((size > 1) & (F.col("value") >= F.col("breakpoints")[0]) & (F.col("value") <= last))
    number = F.least(F.size(F.filter("breakpoints", lambda b: b <= F.col("value"))), size - 1) - 1
    counts = within.groupBy("column", number.alias("bin")).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    bins = edges.where(size > 1).select("column", "breakpoints", F.explode(F.sequence(F.lit(0), size - 2)).alias("bin"))
    bins = bins.select("column", "bin", F.col("breakpoints")[F.col("bin")].alias("lower"), F.col("breakpoints")[F.col("bin") + 1].alias("upper"))
    none = F.lit(0).cast("long")
    return bins.join(counts, ["column", "bin"], "left").select("column", "bin", "lower", "upper", F.coalesce("ref", none).alias("ref"), F.coalesce("cur", none).alias("cur"))


def ks_distance(running: DataFrame) -> DataFrame:
    """(column, value): largest distance of the two distribution functions; null where a side is empty."""

    apart = F.abs(F.col("cum_ref").cast(EXACT) * F.col("n_cur") - F.col("cum_cur").cast(EXACT) * F.col("n_ref"))
    both = (F.col("n_ref").cast(EXACT) * F.col("n_cur")).cast("double")
    per = running.groupBy("column").agg(F.max(F.when(F.col("value").isNotNull(), apart)).alias("d"), F.max(both).alias("n"))
    return per.select("column", F.when(F.col("n") > 0, F.col("d").cast("double") / F.col("n")).alias("value"))
