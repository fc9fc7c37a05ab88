"""Exact global ordered operators without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.  The
helpers here keep the work parallel and the result exact:

1. ``repartitionByRange`` on the *full* sort key (primary key plus a unique
   tie-breaker) cuts the rows into contiguous ranges.  Because the tie-breaker
   is part of the key, even a value shared by a third of all rows is split
   over several ranges.
2. The range id (``spark_partition_id``) is frozen by a reliable checkpoint,
   so both passes below see the same assignment even after executor loss.
3. One tiny aggregate gives per-range counts and sums (one row per range,
   bounded by the partition count), turned into prefix offsets by a window on
   that small frame and broadcast back.
4. A window partitioned by range id computes local row numbers / running
   sums, and the offset makes them global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.session import checkpointed

_BUCKET = "__range_id"


def _range_partition(df: DataFrame, order_by: list[Column], num_ranges: int | None) -> DataFrame:
    """Range-partition on the full key.  Without an explicit count the
    session's shuffle partitions apply and AQE may merge *adjacent* small
    ranges, so range ids stay ordered while their size follows the data."""

    if num_ranges:
        return df.repartitionByRange(num_ranges, *order_by)
    return df.repartitionByRange(*order_by)


def with_global_order(
    df: DataFrame,
    order_by: list[Column],
    row_number_col: str | None = "global_rn",
    sum_of: Column | None = None,
    running_sum_col: str = "running_sum",
    total_col: str | None = None,
    count_col: str | None = None,
    num_ranges: int | None = None,
) -> DataFrame:
    """Add an exact global ``row_number`` (1..n in ``order_by`` order) and/or a
    running sum of ``sum_of`` (frame: unbounded preceding .. current row).

    ``order_by`` must end in a unique tie-breaker, otherwise ties are ordered
    arbitrarily (as in any ``row_number``).  ``total_col`` / ``count_col``
    attach the grand total of ``sum_of`` and the row count.
    """

    # Sorted inside each range, the position of a row in its partition is its
    # local row number: monotonically_increasing_id() = (partition << 33) + position.
    # Computed in the same stage as the range shuffle, so row numbers need no
    # window (and no second exchange); the checkpoint freezes both columns.
    ranged = _range_partition(df, order_by, num_ranges).sortWithinPartitions(*order_by)
    pid = F.spark_partition_id()
    local_rn = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33) + F.lit(1)
    tagged = checkpointed(ranged.withColumn(_BUCKET, pid).withColumn("__local_rn", local_rn))

    aggs = [F.count(F.lit(1)).alias("__n")]
    if sum_of is not None:
        aggs.append(F.sum(sum_of).alias("__s"))
    per_range = tagged.groupBy(_BUCKET).agg(*aggs)
    # Bounded by the number of ranges: an unpartitioned window here is tiny.
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = per_range.select(
        _BUCKET,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n_before"),
        F.sum("__n").over(everything).alias("__n_total"),
        *(
            [
                F.coalesce(F.sum("__s").over(before), F.lit(0).cast(per_range.schema["__s"].dataType)).alias("__s_before"),
                F.sum("__s").over(everything).alias("__s_total"),
            ]
            if sum_of is not None
            else []
        ),
    )
    out = tagged.join(F.broadcast(offsets), _BUCKET)
    local = Window.partitionBy(_BUCKET).orderBy(*order_by)
    if row_number_col:
        out = out.withColumn(row_number_col, (F.col("__local_rn") + F.col("__n_before")).cast("long"))
    if sum_of is not None:
        running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(running_sum_col, F.sum(sum_of).over(running) + F.col("__s_before"))
        if total_col:
            out = out.withColumn(total_col, F.col("__s_total"))
    if count_col:
        out = out.withColumn(count_col, F.col("__n_total"))
    return out.drop(_BUCKET, "__local_rn", "__n_before", "__n_total", "__s_before", "__s_total")


def quartile_score(rn: Column, n: Column) -> Column:
    """Score 1..4 of a percentile rank ``rn/n`` cut at 0.25/0.5/0.75.

    Equals ``ceil(4*rn/n)``; not ``ntile(4)``, which splits remainders
    differently.
    """

    return F.ceil(F.lit(4.0) * rn / n).cast("int")
