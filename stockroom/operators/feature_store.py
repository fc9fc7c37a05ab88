"""Feature-store operators: J7, J8, F1, F2, K4.

J7 point-in-time (as-of, backward, TTL-bounded) lookup, built without a
range-join blow-up and without one task per entity:

1. Requests and feature rows are stacked into one frame ordered by
   (entity, ts, kind, tie) where feature rows sort before requests at the
   same instant (``feature_ts <= request_ts`` is a match).
2. ``repartitionByRange`` on that full key cuts the frame into contiguous
   ranges; the tie-breaker lets a hot entity span many ranges.  It is computed from the row
   where it is needed, and columns that equal the key are not carried twice.
3. The task that sorted a range fills it too: every request takes the latest earlier
   feature row of its entity, a batch at a time.  Requests with their matches, and one row
   a range with its edges, are frozen as a scratch table; the shuffle's files can go then.
4. A range whose first entity continues from earlier ranges takes a carry-in
   value from a small table with one row per range (the last known feature of
   the last entity of every range, filled across ranges of the same entity).
5. Matches older than the TTL become null.

Few feature rows (a bounded count proves it) are sent to every task instead, and looked up
by binary search: the requests are neither sorted nor shuffled.
"""

from __future__ import annotations

import datetime as _dt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.session import BROADCAST_ROW_LIMIT, ScratchTable, free_shuffles

# The reference's declared feature views.
CUSTOMER_VIEW = {
    "entity": "customer_id",
    "ttl_days": 30,
    "fields": [("recency", "bigint"), ("frequency", "bigint"), ("monetary", "float"), ("rfm_score", "float"), ("purchase_velocity", "float"), ("avg_order_value", "float")],
}
SERIES_VIEW = {
    "entity": "sku",
    "ttl_days": 7,
    "fields": [
        ("region", "string"), ("rolling_qty_7", "float"), ("rolling_qty_14", "float"), ("rolling_qty_30", "float"),
        ("lag_qty_1", "float"), ("lag_qty_7", "float"), ("lag_qty_14", "float"), ("avg_price", "float"), ("promotion_flag", "bigint"),
    ],
}


def feature_view(df: DataFrame, view: dict, ts_col: str = "event_timestamp") -> DataFrame:
    """entity + declared fields cast to their declared types (+ the timestamp)."""

    cols = [F.col(view["entity"])] + [F.col(n).cast(t).alias(n) for n, t in view["fields"]]
    if ts_col in df.columns:
        cols.append(F.col(ts_col))
    return df.select(*cols)


def latest_per_entity(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """the latest row per entity key by ``order`` (e.g. event_timestamp, date).

    ``max_by`` over a struct is a partial (map-side) aggregate, so a hot entity
    never gathers in one task.
    """

    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in payload])


def _runs(e: pa.Array, before, begun: bool) -> np.ndarray:
    """Whether an entity is another one than that of the row before (``before`` for the first row)."""

    change = np.ones(len(e), bool)
    if len(e) > 1:
        other = pc.not_equal(e[1:], e[:-1])
        if pa.types.is_floating(e.type):
            other = pc.and_(other, pc.invert(pc.and_(pc.is_nan(e[1:]), pc.is_nan(e[:-1]))))
        change[1:] = other.fill_null(True).to_numpy(zero_copy_only=False)
    first = e[0].as_py()
    change[0] = not begun or first is None or (first != before and not (first != first and before != before))
    return change


def _filler(carried: list[str]):
    """Function over the sorted batches of one range: its requests with their matches, then its edges."""

    def fill(batches):
        begun, opening, first, last, known, where = False, True, None, None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = pa.Table.from_batches([batch]).combine_chunks()
            e, f = (rows.column(c).combine_chunks() for c in ("__e", "__f"))
            e, f = (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in (e, f))
            request = rows.column("__kind").to_numpy() == 1
            change, place = _runs(e, last, begun), np.arange(n)
            if not begun:
                begun, first, where = True, e.take(pa.array([0])), rows.column("__range").to_numpy()[0]
                opened = np.cumsum(change) == 1
            else:
                opened = (np.cumsum(change) == 0) & opening
            start = np.maximum.accumulate(np.where(change, place, -1))  # -1: the run began in an earlier batch
            feature = np.maximum.accumulate(np.where(request, -1, place))
            at = np.where((feature >= start) & (feature >= 0), feature + 1, 0)
            held = known if known is not None else f.take(pa.array([None], pa.int64()))
            none = (at == 0) & ((start >= 0) | (known is None))
            every = pa.concat_arrays([held, f])
            asked = np.flatnonzero(request)
            match = every.take(pa.array(at[asked], mask=none[asked]))
            keep = rows.take(pa.array(asked))
            columns = [keep.column(c).combine_chunks() for c in carried]
            m = len(asked)
            edge = pa.nulls(m, pa.struct([("first", e.type), ("last", e.type), ("v", f.type)]))
            yield pa.RecordBatch.from_arrays([*columns, match, pa.array(opened[asked] & none[asked]), pa.array(np.full(m, where, np.int32)), edge], names=[*carried, "__m", "__open", "__range", "__edge"])
            opening = bool(opened[-1])
            last = e[n - 1].as_py()
            final = e.take(pa.array([n - 1]))
            known = None if none[-1] else every.take(pa.array([at[-1]]))
            kinds = [rows.schema.field(c).type for c in carried]
            empty = f.take(pa.array([None], pa.int64()))
        if begun:
            edge = pa.StructArray.from_arrays([first, final, known if known is not None else empty], names=["first", "last", "v"])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), empty, pa.array([False]), pa.array(np.array([where], np.int32)), edge], names=[*carried, "__m", "__open", "__range", "__edge"])

    return fill


def _looked_up(requests: DataFrame, e: Column, ts: Column, features: pa.Table, names: list[str], seconds: int | None, found_type: T.StructType) -> DataFrame:
    """``requests`` with ``__m``, the latest of ``features`` (__e, __ts, __f) at its instant or before it."""

    entities = pc.unique(features.column("__e").combine_chunks())
    code = pc.index_in(features.column("__e"), value_set=entities).to_numpy().astype(np.int64)
    instant = features.column("__ts").cast(pa.int64()).to_numpy()
    times, rank = np.unique(instant, return_inverse=True)
    key = code * (len(times) + 1) + rank + 1
    order = np.argsort(key)
    held = features.column("__f").combine_chunks().take(pa.array(order))
    shared = requests.sparkSession.sparkContext.broadcast((entities, times, key[order], code[order], instant[order], held))

    def look(batches):
        entities, times, key, code, instant, held = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            mine = pc.index_in(rows.column("__e"), value_set=entities).fill_null(-1).to_numpy().astype(np.int64)
            when = rows.column("__ts").cast(pa.int64())
            known = ~when.is_null().to_numpy() & (mine >= 0)
            when = when.fill_null(0).to_numpy()
            at = np.searchsorted(key, mine * (len(times) + 1) + np.searchsorted(times, when, "right"), "right") - 1
            known &= at >= 0
            at = np.where(known, at, 0)
            if len(key):
                known &= code[at] == mine
                if seconds is not None:
                    known &= instant[at] >= when - seconds * 1_000_000
            match = held.take(pa.array(at, mask=~known))
            yield from rows.select(names).append_column("__m", match).combine_chunks().to_batches()

    schema = T.StructType([requests.schema[c] for c in names] + [T.StructField("__m", found_type)])
    return requests.select(*names, e.alias("__e"), ts.alias("__ts")).mapInArrow(look, schema)


def asof_join(
    requests: DataFrame,
    feature_rows: DataFrame,
    entity: str,
    request_ts: str,
    feature_ts: str,
    feature_cols: list[str],
    ttl: _dt.timedelta | None = None,
    prefix: str = "",
    num_ranges: int | None = None,
    tie: str | None = None,
    few: bool = False,
) -> DataFrame:
    """Every request row + the latest feature row of its entity with
    ``feature_ts <= request_ts`` (and within ``ttl``), else nulls.  Of rows at the
    same instant the one with the largest ``tie`` counts (by default: of their hash).
    ``few`` says that the feature rows are probably few: they are counted, at most to the
    limit of a broadcast, and looked up by binary search if they are.

    Output: request columns, ``{prefix}<feature>`` columns, ``{prefix}feature_ts``.
    """

    req_cols = requests.columns
    # keep wall-clock (NTZ) semantics when the requests carry them, so results
    # do not depend on the session time zone
    ts_type = "timestamp_ntz" if requests.schema[request_ts].dataType.typeName() == "timestamp_ntz" else "timestamp"
    e_type = requests.select(entity).union(feature_rows.select(entity)).schema[0].dataType
    seconds = None if ttl is None else int(ttl.total_seconds())
    feat_struct = F.struct(F.col(feature_ts).cast(ts_type).alias("__fts"), *[F.col(c) for c in feature_cols])
    f = feature_rows.where(F.col(entity).isNotNull() & F.col(feature_ts).isNotNull()).select(
        F.col(entity).cast(e_type).alias("__e"),
        F.col(feature_ts).cast(ts_type).alias("__ts"),
        F.lit(0).alias("__kind"),
        *([F.col(tie).alias("__tie")] if tie else []),
        feat_struct.alias("__f"),
    )
    rank = F.col("__tie") if tie else F.xxhash64(*[F.col("__f")[c] for c in feature_cols])
    f_type = f.schema["__f"].dataType
    if few and isinstance(e_type, T.StringType | T.IntegralType):
        last = f.groupBy("__e", "__ts").agg(F.max_by("__f", F.struct(rank)).alias("__f"))
        held = last.limit(BROADCAST_ROW_LIMIT + 1).toArrow()
        if held.num_rows <= BROADCAST_ROW_LIMIT:
            out = _looked_up(requests, F.col(entity).cast(e_type), F.col(request_ts).cast(ts_type), held, req_cols, seconds, f_type)
            return out.select(*req_cols, *[F.col("__m")[c].alias(f"{prefix}{c}") for c in feature_cols], F.col("__m")["__fts"].alias(f"{prefix}feature_ts"))
    # request columns that equal the key are not carried again
    whole = {entity: "__e"} if requests.schema[entity].dataType == e_type else {}
    if requests.schema[request_ts].dataType.typeName() == ts_type:
        whole[request_ts] = "__ts"
    carried = [c for c in req_cols if c not in whole]
    r = requests.select(
        F.col(entity).cast(e_type).alias("__e"),
        F.col(request_ts).cast(ts_type).alias("__ts"),
        F.lit(1).alias("__kind"),
        *([F.lit(None).cast(f.schema["__tie"].dataType).alias("__tie")] if tie else []),
        F.lit(None).cast(f_type).alias("__f"),
        *[F.col(c).alias(f"__r{i}") for i, c in enumerate(carried)],
    )
    names = [f"__r{i}" for i in range(len(carried))]
    both = r.unionByName(f, allowMissingColumns=True)
    # requests: any order that spreads a hot entity
    spread = F.xxhash64(F.col("__e"), F.col("__ts"), *[F.col(c) for c in names])
    tie_type = f.schema["__tie"].dataType if tie else T.LongType()
    order = [F.col("__e").asc(), F.col("__ts").asc(), F.col("__kind").asc(), F.when(F.col("__kind") == 0, rank).otherwise(spread.cast(tie_type)).asc()]
    ranged = both.repartitionByRange(num_ranges, *order) if num_ranges else both.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).select("__e", "__ts", "__kind", "__f", *names, F.spark_partition_id().alias("__range"))
    edge_type = T.StructType([T.StructField("first", e_type), T.StructField("last", e_type), T.StructField("v", f_type)])
    fields = [T.StructField(c, both.schema[c].dataType) for c in ("__e", "__ts", *names)]
    fields += [T.StructField("__m", f_type), T.StructField("__open", T.BooleanType()), T.StructField("__range", T.IntegerType()), T.StructField("__edge", edge_type)]
    tagged = ScratchTable(ranged.mapInArrow(_filler(["__e", "__ts", *names]), T.StructType(fields)), "asof-order").df
    free_shuffles(requests.sparkSession)

    per_range = tagged.where("__edge is not null").select("__range", F.col("__edge.first").alias("__first_e"), F.struct(F.col("__edge.last").alias("e"), F.col("__edge.v").alias("v")).alias("__last"))
    same_e = Window.partitionBy("__last.e").orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = Window.orderBy("__range")  # bounded by the number of ranges
    carry = (
        per_range.withColumn("__upto", F.last("__last.v", ignorenulls=True).over(same_e))
        .withColumn("__prev_e", F.lag("__last.e").over(prev))
        .withColumn("__prev_v", F.lag("__upto").over(prev))
        .select("__range", F.when(F.col("__prev_e") == F.col("__first_e"), F.col("__prev_v")).alias("__carry"))
    )
    out = tagged.where("__edge is null").join(F.broadcast(carry), "__range")
    out = out.withColumn("__m", F.when(F.col("__open"), F.col("__carry")).otherwise(F.col("__m")))
    if seconds is not None:
        fresh = F.col("__m.__fts") >= (F.col("__ts") - F.expr(f"INTERVAL {seconds} SECONDS"))
        out = out.withColumn("__m", F.when(fresh, F.col("__m")))
    source = whole | dict(zip(carried, names, strict=True))
    return out.select(
        *[F.col(source[c]).alias(c) for c in req_cols],
        *[F.col("__m")[c].alias(f"{prefix}{c}") for c in feature_cols],
        F.col("__m")["__fts"].alias(f"{prefix}feature_ts"),
    )


def feature_service(
    requests: DataFrame,
    customer_rows: DataFrame,
    sku_rows: DataFrame,
    request_ts: str = "ts",
    customer_ts: str = "event_timestamp",
    sku_ts: str = "event_timestamp",
    customer_cols: list[str] | None = None,
    sku_cols: list[str] | None = None,
    sku_tie: str | None = None,
) -> DataFrame:
    """Both views side by side for each request (customer_id, sku, ts); by default all fields they declare."""

    customer_cols = customer_cols or [name for name, _ in CUSTOMER_VIEW["fields"]]
    sku_cols = sku_cols or [name for name, _ in SERIES_VIEW["fields"]]
    c = asof_join(requests, customer_rows, "customer_id", request_ts, customer_ts, customer_cols, _dt.timedelta(days=CUSTOMER_VIEW["ttl_days"]), "customer_")
    return asof_join(c, sku_rows, "sku", request_ts, sku_ts, sku_cols, _dt.timedelta(days=SERIES_VIEW["ttl_days"]), "sku_", tie=sku_tie, few=True)


def export_with_timestamp(df: DataFrame, run_ts: _dt.datetime, col: str = "event_timestamp") -> DataFrame:
    """K4 (frame part): one timestamp literal per run, so reruns are reproducible."""

    return df.withColumn(col, F.lit(run_ts).cast("timestamp"))


def ts_col(c: str) -> Column:
    return F.col(c).cast("timestamp")
