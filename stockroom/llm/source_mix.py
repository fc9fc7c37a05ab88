"""Operator 5: mixing sources to target weights by Pareto order sampling.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating; they share
150 % of all words by weight, stopping at 2 times their own words, the excess
reshared by weight until none is above.

A document of a source with target / size = w + f (w whole, 0 <= f < 1) gets w
certain whole copies.  The remaining words are filled by Pareto order sampling:
with U uniform from the md5 of the doc_id, documents are ranked by
(U / (1 - U)) / (f / (1 - f)) (random odds over inclusion odds) and taken in rank
order up to the words still wanted; of the others, the one whose size is nearest
to what is still missing is added when that brings the sum nearer.

A source may hold a third of all rows, so no task ranks a source: its ranks are cut
into ``BUCKETS`` histogram cells (pre-aggregated), the cell that reaches the target is
found from their sums, and only documents of that cell are ranked.

Defined results: a null text has size 0; a null source is a source; documents
without words are taken 0 times whatever their rank; a null doc_id draws as an
empty one; rows that repeat a doc_id draw alike and are ranked by size, equal rows
are interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom.llm.common import table
from stockroom.session import ScratchTable, checked_broadcast

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
BUCKETS = 1 << 16
RANK = ["rank_key", "doc_key", "size"]


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, 0 for null."""

    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def random_odds(doc_id: Column) -> Column:
    """U / (1 - U) with U from the first 52 bits of md5(doc_id)."""

    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    return u / (1.0 - u)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; a row per source."""

    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    weighed = ScratchTable(by_source.withColumn("weight", weight.cast("long")), "source-sizes").df
    wanted = TOTAL_SHARE * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * MOST_COPIES
    unit = 0.0
    while True:  # each round stops at least one more source; ends when none is newly above
        above = F.col("weight") * F.lit(unit) > cap
        stopped = F.sum(F.when(above, cap).otherwise(0))
        free = F.sum(F.when(above, 0).otherwise(F.col("weight")))
        held, weights = weighed.agg(stopped, free).first()
        new = (wanted - held) / weights if weights else unit
        if new == unit:
            break
        unit = new
    return weighed.select("source", "source_size", F.when(F.col("weight") * F.lit(unit) > cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(unit)).alias("target"))


def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with doc_id, source and size, with their source's plan and their place in its ranks."""

    # A table with a row per source is broadcast when few rows prove it safe, else Spark's skew join splits a hot source.
    joined = rows.join(checked_broadcast(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    odds = random_odds(F.col("doc_id")) / (F.col("part") / (1.0 - F.col("part")))
    key = F.when(F.col("part") > 0, odds / (1.0 + odds)).otherwise(1.0)  # monotone in the odds, within 0 and 1
    return joined.withColumn("rank_key", key).withColumn("doc_key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("cell", F.least(F.floor(F.col("rank_key") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def mixing_plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, source, size): per source the plan that ``ranked`` takes and the cut that ``copies`` takes."""

    targets = ScratchTable(source_targets(sizes), "source-targets").df.withColumnRenamed("source", "s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio)).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = ScratchTable(ranked(sizes, plan), "mix-ranks").df

    # The first cell whose running sum passes the missing words: only its rows are ranked one by one.
    some = rows.where("part > 0 and size > 0")
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = some.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("missing").alias("missing")).withColumn("through", F.sum("words").over(upto))
    edge = cells.where(F.col("through") > F.col("missing")).groupBy(F.col("source").alias("s")).agg(F.min("cell").alias("edge_cell"), F.min(F.col("through")).alias("through"), F.min_by("words", "cell").alias("words"))
    edge = edge.select("s", "edge_cell", (F.col("through") - F.col("words")).alias("before"))
    in_rank = Window.partitionBy("source").orderBy(*RANK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = ScratchTable(edge, "mix-edges").df
    at_edge = some.join(checked_broadcast(edge), F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("edge_cell")))
    filled = at_edge.withColumn("sum", F.sum("size").over(in_rank) + F.col("before")).where(F.col("sum") <= F.col("missing"))
    last = filled.groupBy(F.col("source").alias("f")).agg(F.max(F.struct(*RANK)).alias("last"), F.max("sum").alias("filled"))
    cut = edge.join(last, F.col("s").eqNullSafe(F.col("f")), "left").select("s", "edge_cell", "last", F.coalesce("filled", "before").alias("filled"))
    cut = ScratchTable(cut, "mix-cuts").df

    # Of the rows after the cut, the one that fits what is missing best.
    after = some.join(checked_broadcast(cut), F.col("source").eqNullSafe(F.col("s"))).where(~taken_by_rank())
    after = after.withColumn("off", F.abs(F.col("size") - (F.col("missing") - F.col("filled")))).where(F.col("off") < F.col("missing") - F.col("filled"))
    least = after.groupBy(F.col("source").alias("l")).agg(F.min("off").alias("least"))
    nearest = after.join(checked_broadcast(ScratchTable(least, "mix-least").df), F.col("source").eqNullSafe(F.col("l")) & (F.col("off") == F.col("least"))).groupBy(F.col("source").alias("n")).agg(F.min(F.struct(*RANK)).alias("added"))
    decision = targets.select("s").join(cut.withColumnRenamed("s", "c"), F.col("s").eqNullSafe(F.col("c")), "left").join(nearest, F.col("s").eqNullSafe(F.col("n")), "left").select("s", "edge_cell", "last", "added")
    return plan, checked_broadcast(ScratchTable(decision, "mix-decisions").df)


def taken_by_rank() -> Column:
    """Whether a row lies before its source's cut; with no cut (all rows fit) every row does."""

    own = F.struct(*RANK)
    return F.col("edge_cell").isNull() | (F.col("cell") < F.col("edge_cell")) | F.coalesce(own <= F.col("last"), F.lit(False))


def copies() -> Column:
    """How often the mix takes a row."""

    extra = (F.col("part") > 0) & (F.col("size") > 0) & (taken_by_rank() | F.coalesce(F.struct(*RANK) == F.col("added"), F.lit(False)))
    return F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(0)


def mix(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text, source): doc_id, source, size, source_size, target, taken."""

    sizes = ScratchTable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes").df
    plan, decision = mixing_plan(sizes)
    chosen = ranked(sizes, plan).join(decision, F.col("source").eqNullSafe(F.col("s")))
    return chosen.select("doc_id", "source", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` with all its columns, as often as it is taken."""

    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    plan, decision = mixing_plan(ScratchTable(rows.drop("row"), "mix-sizes").df)
    chosen = ranked(rows, plan).join(decision, F.col("source").eqNullSafe(F.col("s")))
    return chosen.select("row", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select("row.*")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


# The same rows for DuckDB.  Sources stop in order of how soon their limit is reached (twice their
# words over their weight), so the unit of weight is that of the first source that stays within.
OP5_SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM by_source
), ordered AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS wanted,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
    (sum(weight) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS free,
    row_number() OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST) AS place
  FROM weighed
), unit AS (
  SELECT arg_min((wanted - held) / free, place) AS unit FROM ordered WHERE weight * ((wanted - held) / free) <= 2 * source_size
), targets AS (
  SELECT source, source_size, CASE WHEN weight * unit > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE weight * unit END AS target
  FROM weighed, unit
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0::DOUBLE END AS ratio FROM targets
), ranked AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, floor(p.ratio)::BIGINT AS whole, p.ratio - floor(p.ratio) AS part,
    p.target - floor(p.ratio)::BIGINT * p.source_size AS missing,
    (('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), keyed AS (
  SELECT *, (u / (1::DOUBLE - u)) / (part / (1::DOUBLE - part)) AS odds FROM ranked WHERE part > 0 AND size > 0
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1::DOUBLE + odds), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS through FROM keyed
), filled AS (
  SELECT source, coalesce(max(through) FILTER (through <= missing), 0) AS filled FROM summed GROUP BY source
), others AS (
  SELECT s.*, abs(s.size - (s.missing - f.filled)) AS off FROM summed s JOIN filled f ON s.source IS NOT DISTINCT FROM f.source
  WHERE s.through > s.missing AND abs(s.size - (s.missing - f.filled)) < s.missing - f.filled
), added AS (
  SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, odds / (1::DOUBLE + odds), doc_id NULLS FIRST, size) AS r FROM others) WHERE r = 1
), extra AS (
  SELECT doc_id FROM summed WHERE through <= missing UNION ALL SELECT doc_id FROM added
)
SELECT r.doc_id, r.source, r.size, r.source_size, r.target,
  (CASE WHEN r.size > 0 THEN r.whole + (CASE WHEN e.doc_id IS NULL THEN 0 ELSE 1 END) ELSE 0 END * r.size)::BIGINT AS taken
FROM ranked r LEFT JOIN extra e ON r.doc_id = e.doc_id
"""
