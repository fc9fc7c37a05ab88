"""Operator 13: sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``VIRTUAL_NODES`` places of a ring, every document at the hash of its
text, so equal texts start at one place.  A document belongs to the first shard clockwise
from it; a full shard sends what comes after on to the next one clockwise.  The bound of
a shard is its even share of the documents, so counts differ by one at most (law ``rows``).

All documents between two neighbouring places ask the same shards in the same order.  So
only a count per arc decides: round by round, each arc's documents that are still without a
shard ask its next shard, arcs in ring order, until that is full.  This settles arcs
(shards x virtual nodes numbers), not documents.  A document's rank in its arc then says
which stretch of the arc it belongs to, and its place there is its slot.  Ranks come from one
global order of narrow rows along the ring, cut by ranges, so neither a text that a third of all
documents share nor a full arc meets in one task.

Defined results: a null text has size 1, crc32 0 and stands where the empty text does;
a null doc_id is a document like others; equal rows are interchangeable; with fewer documents
than shards the first shards hold one each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions.ordered import with_global_order
from stockroom.llm.common import table
from stockroom.session import ScratchTable

SHARDS = 16
VIRTUAL_NODES = 64
RING = 1 << 16  # places
LAW = "rows"


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, list[int]]]:
    """(last place, shards in the order asked) of every arc, in ring order.

    The stretch behind the last place is an arc that goes on at the first.
    """

    at: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            place = int(hashlib.md5(f"{shard}:{node}".encode()).hexdigest()[:4], 16)
            at[place] = min(shard, at.get(place, shard))  # of shards at one place the smaller number counts
    places = sorted(at)
    arcs = []
    for n in range(len(places) + 1):
        clockwise = dict.fromkeys(at[p] for p in (*places[n:], *places[:n]))
        arcs.append((places[n] if n < len(places) else RING - 1, [*clockwise, *(s for s in range(shards) if s not in clockwise)]))
    return arcs


def settle(counts: list[int], orders: list[list[int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches (arc, first rank, rank behind the last, shard, first slot) for ``counts`` documents an arc."""

    total = sum(counts)
    bound = [total // shards + (shard < total % shards) for shard in range(shards)]
    filled, settled, stretches = [0] * shards, [0] * len(counts), []
    for asked in range(shards):
        for arc, order in enumerate(orders):
            shard = order[asked]
            take = min(counts[arc] - settled[arc], bound[shard] - filled[shard])
            if take:
                stretches.append((arc, settled[arc], settled[arc] + take, shard, filled[shard]))
                settled[arc] += take
                filled[shard] += take
    return stretches


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard."""

    spark = docs.sparkSession
    octets = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    hashed = docs.select("doc_id", (F.octet_length(octets) + 1).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"), F.md5(octets).alias("md5"), F.monotonically_increasing_id().alias("row"))
    place = F.conv(F.substring("md5", 1, 4), 16, 10).cast("int")
    rows = ScratchTable(hashed.withColumn("place", place).withColumn("md5", F.substring("md5", 5, 16)), "ring-rows")

    arcs = ring(shards)
    firsts = [0, *(last + 1 for last, _ in arcs)]
    spans = [(n, firsts[n], last) for n, (last, _) in enumerate(arcs) if firsts[n] <= last]
    arc_of = spark.createDataFrame(spans, "arc int, first int, last int").select("arc", F.explode(F.sequence("first", "last")).alias("place"))
    at = rows.df.groupBy("place").count().join(F.broadcast(arc_of), "place").groupBy("arc").agg(F.sum("count").alias("n"))
    found = {row.arc: row.n for row in at.collect()}  # a row per arc
    counts = [found.get(n, 0) for n in range(len(arcs))]
    stretches = settle(counts, [order for _, order in arcs], shards)
    before = [sum(counts[:n]) for n in range(len(arcs))]
    spread = [(arc, before[arc] + start, before[arc] + stop, shard, slot) for arc, start, stop, shard, slot in stretches]
    plan = spark.createDataFrame(spread, "arc int, start long, stop long, shard int, first_slot long")

    ranked = with_global_order(rows.df, [F.col(c) for c in ("place", "md5", "doc_id", "row")], row_number_col="rank")
    dealt = ranked.join(F.broadcast(arc_of), "place").join(F.broadcast(plan), "arc").where((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("stop")))
    slot = F.col("first_slot") + F.col("rank") - 1 - F.col("start")
    return dealt.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op13_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
