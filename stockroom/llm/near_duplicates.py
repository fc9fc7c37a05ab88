"""Operator 4: n-gram Jaccard join with token-combination prefixes.

A document is the set of hashes of its distinct n-word shingles ("tokens").  Two
documents link when 100 * intersection >= percent * union, so of n tokens at most
``slack(n)`` = n * (100 - percent) // 100 are missing in a partner.

All tokens stand in one order: first the rare tokens of the zone (hashes below a
fixed share of the hash range), then all others, both by hash.  A token is frequent
when more than ``FREQUENT`` documents emit it; each emits its tokens of the zone, and
further ones in hash order until there are 2 * (slack + 1) + 16.

* A document with slack + EXTRA rare zone tokens has those as its prefix.  A partner
  lacks at most slack of them, so at least EXTRA are shared.
* Others ("short of rare tokens") index all their rare zone tokens, then go on in the
  order: rare tokens count singly; frequent tokens are dealt into classes by hash and
  indexed as 2-token combinations inside their class, so a class of m tokens
  guarantees m - 1 matches.  They stop when the guarantees exceed the slack, so at
  least one entry is shared.  How many classes there are depends on a size band; a
  document near a band's edge is indexed in both bands, so partners meet in one.  Very
  small documents index frequent tokens singly within their band.

Rare tokens' lists are short by definition and give pairs, counted per pair.  A
combination's list can be long (a group of near copies): each is compared with one
member (its hub) per round, linked ones become a component, and lists whose members
are in one component are done; what two components share after ``HUB_ROUNDS`` rounds is
compared, leaving out pairs that the triangle inequality, their own tokens or their parity bits exclude
(the bits in which two sets differ are never more than the tokens in which they differ), so no
link is lost.  Every pair is verified on the whole sets.
Equal sets are one node from the start.

Defined results: a text without words (or null) has an empty set, links with nothing
and is its own component; a null doc_id takes no part and gets a null component;
rows that repeat a doc_id are one document that has the links of each; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm.common import mixed, shingle_hashes, slices, table, words_of
from stockroom.llm.components import connected_components
from stockroom.session import ScratchTable, checked_broadcast

WORDS, PERCENT = 3, 90
ZONE = 2.0  # the zone's share of the hash range, as a multiple of the slack's share
FREQUENT = 16
EXTRA = 3
SMALL_SET = 40
WHOLE_BANDS = 7  # sets of these bands (under 2 ** 7 tokens) emit all tokens, so that rare ones are not missed
HUB_ROUNDS = 2
PARITY_WORDS = 16  # 64-bit words of a set's parity bits
TEXT_BYTES = 3_000_000
SIGN = np.uint64(1 << 63)


def slack(n: int, percent: int) -> int:
    return n * (100 - percent) // 100


def token_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct tokens of each text, as signed numbers in hash order."""

    found = words_of(texts)
    hashes = found.hashes()
    out = []
    for start, stop in zip(found.starts, found.starts[1:], strict=False):
        out.append((np.unique(shingle_hashes(hashes[start:stop], words)) ^ SIGN).view(np.int64))
    return out


def zone_limit(percent: int) -> int:
    return int(min(1.0, ZONE * (100 - percent) / 100) * 2**64) - 2**63


def list_array(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, digest of the set (null if empty) and the tokens it emits."""

    limit = zone_limit(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                sets = token_sets(part.column(1), words)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                emitted = [s if bands(len(s), percent).start <= WHOLE_BANDS else s[: max(int(np.searchsorted(s, limit)), 2 * (slack(len(s), percent) + 1) + 16)] for s in sets]
                arrays = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), list_array(emitted)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "digest", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, tokens array<long>")


def bands(n: int, percent: int) -> range:
    """Size bands that partners of an n-token set can lie in; band 0 is for small sets."""

    def band(size: float) -> int:
        return 0 if size <= SMALL_SET else int(size).bit_length()

    return range(band(n * percent / 100), band(n * 100 / percent) + 1)


def entries(combinations: list[tuple[int, int, int]]) -> list[int]:
    """Index entry of each (band, token, token)."""

    if not combinations:
        return []
    parts = np.array(combinations, np.int64).view(np.uint64)
    value = np.zeros(len(parts), np.uint64)
    for column in parts.T:
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + column)
    return value.view(np.int64).tolist()


def entries_of(tokens: np.ndarray, frequent: np.ndarray, n: int, percent: int) -> tuple[list[int], list[int], bool]:
    """Rare tokens and combination entries a document is indexed by, and whether it is short of rare tokens."""

    often = np.isin(tokens, frequent)
    first = ~often & (tokens < zone_limit(percent))
    rare = tokens[first]
    spare = slack(n, percent)
    if len(rare) >= spare + EXTRA:
        return rare[: spare + EXTRA].tolist(), [], False
    singles, combined = set(rare.tolist()), []
    rest = list(zip(tokens[~first].tolist(), often[~first].tolist(), strict=True))
    rare_first = sorted(rest, key=lambda pair: pair[1])  # stable: by hash within either kind
    for band in bands(n, percent):
        classes = max(2, int(2 ** (band - 1) * (100 - percent) / 200))
        held: dict[int, list[int]] = {}
        matches = len(rare)
        for token, is_frequent in rare_first if band <= WHOLE_BANDS else rest:
            if matches > spare:
                break
            if not is_frequent:
                singles.add(token)
                matches += 1
            elif band == 0:
                combined.append((0, 0, token))
                matches += 1
            else:
                same = held.setdefault(token % classes, [])
                combined += [(band, other, token) for other in same]
                matches += bool(same)
                same.append(token)
    return sorted(singles), entries(combined), True


INDEX = "combined boolean, entry long, node long, n long, short boolean, uncommon int"


def index_entries(nodes: DataFrame, percent: int) -> DataFrame:
    """INDEX rows from (node, n, tokens, frequent)."""

    schema = pa.schema([("combined", pa.bool_()), ("entry", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("short", pa.bool_()), ("uncommon", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                columns: list[list] = [[] for _ in schema]
                tokens, frequent = part.column(2), part.column(3)
                for i, (node, n) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    own = tokens[i].values.to_numpy()
                    often = frequent[i].values.to_numpy() if frequent[i].is_valid else np.empty(0, np.int64)
                    singles, combined, short = entries_of(own, often, n, percent)
                    size = len(singles) + len(combined)
                    for column, values in zip(columns, ([False] * len(singles) + [True] * len(combined), singles + combined, [node] * size, [n] * size, [short] * size, [len(own) - len(often)] * size), strict=True):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return nodes.select("node", "n", "tokens", "frequent").mapInArrow(run, INDEX)


def sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def labelled(df: DataFrame, labels: DataFrame | None, *columns: str) -> DataFrame:
    """Add ``<column>_comp`` for each node column: its component, itself if it has no link yet."""

    for column in columns:
        if labels is None:
            df = df.withColumn(f"{column}_comp", F.col(column))
        else:
            own = labels.select(F.col("node").alias("__node"), F.col("comp").alias("__comp"))
            df = df.join(own, F.col(column) == F.col("__node"), "left").withColumn(f"{column}_comp", F.coalesce("__comp", column)).drop("__node", "__comp")
    return df


def hub_rank(hub_round: int) -> Column:
    """A list's hub is its least member: first the one with fewest uncommon tokens, later any."""

    return F.struct("uncommon", "node") if hub_round == 0 else F.struct(F.xxhash64("node", F.lit(hub_round)), "node")


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """PARITY_WORDS words whose bit b tells whether an odd number of tokens falls on b."""

    odd = np.bincount(tokens & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def combination_pairs(index: DataFrame, labels: DataFrame | None, percent: int, hub_round: int | None, first_hubs: DataFrame, unique: DataFrame, distances: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of members of a list that are in different components: each with its hub, or
    (without a round) all whose distances to the list's first hub differ by no more than a
    link's distance (the Jaccard distance is a metric), and whose parity bits and tokens that no
    other candidate has leave room for a link; no other pair can link.  ``unique`` has own_tokens and
    bits of nodes with one set; a node with several has no such bounds."""

    member = labelled(index, labels, "node")
    rank = hub_rank(hub_round or 0)
    lists = member.groupBy("entry").agg(F.min("node_comp").alias("low"), F.max("node_comp").alias("high"), F.min(rank).alias("hub")).where("low < high")
    hubs = lists.select(F.col("entry").alias("e"), F.col("hub.node").alias("hub"))
    if hub_round is None:
        # members of lists with the same first hub meet once, however many lists they share
        left = member.join(hubs.select("e"), F.col("entry") == F.col("e"), "left_semi")
        left = left.join(first_hubs.select(F.col("entry").alias("e"), "hub"), F.col("entry") == F.col("e")).select("hub", "node", "n", "node_comp").distinct()
        known = distances.select(F.col("a").alias("m_a"), F.col("b").alias("m_b"), "distance")
        left = left.join(known, (F.least("node", "hub") == F.col("m_a")) & (F.greatest("node", "hub") == F.col("m_b")), "left")
        left = left.join(unique.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left")
        off = F.when(F.col("bits").isNotNull(), F.when(F.col("node") == F.col("hub"), 0.0).otherwise(F.col("distance")))
        left = left.select("hub", "node", "n", "node_comp", off.alias("off"), F.coalesce("own_tokens", F.lit(0)).alias("own"), *(F.col("bits")[i].alias(f"bits{i}") for i in range(PARITY_WORDS)))
        right = left.select(F.col("hub").alias("h"), *(F.col(c).alias(f"other_{c}" if c != "node" else "other") for c in left.columns if c != "hub")).withColumnRenamed("other_node_comp", "other_comp")
        near = F.coalesce(F.abs(F.col("off") - F.col("other_off")) <= 1 - percent / 100 + 1e-9, F.lit(True))
        # tokens of one alone are all in the symmetric difference, at most (100 - percent) / (100 + percent) of both sizes in a link
        room = (F.col("n") + F.col("other_n")) * (100 - percent)
        near &= (F.col("own") + F.col("other_own")) * (100 + percent) <= room
        differ = reduce(Column.__add__, (F.bit_count(F.col(f"bits{i}").bitwiseXOR(F.col(f"other_bits{i}"))) for i in range(PARITY_WORDS)))
        near &= F.coalesce(differ * (100 + percent) <= room, F.lit(True))
        met = left.join(right, (F.col("hub") == F.col("h")) & (F.col("node") < F.col("other")) & (F.col("node_comp") != F.col("other_comp")) & sizes_fit("n", "other_n", percent) & near)
        return met.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    own = member.select(F.col("entry").alias("h"), F.col("node").alias("hub_node"), F.col("n").alias("hub_n"), F.col("node_comp").alias("hub_comp"))
    hubs = hubs.join(own, (F.col("e") == F.col("h")) & (F.col("hub") == F.col("hub_node"))).select("e", "hub", "hub_n", "hub_comp").dropDuplicates(["e"])
    met = member.join(hubs, F.col("entry") == F.col("e")).where((F.col("node_comp") != F.col("hub_comp")) & sizes_fit("n", "hub_n", percent))
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def rare_token_pairs(index: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share as many rare tokens as their prefixes guarantee."""

    left = index.select("entry", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("short").alias("a_short"))
    right = index.select(F.col("entry").alias("e"), F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("short").alias("b_short"))
    met = left.join(right, (F.col("entry") == F.col("e")) & (F.col("a") < F.col("b")) & sizes_fit("a_n", "b_n", percent))
    counted = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.col("a_short") & F.col("b_short")).alias("short"))
    return counted.where((F.col("shared") >= EXTRA) | F.col("short")).select("a", "b")


def whole_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(id, tokens, bits): whole sets of the given nodes and their parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                sets = token_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(sets), list_array([parity_bits(s) for s in sets])], names=["id", "tokens", "bits"])

    wanted = docs.select("doc_id", "text").join(checked_broadcast(nodes), F.col("doc_id") == F.col("node"), "left_semi")
    return wanted.mapInArrow(run, "id long, tokens array<long>, bits array<long>")


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, distance) of the pairs, by their whole sets."""

    a, b = (sets.select(F.col("id").alias(f"{x}_id"), F.col("tokens").alias(f"{x}_tokens")) for x in "ab")
    both = pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
    counted = both.select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("common"), (F.size("a_tokens") + F.size("b_tokens")).alias("sizes"))
    either = F.col("sizes") - F.col("common")
    found = counted.select("a", "b", (100 * F.col("common") >= percent * either).alias("linked"), (1 - F.col("common") / either).alias("distance"))
    return found.groupBy("a", "b").agg(F.max("linked").alias("linked"), F.min("distance").alias("distance"))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, comp) after the links of one more round: only components that these join are worked on."""

    edges = labelled(links, labels, "a", "b").where("a_comp != b_comp").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct()
    moved = connected_components(edges).df
    if labels is None:
        return moved
    to = moved.select(F.col("node").alias("__from"), F.col("comp").alias("__to"))
    kept = labels.join(to, F.col("comp") == F.col("__from"), "left").select("node", F.coalesce("__to", "comp").alias("comp"))
    return ScratchTable(kept.unionByName(moved).distinct(), "near-labels").df


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id."""

    sketch = ScratchTable(sketches(docs, words, percent), "sketches")
    rows = sketch.df.where("digest is not null and doc_id is not null").select("doc_id", "n", "digest")
    classes = ScratchTable(rows.groupBy("digest").agg(F.min("doc_id").alias("node")), "set-classes").df
    copies = rows.join(classes, "digest").where("doc_id != node").select("doc_id", "digest")
    nodes = sketch.df.where("digest is not null and doc_id is not null").join(checked_broadcast(copies), ["doc_id", "digest"], "left_anti").select(F.col("doc_id").alias("node"), "n", "tokens")

    emitted = nodes.select("node", F.explode("tokens").alias("token"))
    frequent = ScratchTable(emitted.groupBy("token").count().where(F.col("count") > FREQUENT).select("token"), "frequent-tokens").df
    own = emitted.join(checked_broadcast(frequent), "token").groupBy(F.col("node").alias("f")).agg(F.collect_list("token").alias("frequent"))  # at most a document's own tokens
    index = ScratchTable(index_entries(nodes.join(own, F.col("node") == F.col("f"), "left"), percent), "prefix-index")
    combined = index.df.where("combined").drop("combined")
    lists = combined.groupBy(F.col("entry").alias("e")).agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("e")
    combined = ScratchTable(combined.join(lists, F.col("entry") == F.col("e"), "left_semi"), "combinations").df
    rare = ScratchTable(rare_token_pairs(index.df.where("not combined"), percent), "rare-pairs").df
    index.drop()

    needed = rare.select(F.col("a").alias("node")).unionByName(rare.select(F.col("b").alias("node"))).unionByName(combined.select("node")).distinct()
    sets = ScratchTable(whole_sets(docs, ScratchTable(needed, "needed").df, words), "whole-sets")

    first_hubs = ScratchTable(combined.groupBy("entry").agg(F.min(hub_rank(0)).alias("first")).select("entry", F.col("first.node").alias("hub")), "first-hubs").df
    alone = sets.df.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("documents"), F.min("id").alias("node")).where("documents = 1")
    single = sets.df.groupBy("id").agg(F.count("*").alias("sets"), F.first("bits").alias("bits")).where("sets = 1").select(F.col("id").alias("node"), "bits")
    unique = ScratchTable(single.join(alone.groupBy("node").agg(F.count("*").alias("own_tokens")), "node", "left"), "own-tokens").df
    labels, tested = None, []
    for hub_round in [*range(HUB_ROUNDS), None]:
        open_pairs = labelled(rare, labels, "a", "b").where("a_comp != b_comp").select("a", "b")
        if hub_round is not None:  # one pair a node: a component needs no more
            open_pairs = open_pairs.groupBy("b").agg((F.min("a") if hub_round == 0 else F.max("a")).alias("a")).select("a", "b")
        pairs = open_pairs.unionByName(combination_pairs(combined, labels, percent, hub_round, first_hubs, unique, tested[0] if tested else None)).distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, tested).select("a", "b"), ["a", "b"], "left_anti")
        tested.append(ScratchTable(measured(pairs, sets.df, percent), "measured-pairs").df)
        labels = merged(labels, tested[-1].where("linked").select("a", "b"))
    sets.drop()

    members = rows.join(classes, "digest")
    linked = labelled(members, labels, "node").select("doc_id", F.col("n").alias("n_shingles"), F.col("node_comp").alias("component_id"))
    alone = sketch.df.where("digest is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
