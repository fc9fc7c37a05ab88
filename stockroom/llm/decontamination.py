"""Operator 1: benchmark decontamination with SimHash over item-sized windows.

Words are lower-cased (A-Z) and stripped of punctuation at their ends; a text is a
bag of 5-word shingles (a shorter one is a single shingle), each weighing its number
of characters.  A document holds an item when a window of as many words as the item
has is at least 0.8 similar to it: weight in common over weight in either.

1. Windows are looked at only where a shingle of an item occurs; a window without
   one has similarity 0, so nothing is lost.
2. Each window of an item's size there gets a 64-bit SimHash.
3. A multi-index (``BLOCKS`` blocks of the fingerprint, probed with every value at
   most ``RADIUS // BLOCKS`` bits away) finds all item fingerprints within ``RADIUS``:
   if no block were that near, all blocks together would differ in more bits.
4. The exact weighted similarity decides each candidate.

The benchmark is taken in blocks of ``ITEMS_A_BLOCK`` items, each broadcast for one
pass over the documents, so its broadcast size is bounded whatever its length; the
documents are neither shuffled nor collected.

Defined results: a text shorter than an item is compared whole; null or empty texts hold nothing
and are found nowhere; equal items
are reported each; a document reports an item once, with its best window (the first
of ties); null doc_ids pass through; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stockroom.llm.common import mixed, shingle_hashes, slices, table, words_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BITS = 64
RADIUS = 20
BLOCKS = 7
ITEMS_A_BLOCK = 20_000
TEXT_BYTES = 2_000_000
PUNCTUATION = b".,;:!?\"'()[]{}"

FOUND = "item_id long, similarity double, start_word long, n_words int, hamming int"


@dataclass
class Prepared:
    """Stripped words of a run of texts: hashes, lengths in characters, and where each text starts."""

    hashes: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Prepared:
        words = words_of(texts)
        words.distinct = [word.strip(PUNCTUATION) or word for word in words.distinct]
        lengths = np.array([len(word.decode("utf-8", "replace")) for word in words.distinct], np.int64)
        return Prepared(words.hashes(), lengths[words.codes] if len(words.codes) else np.empty(0, np.int64), words.starts)


def shingles(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order and their weights."""

    width = min(SHINGLE_WORDS, len(hashes))
    before = np.concatenate([[0], np.cumsum(lengths)])
    return shingle_hashes(hashes, SHINGLE_WORDS), before[width:] - before[: len(before) - width]


def weighted_similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weight in common over weight in either, of two bags of shingles."""

    weight = dict(zip(left[0].tolist(), left[1].tolist(), strict=True)) | dict(zip(right[0].tolist(), right[1].tolist(), strict=True))
    a, b = Counter(left[0].tolist()), Counter(right[0].tolist())
    common = sum(n * weight[s] for s, n in (a & b).items())
    either = sum(n * weight[s] for s, n in (a | b).items())
    return common / either if either else 0.0


def bit_votes(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per shingle its weight with the sign of each bit of its hash."""

    bits = (codes[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.where(bits == 1, weights[:, None], -weights[:, None])


def fingerprints(votes: np.ndarray) -> np.ndarray:
    """SimHash of each row of summed votes."""

    return ((votes > 0).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class MultiIndex:
    """All stored fingerprints within RADIUS of a query, by exact block look-ups."""

    def __init__(self, stored: np.ndarray):
        self.stored = stored
        edges = np.linspace(0, BITS, BLOCKS + 1).astype(int)
        self.blocks = []
        for low, high in zip(edges, edges[1:], strict=False):
            width = int(high - low)
            near = [sum(1 << b for b in flips) for k in range(RADIUS // BLOCKS + 1) for flips in combinations(range(width), k)]
            value = self.block(stored, low, width)
            order = np.argsort(value, kind="stable")
            bounds = np.searchsorted(value[order], np.arange((1 << width) + 1))
            self.blocks.append((low, width, np.array(near), order, bounds))

    @staticmethod
    def block(values: np.ndarray, low: int, width: int) -> np.ndarray:
        return ((values >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, stored number, distance) of every pair within RADIUS."""

        pairs = [np.empty(0, np.int64)]
        for low, width, near, order, bounds in self.blocks:
            probes = self.block(queries, low, width)[:, None] ^ near
            first, last = bounds[probes].ravel(), bounds[probes + 1].ravel()
            counts = last - first
            asked = np.repeat(np.repeat(np.arange(len(queries)), near.size), counts)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
            pairs.append(asked * len(self.stored) + order[place])
        asked, hit = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.stored)))
        distance = np.bitwise_count(queries[asked] ^ self.stored[hit]).astype(np.int64)
        near = distance <= RADIUS
        return asked[near], hit[near], distance[near]


class ItemIndex:
    """One block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]):
        prepared = Prepared.of(pa.array([text for _, text in items], pa.string()))
        self.ids, self.sizes, self.bags, prints = [], [], [], []
        self.having: dict[int, list[int]] = defaultdict(list)  # shingle -> items
        for number, (item_id, _) in enumerate(items):
            a, b = prepared.starts[number : number + 2]
            if a == b:
                continue
            bag = shingles(prepared.hashes[a:b], prepared.lengths[a:b])
            for code in set(bag[0].tolist()):
                self.having[code].append(len(self.ids))
            self.ids.append(item_id)
            self.sizes.append(int(b - a))
            self.bags.append(bag)
            prints.append(fingerprints(bit_votes(*bag).sum(axis=0)[None, :])[0])
        self.codes = np.array(sorted(self.having), np.uint64)
        self.marks = np.zeros(1 << 20, bool)  # low bits of the items' shingles: a quick first test
        self.marks[(self.codes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.short = sorted({size for size in self.sizes if size < SHINGLE_WORDS})
        self.index = MultiIndex(np.array(prints, np.uint64))

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """Places of those codes that are an item's shingle."""

        places = np.flatnonzero(self.marks[(codes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return places[np.isin(codes[places], self.codes)]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(text number, item_id, similarity, first word, words, Hamming distance)."""

        prepared = Prepared.of(texts)
        places: dict[int, dict[int, list[int]]] = defaultdict(dict)  # text -> shingle width -> places
        for width in [*self.short, SHINGLE_WORDS]:
            if len(prepared.hashes) < width:
                continue
            found = self.hits(shingle_hashes(prepared.hashes, width))
            owner = np.searchsorted(prepared.starts, found, side="right") - 1
            whole = found + width <= prepared.starts[owner + 1]
            for number in np.unique(owner[whole]):
                places[number][width] = (found[whole & (owner == number)] - prepared.starts[number]).tolist()
        for number in sorted(places):
            a, b = prepared.starts[number : number + 2]
            yield from ((int(number), *row) for row in self.search_one(prepared.hashes[a:b], prepared.lengths[a:b], places[number]))

    def search_one(self, hashes: np.ndarray, lengths: np.ndarray, places: dict[int, list[int]]) -> Iterator[tuple]:
        best: dict[int, tuple] = {}
        for width, at in places.items():
            codes, weights = shingle_hashes(hashes, width), np.convolve(lengths, np.ones(width, np.int64), "valid")
            sizes: dict[int, set[int]] = defaultdict(set)  # item size -> windows to look at
            for place in at:
                for size in {self.sizes[item] for item in self.having[int(codes[place])] if min(self.sizes[item], SHINGLE_WORDS) == width}:
                    # a text shorter than the item is one window
                    last = max(0, min(place, len(hashes) - size))
                    sizes[size].update(range(min(last, max(0, place + width - size)), last + 1))
            summed = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(bit_votes(codes, weights), axis=0)])
            for size, windows in sizes.items():
                held = min(size, len(hashes))
                starts, n = np.array(sorted(windows)), held - width + 1
                asked, items, distance = self.index.within(fingerprints(summed[starts + n] - summed[starts]))
                for q, item, d in zip(asked.tolist(), items.tolist(), distance.tolist(), strict=True):
                    if self.sizes[item] != size:
                        continue
                    start = int(starts[q])
                    similarity = weighted_similarity((codes[start : start + n], weights[start : start + n]), self.bags[item])
                    if similarity >= SIMILARITY and similarity > best.get(item, (0.0,))[0]:
                        best[item] = (similarity, start, held, d)
        for item, (similarity, start, held, d) in sorted(best.items()):
            yield self.ids[item], similarity, start, held, d


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items with a text, ITEMS_A_BLOCK at a time."""

    block: list[tuple[int, str]] = []
    for row in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        if len(block) == ITEMS_A_BLOCK:
            yield block
            block = []
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, hamming): benchmark items held by documents."""

    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int32()), ("hamming", pa.int32())])

    def search(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1, TEXT_BYTES):
                    ids = part.column(0).to_pylist()
                    rows = [(ids[number], *row) for number, *row in index.value.search(part.column(1))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        return run

    found = spark.createDataFrame([], f"doc_id long, {FOUND}")
    for block in item_blocks(benchmark):
        index = spark.sparkContext.broadcast(ItemIndex(block))
        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(search(index), f"doc_id long, {FOUND}"))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are; no join, no shuffle."""

    index = docs.columns.index(text)

    def clean(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, index, TEXT_BYTES):
                    keep = np.ones(part.num_rows, bool)
                    keep[[number for number, *_ in items.value.search(part.column(index))]] = False
                    yield part.filter(pa.array(keep))

        return run

    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(ItemIndex(block))), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
