"""Operator 11: spelling variants grouped by a frequency-vector trie.

A word is the vector of its letter-group counts (each of a-z a group, all other letters
four more).  Words stand in a trie by successive counts.  One inserted, deleted or
replaced letter changes at most one count up and one down, so a depth-first search walks
down with a budget of one surplus and one deficit; words at the leaves it reaches are
compared letter by letter.

On Spark the trie is cut into subtrees.  Where it is cut is read off a bounded sample of
words (``SAMPLE_WORDS``) and only sets the balance of tasks: any cut gives the same rows.
A word goes to its own subtree and, as a guest, to every later subtree that the budget
reaches, so each pair is found once.  A subtree is one group of some
``words / (SUBTREES_PER_PARTITION * shuffle partitions)`` words and their guests.

Defined results: a null or empty text has no words; a null doc_id is written as nothing
before the colon; rows that repeat a doc_id count each; a word may be as long as a text;
an empty table, or one without a word often enough, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm.common import table
from stockroom.session import ScratchTable

LETTERS, MIN_LETTERS = "a-zÀ-ÿ", 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP_EVERY = 31  # runs whose hash this number divides lose a letter
MIN_COUNT = 2
FORM_RATIO = 10

GROUPS = 30
LEAF_WORDS = 64  # nodes of so few words are leaves
SAMPLE_WORDS = 100_000
SUBTREES_PER_PARTITION, MOST_SUBTREES = 8, 8192
PAIRS_AT_ONCE = 1 << 20
LETTERS_AT_ONCE = 1 << 21


class Words:
    """Letters of many words, side by side, and each word's counts."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)

    def counts(self) -> np.ndarray:
        plain = (self.letters >= 97) & (self.letters <= 122)
        group = np.where(plain, self.letters - 97, 26 + self.letters % 4)
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        flat = np.bincount(owner * GROUPS + group, minlength=len(self.lengths) * GROUPS)
        return np.minimum(flat, np.iinfo(np.int16).max).astype(np.int16).reshape(-1, GROUPS)

    def one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` differ by exactly one inserted, deleted or replaced letter."""

        near = np.zeros(len(a), bool)
        swap = self.lengths[a] > self.lengths[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        longer = self.lengths[b] - self.lengths[a]
        for start, stop in runs_of(self.lengths[a], LETTERS_AT_ONCE):
            x, y, n = a[start:stop], b[start:stop], self.lengths[a[start:stop]]
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(first, n)
            at_x, at_y = np.repeat(self.starts[x], n) + place, np.repeat(self.starts[y], n) + place
            unequal = self.letters[at_x] != self.letters[at_y]
            replaced = np.add.reduceat(unequal, first, dtype=np.int64) == 1
            # with one letter more: equal up to some place, equal one letter on from there
            end = len(self.letters) - 1
            shifted = self.letters[at_x] != self.letters[np.minimum(at_y + 1, end)]
            head = np.minimum.reduceat(np.where(unequal, place, np.repeat(n, n)), first)
            tail = np.maximum.reduceat(np.where(shifted, place, -1), first)
            near[start:stop] = np.where(longer[start:stop] == 0, replaced, (longer[start:stop] == 1) & (tail < head))
        return near


def runs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs whose sizes sum to ``most`` at most (a larger one stands alone)."""

    through = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = through[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(through, before + most, side="right")))
        yield start, stop
        start = stop


def thermometer(counts: np.ndarray) -> np.ndarray:
    """Two bits a group: at least one, at least two.  Bits of one word that another lacks are
    never more than its surplus over it."""

    bits = np.uint64(1) << np.arange(GROUPS, dtype=np.uint64)
    one, two = ((counts >= n).astype(np.uint64) @ bits for n in (1, 2))
    return one | (two << np.uint64(GROUPS))


class CountTrie:
    """Words in the order of their counts; a node is a run of words equal in the first counts."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        self.rows = counts[self.order]
        self.bits = thermometer(self.rows)

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs at leaves within a surplus of one and a deficit of one."""

        bits = thermometer(queries)
        none = np.zeros(len(queries), np.int16)
        stack = [(0, len(self.rows), 0, np.arange(len(queries)), none, none)] if len(self.rows) else []
        while stack:
            lo, hi, depth, alive, over, under = stack.pop()
            differ = np.flatnonzero(self.rows[lo, depth:] != self.rows[hi - 1, depth:])
            if hi - lo <= LEAF_WORDS or not len(differ):
                yield from self.at_leaf(lo, hi, alive, bits[alive])
                continue
            split = depth + int(differ[0])  # counts before it are the same in the whole node
            if split > depth:
                change = self.rows[lo, depth:split] - queries[alive, depth:split]
                over = over + np.maximum(change, 0).sum(axis=1, dtype=np.int16)
                under = under - np.minimum(change, 0).sum(axis=1, dtype=np.int16)
            column, asked = self.rows[lo:hi, split], queries[alive, split]
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1), hi - lo]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                change = column[start] - asked
                more, less = over + np.maximum(change, 0), under - np.minimum(change, 0)
                keep = np.flatnonzero((more <= 1) & (less <= 1))
                if len(keep):
                    stack.append((lo + start, lo + stop, split + 1, alive[keep], more[keep], less[keep]))

    def at_leaf(self, lo: int, hi: int, alive: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(lo, hi, PAIRS_AT_ONCE):
            held = self.bits[at : min(hi, at + PAIRS_AT_ONCE)]
            step = max(1, PAIRS_AT_ONCE // len(held))
            for start in range(0, len(alive), step):
                some = asked[start : start + step, None]
                within = (np.bitwise_count(held & ~some) <= 1) & (np.bitwise_count(some & ~held) <= 1)
                query, word = np.nonzero(within)
                yield alive[start + query], self.order[at + word]


class Cut:
    """Where the whole trie is cut: inner nodes split by the next count, leaves are numbered subtrees.

    Counts over the largest seen in a node go with it, so every word has one own subtree;
    bringing counts together never makes a difference larger, so no pair is lost.
    """

    def __init__(self, sample: np.ndarray, most_words: float):
        self.levels = np.argsort(-sample.var(axis=0), kind="stable") if len(sample) else np.arange(GROUPS)
        self.nodes: list[list[int] | int] = []
        self.subtrees = 0
        self.split(sample[:, self.levels], 0, max(1.0, most_words))

    def split(self, rows: np.ndarray, depth: int, most_words: float) -> int:
        number = len(self.nodes)
        self.nodes.append(-1)
        if len(rows) <= most_words or depth == GROUPS:
            self.nodes[number] = self.subtrees
            self.subtrees += 1
            return number
        top = int(rows[:, depth].max())
        self.nodes[number] = [self.split(rows[rows[:, depth] == count], depth + 1, most_words) for count in range(top + 1)]
        return number

    def reach(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(subtree, word, own) for each word's own subtree and the later ones within its budget."""

        none = np.zeros(len(counts), np.int16)
        stack = [(0, 0, np.arange(len(counts)), none, none)]
        subtrees, words, owned = [], [], []
        while stack:
            node, depth, alive, over, under = stack.pop()
            children = self.nodes[node]
            if isinstance(children, int):
                subtrees.append(np.full(len(alive), children, np.int32))
                words.append(alive)
                owned.append((over == 0) & (under == 0))
                continue
            asked = np.minimum(counts[alive, self.levels[depth]], len(children) - 1)
            for count, child in enumerate(children):
                more, less = over + np.maximum(count - asked, 0), under + np.maximum(asked - count, 0)
                keep = np.flatnonzero((more <= 1) & (less <= 1))
                if len(keep):
                    stack.append((child, depth + 1, alive[keep], more[keep], less[keep]))
        subtree, word, own = np.concatenate(subtrees), np.concatenate(words), np.concatenate(owned)
        home = np.zeros(len(counts), np.int32)
        home[word[own]] = subtree[own]
        keep = own | (subtree > home[word])
        return subtree[keep], word[keep], own[keep]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, lower-cased and with the slips of the contract, that are long and frequent enough."""

    lowered = F.translate(F.col("text"), UPPER, LOWER)
    long_runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{MIN_LETTERS},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(long_runs).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    place = F.pmod(F.col("h"), F.col("size")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.col("size")))
    words = hashed.select(F.when(F.col("h") % SLIP_EVERY == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of every two words (word, n) one edit apart, in both directions."""

    spark = words.sparkSession
    total = words.count()
    sample = words.sample(SAMPLE_WORDS / total, seed=1).limit(2 * SAMPLE_WORDS) if total > SAMPLE_WORDS else words
    counts = Words([row.word for row in sample.select("word").collect()]).counts()
    subtrees = min(MOST_SUBTREES, SUBTREES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(Cut(counts, len(counts) / subtrees))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                subtree, word, own = shared.value.reach(Words(batch.column(0).to_pylist()).counts())
                yield pa.RecordBatch.from_arrays([pa.array(subtree), pa.array(own), *(batch.column(c).take(pa.array(word)) for c in (0, 1))], names=["subtree", "own", "word", "n"])

    def search(rows: pa.Table) -> pa.Table:
        own = rows.column("own").to_numpy(zero_copy_only=False)
        rows = rows.take(pa.array(np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])))
        words = Words(rows.column("word").to_pylist())
        held = int(own.sum())
        counts = words.counts()[:, shared.value.levels]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for query, word in CountTrie(counts[:held]).search(counts):
            once = query > word  # guests come after the subtree's own words
            query, word = query[once], word[once]
            near = words.one_edit(query, word)
            left.append(query[near])
            right.append(word[near])
        a, b = np.concatenate([*left, *right]), np.concatenate([*right, *left])
        text, n = rows.column("word"), rows.column("n")
        return pa.table({"word": text.take(pa.array(a)), "n": n.take(pa.array(a)), "near": text.take(pa.array(b)), "near_n": n.take(pa.array(b))})

    dealt = words.mapInArrow(deal, "subtree int, own boolean, word string, n long")
    return dealt.groupBy("subtree").applyInArrow(search, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> ScratchTable:
    """(word, root) from (word, form): the last form that can be followed.  Forms grow tenfold in
    count, so chains are short; each step doubles what a word has followed."""

    current = ScratchTable(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = current.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = ScratchTable(current.df.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        current.drop()
        current = followed
        if not current.df.where("moved").limit(1).count():
            return current


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Per word of (doc_id, text): word, form, root, n, n_near, form_n."""

    words = ScratchTable(word_counts(docs), "variant-words").df
    candidate = F.when(F.col("near_n") >= FORM_RATIO * F.col("n"), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(candidate).alias("best"))
    near = ScratchTable(found.select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")), "variant-forms").df
    root = roots(near.where("form is not null")).df.select("word", "root")
    joined = words.join(near, "word", "left").join(root, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
