"""Operator 9: quality rules by distribution divergence.

Two passes.  The first counts, over every text with a language, words and shares of
character classes per language; the commonest words (``COMMON_WORDS``, plus one bin
for all others) form its word reference, the median shares its class reference.
The second compares each text with the references by Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1) and takes the nearest language
for each histogram, so a wrong or missing language label does no harm.  A text
passes when both distances are within thresholds that widen for short texts
(a sample's distance to its own source falls as 1 / sqrt(length)); under the
minimum lengths the distances say nothing and do not decide.

Defined results: a null text is an empty one (all counts 0, base_failed, not
kept); with no reference at all only the base rule decides; repeated rows are
judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockroom.llm.common import shingle_hashes, slices, table, words_of
from stockroom.llm.language_id import _is_letter
from stockroom.session import ScratchTable

TEXT_BYTES = 4_000_000
COMMON_WORDS = 40
MIN_WORDS = 50
# Base rule
MOST_REPEATED_PERCENT = 50
# Divergence rule: distance allowed at length n is LIMIT + SPREAD / sqrt(n)
CHAR_LIMIT, CHAR_SPREAD, MIN_CHARS = 0.12, 2.9, 200
WORD_LIMIT, WORD_SPREAD = 0.17, 1.9
STEPS = 1000

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "other_letter", "digit", "space", "newline", "stop", "symbol", "other")
_CLASS_OF = None


def class_table() -> np.ndarray:
    """Character class by code point, built once in each worker."""

    global _CLASS_OF
    if _CLASS_OF is None:
        of = np.full(0x110000, CLASSES.index("other"), np.uint8)
        of[_is_letter()] = CLASSES.index("other_letter")
        for name, chars in (
            ("lower", "abcdefghijklmnopqrstuvwxyz"),
            ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            ("digit", "0123456789"),
            ("space", " \t\r"),
            ("newline", "\n"),
            ("stop", ".,;:'\"()-"),
            ("symbol", SYMBOLS),
        ):
            of[[ord(c) for c in chars]] = CLASSES.index(name)
        _CLASS_OF = of
    return _CLASS_OF


def class_histograms(texts: list[str]) -> np.ndarray:
    """Counts of each character class, a row per text."""

    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
    flat = np.bincount(owner * len(CLASSES) + class_table()[points], minlength=len(texts) * len(CLASSES))
    return flat.reshape(len(texts), len(CLASSES))


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's distribution to the reference (1 for an empty row)."""

    total = counts.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(total, 1), np.broadcast_to(reference, counts.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, item, n) over every text with a language: occurrences of each word, and for
    each character class how many texts have which share of it (in steps of 1 / STEPS).  Class
    shares are counted per text, so that a median can leave out the influence of odd texts."""

    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.binary()), ("n", pa.int64())])

    def rows(lang: str, kind: str, items: list[bytes], n: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array([lang] * len(n), pa.string()), pa.array([kind] * len(n), pa.string()), pa.array(items, pa.binary()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                langs = np.array(part.column(1).to_pylist(), object)
                histograms = class_histograms(part.column(0).to_pylist())
                total = histograms.sum(axis=1)
                for lang in set(langs):
                    chosen = np.flatnonzero(langs == lang)
                    words = words_of(part.column(0).take(pa.array(chosen)))
                    yield rows(lang, "word", words.distinct, np.bincount(words.codes, minlength=len(words.distinct)))
                    long = chosen[total[chosen] >= MIN_CHARS]
                    steps = np.rint(STEPS * histograms[long] / total[long, None]).astype(np.int64)
                    held = shares.setdefault(lang, np.zeros((len(CLASSES), STEPS + 1), np.int64))
                    np.add.at(held, (np.broadcast_to(np.arange(len(CLASSES)), steps.shape), steps), 1)
        for lang, held in shares.items():
            places = np.argwhere(held)
            yield rows(lang, "class", [f"{CLASSES[c]}:{step}".encode() for c, step in places], held[held > 0])

    raw = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, kind string, item binary, n long")
    return raw.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> list[dict]:
    """Per language: median share of each character class (scaled to 1), the commonest words and
    their shares (last: all other words).

    Only the class steps, ``COMMON_WORDS`` words and a total per language reach the driver.
    """

    scratch = ScratchTable(language_counts(docs), "language-counts")
    words = scratch.df.where("kind = 'word'")
    classes: dict[str, dict[str, Counter]] = {}
    for row in scratch.df.where("kind = 'class'").collect():  # at most len(CLASSES) * (STEPS + 1) per language
        name, step = bytes(row.item).decode().split(":")
        classes.setdefault(row.lang, {}).setdefault(name, Counter())[int(step)] += row.n
    totals = {row.lang: row.n for row in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    commonest = [F.desc("n"), F.asc("item")]
    of_bucket = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*commonest))
    of_all = F.row_number().over(Window.partitionBy("lang").orderBy(*commonest))
    # ranked per bucket of words first, so that no task ranks all words of a language
    kept = words.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(512))).withColumn("r", of_bucket).where(F.col("r") <= COMMON_WORDS)
    top: dict[str, list] = {}
    for row in kept.withColumn("rank", of_all).where(F.col("rank") <= COMMON_WORDS).orderBy("lang", "rank").collect():
        top.setdefault(row.lang, []).append((bytes(row.item), row.n))
    scratch.drop()
    found = []
    for lang in sorted(top.keys() & classes.keys()):
        medians = np.array([median_step(classes[lang].get(name, Counter())) for name in CLASSES]) / STEPS
        n = np.array([count for _, count in top[lang]])
        found.append({"lang": lang, "classes": medians / max(medians.sum(), 1e-9), "words": [word for word, _ in top[lang]], "shares": np.append(n, totals[lang] - n.sum()) / totals[lang]})
    return found


def median_step(steps: Counter) -> int:
    """Lower median of the steps, by their counts."""

    half, seen = sum(steps.values()) / 2, 0
    for step in sorted(steps):
        seen += steps[step]
        if seen >= half:
            return step
    return 0


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line of the text."""

    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside a 3-word window that occurs twice or more."""

    if len(hashes) < 4:
        return 0
    windows = shingle_hashes(hashes, 3)
    _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = n[back] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(hashes), bool)
    for offset in range(3):
        covered[offset : offset + len(windows)] |= again
    return int(covered.sum())


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
_ARROW = pa.schema([(c, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for c, t in (x.split() for x in COLUMNS.split(", "))])


def judge(texts: pa.Array, refs: list[dict]) -> list[pa.Array]:
    """The rule columns of every text."""

    values = [text or "" for text in texts.to_pylist()]
    n = len(values)
    words = words_of(texts, lower=False)  # the base rule tells cases apart, the references do not
    n_words = np.diff(words.starts)
    owner = np.repeat(np.arange(n), n_words)
    lengths = np.array(pc.utf8_length(pa.array(words.distinct, pa.binary()).cast(pa.string())), np.int64)
    word_chars = np.bincount(owner, weights=lengths[words.codes], minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
    histograms = class_histograms(values)
    symbols = histograms[:, CLASSES.index("symbol")]
    hashes = words.hashes()
    repeats = np.array([repeated_words(hashes[a:b]) for a, b in zip(words.starts, words.starts[1:], strict=False)], np.int64)
    lines = np.array([duplicate_lines(text) if "\n" in text else 0 for text in values], np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MOST_REPEATED_PERCENT * n_words)

    chars, char_distance, word_distance = histograms.sum(axis=1), np.ones(n), np.ones(n)
    numbers: dict[bytes, list[int]] = {}
    for i, word in enumerate(words.distinct):
        numbers.setdefault(word.lower(), []).append(i)
    for ref in refs:
        char_distance = np.minimum(char_distance, divergence(histograms, ref["classes"]))
        place = np.full(len(words.distinct), len(ref["words"]), np.int64)
        for i, word in enumerate(ref["words"]):
            place[numbers.get(word, [])] = i
        width = len(ref["words"]) + 1
        counts = np.bincount(owner * width + place[words.codes], minlength=n * width).reshape(n, width) if len(owner) else np.zeros((n, width))
        word_distance = np.minimum(word_distance, divergence(counts, ref["shares"]))
    char_ok = (chars < MIN_CHARS) | (char_distance <= CHAR_LIMIT + CHAR_SPREAD / np.sqrt(np.maximum(chars, 1)))
    word_ok = (n_words < MIN_WORDS) | (word_distance <= WORD_LIMIT + WORD_SPREAD / np.sqrt(np.maximum(n_words, 1)))
    kept = ~failed & ((char_ok & word_ok) if refs else True)
    return [pa.array(x, t) for x, t in zip((n_words, word_chars, symbols, lines, repeats, failed, kept, char_distance, word_distance), _ARROW.types, strict=True)]


def quality(docs: DataFrame, refs: list[dict], text: str = "text") -> DataFrame:
    """Append the rule columns to every row of ``docs`` without a shuffle (``refs``: a few words and numbers per language)."""

    docs = docs.drop(*_ARROW.names)
    index = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, index, TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, *judge(part.column(index), shared.value)], names=[*part.schema.names, *_ARROW.names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(COLUMNS).fields]))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs.select("doc_id", "text"), references(docs)).drop("text")
