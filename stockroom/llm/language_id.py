"""Operator 10: language ID by a bit-sliced Bloom filter over character n-grams.

Learning counts the 3- and 4-grams of letters (words padded by a boundary) of
every labelled training text, per language, and keeps for each language those
with a share of at least ``MIN_SHARE`` of its n-grams (so at most 1 / MIN_SHARE
per size, whatever the corpus) that are not much commoner elsewhere.  The kept
n-grams of all languages go into one bit-sliced Bloom filter: position p holds a
bitmask of languages, and the AND over an n-gram's positions is the set of all
languages that contain it.  A text is decided by the popcounts of those masks per
language, each corrected for that language's false-positive rate.

Defined results: a null text or one without a letter gets ``und`` and score 0; so
does every text if nothing could be learned; ties go to the first language by
code point; repeated rows are scored alike; other columns pass through untouched (one named like a result column is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from stockroom.llm.common import fold, mixed, slices, table

SIZES = (3, 4)
MIN_SHARE = 2e-5  # of a language's n-grams of one size; bounds the kept n-grams by 50,000 per size and language
MOST_ELSEWHERE = 20.0  # an n-gram this many times commoner in another language is taken for stray text
POSITIONS = 1 << 21
PROBES = 3
UNDETERMINED = "und"
TEXT_BYTES = 250_000

_LETTERS = None


def _is_letter() -> np.ndarray:
    """Letter flags by code point, built once in each worker."""

    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def letter_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts as code points with one 0 between words, and the text number of each."""

    lowered = [(text or "").lower() for text in texts]
    points = np.frombuffer("\0".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(text) + 1 for text in lowered])[: len(points)]
    points = np.where(_is_letter()[points], points, 0).astype(np.uint64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[keep], owner[keep]


def grams(points: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the n-grams (a boundary only at either end) and the text number of each.

    Four code points of up to 21 bits do not fit 64 bits, so they are hashed.
    """

    count = len(points) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.full(count, size, np.uint64)
    whole = np.ones(count, bool)
    for i in range(size):
        part = points[i : i + count]
        code = code * np.uint64(0x9E3779B97F4A7C15) + part
        if 0 < i < size - 1:
            whole &= part != 0
    # the 0 that starts a gram belongs to the text before it
    return mixed(code[whole]), owner[size - 1 :][whole]


@dataclass
class LanguageModel:
    """Bit-sliced Bloom filter: ``masks[position]`` has bit l set for language l (64 languages a column)."""

    languages: list[str]
    masks: np.ndarray  # POSITIONS x words of 64 languages
    false_positive: np.ndarray  # per language

    @staticmethod
    def build(rows: list[tuple[str, int]]) -> LanguageModel:
        languages = sorted({lang for lang, _ in rows})
        masks = np.zeros((POSITIONS, max(1, -(-len(languages) // 64))), np.uint64)
        by_language: dict[str, list[int]] = {}
        for lang, code in rows:
            by_language.setdefault(lang, []).append(code)
        false_positive = np.zeros(len(languages))
        for number, lang in enumerate(languages):
            places = positions(np.array(by_language[lang], np.int64).view(np.uint64)).ravel()
            masks[places, number // 64] |= np.uint64(1) << np.uint64(number % 64)
            false_positive[number] = (len(np.unique(places)) / POSITIONS) ** PROBES
        return LanguageModel(languages, masks, false_positive)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = len(texts)
        if not self.languages:
            return [UNDETERMINED] * n, [0.0] * n
        points, owner = letter_stream(texts)
        hits, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for size in SIZES:
            code, of = grams(points, owner, size)
            total += np.bincount(of, minlength=n)[:n]
            found = None
            for probe in positions(code):
                found = self.masks[probe] if found is None else found & self.masks[probe]
            for number in range(len(self.languages)):
                has = (found[:, number // 64] >> np.uint64(number % 64)) & np.uint64(1)
                hits[:, number] += np.bincount(of, weights=has, minlength=n)[:n]
        share = hits / np.maximum(total, 1)[:, None]
        corrected = np.clip((share - self.false_positive) / (1 - self.false_positive), 0, 1)
        letters = np.zeros(n, bool)
        letters[owner[points != 0]] = True
        best = corrected.argmax(axis=1)
        predicted = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
        return predicted, np.where(letters, corrected[np.arange(n), best], 0.0).tolist()


def positions(code: np.ndarray) -> np.ndarray:
    """PROBES filter positions of each n-gram code."""

    return np.stack([(code >> np.uint64(21 * i)).astype(np.int64) & (POSITIONS - 1) for i in range(PROBES)])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, size, gram, n) over every row of (text, lang); summed inside each task before the shuffle."""

    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(key: tuple[str, int]) -> None:
            codes, counts = (np.concatenate(x) for x in zip(*held[key], strict=True))
            unique, back = np.unique(codes, return_inverse=True)
            held[key] = [(unique, np.bincount(back, weights=counts).astype(np.int64))]

        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                langs = np.array(part.column(1).to_pylist(), object)
                texts = np.array(part.column(0).to_pylist(), object)
                for lang in set(langs):
                    points, owner = letter_stream(texts[langs == lang].tolist())
                    for size in SIZES:
                        held.setdefault((lang, size), []).append(np.unique(grams(points, owner, size)[0], return_counts=True))
                        if len(held[lang, size]) > 8:
                            merge((lang, size))
        for key in held:
            merge(key)
            codes, counts = held[key][0]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(codes)), pa.array([key[1]] * len(codes), pa.int32()), pa.array(codes.view(np.int64)), pa.array(counts)], schema=schema)

    raw = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, size int, gram long, n long")
    return raw.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame) -> LanguageModel:
    """Fit on every row of (text, lang) with both present."""

    counts = gram_counts(labelled)
    totals = counts.groupBy(F.col("lang").alias("l"), F.col("size").alias("s")).agg(F.sum("n").alias("total"))
    # totals: one row per language and n-gram size
    share = counts.join(totals, (F.col("lang") == F.col("l")) & (F.col("size") == F.col("s"))).select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= MIN_SHARE)
    most = share.groupBy("gram").agg(F.collect_list(F.struct("share", "lang")).alias("all"), F.max("share").alias("top"))
    kept = most.select("gram", "top", F.explode("all").alias("one")).where(F.col("one.share") * MOST_ELSEWHERE >= F.col("top")).select("one.lang", "gram")
    return LanguageModel.build([(row.lang, row.gram) for row in kept.toLocalIterator()])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append the predicted language and its score to every row of ``docs``, in place and without a shuffle."""

    docs = docs.drop(predicted, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    index = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, index, TEXT_BYTES):
                languages, scores = shared.value.score(part.column(index).to_pylist())
                arrays = [*part.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, predicted, score])

    return docs.mapInArrow(predict, StructType([*docs.schema.fields, StructField(predicted, StringType()), StructField(score, DoubleType())]))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold("doc_id", 4) != 2).select("text", "lang"))
    scored = identify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
