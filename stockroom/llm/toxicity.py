"""Operator 3: toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic texts and one on
windows of ordinary texts.  A window is a word (A-Z lower-cased, punctuation at its
ends removed) between blanks; the toxic dictionary is trained on those that occur in
clearly more toxic than ordinary texts only.  A window's gain is its compressed length
under the ordinary dictionary minus that under the toxic one; both dictionaries
hold a fixed tail that follows every window, as zstandard looks for no match in the
last bytes of its input.  Each gain step has a weight, the log ratio of its frequency
among the distinct windows of toxic and of ordinary training texts; a text's sum of
weights, alone and relative to its length, goes through a calibrated logistic
threshold (score 0.5).

Learning uses at most ``SAMPLE_OF_A_CLASS`` labelled texts of either class (those
with the smallest md5 of their doc_id), a bounded sample; the threshold weights either class
by all its labelled texts, so that it does not move with the sample; scoring reads whole texts.

Defined results: a null, empty or wordless text gets the score of no evidence; without
labelled texts of both classes every text gets 0; a repeated label row counts once;
repeated document rows are scored alike; other columns pass through untouched (one
named like a result column is replaced).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from stockroom.llm.common import fold, mixed, slices, table, words_of

SAMPLE_OF_A_CLASS = 2_000
DICTIONARY_BYTES = 8_192
SEGMENT, MER = 16, 6  # zstandard's k and d: segment and substring lengths of its training
HASHES, LOWEST = 8, 5  # near copies among the training texts
SAMPLED_WINDOWS = 100_000
STEPS = (-3, 10)  # gains outside count as the ends
TAIL = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
PUNCTUATION = b".,;:!?%&$*#\"'()[]{}<>|=/\\-_"
TEXT_BYTES = 16_000_000

_PARAMETERS = {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 4, "window_log": 16, "hash_log": 15, "chain_log": 15, "search_log": 5, "target_length": 64}


@dataclass
class ToxicityModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(STEPS[1] - STEPS[0] + 1))
    logistic: np.ndarray | None = None

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, as a step number."""

        def lengths(content: bytes) -> np.ndarray:
            parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS, write_content_size=False, write_checksum=False, write_dict_id=False)
            compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters).compress
            return np.fromiter((len(compress(window + TAIL)) for window in windows), np.int64, len(windows))

        return np.clip(lengths(self.ordinary) - lengths(self.toxic), *STEPS) - STEPS[0]

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        if self.logistic is None:
            return np.zeros(n)
        windows, owner, which = distinct_windows(texts)
        weight = self.weights[self.gains(windows)] if windows else np.empty(0)
        return 1 / (1 + np.exp(-self.evidence(np.bincount(owner, weights=weight[which], minlength=n), np.bincount(owner, minlength=n)) @ self.logistic))

    @staticmethod
    def evidence(total: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Features of the logistic threshold."""

        return np.stack([np.clip(total, -30, 30), np.clip(total / np.sqrt(np.maximum(count, 1)), -5, 5), np.ones(len(total))], axis=1)


def distinct_windows(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct windows of all texts, and (text number, window number) of each window that a text has."""

    words = words_of(texts)
    numbers: dict[bytes, int] = {}
    of_word = np.fromiter((numbers.setdefault(word.strip(PUNCTUATION), len(numbers)) for word in words.distinct), np.int64, len(words.distinct))
    owner = np.repeat(np.arange(len(texts)), np.diff(words.starts))
    code = of_word[words.codes] if len(owner) else np.empty(0, np.int64)
    if b"" in numbers:
        full = code != numbers[b""]
        owner, code = owner[full], code[full]
    owner, code = np.divmod(np.unique(owner * max(1, len(numbers)) + code), max(1, len(numbers)))
    return [b" " + word + b" " for word in numbers], owner, code


def trained(windows: list[bytes], frequency: np.ndarray, rng: np.random.Generator) -> bytes:
    """zstandard dictionary of windows drawn by frequency, ten to a training sample."""

    drawn = rng.choice(len(windows), SAMPLED_WINDOWS, p=frequency / frequency.sum())
    samples = [b"".join(windows[i] for i in drawn[at : at + 10]) for at in range(0, len(drawn), 10)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=MER).as_bytes()
    except zstandard.ZstdError:  # too little variety to train on: all of it fits
        order = np.argsort(-frequency, kind="stable")
        return b"".join(windows[i] for i in order[: DICTIONARY_BYTES // 4] if frequency[i])[-DICTIONARY_BYTES:]


def evidence_of_toxicity(in_toxic: np.ndarray, in_ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of windows that toxic texts have more often than their share, 0 for
    those within what chance brings about among so many windows (2 ln of their number)."""

    share, both = toxic.mean(), in_toxic + in_ordinary
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(in_toxic > 0, in_toxic * np.log(in_toxic / (both * share)), 0) + np.where(in_ordinary > 0, in_ordinary * np.log(in_ordinary / (both * (1 - share))), 0))
    return np.where((in_toxic > both * share) & (ratio > 2 * np.log(len(both))), ratio, 0)


def one_of_each_kind(owner: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the texts left when near copies of an earlier one go: copies of one text are
    one piece of evidence, however many there are.  Texts are near copies when they share the
    ``LOWEST`` smallest hashes of their windows under one of ``HASHES`` hash functions."""

    kept, seen = [], set()
    hashed = np.stack([mixed(which.astype(np.uint64) + np.uint64((number + 1) << 40)) for number in range(HASHES)])
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for text in range(n):
        own = hashed[:, bounds[text] : bounds[text + 1]]
        keys = {(number, np.sort(own[number])[:LOWEST].tobytes()) for number in range(HASHES)}
        if keys.isdisjoint(seen):
            kept.append(text)
        seen |= keys
    return np.array(kept)


def fit(texts: list[str | None], toxic: np.ndarray, labelled: tuple[int, int] | None = None) -> ToxicityModel:
    """Learn from a bounded list of texts and their labels; ``labelled`` counts all ordinary and
    all toxic texts that the list was drawn from (without it, those of the list)."""

    if not toxic.any() or toxic.all():
        return ToxicityModel()
    labelled = labelled or (int((~toxic).sum()), int(toxic.sum()))
    windows, owner, which = distinct_windows(pa.array(texts, pa.string()))
    kept = one_of_each_kind(owner, which, len(texts))
    number = np.full(len(texts), -1)
    number[kept] = np.arange(len(kept))
    toxic, owner, which = toxic[kept], number[owner][number[owner] >= 0], which[number[owner] >= 0]
    in_toxic = np.bincount(which[toxic[owner]], minlength=len(windows))
    in_ordinary = np.bincount(which[~toxic[owner]], minlength=len(windows))
    telling = evidence_of_toxicity(in_toxic, in_ordinary, toxic)
    if not telling.any() or not in_ordinary.any():
        return ToxicityModel()
    rng = np.random.default_rng(0)
    model = ToxicityModel(trained(windows, telling, rng), trained(windows, in_ordinary, rng))
    step = model.gains(windows)[which]
    among = [np.bincount(step[toxic[owner] == label], minlength=len(model.weights)) + 1.0 for label in (True, False)]
    model.weights = np.log(among[0] / among[0].sum()) - np.log(among[1] / among[1].sum())
    x = model.evidence(np.bincount(owner, weights=model.weights[step], minlength=len(kept)), np.bincount(owner, minlength=len(kept)))
    of_class = np.array([labelled[label] / (toxic == label).sum() for label in (0, 1)])[toxic.astype(int)]
    model.logistic = logistic_regression(x, toxic, of_class / of_class.mean())
    return model


def logistic_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge, over rows of the given weights."""

    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        change = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta)), x.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += change
        if np.abs(change).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on the bounded sample of labelled rows of ``docs``."""

    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = [known.where(F.col("toxic") == label).orderBy(draw, "doc_id").limit(SAMPLE_OF_A_CLASS) for label in (0, 1)]
    labelled = {row.toxic: row.n for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # at most two rows
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * SAMPLE_OF_A_CLASS rows
    rows = docs.select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return fit([row.text for row in rows], np.array([row.toxic == 1 for row in rows], bool), (labelled.get(0, 0), labelled.get(1, 0)))


def judge(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Append score and predicted to every row of ``docs``, without a shuffle."""

    docs = docs.drop("score", "predicted")
    index, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, index, TEXT_BYTES):
                score = shared.value.score(part.column(index))
                arrays = [*part.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(fold("doc_id", 5) != 0))
    return judge(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
