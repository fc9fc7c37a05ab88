"""Corpus pipeline: language ID, near duplicates, decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on every row of ``docs``; all but the
last return the columns of ``docs``.  ``run`` writes each result as Parquet in the
shared checkpoint folder and reads it again, so a lost executor costs one stage at most.

Rows with nulls are kept unless a stage says otherwise: a text without a letter (null
included) is rejected by language ID; rows without a doc_id have no near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom.llm import decontamination, language_id, near_duplicates, source_mix, token_files
from stockroom.llm.common import fold, table
from stockroom.session import ScratchTable, checked_broadcast

MIN_LANGUAGE_SCORE = 0.2  # share of a text's n-grams that its language must know
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the others, and those without a letter, go."""

    model = language_id.learn(docs.where(fold("doc_id", 4) != 2).select("text", "lang"))
    scored = language_id.identify(docs, model, predicted="__lang_pred", score="__lang_score")
    known = (F.col("__lang_pred") != language_id.UNDETERMINED) & (F.col("__lang_score") >= MIN_LANGUAGE_SCORE)
    return scored.where(known).select(*(f"`{c}`" for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, in one row."""

    groups = ScratchTable(near_duplicates.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT), "groups").df
    dropped = groups.where("doc_id != component_id").select("doc_id").distinct()
    first = docs.join(checked_broadcast(dropped), "doc_id", "left_anti")
    repeated = checked_broadcast(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    in_row = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = first.join(repeated, "doc_id", "left_semi").withColumn("__row", in_row).where("__row = 1").drop("__row")
    return first.join(repeated, "doc_id", "left_anti").unionByName(one).select(*(f"`{c}`" for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""

    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""

    return source_mix.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document what reading them back gives."""

    return token_files.token_files(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("source_mix", mix_sources),
    ("token_files", write_token_files),
]

# SQL can express neither the language model nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ScratchTable(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
