"""Corpus pipeline: language ID, quality, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. Stages before the last
keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import language, near_duplicates, packing, quality
from barloom.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this a document's quality is rejected, as in the quality query.
LEAST_QUALITY = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    docs = docs.select(*COLUMNS)
    found = language.identify(docs, language.train_languages(docs))
    return found.where("not rejected").select(*COLUMNS)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    docs = docs.select(*COLUMNS)
    scored = quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")), "quality_score")
    return scored.where(F.col("quality_score") >= LEAST_QUALITY).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five words, 0.8), the smallest
    id; whole rows, so that an id on two texts loses neither's class."""
    return near_duplicates.one_of_each(docs.select(*COLUMNS), words=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of 4096."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 4096)


STAGES = [("language", keep_known_languages), ("quality", keep_good_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Classifiers and the search for near-duplicates have no SQL; the tests state the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
