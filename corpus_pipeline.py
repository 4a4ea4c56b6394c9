"""A training corpus from the table documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads what it
wrote. The first three return the columns of ``docs`` and fewer rows, the fourth adds
nothing to them but repeats a document as often as the mix takes it and writes the rows in
the order of the mix, the last encodes.

Defined cases: a text that is null, empty or without a letter goes in the language stage
at the latest. Null languages and labels teach nothing, a null source is a source of its
own, a null id is told apart by its text. Rows that repeat an id are told apart by
their texts in the near-duplicates stage. Further columns are passed on as they are. Empty tables give none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import language, mixing, pieces, quality, simhash
from spanloom.llm.common import read, remove, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier scores 0.5 or more."""
    return quality.keep_good(docs, quality.learned(docs, read(spark, sf_dir, "labels"), quality.may_learn()))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have letters and that a learned language codes no worse than byte by byte, but for a few odd words."""
    return language.keep_known(docs, language.learned(docs))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: its words over the document's, to the nearest whole number."""
    return mixing.mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded."""
    return pieces.encode(docs, pieces.model_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near-duplicates by SimHash", neardup_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: Training, hashing and tokenising have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result goes through Parquet files in the shared folder."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
