"""Five stages that make a tokenized training corpus of ``documents``.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and
read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgraph.llm import decontaminate, language_id, line_dedup, ngram_join, sentencepiece_codec
from gridgraph.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts without a letter and ambiguous ones go."""
    return language_id.keep_known(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, exactly or within two edits;
    documents go that have no word in the other lines, or four fifths of whose text stand
    in one other document."""
    return _counted(line_dedup.drop_repeated_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents with five-word Jaccard 0.8 or more."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth, without these."""
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the decoded text, in place of the text."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.default_model()).drop("text")


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", decontamination), ("sentencepiece", tokens)]

#: SQL cannot express the stages' models and joins; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
