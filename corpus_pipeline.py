"""A training corpus from raw documents: quality, repeated lines, near duplicates, repeated passages, packed sequences.

Every stage works on all rows that the one before kept and returns documents' columns, but the last, which returns the pieces.
Near duplicates share 0.8 of their five-word shingles or more; of each group the smallest doc_id stays.

Defined edges, for every stage: an empty table gives no rows. Columns beside doc_id and text go through as they are, whatever their names; only
n_chars follows a text that changes. Rows without a doc_id are judged by the quality stage alone, and packed. What null and empty texts, repeated rows
and ties do is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import lines, near_dup, packing, quality, suffixes
from corvane.llm.common import shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's trusted texts have too. Null texts are judged like empty ones; rows of equal text and language share their fate; without labels all stay."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three documents or more hold, except in the largest doc_id. Null texts stay null; a line that repeats within one document counts once; a doc_id's rows are one document."""
    return lines.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Null and empty texts are near nothing and stay; of a doc_id that repeats all rows stay or none; ties go to the smallest doc_id."""
    return near_dup.drop_near_duplicates(docs, words=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that start earlier: in a smaller doc_id, or before in the same text. Null and short texts stay as they are; of equal rows one counts as the earlier."""
    return suffixes.drop_repeated_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their places in training sequences. A null or empty text is one piece of one token; repeated rows are packed like any others; only doc_id and text are read."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near_duplicates", drop_near_copies), ("passages", drop_passages), ("packing", pack)]

#: Neither the language model nor the packing can be put in SQL: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
