"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  A runner writes what a stage returns as Parquet
and gives the re-read table to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strideline.llm import langid, line_dedup, mixing, near_dup
from strideline.llm.queries import bpe_digests, read_table
from strideline.llm.scratch import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text of a language."""
    return langid.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; every document stays."""
    return line_dedup.drop_repeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return near_dup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those it does not take go."""
    return mixing.repeat_to_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of its decoded text."""
    return bpe_digests(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot train or apply a network, nor sketch and align texts; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
