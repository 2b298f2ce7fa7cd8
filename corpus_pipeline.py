"""A training corpus from raw documents, in five stages.

Each stage takes the rows that the one before has written and returns the columns of
``documents``; the last returns the index of the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import decontaminate, jaccard_join, mixing, quality, token_files
from marketlens.llm.shared import stored, table


def select_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose probability of the top grade is high enough."""
    return quality.select(docs, quality.graded(table(spark, folder, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files of the documents; their index."""
    return token_files.encode_and_read(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# The model, the hashes and the tokenizer are beyond SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
