"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import (
    decontaminate, exact_dedup, jaccard_join, line_dedup, lm_scoring, merkle, mixing,
    periodic_runs, pii, quality, suffix_dedup, token_counts, token_files,
)
from marketlens.llm.shared import table


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, folder, "documents"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.classes(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(table(spark, folder, "documents"),
                          quality.graded(table(spark, folder, "labels")))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.removals(table(spark, folder, "documents"), passages=True)


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.occurrences(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_and_read(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.classes(table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.scores(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.summary(periodic_runs.runs(
        periodic_runs.looped(table(spark, folder, "documents"))))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verify(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_files": op8_token_files,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_counts": op10_token_counts,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle": op13_merkle,
}
