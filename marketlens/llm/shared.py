"""Helpers shared by the operators: tables, stored intermediates, scale settings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marketlens.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with numbered columns, but for ``text``, so that none clashes with added ones."""
    return docs.toDF(*(c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)))
