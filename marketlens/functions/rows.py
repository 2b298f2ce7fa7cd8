"""Global figures next to rows, without a join, rows spread over the cores, rows written down."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import shared_folder


def beside(rows: DataFrame, *singles: DataFrame) -> DataFrame:
    """``rows`` with the columns of frames that have one row each.

    Each frame is a scalar subquery: it is worked out once and its values are constants of the
    plan, so there is no join without keys.
    """
    for single in singles:
        value = single.select(F.struct(*single.columns)).scalar()
        rows = rows.withColumn("_single", value).select(*rows.columns, "_single.*")
    return rows


def spread(rows: DataFrame, key: str, least: int = 50_000) -> DataFrame:
    """Checkpointed ``rows`` in a part a core, for passes that cost more than their bytes tell.

    Small shuffle parts are merged by size, which leaves many narrow rows to a few tasks. A part
    keeps ``least`` rows; rows that are in enough parts already stay as they are.
    """
    wanted = min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // least)
    if wanted <= rows.rdd.getNumPartitions():
        return rows
    return rows.repartition(wanted, key).sortWithinPartitions(key).checkpoint()


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, for plans that read them more than once."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
