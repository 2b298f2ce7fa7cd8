"""Read and write the six tables as files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators.bi import daily_aggregate
from marketlens.operators.dashboard import data_dictionary
from marketlens.plans.tables import Tables
from marketlens.schemas import DEFAULTS, SCHEMAS

# Column a fact is ordered by on disk, so that file statistics can skip by date.
TIME_COLUMNS = {"transactions": "transaction_date", "betting_activity": "bet_date",
                "sessions": "start_time"}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns by name in the fixed schema; absent ones are NULL, defaults filled in."""
    present = {c.lower(): c for c in df.columns}
    defaults = DEFAULTS.get(table, {})
    out = []
    for field in SCHEMAS[table].fields:
        source = present.get(field.name)
        column = F.col(f"`{source}`") if source else F.lit(None)
        column = column.cast(field.dataType)
        if field.name in defaults:
            column = F.coalesce(column, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(column.alias(field.name))
    return df.select(*out)


def read_table(spark: SparkSession, folder: str, table: str, format: str = "csv") -> DataFrame:
    """One table from ``<folder>/<table>.<format>``, a file or a folder of part files.

    CSV is matched by header name, as column order differs between producers; types come
    from the fixed schema, never from inference. A missing input raises.
    """
    reader = spark.read
    if format == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    return conform(reader.format(format).load(f"{folder}/{table}.{format}"), table)


def load_tables(spark: SparkSession, folder: str, as_of: dt.date, format: str = "csv") -> Tables:
    """All six tables; each is opened when an operator first names it."""
    builders = {
        name: (lambda name=name: read_table(spark, folder, name, format))
        for name in Tables.NAMES
    }
    return Tables(as_of, **builders)


def write_tables(t: Tables, folder: str, format: str = "parquet") -> None:
    """Overwrite one dataset per table.

    Parquet facts are range-partitioned and sorted by time: day and window filters then
    skip most row groups. They are not bucketed by customer, since one bucket is read by
    one task and a single customer may own a large part of the rows.
    """
    for name in t.NAMES:
        df = getattr(t, name)
        if format == "parquet" and name in TIME_COLUMNS:
            df = df.repartitionByRange(TIME_COLUMNS[name]).sortWithinPartitions(TIME_COLUMNS[name])
        writer = df.write.mode("overwrite")
        if format == "csv":
            writer = writer.option("header", True)
        writer.format(format).save(f"{folder}/{name}.{format}")


def write_data_dictionary(t: Tables, folder: str) -> None:
    """Counts, dates and value lists as one JSON record."""
    row = data_dictionary(t).withColumn("as_of", t.today)
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/data_dictionary.json")


def write_daily_aggregate(t: Tables, folder: str, years: int = 2,
                          active_days: int | None = None) -> None:
    """Daily extract partitioned by month; only the months present are replaced.

    The extract starts with a whole month, so a replaced month is never a partial one.
    """
    rows = daily_aggregate(t, years, active_days, whole_months=True).withColumn(
        "month", F.date_format("date", "yyyy-MM"))
    rows.repartition("month").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("month").parquet(folder)


def persist_tables(t: Tables) -> Tables:
    """Keep the tables in memory or on disk for repeated use; ``unpersist`` them after."""
    return Tables(t.as_of, **{name: getattr(t, name).persist() for name in t.NAMES})
