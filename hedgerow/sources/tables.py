"""Stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *columns: str, partitions: int | None = None) -> DataFrame:
    """Columns of a Parquet table, dealt to `partitions` if a number is given.

    A table of few row groups and heavy work on each row gains from it; others are read as they lie.
    """
    table = spark.read.parquet(path)
    table = table.select(*columns) if columns else table
    return table.repartition(partitions) if partitions else table
