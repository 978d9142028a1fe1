"""Stored findings and expected literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.operators.findings import FINDINGS_SCHEMA, conform

_STORED = T.StructType(
    [f for f in FINDINGS_SCHEMA if f.name != "ts"] + [T.StructField("timestamp", T.StringType())]
)


def read_findings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Findings from JSON, of any producer's shape.

    One finding per line splits across tasks; `multi_line` reads files that are one JSON array.
    """
    rows = spark.read.schema(_STORED).option("multiLine", multi_line).json(path)
    return conform(rows.withColumn("ts", F.try_to_timestamp("timestamp")))


def expected_literals(spark: SparkSession, checks: dict[str, list[str]]) -> DataFrame:
    """(path, literal) from a mapping of paths to the literals they should hold."""
    rows = [(path, literal) for path, literals in checks.items() for literal in literals]
    return spark.createDataFrame(rows, "path string, literal string")
