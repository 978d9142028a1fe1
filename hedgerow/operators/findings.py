"""The findings table: schema, union, numbering, dedup and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.catalogue import noise
from hedgerow.functions.numbering import first_per, number_rows
from hedgerow.functions.scratch import stage
from hedgerow.functions.text import contains_any

_FIELDS = {
    T.StringType(): (
        "finding_id cwe category name file snippet status severity description endpoint "
        "parameter payload evidence url technique remediation owasp"
    ),
    T.IntegerType(): "line confidence risk_score",
    T.TimestampType(): "ts",
}
_ORDER = (
    "finding_id cwe category name file line snippet status severity confidence description ts "
    "endpoint parameter payload evidence url technique remediation owasp risk_score"
)
_TYPES = {name: kind for kind, names in _FIELDS.items() for name in names.split()}
FINDINGS_SCHEMA = T.StructType([T.StructField(name, _TYPES[name]) for name in _ORDER.split()])


def conform(findings: DataFrame, *more: str) -> DataFrame:
    """The fixed findings columns, and `more`; what a producer does not have is null."""
    present = set(findings.columns)
    return findings.select(
        *(
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FINDINGS_SCHEMA
        ),
        *more,
    )


def stamped(findings: DataFrame) -> DataFrame:
    """With the time of the run."""
    return findings.withColumn("ts", F.current_timestamp())


def union_findings(*producers: DataFrame) -> DataFrame:
    """All findings of all producers; nothing is removed."""
    return reduce(DataFrame.unionByName, [conform(p) for p in producers])


def with_running_ids(findings: DataFrame, prefix, *order: str, width: int = 0) -> DataFrame:
    """`finding_id` as prefix and running number from 0, in the given order.

    `prefix` is a text such as `EP`, or a column; `width` pads the number with zeros (at least).
    """
    numbered = number_rows(findings.drop("finding_id"), *order, column="_n")
    number = F.col("_n").cast("string")
    if width:
        number = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return numbered.withColumn("finding_id", F.concat(head, F.lit("-"), number)).drop("_n")


def category_prefix():
    """First four letters of the category, upper case (`SQL Injection` gives `SQL `)."""
    return F.upper(F.substring("category", 1, 4))


def ordered(findings: DataFrame) -> DataFrame:
    """Stable result order of a file scan.

    Sorting samples its input, so the findings are staged rather than scanned for twice.
    """
    return stage(findings, "findings").orderBy("file", "rule_ord", "line")


def keep_first(findings: DataFrame, keys, *order: str) -> DataFrame:
    """The first finding of each key by `order`."""
    carry = [c for c in findings.columns if c not in keys]
    return first_per(findings, list(keys), list(order), carry).select(*findings.columns)


def deduplicate_xss(findings: DataFrame, *order: str) -> DataFrame:
    """First finding per (site, endpoint, parameter, payload)."""
    return keep_first(findings, ["site", "endpoint", "parameter", "payload"], *order)


def likely_real(findings: DataFrame) -> DataFrame:
    """Post-filter of likely real findings.

    Hashed scripts and library files go. What is left is kept for a telling snippet, and kept for
    the category NETWORK: a finding with both is there twice.
    """
    file = F.coalesce(F.col("file"), F.lit(""))
    own = findings.filter(
        ~file.rlike(noise.HASHED_SCRIPT_PATTERN) & ~contains_any(file, noise.LIBRARY_WORDS)
    )
    telling = contains_any(F.coalesce(F.col("snippet"), F.lit("")), noise.REAL_SNIPPET_WORDS)
    network = F.coalesce(F.col("category") == noise.REAL_CATEGORY, F.lit(False))
    copies = telling.cast("int") + network.cast("int")
    return (
        own.withColumn("_copies", copies)
        .filter(F.col("_copies") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .drop("_copies", "_copy")
    )
