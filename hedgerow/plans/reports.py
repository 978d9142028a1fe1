"""Counts and listings over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions.risk import SEVERITY_PRIORITY, severity_priority

# Rows of the listing.
LISTING_ROWS = 100


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity from critical to info; a missing one is MEDIUM, none has no row."""
    level = F.coalesce(F.col("severity"), F.lit("MEDIUM")).alias("severity")
    return (
        findings.groupBy(level)
        .agg(F.count("*").alias("findings"))
        .filter(F.col("severity").isin(*SEVERITY_PRIORITY))
        .orderBy(severity_priority(F.col("severity")))
    )


def category_counts(findings: DataFrame, *order: str) -> DataFrame:
    """Findings per category, most first; equal counts by first appearance in `order`."""
    name = F.coalesce(F.col("category"), F.lit("UNKNOWN")).alias("category")
    counted = findings.groupBy(name).agg(
        F.count("*").alias("findings"), F.min(F.struct(*order)).alias("_first")
    )
    return counted.orderBy(F.desc("findings"), "_first").drop("_first")


def severity_summary(findings: DataFrame) -> DataFrame:
    """Counts of the four reported severities in one row."""
    level = F.coalesce(F.col("severity"), F.lit("MEDIUM"))
    return findings.agg(
        *(F.count_if(level == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
    )


def report_header(findings: DataFrame) -> DataFrame:
    """Total and the three counts at the head of a report; a missing severity is not counted."""
    return findings.agg(
        F.count("*").alias("total"),
        *(
            F.count_if(F.col("severity") == s).alias(s.lower())
            for s in ("CRITICAL", "HIGH", "MEDIUM")
        ),
    )


def _pair(endpoint: str = "endpoint", parameter: str = "parameter") -> Column:
    return F.concat(F.col(endpoint), F.lit(":"), F.col(parameter))


def vulnerable_parameters(findings: DataFrame) -> DataFrame:
    """Distinct `endpoint:parameter` with a finding."""
    return findings.select(_pair().alias("parameter")).distinct()


def xss_summary(findings: DataFrame, tested: DataFrame) -> DataFrame:
    """One row: findings, vulnerable and tested parameters, critical and high findings.

    `tested` holds (endpoint, parameter) of the recorded probes.
    """
    found = findings.agg(
        F.count("*").alias("total_findings"),
        F.count_distinct(_pair()).alias("vulnerable_params"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
    )
    probes = tested.agg(F.count_distinct(_pair()).alias("tested_params"))
    # Two single rows side by side.
    return found.withColumn("_one", F.lit(1)).join(
        probes.withColumn("_one", F.lit(1)), "_one"
    ).drop("_one")


def endpoints_with_hit(endpoints: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """(endpoint, hit): whether some vulnerable `endpoint:parameter` starts with the endpoint.

    A pair is cut at the lengths that endpoints have, and nowhere else; its cuts are keys of an
    equi-join. The lengths are one row, as many numbers as endpoints have different lengths.
    """
    asked = endpoints.select("endpoint").distinct()
    lengths = asked.select(F.length("endpoint").alias("n")).distinct().agg(
        F.collect_set("n").alias("_lengths")
    )
    pairs = vulnerable.select(F.col("parameter").alias("_pair")).distinct()
    prefixes = pairs.withColumn("_one", F.lit(1)).join(
        F.broadcast(lengths.withColumn("_one", F.lit(1))), "_one"
    ).select(
        F.explode(
            F.transform(
                F.filter("_lengths", lambda n: n <= F.length("_pair")),
                lambda n: F.substring(F.col("_pair"), F.lit(1), n),
            )
        ).alias("endpoint")
    ).distinct()
    return asked.join(prefixes.withColumn("_hit", F.lit(True)), "endpoint", "left").select(
        "endpoint", F.coalesce("_hit", F.lit(False)).alias("hit")
    )


def scan_counters(counts: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: scanned and skipped files, and findings."""
    total = findings.agg(F.count("*").alias("findings")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def listing(findings: DataFrame, *order: str, rows: int | None = None) -> DataFrame:
    """Findings with shortened fields, in order: all of them, or the first `rows`."""
    place = F.coalesce(F.col("file"), F.lit(""))
    place = F.when(
        F.coalesce(F.col("line"), F.lit(0)) > 0,
        F.concat(place, F.lit(":"), F.col("line").cast("string")),
    ).otherwise(place)
    short = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("N/A")), 1, n)
    shown = findings.orderBy(*order)
    return (shown if rows is None else shown.limit(rows)).select(
        short("finding_id", 6).alias("id"),
        F.coalesce(F.col("severity"), F.lit("MEDIUM")).alias("severity"),
        short("category", 10).alias("category"),
        F.substring(place, 1, 23).alias("location"),
        short("description", 48).alias("description"),
    )


def xss_listing(findings: DataFrame) -> DataFrame:
    """Cross-site scripting findings with shortened fields, in order of the id's number."""
    number = F.regexp_extract("finding_id", r"(\d+)$", 1).try_cast("bigint")
    short = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("N/A")), 1, n).alias(c)
    return findings.orderBy(number, "finding_id").select(
        F.substring("finding_id", 1, 6).alias("id"), short("technique", 16),
        short("endpoint", 13), short("parameter", 10), short("payload", 33),
        F.concat(F.coalesce("confidence", F.lit(0)).cast("string"), F.lit("%")).alias("confidence"),
    )


def framework_listing(numbered: DataFrame, number: str = "number") -> DataFrame:
    """Framework findings with their number and shortened fields, in order."""
    text = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return numbered.orderBy(number).select(
        F.col(number).cast("string").alias("number"),
        F.substring(text("category", "Unknown"), 1, 23).alias("category"),
        F.substring(text("name", ""), 1, 28).alias("name"),
        text("severity", "MEDIUM").alias("severity"),
        F.substring(text("endpoint", ""), 1, 18).alias("endpoint"),
    )
