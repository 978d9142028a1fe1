"""Severity, confidence and risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions.text import let

# Category -> (severity, confidence), in lookup order, and the default.
CATEGORY_RISK = {
    "APPLICATION": ("HIGH", 85),
    "NETWORK": ("HIGH", 80),
    "OPERATIONS": ("MEDIUM", 75),
    "SECRETS": ("CRITICAL", 90),
    "AUTHENTICATION": ("CRITICAL", 90),
    "AUTHORIZATION": ("HIGH", 85),
    "XSS": ("HIGH", 85),
    "INJECTION": ("CRITICAL", 90),
    "SSRF": ("HIGH", 80),
    "CORS": ("MEDIUM", 75),
    "LOGGING": ("MEDIUM", 70),
    "DEBUG": ("HIGH", 80),
    "CONFIG": ("MEDIUM", 75),
    "DEPENDENCIES": ("MEDIUM", 70),
}
DEFAULT_RISK = ("MEDIUM", 70)

# Score weight and listing priority of each severity, and the defaults.
SEVERITY_WEIGHT = {"CRITICAL": 10, "HIGH": 8, "MEDIUM": 5, "LOW": 3, "INFO": 1}
DEFAULT_WEIGHT = 5
SEVERITY_PRIORITY = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4, "INFO": 5}
DEFAULT_PRIORITY = 3
# Severities from low to high, for the minimum-severity filter.
SEVERITY_ORDER = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def _lookup(value: Column, table: dict, default):
    """Value of an exact key in a small fixed table."""
    place = F.array_position(F.lit(list(table)), value).cast("int")
    values = F.lit([default, *table.values()])
    return F.element_at(values, F.coalesce(place, F.lit(0)) + 1)


def _risk_place(category: Column) -> Column:
    """Place of the category's entry in the risk table, from 1; 0 for the default.

    The exact key, else the first key that holds the category or is held by it, in any case.
    """
    exact = F.array_position(F.lit(list(CATEGORY_RISK)), category)
    near = let(
        F.lower(category),
        lambda low: F.array_position(
            F.transform(
                F.lit([key.lower() for key in CATEGORY_RISK]),
                lambda key: F.contains(low, key) | F.contains(key, low),
            ),
            F.lit(True),
        ),
    )
    return F.when(exact > 0, exact).otherwise(near).cast("int")


def risk(category: Column) -> Column:
    """(severity, confidence) of a category."""
    table = [DEFAULT_RISK, *CATEGORY_RISK.values()]
    place = _risk_place(category) + 1
    return F.struct(
        F.element_at(F.lit([severity for severity, _ in table]), place).alias("severity"),
        F.element_at(F.lit([confidence for _, confidence in table]), place).alias("confidence"),
    )


def risk_score(severity: Column, confidence: Column) -> Column:
    """Weight of the severity times confidence in percent, truncated."""
    weight = _lookup(F.upper(severity), SEVERITY_WEIGHT, DEFAULT_WEIGHT)
    return (weight * (confidence / F.lit(100.0))).cast("int")


def severity_priority(severity: Column) -> Column:
    return _lookup(F.upper(severity), SEVERITY_PRIORITY, DEFAULT_PRIORITY)


def classify(findings: DataFrame) -> DataFrame:
    """Overwrite severity and confidence from the category, and add the score."""
    found = risk(F.coalesce(F.col("category"), F.lit("UNKNOWN")))
    return (
        findings.withColumn("_risk", found)
        .withColumn("severity", F.col("_risk.severity"))
        .withColumn("confidence", F.col("_risk.confidence"))
        .withColumn("risk_score", risk_score(F.col("_risk.severity"), F.col("_risk.confidence")))
        .drop("_risk")
    )


def at_least(findings: DataFrame, minimum: str = "MEDIUM") -> DataFrame:
    """Findings of at least this severity; a missing one counts as MEDIUM, an unknown one raises."""
    if minimum.upper() not in SEVERITY_ORDER:
        raise ValueError(f"{minimum!r} is not a severity")
    level = F.upper(F.coalesce(F.col("severity"), F.lit("MEDIUM")))
    place = F.array_position(F.lit(list(SEVERITY_ORDER)), level)
    rank = F.when(place > 0, place).otherwise(
        F.raise_error(F.concat(level, F.lit(" is not a severity"))).cast("bigint")
    )
    return findings.filter(rank > SEVERITY_ORDER.index(minimum.upper()))
