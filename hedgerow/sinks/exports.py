"""Findings as JSON, table, CSV and HTML.

Each format is a folder of part files written in parallel. Where order matters, part files follow
each other in name order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions.numbering import number_rows
from hedgerow.functions.scratch import stage
from hedgerow.functions.text import escape_html
from hedgerow.operators.findings import conform, likely_real
from hedgerow.plans.reports import report_header

# Columns of the CSV export, in order.
CSV_COLUMNS = (
    "finding_id", "category", "name", "file", "line", "status", "severity", "confidence",
    "description", "cwe",
)
# The text of an export without findings.
NO_FINDINGS = "No findings found"
# A total order over findings, for numbering and reports.
FINDING_ORDER = ("file", "line", "category", "name", "finding_id", "endpoint", "payload", "url")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _stored(findings: DataFrame) -> DataFrame:
    return conform(findings).withColumn("timestamp", iso_time(F.col("ts"))).drop("ts")


def write_json(findings: DataFrame, path: str) -> str:
    """One JSON object per finding; fields a finding does not have are left out."""
    _stored(findings).write.mode("overwrite").json(path)
    return path


def findings_table(findings: DataFrame, staged: bool = False) -> DataFrame:
    """Rows of the findings table: running id from 1, `file_path`, `line_num`, score 0 if none."""
    rows = _stored(findings).select(
        "finding_id", "cwe", "category", "name",
        F.col("file").alias("file_path"), F.col("line").alias("line_num"),
        "snippet", "status", "severity", "confidence", "description", "timestamp",
        F.coalesce("risk_score", F.lit(0)).alias("risk_score"),
    )
    lead = ["file_path", "line_num", "category", "name", "finding_id"]
    order = lead + [c for c in rows.columns if c not in lead]
    numbered = number_rows(rows, *order, column="id", start=1, staged=staged)
    return numbered.select("id", *rows.columns)


def write_table(
    findings: DataFrame, table: str = "security_findings", path: str | None = None,
    staged: bool = False,
) -> str:
    """Replace the findings table."""
    writer = findings_table(findings, staged).write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return table


def csv_rows(findings: DataFrame) -> DataFrame:
    """The CSV columns as text, empty where a finding has no value."""
    return conform(findings).select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS)
    )


def write_csv(findings: DataFrame, path: str) -> str:
    """CSV with a header; without findings, a text that says so."""
    rows = csv_rows(findings)
    if rows.isEmpty():
        spark = findings.sparkSession
        spark.createDataFrame([(NO_FINDINGS,)], "value string").write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").option("header", True).option("escape", '"').option(
            "emptyValue", ""
        ).csv(path)
    return path


_PAGE_HEAD = (
    '<!DOCTYPE html><html><head><meta charset="UTF-8"><title>Security findings</title><style>'
    "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;width:100%}"
    "td,th{border-bottom:1px solid #999;padding:.5em;text-align:left}"
    ".critical,.high{font-weight:bold}</style></head><body><h1>Security findings</h1>"
)
_TABLE_HEAD = (
    "<table><thead><tr><th>Severity</th><th>Category</th><th>Name</th><th>Location</th></tr>"
    "</thead><tbody>"
)


def html_lines(findings: DataFrame) -> DataFrame:
    """(part, file, line, ..., value): the report's head, one row per finding, and its foot."""
    rows = conform(findings)
    shown = lambda c, default="N/A": escape_html(F.coalesce(F.col(c).cast("string"), F.lit(default)))
    severity = shown("severity", "MEDIUM")
    body = rows.select(
        F.lit(1).alias("part"), *FINDING_ORDER,
        F.concat(
            F.lit('<tr><td><span class="'), F.lower(severity), F.lit('">'), severity,
            F.lit("</span></td><td>"), shown("category"), F.lit("</td><td>"), shown("name"),
            F.lit("</td><td>"), shown("file"), F.lit(":"), shown("line"), F.lit("</td></tr>"),
        ).alias("value"),
    )
    no_key = [F.lit(None).cast(body.schema[c].dataType).alias(c) for c in FINDING_ORDER]
    counts = report_header(findings)
    head = counts.select(
        F.lit(0).alias("part"), *no_key,
        F.concat(
            F.lit(_PAGE_HEAD), F.lit("<p>Total Findings: "), F.col("total"),
            F.lit("</p><p>Critical: "), F.col("critical"), F.lit("</p><p>High: "), F.col("high"),
            F.lit("</p><p>Medium: "), F.col("medium"), F.lit("</p>" + _TABLE_HEAD),
        ).alias("value"),
    )
    foot = findings.sparkSession.range(1).select(
        F.lit(2).alias("part"), *no_key, F.lit("</tbody></table></body></html>").alias("value")
    )
    return head.unionByName(body).unionByName(foot)


def write_html(findings: DataFrame, path: str) -> str:
    """HTML report; its part files in name order are the page."""
    # Counted for the head and listed for the body.
    return _write_html(stage(conform(findings), "report"), path)


def _write_html(findings: DataFrame, path: str) -> str:
    ordered = html_lines(findings).orderBy("part", *FINDING_ORDER)
    ordered.select("value").write.mode("overwrite").text(path)
    return path


def envelope_metadata(findings: DataFrame, target: str) -> DataFrame:
    """One row: target, time, number of findings and scanner name."""
    return findings.agg(F.count("*").alias("total_findings")).select(
        F.lit(target).alias("target"),
        iso_time(F.current_timestamp()).alias("timestamp"),
        "total_findings",
        F.lit("hedgerow framework scan").alias("scanner"),
    )


def write_envelope(findings: DataFrame, path: str, target: str) -> str:
    """`metadata` and `findings` side by side below the path."""
    kept = stage(conform(findings), "envelope")
    write_json(kept, f"{path}/findings")
    envelope_metadata(kept, target).write.mode("overwrite").json(f"{path}/metadata")
    return path


def write_all(findings: DataFrame, folder: str, table: str = "security_findings") -> dict:
    """Every format. Findings are staged once, so the scan behind them runs once."""
    kept = stage(conform(findings), "findings")
    return {
        "json": write_json(kept, f"{folder}/findings.json"),
        "table": write_table(kept, table, f"{folder}/findings.table", staged=True),
        "csv": write_csv(kept, f"{folder}/findings.csv"),
        "html": _write_html(kept, f"{folder}/report.html"),
    }


def write_likely_real(findings: DataFrame, path: str) -> str:
    """JSON of the likely real findings only."""
    return write_json(likely_real(conform(findings)), path)
