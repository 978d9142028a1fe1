"""Whole scans: a source tree, stored pages, captured responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.functions import urls
from hedgerow.functions.scratch import stage
from hedgerow.functions.text import preview
from hedgerow.operators.extract import (
    discovered_endpoints, endpoint_candidates, find_all_in_lines, page_secrets, site_secrets,
)
from hedgerow.operators.findings import (
    category_prefix, conform, deduplicate_xss, stamped, union_findings, with_running_ids,
)
from hedgerow.operators.lookups import owasp
from hedgerow.operators.matchers import match_files
from hedgerow.operators.pages import distinct_endpoints
from hedgerow.operators.responses import detect, live_endpoints
from hedgerow.operators.rules import MODES, accept_rules, mode_patterns, stock_rules
from hedgerow.sources.files import list_scanned, read_scanned, scan_counts, wanted_files
from hedgerow.sources.walk import RANGE_BYTES, read_ranges

# Detectors of captured responses that each scan mode adds.
MODE_DETECTORS = {
    "3": ("file_read_probe", "upload_probe"),
    "4": ("sensitive_api", "object_probe"),
    "5": ("cors_probe", "admin_probe", "debug_mode"),
    "6": ("reflected", "dom_sink", "parameter", "login_reflection"),
}
FRAMEWORK_DETECTORS = (
    "search_reflection", "fragment_reflection", "login_script", "database_error", "login_bypass",
    "template", "graphql", "command", "open_redirect", "internal_fetch", "file_read",
    "object_reference", "upload_accepted", "cors", "token", "admin_panel",
)


def scan_tree(
    spark: SparkSession, root: str, rules=None, hidden: bool = True, max_bytes: int | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Findings in the files below the root. Patterns that do not compile are left out;
    `rejected_patterns` gives them. Files of any size are scanned unless `max_bytes` is given; they are
    read in ranges of `range_bytes`.

    The walk needs a file system that pyarrow can open. With `hidden` false Spark's own source reads the
    tree instead: whole files of less than 2 GB, without names that start with `.` or `_`.
    """
    accepted, _ = accept_rules(spark, stock_rules() if rules is None else rules)
    if not hidden:
        return stamped(match_files(read_scanned(spark, root, max_bytes), accepted))
    return _scan_listed(list_scanned(spark, root), accepted, max_bytes, range_bytes)


def _scan_listed(listing: DataFrame, rules, max_bytes: int | None, range_bytes: int) -> DataFrame:
    texts = read_ranges(wanted_files(listing, max_bytes), range_bytes)
    return stamped(match_files(texts, rules, ranges=True))


def scan_tree_with_counts(
    spark: SparkSession, root: str, rules=None, max_bytes: int | None = None, range_bytes: int = RANGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """`scan_tree` and its counters (scanned, skipped), both from one listing; counting reads no file."""
    accepted, _ = accept_rules(spark, stock_rules() if rules is None else rules)
    listing = list_scanned(spark, root)
    return _scan_listed(listing, accepted, max_bytes, range_bytes), scan_counts(listing, max_bytes)


def rejected_patterns(spark: SparkSession, rules=None) -> DataFrame:
    """The patterns that a scan with these rules leaves out, with the reason."""
    return accept_rules(spark, stock_rules() if rules is None else rules)[1]


def _verified(candidates: DataFrame, responses: DataFrame, mode: str, name: str, file: str,
              confidence: int) -> DataFrame:
    """Findings for candidate endpoints (site, value, line, snippet) that were captured live."""
    live = live_endpoints(responses).withColumnRenamed("endpoint", "value")
    return candidates.join(live, ["site", "value"], "left_semi").select(
        "site",
        F.col("value").alias("endpoint"),
        F.lit("N/A").alias("cwe"),
        F.lit(mode).alias("category"),
        F.lit(name).alias("name"),
        F.col(file).alias("file"),
        "line", "snippet",
        F.lit("VULNERABLE").alias("status"),
        F.lit(MODES[mode][2]).alias("severity"),
        F.lit(confidence).alias("confidence"),
        F.concat(F.lit("Verified: "), F.col("value"), F.lit(" (200 OK)")).alias("description"),
    )


def endpoint_findings(pages: DataFrame, responses: DataFrame, mode: str, patterns=None) -> DataFrame:
    """Paths that the mode's patterns find in page lines and that were captured live."""
    patterns = mode_patterns(mode) if patterns is None else list(patterns)
    sited = pages.withColumn("site", urls.site(F.col("url")))
    matches = find_all_in_lines(
        sited, "page_id", "site", "url", patterns=patterns, content="html"
    )
    candidates = endpoint_candidates(matches, "site", base_url="url")
    return _verified(candidates, responses, mode, "Verified Endpoint Found", "url", 95)


def script_endpoint_findings(
    scripts: DataFrame, responses: DataFrame, reported: DataFrame, mode: str, patterns=None
) -> DataFrame:
    """The same for lines of stored scripts (site, name, content), less what pages reported."""
    patterns = mode_patterns(mode) if patterns is None else list(patterns)
    matches = find_all_in_lines(scripts, "site", "name", patterns=patterns, script=True)
    seen = reported.select("site", F.col("endpoint").alias("value")).distinct()
    candidates = endpoint_candidates(
        matches.withColumnRenamed("name", "script"), "site", base_url="site", file="script"
    ).join(seen, ["site", "value"], "left_anti")
    return _verified(candidates, responses, mode, "Verified Endpoint in JS", "script", 90)


def discovery_findings(
    pages: DataFrame, responses: DataFrame, reported: DataFrame
) -> DataFrame:
    """Crawled endpoints of each site that are live and not reported yet."""
    found = discovered_endpoints(
        distinct_endpoints(pages), reported.select("site", "endpoint").distinct(),
        live_endpoints(responses), "site", "endpoint",
    )
    return found.select(
        "site", "endpoint",
        F.lit("N/A").alias("cwe"),
        F.lit("endpoint").alias("category"),
        F.lit("Verified Discovered Endpoint").alias("name"),
        F.col("site").alias("file"),
        F.lit(0).alias("line"),
        preview(F.col("endpoint"), 200).alias("snippet"),
        F.lit("VULNERABLE").alias("status"),
        F.lit("MEDIUM").alias("severity"),
        F.lit(95).alias("confidence"),
        F.concat(F.lit("Verified: "), F.col("endpoint"), F.lit(" (200 OK)")).alias("description"),
    )


# Place of a finding in its scan: the part of the scan, then up to four values.
_PLACE = ("_part", "_a", "_b", "_c", "_d")


def _placed(findings: DataFrame, part: int, a, b, c, d) -> DataFrame:
    """The fixed columns with the place of each finding, for numbering."""
    place = [F.lit(part), a.cast("int"), b.cast("string"), c.cast("string"), d.cast("bigint")]
    columns = [v.alias(name) for v, name in zip(place, _PLACE)]
    kept = findings.select("*", *columns)
    return conform(kept, *_PLACE)


def _identified(prefix, *parts: DataFrame, width: int = 0) -> DataFrame:
    """All parts, numbered in order of place."""
    rows = reduce(DataFrame.unionByName, parts)
    return with_running_ids(rows, prefix, *_PLACE, width=width).drop(*_PLACE)


def _placed_detections(findings: DataFrame, part: int = 0) -> DataFrame:
    return _placed(
        findings, part, F.col("detector_ord"), F.col("site"), F.lit(""), F.col("resp_id")
    )


def scan_framework(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Framework scan: secrets of front pages and all framework detectors."""
    secrets = site_secrets(pages, "page_id", "url", content="html").withColumn(
        "owasp", owasp(F.col("category"))
    )
    return _identified(
        category_prefix(),
        _placed(
            secrets, 0, F.col("pat_ord"), F.col("url"), F.lpad(F.col("page_id"), 20, "0"),
            F.col("match_pos"),
        ),
        _placed_detections(detect(responses, FRAMEWORK_DETECTORS), 1),
        width=3,
    )


def scan_web(
    pages: DataFrame, responses: DataFrame, mode: str = "7", scripts: DataFrame | None = None
) -> DataFrame:
    """Web scan of stored pages, captured responses and, if there are any, stored scripts (site,
    name, content) in one of the modes 1 to 7. Findings are numbered per kind, as `EP-0`."""
    if mode not in MODES:
        raise ValueError(f"{mode!r} is not a scan mode")

    def placed(found: DataFrame, part: int) -> DataFrame:
        return _placed(
            found, part, F.lit(0), F.col("site"),
            F.concat_ws(" ", F.col("file"), F.col("endpoint")), F.col("line"),
        )

    reported = endpoint_findings(pages, responses, mode)
    if scripts is not None or mode in ("1", "7"):
        # Used again below.
        reported = stage(reported, "endpoints")
    endpoints = [placed(reported, 0)]
    if scripts is not None:
        in_scripts = stage(
            script_endpoint_findings(scripts, responses, reported, mode), "endpoints"
        )
        endpoints.append(placed(in_scripts, 1))
        reported = reported.unionByName(in_scripts)
    if mode in ("1", "7"):
        endpoints.append(placed(discovery_findings(pages, responses, reported), 2))
    parts = [_identified("EP", *endpoints)]
    if mode == "2":
        secrets = page_secrets(pages, "page_id", content="html", url="url")
        parts.append(_identified("SEC", _placed(
            secrets, 0, F.col("pat_ord"), F.col("file"), F.lpad(F.col("page_id"), 20, "0"),
            F.col("match_pos"),
        )))
    if mode in ("3", "4", "5"):
        prefix = F.upper(F.substring("category", 1, 3))
        parts.append(_identified(prefix, _placed_detections(detect(responses, MODE_DETECTORS[mode]))))
    if mode == "6":
        once = deduplicate_xss(detect(responses, MODE_DETECTORS[mode]), "detector_ord", "resp_id")
        parts.append(_identified("XSS", _placed_detections(once), width=3))
    if mode == "7":
        parts.append(scan_framework(pages, responses))
    return stamped(union_findings(*parts))
