"""Security-findings analytics as Spark jobs."""

from hedgerow.functions.risk import at_least, classify, risk, risk_score
from hedgerow.operators.matchers import category_matches, match_files, rule_matches
from hedgerow.operators.pages import crawl_rows, crawl_summary, site_endpoints
from hedgerow.operators.responses import detect
from hedgerow.operators.rules import Rule, category_rules, stock_rules
from hedgerow.plans.scans import scan_framework, scan_tree, scan_web
from hedgerow.sinks.exports import write_all

__all__ = [
    "Rule", "at_least", "category_matches", "category_rules", "classify", "crawl_rows",
    "crawl_summary", "detect", "match_files", "risk", "risk_score", "rule_matches",
    "scan_framework", "scan_tree", "scan_web", "site_endpoints", "stock_rules", "write_all",
]
