"""Find-all extraction: secrets in whole texts, endpoints in lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions.numbering import first_per
from hedgerow.functions.patterns import can_match_sql, java_pattern
from hedgerow.functions.text import fold_sql, let_sql, preview, sql_text
from hedgerow.functions.urls import drop_trailing_slashes
from hedgerow.operators.lines import candidate_lines
from hedgerow.operators.rules import MODES, mode_patterns
from hedgerow.operators.noise import (
    is_build_artifact, is_minified, is_skipped_script_line,
)

# Secrets looked for in one page, in order.
PAGE_SECRETS = (
    ("API Key", r"""API_KEY\s*=\s*["\']([^"\']+)["\']"""),
    ("JWT Secret", r"""JWT_SECRET\s*=\s*["\']([^"\']+)["\']"""),
    ("OpenAI API Key", r"sk-[a-zA-Z0-9]{20,}"),
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}"),
    ("Webhook Secret", r"""webhook_secret\s*[:=]\s*["\']([^"\']+)["\']"""),
    ("Password", r"""password\s*[:=]\s*["\']([^"\']+)["\']"""),
)
# Secrets looked for in a site's front page, in order.
SITE_SECRETS = (
    ("API_KEY", r"""API_KEY\s*=\s*["\']([^"\']+)["\']"""),
    ("JWT_SECRET", r"""JWT_SECRET\s*=\s*["\']([^"\']+)["\']"""),
    ("OpenAI Key", r"sk-[a-zA-Z0-9]{20,}"),
    ("AWS Key", r"AKIA[0-9A-Z]{16}"),
    ("JWT Token", r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"),
    ("Private Key", r"BEGIN\s+(?:RSA|DSA|EC|OPENSSH)\s+PRIVATE\s+KEY"),
    ("Webhook Secret", r"""webhook_secret[_\s]*[:=][_\s]*["\']([^"\']+)["\']"""),
)
# Fixed value: endpoints of a live scan are longer than this.
MIN_ENDPOINT_CHARS = 3


def _find_all_sql(text: str, folded: str, patterns) -> str:
    """SQL array of (pat_ord, match_pos, value): every match of every pattern.

    The value is the first group if the pattern has one, else the whole match.
    """
    parts = []
    for i, pattern in enumerate(patterns):
        group = 1 if re.compile(pattern).groups else 0
        found = f"regexp_extract_all({text}, {sql_text(java_pattern(pattern))}, {group})"
        entry = f"named_struct('pat_ord', {i}, 'match_pos', _j, 'value', _v)"
        guard = can_match_sql(folded, [pattern])
        parts.append(f"CASE WHEN {guard} THEN transform({found}, (_v, _j) -> {entry}) END")
    return f"flatten(filter(array({', '.join(parts)}), _part -> _part IS NOT NULL))"


def _exploded(df: DataFrame, matches: str, *keys: str) -> DataFrame:
    rows = df.select(*keys, F.expr(f"explode_outer({matches}) AS _match"))
    return rows.filter(F.col("_match").isNotNull()).select(*keys, "_match.*")


def find_all(texts: DataFrame, *keys: str, content: str, patterns) -> DataFrame:
    """(keys, pat_ord, match_pos, value): every match in the whole text, in one pass."""
    matches = let_sql(
        f"named_struct('t', {content}, 'f', {fold_sql(content)})",
        "_c",
        f"CASE WHEN {can_match_sql('_c.f', patterns)} "
        f"THEN {_find_all_sql('_c.t', '_c.f', patterns)} END",
    )
    return _exploded(texts, matches, *keys)


def find_all_in_lines(
    texts: DataFrame, *keys: str, patterns, content: str = "content", script: bool = False,
    min_chars: int = 0, skip_minified: bool = False,
) -> DataFrame:
    """(keys, line, text, pat_ord, match_pos, value) over the lines of the texts.

    Lines of fewer than `min_chars` characters are left out. For scripts, so are module and console
    lines and, with `skip_minified`, minified files.
    """
    patterns = list(patterns)
    if script and skip_minified:
        texts = texts.filter(~is_minified(F.col(content)))
    lines = candidate_lines(
        texts, *keys, patterns=patterns, content=content, newline_only=True
    )
    if min_chars:
        lines = lines.filter(F.length("text") >= min_chars)
    if script:
        lines = lines.filter(~is_skipped_script_line(F.col("text")))
    return _exploded(lines, _find_all_sql("text", "folded", patterns), *keys, "line", "text")


def mode_matches(texts: DataFrame, *keys: str, content: str = "content", **cuts) -> DataFrame:
    """(mode, keys, line, text, pat_ord, match_pos, value): script lines against all scan modes.

    `cuts` are those of `find_all_in_lines`. The patterns of all modes are matched in one pass; a match then belongs to each mode that has
    its pattern, a lookup in a table of a few patterns.
    """
    patterns = mode_patterns("7")
    found = find_all_in_lines(texts, *keys, patterns=patterns, content=content, script=True, **cuts)
    modes = [[m for m in MODES if p in mode_patterns(m)] for p in patterns]
    lists = ", ".join("array(" + ", ".join(sql_text(m) for m in ms) + ")" for ms in modes)
    return found.select(
        F.explode(F.expr(f"element_at(array({lists}), pat_ord + 1)")).alias("mode"), *found.columns
    )


def endpoint_candidates(
    matches: DataFrame, *site: str, base_url: str, file: str | None = None, longer_than: int = 0
) -> DataFrame:
    """Values that look like a path, once per site: the first by (file, line, pattern, match).

    Values of `longer_than` characters or fewer are left out.
    """
    paths = matches.filter(
        (F.length("value") > longer_than) & F.startswith(F.col("value"), F.lit("/"))
    ).withColumn("snippet", preview(F.col("text"), 200))
    order = ([file] if file else []) + ["line", "pat_ord", "match_pos"]
    carry = [*order[:-1], "snippet", base_url]
    first = first_per(
        paths, [*site, "value"], order, [c for c in dict.fromkeys(carry) if c not in site]
    )
    full = F.concat(drop_trailing_slashes(F.col(base_url)), F.col("value"))
    return first.withColumn("full_url", full)


def discovered_endpoints(
    endpoints: DataFrame, reported: DataFrame, live: DataFrame, *keys: str
) -> DataFrame:
    """Crawled endpoints that are no build product, not reported before, and live."""
    return (
        endpoints.filter(~is_build_artifact("endpoint"))
        .join(reported.select(*keys), list(keys), "left_anti")
        .join(live.select(*keys), list(keys), "left_semi")
    )


def _named(catalogue) -> Column:
    names = ", ".join(sql_text(name) for name, _ in catalogue)
    return F.expr(f"element_at(array({names}), pat_ord + 1)")


def page_secrets(pages: DataFrame, *keys: str, content: str, url: str) -> DataFrame:
    """Findings for secrets in a page: one per match, empty matches left out."""
    rows = find_all(
        pages, *dict.fromkeys([*keys, url]), content=content,
        patterns=[p for _, p in PAGE_SECRETS],
    )
    name = _named(PAGE_SECRETS)
    return rows.filter(F.col("value") != "").select(
        *keys, "pat_ord", "match_pos",
        F.lit("secrets").alias("category"),
        F.concat(F.lit("Hardcoded "), name).alias("name"),
        F.concat(
            F.lit("Found "), name, F.lit(": "), preview(F.col("value"), 30), F.lit("...")
        ).alias("description"),
        F.lit("CRITICAL").alias("severity"),
        F.lit(100).alias("confidence"),
        F.col(url).alias("file"),
        F.lit(0).alias("line"),
        preview(F.col("value"), 100).alias("snippet"),
        F.lit("VULNERABLE").alias("status"),
    )


def site_secrets(pages: DataFrame, *keys: str, content: str) -> DataFrame:
    """Findings for secrets in a site's front page: one per match."""
    rows = find_all(pages, *keys, content=content, patterns=[p for _, p in SITE_SECRETS])
    name = _named(SITE_SECRETS)
    return rows.select(
        *keys, "pat_ord", "match_pos",
        F.lit("Hardcoded Secret").alias("category"),
        F.concat(F.lit("Hardcoded "), name).alias("name"),
        F.concat(
            F.lit("Found "), name, F.lit(": "), preview(F.col("value"), 30), F.lit("...")
        ).alias("description"),
        F.lit("CRITICAL").alias("severity"),
        F.lit(100).alias("confidence"),
        F.lit("/").alias("endpoint"),
        preview(F.col("value"), 200).alias("payload"),
        F.lit("CWE-798").alias("cwe"),
        F.lit("Move secrets to environment variables").alias("remediation"),
    )
