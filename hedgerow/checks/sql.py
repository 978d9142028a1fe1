"""SQL for DuckDB that states what the Spark queries should return.

It is written from the semantics, not from the Spark code: plain regexes with one test per pattern,
windows over all lines, and row numbers for first hits.
"""

from __future__ import annotations

import re

from hedgerow.catalogue import noise, web
from hedgerow.catalogue.categories import CATEGORY_PATTERNS
from hedgerow.checks.planted import FILES_SQL, PAGES_SQL, RESPONSES_SQL, quote
from hedgerow.functions.risk import CATEGORY_RISK
from hedgerow.operators.lookups import OWASP
from hedgerow.operators.pages import SCRIPT_ENDPOINT_PATTERNS
from hedgerow.operators.rules import MODES

_SPACE = (
    r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def strip(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace({text}, {quote('^' + _SPACE + '+')}, ''), "
        f"{quote(_SPACE + '+$')}, '')"
    )


def found(text: str, pattern: str) -> str:
    """Whether a pattern is found, without regard to case.

    RE2 has no look-ahead: the three patterns that use one are put in other words.
    """
    if pattern == r"/admin.*(?!.*auth)":
        pattern = "/admin"
    tail = "(?!.*@login_required)"
    if pattern.endswith(tail):
        head = pattern[: -len(tail)]
        return (
            f"(regexp_matches({text}, {quote(head)}, 'i') AND NOT "
            f"regexp_matches({text}, {quote(head + '.*@login_required')}, 'i'))"
        )
    return f"regexp_matches({text}, {quote(pattern)}, 'i')"


def any_found(text: str, patterns) -> str:
    return found(text, "|".join(f"(?:{p})" for p in patterns))


def one_of(text: str, values) -> str:
    return f"{text} IN ({', '.join(quote(v) for v in values)})"


# --- files and lines -----------------------------------------------------------------------------


def extension(path: str) -> str:
    name = f"regexp_extract({path}, '[^/]*$', 0)"
    return f"lower(regexp_extract({name}, '^\\.*[^.].*(\\.[^.]*)$', 1))"


def scanned_extension(path: str) -> str:
    return one_of(extension(path), noise.SCAN_EXTENSIONS)


def skipped_dir(path: str) -> str:
    inside = " OR ".join(f"contains('/' || lower({path}), '/{d}/')" for d in noise.SKIP_DIRS)
    return f"({inside})"


def noise_path(path: str) -> str:
    name = f"regexp_extract({path}, '[^/]*$', 0)"
    return (
        f"({any_found(name, noise.SKIP_BASENAME_PATTERNS)} OR {skipped_dir(path)} "
        f"OR {any_found(path, noise.SKIP_PATH_PATTERNS)})"
    )


def noise_line(text: str) -> str:
    return (
        f"({text} = '' OR starts_with({text}, '//') OR starts_with({text}, '/*') OR "
        f"{one_of(text, noise.LONE_TOKENS)} OR {any_found(text, noise.SKIP_LINE_PATTERNS)})"
    )


def build_artifact(endpoint: str) -> str:
    return any_found(endpoint, noise.BUILD_ARTIFACT_PATTERNS)


LINES = (
    f"parts AS (SELECT path, string_split_regex(content, {quote(_BREAKS)}) AS ps FROM files), "
    "whole AS (SELECT path, CASE WHEN ps[len(ps)] = '' THEN ps[1:len(ps) - 1] ELSE ps END AS ps "
    "FROM parts), "
    "numbered AS (SELECT path, CAST(generate_subscripts(ps, 1) AS INTEGER) AS line, "
    "unnest(ps) AS raw FROM whole), "
    f"texts AS (SELECT path, line, raw, {strip('raw')} AS text FROM numbered)"
)
CONTEXT = (
    f"context AS (SELECT *, bool_or({any_found('raw', noise.SANITISER_WORDS)}) OVER "
    "(PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS sanitised "
    "FROM texts)"
)
_SOURCES = {
    "files": FILES_SQL,
    "plain": "files AS (SELECT 'd' || doc_id AS path, text AS content FROM documents)",
    "conversations": (
        "files AS (SELECT 'c' || conv_id || '/' || turn AS path, text || chr(10) || CASE turn % 3 "
        "WHEN 0 THEN 'token = \"abc-123\"' WHEN 1 THEN 'plain' ELSE 'secret: \"s-1\"' END AS content "
        "FROM conversations)"
    ),
}


def source(name: str) -> str:
    """The common table `files` (path, content)."""
    return _SOURCES[name]


def _first_label(category: str) -> str:
    cases = " ".join(
        f"WHEN {found('text', p)} THEN {quote(label)}" for p, label in CATEGORY_PATTERNS[category]
    )
    return f"CASE {cases} END"


def category_matches(categories, source: str = "files", severity: str = "HIGH") -> str:
    items = ", ".join(
        "{" + f"'category': {quote(c)}, 'name': {_first_label(c)}" + "}" for c in categories
    )
    return (
        f"WITH {_SOURCES[source]}, {LINES}, {CONTEXT}, hits AS (SELECT path, line, text, sanitised, "
        f"unnest([{items}], recursive := true) FROM context WHERE NOT {noise_line('text')}) "
        "SELECT 'AS-' || category || '-' || line AS finding_id, 'N/A' AS cwe, category, name, "
        "path AS file, line, substr(text, 1, 200) AS snippet, "
        "CASE WHEN sanitised THEN 'SANITIZED' ELSE 'VULNERABLE' END AS status, "
        f"'{severity}' AS severity, CAST(CASE WHEN sanitised THEN 50 ELSE 80 END AS INTEGER) AS "
        "confidence, name || ' detected' || CASE WHEN sanitised THEN ' (sanitized)' ELSE '' END AS "
        "description FROM hits WHERE name IS NOT NULL"
    )


def _covers(rule) -> str:
    if "" in rule.file_exts:
        return "true"
    ends = " OR ".join(f"suffix(path, {quote(e)})" for e in rule.file_exts)
    return f"({ends} OR {one_of('ext', rule.file_exts)})"


class rule_matches:
    """Findings of rules with own patterns."""

    def __init__(self, rules):
        self.rules = rules

    def rows(self) -> str:
        items = ", ".join(
            "{" + f"'hit': {_covers(r)} AND {any_found('text', r.vuln_patterns)}, "
            f"'category': {quote(r.category)}, 'name': {quote(r.name)}, 'cwe': {quote(r.cwe)}, "
            f"'severity': {quote(r.severity)}, 'confidence': {r.confidence}, "
            f"'description': {quote(r.vuln_desc)}" + "}"
            for r in self.rules
        )
        return (
            f"WITH {FILES_SQL}, {LINES}, extended AS (SELECT *, {extension('path')} AS ext FROM "
            f"texts WHERE NOT {noise_line('text')}), hits AS (SELECT path, line, text, "
            f"unnest([{items}], recursive := true) FROM extended) "
            "SELECT 'AS-' || category || '-' || line AS finding_id, cwe, category, name, "
            "path AS file, line, substr(text, 1, 200) AS snippet, 'VULNERABLE' AS status, severity, "
            "CAST(confidence AS INTEGER) AS confidence, description FROM hits WHERE hit"
        )

    def count_by(self, *keys: str) -> str:
        names = ", ".join(keys)
        return f"SELECT {names}, count(*) AS findings FROM ({self.rows()}) GROUP BY {names}"


def user_rules(rules) -> str:
    """One rule with own patterns and one whose category is in the catalogue."""
    own, catalogued = rules
    base = category_matches([catalogued.category.lower()], severity=catalogued.severity)
    return (
        f"{rule_matches([own]).rows()} UNION ALL SELECT finding_id, {quote(catalogued.cwe)} AS cwe, "
        "category, name, file, line, snippet, status, severity, confidence, description FROM "
        f"(SELECT *, file AS path, {extension('file')} AS ext FROM ({base})) WHERE "
        f"{_covers(catalogued)}"
    )


def rules_for_files(rules) -> str:
    items = ", ".join(
        "{" + f"'hit': {_covers(r)}, 'rule_ord': {i}, 'rule_id': {quote(r.rule_id)}" + "}"
        for i, r in enumerate(rules)
    )
    return (
        f"WITH {FILES_SQL}, extended AS (SELECT path, {extension('path')} AS ext FROM files), "
        f"pairs AS (SELECT path, unnest([{items}], recursive := true) FROM extended) "
        "SELECT path, CAST(rule_ord AS INTEGER) AS rule_ord, rule_id FROM pairs WHERE hit"
    )


def rule_trace(rules) -> str:
    items = ", ".join(
        "{" + f"'hit': {found('text', p)}, 'rule_id': {quote(r.rule_id)}, 'pat_ord': {j}, "
        f"'pattern': {quote(p)}" + "}"
        for r in rules
        for j, p in enumerate(r.vuln_patterns)
    )
    return (
        f"WITH {FILES_SQL}, {LINES}, hits AS (SELECT path, line, "
        f"unnest([{items}], recursive := true) FROM texts) SELECT path, line, rule_id, "
        "CAST(pat_ord AS INTEGER) AS pat_ord, pattern FROM hits WHERE hit"
    )


def pattern_hits(patterns) -> str:
    items = ", ".join(
        "{" + f"'hit': {found('text', p)}, 'pattern': {quote(p)}" + "}"
        for p in dict.fromkeys(patterns)
    )
    return (
        f"WITH {FILES_SQL}, {LINES}, hits AS (SELECT unnest([{items}], recursive := true) "
        "FROM texts) SELECT pattern, count(*) FILTER (hit) AS hits FROM hits GROUP BY pattern"
    )


# --- find-all ------------------------------------------------------------------------------------


def _all_matches(keys: str, text: str, source: str, patterns) -> str:
    """(keys, pat_ord, match_pos, value) of every match."""
    parts = [
        f"SELECT {keys}, {i} AS pat_ord, regexp_extract_all({text}, {quote(p)}, "
        f"{1 if re.compile(p).groups else 0}, 'i') AS ms FROM {source}"
        for i, p in enumerate(patterns)
    ]
    return (
        f"SELECT {keys}, CAST(pat_ord AS INTEGER) AS pat_ord, "
        "CAST(generate_subscripts(ms, 1) - 1 AS INTEGER) AS match_pos, unnest(ms) AS value "
        f"FROM ({' UNION ALL '.join(parts)}) WHERE len(ms) > 0"
    )


def _newline_lines(source: str, content: str, keys: str, script: bool) -> str:
    skips = " OR ".join(f"contains(text, {quote(s)})" for s in noise.SCRIPT_LINE_SKIPS)
    small = f"WHERE NOT (len(ps) < 5 AND length({content}) > 10000)" if script else ""
    return (
        f"nl AS (SELECT *, string_split({content}, chr(10)) AS ps FROM {source}), "
        f"nr AS (SELECT {keys}, CAST(generate_subscripts(ps, 1) AS INTEGER) AS line, "
        f"unnest(ps) AS raw FROM nl {small}), "
        f"nt AS (SELECT {keys}, line, {strip('raw')} AS text FROM nr), "
        f"long AS (SELECT * FROM nt WHERE length(text) >= 10"
        + (f" AND NOT ({skips}))" if script else ")")
    )


def find_all_lines(patterns, script: bool) -> str:
    return (
        f"WITH {FILES_SQL}, {_newline_lines('files', 'content', 'path', script)} "
        + _all_matches("path, line", "text", "long", patterns)
    )


def mode_counts(mode: str, patterns) -> str:
    return (
        f"WITH {FILES_SQL}, {_newline_lines('files', 'content', 'path', True)} "
        f"SELECT '{mode}' AS mode, '{MODES[mode][2]}' AS severity, "
        f"CAST({len(patterns)} AS BIGINT) AS patterns, count(*) AS matches FROM "
        f"({_all_matches('path, line', 'text', 'long', patterns)})"
    )


_SITE = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def endpoint_candidates(patterns) -> str:
    return (
        f"WITH {PAGES_SQL}, sited AS (SELECT *, {_SITE} AS site FROM planted), "
        f"{_newline_lines('sited', 'html', 'site', False)}, "
        f"m AS ({_all_matches('site, line', 'text', 'long', patterns)}), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY site, value ORDER BY line, pat_ord, "
        "match_pos) AS rn FROM m WHERE length(value) > 3 AND starts_with(value, '/')) "
        "SELECT site, value, line, pat_ord, site || value AS full_url FROM r WHERE rn = 1"
    )


def find_all(pattern: str) -> str:
    return (
        f"WITH {FILES_SQL} SELECT doc_id, match_pos, value FROM "
        f"({_all_matches('doc_id', 'content', 'files', [pattern])})"
    )


def secret_findings(catalogue, page: bool) -> str:
    names = ", ".join(quote(name) for name, _ in catalogue)
    rows = _all_matches("doc_id, path", "content", "files", [p for _, p in catalogue])
    head = (
        f"WITH {FILES_SQL}, m AS (SELECT *, [{names}][pat_ord + 1] AS kind FROM ({rows})) "
        "SELECT doc_id, 'Hardcoded ' || kind AS name, 'Found ' || kind || ': ' || "
        "substr(value, 1, 30) || '...' AS description, 'CRITICAL' AS severity, "
        "CAST(100 AS INTEGER) AS confidence, "
    )
    if page:
        return head + (
            "'secrets' AS category, path AS file, CAST(0 AS INTEGER) AS line, "
            "substr(value, 1, 100) AS snippet, 'VULNERABLE' AS status FROM m WHERE value <> ''"
        )
    return head + (
        "'Hardcoded Secret' AS category, '/' AS endpoint, substr(value, 1, 200) AS payload, "
        "'CWE-798' AS cwe FROM m"
    )


# --- pages ---------------------------------------------------------------------------------------


def authority(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def _path(url: str) -> str:
    whole = f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    return f"regexp_replace({whole}, ';[^/]*$', '')"


def _keys(url: str) -> str:
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    return (
        f"list_transform(list_filter(string_split({query}, '&'), lambda p: contains(p, '=')), "
        "lambda p: string_split(p, '=')[1])"
    )


def _unescape(text: str) -> str:
    for reference, character in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, {quote(reference)}, {quote(character)})"
    return text


_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _attribute(tag: str, name: str, alias: str) -> str:
    # RE2 has no lookahead: a blank or slash, or nothing before the blank of the name
    inner = rf"""(?:[\s/](?:[^>"']*(?:"[^"]*"|'[^']*'))*?[^>"']*?)?"""
    pattern = rf"<{tag}{inner}\s{name}\s*=\s*{_VALUE}"
    raw = "regexp_replace(v, '^[\"''](.*)[\"'']$', '\\1', 's')"
    return (
        f"(SELECT page_id, url, CAST(generate_subscripts(vs, 1) - 1 AS INTEGER) AS pos, "
        f"unnest(list_transform(vs, lambda v: {_unescape(raw)})) AS {alias} FROM (SELECT page_id, url, "
        f"regexp_extract_all(markup, {quote(pattern)}, 1, 'is') AS vs FROM marked))"
    )


def _resolved(link: str) -> str:
    """Links of the pages: absolute, rooted, query, fragment, scheme and relative ones."""
    origin = "regexp_extract(base, '^([A-Za-z]+://[^/?#]*)', 1)"
    folder = f"regexp_replace({_path('base')}, '[^/]*$', '')"
    folder = f"CASE WHEN {folder} = '' THEN '/' ELSE {folder} END"
    up = f"regexp_replace({folder}, '[^/]+/$', '')"
    return (
        f"CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link} "
        f"WHEN starts_with({link}, '//') THEN regexp_extract(base, '^[a-z]+:', 0) || {link} "
        f"WHEN starts_with({link}, '/') THEN {origin} || {link} "
        f"WHEN starts_with({link}, '?') THEN regexp_extract(base, '^[^?#]*', 0) || {link} "
        f"WHEN starts_with({link}, '#') THEN regexp_extract(base, '^[^#]*', 0) || {link} "
        f"WHEN starts_with({link}, '../') THEN {origin} || {up} || substr({link}, 4) "
        f"ELSE {origin} || {folder} || {link} END"
    )


def _script_endpoints() -> str:
    parts = " || ".join(
        f"regexp_extract_all(body, {quote(p)}, {2 if p.startswith('axios') else 1}, 'i')"
        for p in SCRIPT_ENDPOINT_PATTERNS
    )
    return f"list_filter({parts}, lambda e: starts_with(e, '/'))"


_IN_TAG = r"""(?:"[^"]*"|'[^']*'|[^>"'])*"""
_SCRIPT_TAG = rf"<script\b({_IN_TAG})>(.*?)</script\s*>"
_SCRIPT_OR_COMMENT = rf"(<script\b{_IN_TAG}>.*?</script\s*>)|<!--.*?-->"
_SCRIPT_BODY = rf"(<script\b{_IN_TAG}>).*?</script\s*>"
PAGE_PARTS = (
    "clean AS (SELECT page_id, url, rtrim(url, '/') AS base, "
    f"regexp_replace(html, {quote(_SCRIPT_OR_COMMENT)}, '\\1', 'gis') AS html FROM planted), "
    f"marked AS (SELECT page_id, url, base, regexp_replace(html, {quote(_SCRIPT_BODY)}, '\\1', 'gis') AS markup FROM clean), "
    f"hrefs AS (SELECT * FROM {_attribute('a', 'href', 'href')}), "
    f"targets AS (SELECT page_id, url, {_resolved(strip('href'))} AS link FROM "
    "(SELECT *, rtrim(url, '/') AS base FROM hrefs)), "
    f"links AS (SELECT DISTINCT page_id, url, link FROM targets WHERE {authority('link')} IN ('', {authority('url')})), "
    f"path_endpoints AS (SELECT page_id, url, {_path('link')} AS endpoint FROM links "
    f"WHERE {_path('link')} NOT IN ('', '/')), "
    "prefixes AS (SELECT page_id, url, string_split(" + _path("link") + ", '/') AS ps FROM links), "
    "prefix_endpoints AS (SELECT page_id, url, '/' || p AS endpoint FROM (SELECT page_id, url, "
    "unnest(list_transform(range(1, len(ps) + 1), lambda i: array_to_string(ps[1:i], '/'))) AS p "
    "FROM prefixes) WHERE p <> ''), "
    f"query_keys AS (SELECT page_id, url, unnest({_keys('link')}) AS key FROM links), "
    f"own_query_keys AS (SELECT page_id, url, unnest({_keys('url')}) AS key FROM planted), "
    "query_endpoints AS (SELECT page_id, url, '?' || key || '=' AS endpoint FROM query_keys), "
    f"srcs AS (SELECT page_id, url, pos, string_split(CASE WHEN starts_with(src, '//') THEN 'https:' "
    f"|| src ELSE {_resolved('src')} END, '?')[1] AS script FROM (SELECT *, rtrim(url, '/') AS base "
    f"FROM {_attribute('script', 'src', 'src')})), "
    "script_files AS (SELECT page_id, url, script, CAST(row_number() OVER (PARTITION BY page_id ORDER BY "
    f"min(pos)) - 1 AS INTEGER) AS pos, {_SITE} AS site FROM srcs WHERE suffix(script, '.js') "
    "GROUP BY page_id, url, script), "
    "blocks AS (SELECT page_id, url, unnest(regexp_extract_all(html, "
    f"{quote(_SCRIPT_TAG)}, 0, 'is')) AS block FROM clean), "
    f"bodies AS (SELECT page_id, url, regexp_extract(block, {quote(_SCRIPT_TAG)}, 1, 'is') AS head, "
    f"regexp_extract(block, {quote(_SCRIPT_TAG)}, 2, 'is') AS body FROM blocks), "
    f"script_endpoints AS (SELECT page_id, url, {_SITE} AS site, unnest({_script_endpoints()}) AS "
    "endpoint FROM bodies WHERE NOT regexp_matches(head, '(?:^|\\s)src\\s*=', 'i')), "
    f"data_urls AS (SELECT page_id, url, endpoint FROM "
    f"{_attribute('[a-z][a-z0-9-]*', 'data-url', 'endpoint')} WHERE endpoint <> ''), "
    f"form_actions AS (SELECT page_id, url, endpoint FROM {_attribute('form', 'action', 'endpoint')} "
    "WHERE endpoint <> ''), "
    f"endpoints AS (SELECT {_SITE} AS site, endpoint FROM (SELECT url, endpoint FROM path_endpoints "
    "UNION ALL SELECT url, endpoint FROM prefix_endpoints UNION ALL SELECT url, endpoint FROM "
    "query_endpoints UNION ALL SELECT url, endpoint FROM script_endpoints UNION ALL SELECT url, "
    "endpoint FROM data_urls UNION ALL SELECT url, endpoint FROM form_actions)), "
    "crawl_rows AS (SELECT site, 'js_file' AS kind, script AS value FROM script_files UNION ALL "
    f"SELECT {_SITE}, 'html_page', link FROM links UNION ALL SELECT site, 'endpoint', endpoint FROM "
    "endpoints)"
)


# --- captured responses --------------------------------------------------------------------------

LIVE = (
    "live_strict AS (SELECT DISTINCT site, endpoint FROM responses WHERE payload IS NULL AND "
    "method = 'GET' AND status = 200), "
    "live_lax AS (SELECT DISTINCT site, endpoint FROM responses WHERE payload IS NULL AND "
    "method = 'GET' AND status IN (200, 301, 302, 307, 308))"
)


def _has(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


_ESCAPED = (
    "replace(replace(replace(replace(payload, '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
    "'''', '&#39;')"
)
REFLECTED = (
    "(contains(body, payload) OR contains(body, replace(url_encode(payload), '%2F', '/')) OR "
    f"contains(body, {_ESCAPED}) OR "
    + _has("lower(body)", "<script>alert", "onerror=alert", "onload=alert", "javascript:alert",
           "confirm(", "prompt(")
    + ")"
)
_SIGNATURES = (
    "SQL syntax", "mysql_fetch", "ORA-", "PostgreSQL", "SQLite", "Unclosed quotation mark",
    "You have an error", "sql", "database", "query", "SELECT", "FROM", "WHERE",
)
_SIGNATURE = "CASE " + " ".join(
    f"WHEN contains(lower(body), {quote(s.lower())}) THEN {quote(s)}" for s in _SIGNATURES
) + " END"
_JWT = r"regexp_extract(body, 'eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}', 0)"
_LOW = "lower(body)"
_QUICK = ("<script>alert(1)</script>", "<img src=x onerror=alert(1)>", "<svg onload=alert(1)>")
_TEMPLATES = (
    "CASE payload WHEN '{{7*7}}' THEN 'Basic Math' WHEN '{{7*''7''}}' THEN 'String Multiplication' "
    "WHEN '{{config}}' THEN 'Config Access' WHEN '${7*7}' THEN 'Expression' WHEN "
    "'{{''''.__class__.__mro__}}' THEN 'Object Access' END"
)
_COMMANDS = (
    "CASE payload WHEN '; whoami' THEN 'Basic Command' WHEN '| whoami' THEN 'Pipe Command' WHEN "
    "'&& whoami' THEN 'AND Command' WHEN '$(whoami)' THEN 'Subshell' WHEN '`whoami`' THEN "
    "'Backtick' END"
)


def _xss(technique, confidence, where, live, scope=("endpoint",), parameter="parameter"):
    return dict(
        shape="xss", category="xss", name="'XSS Vulnerability'", severity="CRITICAL", cwe="CWE-79",
        description=f"'XSS vulnerability found in ' || endpoint || ' parameter ''' || {parameter} || ''''",
        technique=technique, confidence=confidence, where=where, live=live, scope=scope,
        parameter=parameter, payload="substr(payload, 1, 100)",
    )


def _framework(category, name, description, severity, confidence, cwe, where, **more):
    base = dict(
        shape="framework", category=category, name=name, description=description,
        severity=severity, confidence=confidence, cwe=cwe, where=where, live="lax",
        scope=("endpoint",), evidence="substr(body, 1, 200)", payload="payload",
    )
    return {**base, **more}


def _probe(category, name, description, severity, confidence, where, **more):
    base = dict(
        shape="probe", category=category, name=name, description=description, severity=severity,
        confidence=confidence, where=where, live="", scope=("endpoint",),
        snippet="substr(body, 1, 200)",
    )
    return {**base, **more}


_DETECTIONS = {
    "reflected": _xss(
        "Reflected XSS", 95,
        f"method = 'GET' AND {one_of('endpoint', web.TARGETED_ENDPOINTS)} AND parameter IN ('q', "
        f"'search', 'query', 'id', 'page', 'user') AND {one_of('payload', _QUICK)} AND {REFLECTED}",
        "strict",
    ),
    "dom_sink": _xss(
        "DOM-based XSS", 80,
        "endpoint = '/#' AND payload IN ('#<script>alert(1)</script>', '#<img src=x "
        "onerror=alert(1)>', '#<svg onload=alert(1)>', '#<body onload=alert(1)>', "
        "'javascript:alert(1)') AND regexp_matches(body, 'document\\.write|\\.innerHTML\\s*=|"
        "\\.outerHTML\\s*=|\\.insertAdjacentHTML|dangerouslySetInnerHTML|eval\\s*\\(|"
        "Function\\s*\\(', 'i')",
        "", ("endpoint", "payload"), "'hash'",
    ),
    "parameter": _xss(
        "Parameter XSS", 90,
        f"method = 'GET' AND {one_of('endpoint', web.TARGETED_ENDPOINTS)} AND parameter IN ('q', "
        "'search', 'query', 'id', 'user') AND payload IN ('<script>alert(1)</script>', "
        "'<script>alert(''XSS'')</script>', '<script>alert(document.domain)</script>') "
        f"AND {REFLECTED}",
        "strict", ("endpoint", "parameter"),
    ),
    "login_reflection": _xss(
        "Stored XSS (Login)", 85,
        "method = 'POST' AND endpoint = '/login' AND payload IN ('<script>alert(1)</script>', "
        "'<img src=x onerror=alert(1)>', '''\"><script>alert(1)</script>') "
        f"AND {REFLECTED}",
        "strict", parameter="'username'",
    ),
    "search_reflection": _framework(
        "XSS", "'Reflected XSS'", "'XSS via search parameter'", "CRITICAL", 95, "CWE-79",
        f"method = 'GET' AND endpoint = '/search' AND {one_of('payload', _QUICK)} "
        "AND contains(body, payload)",
    ),
    "fragment_reflection": _framework(
        "XSS", "'DOM XSS'", "'DOM-based XSS via URL fragment'", "CRITICAL", 85, "CWE-79",
        "endpoint = '/#' AND payload = '#<script>alert(1)</script>' AND contains(body, 'alert(1)')",
        live="", evidence="''",
    ),
    "login_script": _framework(
        "XSS", "'Stored XSS (Login)'", "'XSS in login response message'", "CRITICAL", 90, "CWE-79",
        "method = 'POST' AND endpoint = '/login' AND payload = '<script>alert(1)</script>' AND "
        "contains(body, '<script>alert(1)</script>')",
        evidence="''",
    ),
    "database_error": _framework(
        "SQL Injection", "'SQL Injection in ' || endpoint", f"'SQL error: ' || {_SIGNATURE}",
        "CRITICAL", 95, "CWE-89",
        "method = 'GET' AND parameter = 'id' AND endpoint IN ('/api/users', '/api/graphql', "
        f"'/search', '/login') AND payload IS NOT NULL AND {_SIGNATURE} IS NOT NULL",
        scope=("endpoint", "payload"),
    ),
    "login_bypass": _framework(
        "SQL Injection", "'Auth Bypass via SQL Injection'", "'Login bypass with: ' || payload",
        "CRITICAL", 100, "CWE-89",
        "method = 'GET' AND parameter = 'id' AND endpoint = '/login' AND contains(body, "
        "'Logged in as:')",
    ),
    "template": _framework(
        "SSTI", "'Server-Side Template Injection'", f"'Template injection with ' || {_TEMPLATES}",
        "CRITICAL", 90, "CWE-94",
        f"method = 'GET' AND endpoint = '/search' AND {_TEMPLATES} IS NOT NULL AND "
        f"{_has('body', '49', '7777777')}",
    ),
    "graphql": _framework(
        "GraphQL", "'GraphQL Data Exposure'", "'Sensitive data exposed via GraphQL'", "HIGH", 90,
        "CWE-200", "method = 'POST' AND endpoint = '/api/graphql' AND contains(body, 'password')",
    ),
    "command": _framework(
        "Command Injection", f"'Command Injection (' || {_COMMANDS} || ')'",
        "'Command execution with: ' || payload", "CRITICAL", 90, "CWE-78",
        f"method = 'GET' AND endpoint = '/api/webhook' AND {_COMMANDS} IS NOT NULL AND "
        f"{_has(_LOW, 'uid=', 'gid=', 'root', 'admin', 'windows')}",
    ),
    "open_redirect": _framework(
        "Open Redirect", "'Open Redirect'", "'Redirects to attacker.com'", "MEDIUM", 90, "CWE-601",
        "method = 'GET' AND parameter = 'redirect' AND endpoint IN ('/api/webhook', '/login') AND "
        "status IN (301, 302, 307, 308) AND contains(location, 'attacker.com')",
        evidence="''",
    ),
    "internal_fetch": _framework(
        "SSRF", "'Server-Side Request Forgery'", "'SSRF to internal resource: ' || payload", "HIGH",
        85, "CWE-918",
        "method = 'GET' AND parameter = 'url' AND endpoint = '/api/users' AND status = 200 AND "
        "length(body) > 50",
    ),
    "file_read": _framework(
        "Path Traversal", "'Path Traversal'", "'File access: ' || payload", "HIGH", 90, "CWE-22",
        "method = 'GET' AND parameter = 'file' AND endpoint = '/download' AND "
        + _has("body", "root:", "Windows"),
    ),
    "object_reference": _framework(
        "IDOR", "'IDOR in ' || endpoint", "'Access to resource ID: ' || payload", "HIGH", 85,
        "CWE-639",
        "method = 'GET' AND parameter = 'id' AND endpoint IN ('/api/users', '/profile', "
        "'/profile/[id]') AND status = 200 AND "
        + _has(_LOW, "user", "profile", "email", "password"),
    ),
    "upload_accepted": _framework(
        "File Upload", "'Unrestricted File Upload'", "'Uploaded executable file: ' || payload",
        "HIGH", 85, "CWE-434",
        "method = 'POST' AND endpoint = '/upload' AND " + _has(_LOW, "uploaded", "success"),
        evidence="''",
    ),
    "cors": _framework(
        "CORS Misconfiguration", "'Wildcard CORS'", "'CORS allows any origin on ' || endpoint",
        "MEDIUM", 95, "CWE-942",
        "method = 'OPTIONS' AND endpoint IN ('/api/users', '/api/profile', '/api/webhook') AND "
        "allowed = '*'",
        scope=(), payload="'*'", evidence="''",
        first="CASE endpoint WHEN '/api/users' THEN 1 WHEN '/api/profile' THEN 2 ELSE 3 END, ",
    ),
    "token": _framework(
        "JWT Weak Secret", "'JWT with Weak Secret'",
        f"'JWT token found: ' || substr({_JWT}, 1, 20) || '...'", "CRITICAL", 90, "CWE-312",
        f"method = 'GET' AND endpoint = '/api/users' AND payload IS NULL AND {_JWT} <> ''",
        live="", payload=f"substr({_JWT}, 1, 50)", evidence="''",
    ),
    "admin_panel": _framework(
        "No Authentication", "'Unprotected Admin Panel'",
        "'Admin panel accessible without authentication'", "CRITICAL", 100, "CWE-306",
        "method = 'GET' AND endpoint = '/admin' AND payload IS NULL AND "
        + _has("body", "Admin Panel", "Dashboard"),
        payload="''",
    ),
    "file_read_probe": _probe(
        "file", "'Path Traversal'", "'File access: ' || payload", "HIGH", 90,
        "method = 'GET' AND parameter = 'file' AND endpoint = '/download' AND "
        + _has("body", "root:", "Windows"),
    ),
    "upload_probe": _probe(
        "file", "'Unrestricted File Upload'", "'Uploaded PHP file successfully'", "HIGH", 85,
        "method = 'POST' AND endpoint = '/upload' AND " + _has(_LOW, "uploaded", "success"),
    ),
    "sensitive_api": _probe(
        "api", "'Sensitive Data Exposure in ' || endpoint", "'API exposes sensitive data'", "HIGH",
        85,
        "method = 'GET' AND endpoint IN ('/api/users', '/api/graphql', '/api/webhook', "
        "'/api/profile') AND payload IS NULL AND status = 200 AND "
        + _has("body", "password", "secret"),
    ),
    "object_probe": _probe(
        "api", "'IDOR in ' || parent", "'Access to user ID 1 without auth'", "HIGH", 80,
        "method = 'GET' AND endpoint IN ('/api/users/1', '/api/profile/1') AND payload IS NULL AND "
        "status = 200 AND contains(lower(body), 'user') AND (site, parent) IN (SELECT (site, "
        "endpoint) FROM live_strict)",
    ),
    "cors_probe": _probe(
        "misconfig", "'Wildcard CORS'", "'CORS allows any origin'", "MEDIUM", 95,
        "method = 'OPTIONS' AND endpoint = '/api/users' AND allowed = '*'",
        snippet="'Access-Control-Allow-Origin: *'",
    ),
    "admin_probe": _probe(
        "misconfig", "'Unprotected Admin Panel'", "'Admin panel accessible without auth'",
        "CRITICAL", 100,
        "method = 'GET' AND endpoint = '/admin' AND payload IS NULL AND status = 200 AND "
        + _has("body", "Admin", "Dashboard"),
    ),
    "debug_mode": _probe(
        "misconfig", "'Debug Mode Enabled'", "'Debug mode is enabled in production'", "HIGH", 80,
        "method = 'GET' AND endpoint = '/' AND payload IS NULL AND contains(lower(body), 'debug') "
        "AND contains(lower(body), 'true')",
        snippet="'Debug: True'",
    ),
}


_DETECTIONS["reflected"]["first"] = (
    f"list_position([{', '.join(map(quote, _QUICK))}], payload), "
    "list_position(['q', 'search', 'query', 'id', 'page', 'user'], parameter), "
)
# The probes of a site's login end at the first bypass.
_DETECTIONS["database_error"]["where"] += (
    " AND NOT (endpoint = '/login' AND (site, endpoint) IN (SELECT (site, endpoint) FROM live_lax) AND (site, payload_ord) IN "
    "(SELECT (l.site, l.payload_ord) FROM responses l JOIN (SELECT site, min(payload_ord) AS bypass FROM responses WHERE "
    "method = 'GET' AND parameter = 'id' AND endpoint = '/login' AND contains(body, 'Logged in as:') GROUP BY site) m "
    "ON l.site = m.site AND l.payload_ord > m.bypass))"
)


def _detection(id: str) -> str:
    d = _DETECTIONS[id]
    scope = ", ".join(["site", *d["scope"]])
    live = f" AND (site, endpoint) IN (SELECT (site, endpoint) FROM live_{d['live']})" if d["live"] else ""
    xss, probe = d["shape"] == "xss", d["shape"] == "probe"
    null = "CAST(NULL AS VARCHAR)"
    entry = {"xss": "'A03:2021 - Injection'", "probe": null}.get(d["shape"]) or owasp(quote(d["category"]))
    columns = {
        "detector": quote(id), "site": "site", "resp_id": "resp_id",
        "category": quote(d["category"]), "name": d["name"], "description": d["description"],
        "severity": quote(d["severity"]), "confidence": f"CAST({d['confidence']} AS INTEGER)",
        "endpoint": null if probe else "endpoint",
        "parameter": d.get("parameter", null) if xss else null,
        "payload": null if probe else d["payload"],
        "evidence": d["evidence"] if d["shape"] == "framework" else null,
        "url": null if probe else ("url" if xss else "site || endpoint"),
        "cwe": quote(d["cwe"]) if "cwe" in d else null,
        "technique": quote(d["technique"]) if xss else null,
        "owasp": entry,
        "file": "url" if probe else null,
        "snippet": d["snippet"] if probe else null,
        "status": "'VULNERABLE'" if probe else null,
    }
    fields = ", ".join(f"{value} AS {name}" for name, value in columns.items())
    first = d.get("first", "")
    return (
        f"SELECT {fields} FROM (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY {first}"
        "payload_ord, resp_id) AS rn FROM (SELECT *, replace(endpoint, '/1', '') AS parent FROM "
        f"responses) WHERE {d['where']}{live}) WHERE rn = 1"
    )


def detections(ids) -> str:
    return " UNION ALL ".join(_detection(i) for i in ids)


def signatures() -> str:
    items = ", ".join(
        f"({quote(family)}, {i}, {quote(s)})"
        for family, signatures in web.REQUEST_SIGNATURES.items()
        for i, s in enumerate(signatures)
    )
    return (
        f"WITH {RESPONSES_SQL}, s(family, sig_ord, signature) AS (VALUES {items}) SELECT resp_id, "
        "family, CAST(sig_ord AS INTEGER) AS sig_ord, signature FROM responses, s WHERE "
        "contains(concat_ws(' ', method, url, payload), signature)"
    )


# --- lookups and scores --------------------------------------------------------------------------


def owasp(category: str) -> str:
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in OWASP.items())
    return f"coalesce(CASE {category} {cases} END, 'Unknown')"


def risk(category: str) -> str:
    """[severity, confidence] of a category."""
    value = {k: f"['{s}', '{c}']" for k, (s, c) in CATEGORY_RISK.items()}
    exact = " ".join(f"WHEN {category} = '{k}' THEN {v}" for k, v in value.items())
    near = " ".join(
        f"WHEN contains(lower({category}), '{k.lower()}') OR contains('{k.lower()}', "
        f"lower({category})) THEN {v}"
        for k, v in value.items()
    )
    return f"CASE {exact} {near} ELSE ['MEDIUM', '70'] END"


def score(severity: str, confidence: str) -> str:
    weight = (
        f"CASE upper({severity}) WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 5 "
        "WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 1 ELSE 5 END"
    )
    factor = f"(CAST({confidence} AS DOUBLE) / CAST(100 AS DOUBLE))"
    return f"CAST(trunc(({weight}) * {factor}) AS INTEGER)"


def priority(severity: str) -> str:
    return (
        f"CAST(CASE upper({severity}) WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 "
        "WHEN 'LOW' THEN 4 WHEN 'INFO' THEN 5 ELSE 3 END AS INTEGER)"
    )
