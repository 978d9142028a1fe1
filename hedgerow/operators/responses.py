"""Evidence in captured responses.

Input: `responses` (resp_id, endpoint, url, method, parameter, payload, payload_ord, status, headers,
body), responses that were recorded earlier. Nothing here sends a request. A row without a payload
is a plain capture of its endpoint and tells whether the endpoint is live.

Every detector is a condition on one response and a scope in which its first hit is reported. All
detectors run in one pass over the responses; the first hit per scope is a minimum that is combined
before the shuffle, so a site or endpoint with a third of all responses sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.catalogue.web import REQUEST_SIGNATURES, TARGETED_ENDPOINTS, TARGETED_PARAMETERS
from hedgerow.functions import urls
from hedgerow.functions.patterns import any_matches_sql
from hedgerow.functions.text import (
    PAYLOAD_ESCAPES, contains_any_sql, fold_sql, let_sql, sql_text,
)
from hedgerow.operators.lookups import owasp

# Statuses of a live endpoint, strict and lax, and of a redirect.
STRICT_STATUSES = (200,)
LAX_STATUSES = (200, 301, 302, 307, 308)
REDIRECT_STATUSES = (301, 302, 307, 308)

# Lower-case texts that betray a reflected script.
REFLECTION_INDICATORS = (
    "<script>alert", "onerror=alert", "onload=alert", "javascript:alert", "confirm(", "prompt(",
)
# Payloads, parameters and endpoints that the recorded probes used, in probe order.
QUICK_PAYLOADS = (
    "<script>alert(1)</script>", "<img src=x onerror=alert(1)>", "<svg onload=alert(1)>",
)
QUICK_PARAMETERS = ("q", "search", "query", "id", "page", "user")
FRAGMENT_PAYLOADS = (
    "#<script>alert(1)</script>", "#<img src=x onerror=alert(1)>", "#<svg onload=alert(1)>",
    "#<body onload=alert(1)>", "javascript:alert(1)",
)
LOGIN_PAYLOADS = (
    "<script>alert(1)</script>", "<img src=x onerror=alert(1)>", "'\"><script>alert(1)</script>",
)
DOM_SINKS = (
    r"document\.write", r"\.innerHTML\s*=", r"\.outerHTML\s*=", r"\.insertAdjacentHTML",
    "dangerouslySetInnerHTML", r"eval\s*\(", r"Function\s*\(",
)
DATABASE_ENDPOINTS = ("/api/users", "/api/graphql", "/search", "/login")
DATABASE_SIGNATURES = (
    "SQL syntax", "mysql_fetch", "ORA-", "PostgreSQL", "SQLite", "Unclosed quotation mark",
    "You have an error", "sql", "database", "query", "SELECT", "FROM", "WHERE",
)
TEMPLATE_PAYLOADS = {
    "{{7*7}}": "Basic Math",
    "{{7*'7'}}": "String Multiplication",
    "{{config}}": "Config Access",
    "${7*7}": "Expression",
    "{{''.__class__.__mro__}}": "Object Access",
}
TEMPLATE_RESULTS = ("49", "7777777")
COMMAND_PAYLOADS = {
    "; whoami": "Basic Command",
    "| whoami": "Pipe Command",
    "&& whoami": "AND Command",
    "$(whoami)": "Subshell",
    "`whoami`": "Backtick",
}
COMMAND_OUTPUT = ("uid=", "gid=", "root", "admin", "windows")
REDIRECT_ENDPOINTS = ("/api/webhook", "/login")
REDIRECT_MARKER = "attacker.com"
FILE_CONTENTS = ("root:", "Windows")
OBJECT_ENDPOINTS = ("/api/users", "/profile", "/profile/[id]")
OBJECT_WORDS = ("user", "profile", "email", "password")
UPLOAD_WORDS = ("uploaded", "success")
CORS_ENDPOINTS = ("/api/users", "/api/profile", "/api/webhook")
API_ENDPOINTS = ("/api/users", "/api/graphql", "/api/webhook", "/api/profile")
OBJECT_PROBES = ("/api/users/1", "/api/profile/1")
JWT_PATTERN = r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"
MIN_FETCH_CHARS = 50


def live_endpoints(responses: DataFrame, statuses=STRICT_STATUSES) -> DataFrame:
    """(site, endpoint) whose plain capture ended with one of the statuses."""
    plain = responses.filter(
        F.col("payload").isNull() & (F.col("method") == "GET") & F.col("status").isin(*statuses)
    )
    return plain.select(urls.site(F.col("url")).alias("site"), "endpoint").distinct()


def _live_kinds(responses: DataFrame) -> DataFrame:
    """(site, endpoint, _live): strict and lax live endpoints in one pass."""
    plain = responses.filter(
        F.col("payload").isNull() & (F.col("method") == "GET")
        & F.col("status").isin(*LAX_STATUSES)
    )
    strict = F.bool_or(F.col("status").isin(*STRICT_STATUSES))
    kinds = F.when(strict, F.array(F.lit("lax"), F.lit("strict"))).otherwise(F.array(F.lit("lax")))
    return (
        plain.groupBy(urls.site(F.col("url")).alias("site"), "endpoint")
        .agg(kinds.alias("_kinds"))
        .select("site", "endpoint", F.explode("_kinds").alias("_live"))
    )


def percent_encode_sql(text: str) -> str:
    form = f"url_encode({text})"
    for was, now in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        form = f"replace({form}, '{was}', '{now}')"
    return form


def _escaped_sql(text: str) -> str:
    for raw, escaped in PAYLOAD_ESCAPES:
        text = f"replace({text}, {sql_text(raw)}, {sql_text(escaped)})"
    return text


def reflected_sql() -> str:
    """SQL condition: the body holds the payload raw, percent-encoded or HTML-escaped, or holds
    one of the indicators."""
    return (
        f"(contains(body, payload) OR contains(body, {percent_encode_sql('payload')}) "
        f"OR contains(body, {_escaped_sql('payload')}) "
        f"OR {contains_any_sql('low', REFLECTION_INDICATORS)})"
    )


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(sql_text(v) for v in values)})"


def _header(name: str) -> str:
    """SQL value of a header, in any case; null if the response has none."""
    return f"get(map_values(map_filter(headers, (_k, _v) -> lower(_k) = '{name}')), 0)"


def _described(column: str, names: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in names.items())
    return f"coalesce(CASE {column} {cases} END, '')"


@dataclass(frozen=True)
class Detector:
    """One kind of evidence. Texts ending in `_sql` are SQL over the response's columns and `low`,
    the lower-case body. `scope` names the columns, besides the site, within which only the first
    hit by (rank, payload_ord, resp_id) is kept; hits at endpoints that had to be live and were not
    do not count."""

    id: str
    shape: str  # xss, framework or probe: which fields the finding has
    category: str
    where_sql: str  # on top of `endpoints` and `method`
    name_sql: str
    description_sql: str
    severity: str
    confidence: int
    endpoints: tuple[str, ...] = ()
    method: str | None = None
    scope: tuple[str, ...] = ("endpoint",)
    live: str = ""  # "", strict or lax
    cwe: str | None = None
    remediation: str | None = None
    technique: str | None = None
    payload_sql: str = "payload"
    whole_payload_sql: str = ""  # where `payload_sql` shows a part
    evidence_sql: str = "body"
    parameter_sql: str = "parameter"
    rank_sql: str = "0"
    endpoint_sql: str = "endpoint"


def _xss(id: str, where: str, technique: str, confidence: int, **more) -> Detector:
    parameter = more.get("parameter_sql", "parameter")
    return Detector(
        id, "xss", "xss", where, "'XSS Vulnerability'",
        f"concat('XSS vulnerability found in ', endpoint, ' parameter \\'', {parameter}, '\\'')",
        "CRITICAL", confidence, cwe="CWE-79", technique=technique, evidence_sql="''", **more,
    )


def _framework(
    id: str, category: str, where: str, name: str, description: str, severity: str,
    confidence: int, cwe: str, remediation: str, **more,
) -> Detector:
    more.setdefault("live", "lax")
    return Detector(
        id, "framework", category, where, name, description, severity, confidence, cwe=cwe,
        remediation=remediation, **more,
    )


def _probe(
    id: str, category: str, where: str, name: str, description: str, severity: str,
    confidence: int, evidence: str = "body", **more,
) -> Detector:
    return Detector(
        id, "probe", category, where, name, description, severity, confidence,
        evidence_sql=evidence, **more,
    )


def _first_signature() -> str:
    cases = " ".join(
        f"WHEN contains(low, {sql_text(s.lower())}) THEN {sql_text(s)}"
        for s in DATABASE_SIGNATURES
    )
    return f"CASE {cases} END"


def _place(column: str, values) -> str:
    return f"array_position(array({', '.join(map(sql_text, values))}), {column})"


_REFLECTED = reflected_sql()
_SCRIPT = sql_text(QUICK_PAYLOADS[0])
_JWT = f"regexp_extract(body, {sql_text(JWT_PATTERN)}, 0)"
_SINK = let_sql(
    f"named_struct('t', body, 'f', {fold_sql('body')})", "_b",
    any_matches_sql("_b.t", "_b.f", DOM_SINKS),
)

ALL_PAYLOADS = tuple(dict.fromkeys(p for family in REQUEST_SIGNATURES.values() for p in family))


def _parameter_sql(parameters: Sequence[str], payloads: Sequence[str]) -> str:
    return f"{_in('parameter', parameters)} AND {_in('payload', payloads)} AND {_REFLECTED}"


def _fragment_sql(payloads: Sequence[str]) -> str:
    return f"{_in('payload', payloads)} AND contains(body, 'alert(1)')"


DETECTORS: tuple[Detector, ...] = (
    _xss(
        "reflected",
        f"{_in('parameter', QUICK_PARAMETERS)} AND {_in('payload', QUICK_PAYLOADS)} "
        f"AND {_REFLECTED}",
        "Reflected XSS", 95, live="strict",
        # payload by payload, and for each parameter by parameter, whatever the order of capture
        rank_sql=f"{_place('payload', QUICK_PAYLOADS)} * {len(QUICK_PARAMETERS)} + {_place('parameter', QUICK_PARAMETERS)}",
        endpoints=TARGETED_ENDPOINTS, method="GET",
    ),
    _xss(
        "dom_sink",
        f"{_in('payload', FRAGMENT_PAYLOADS)} AND {_SINK}",
        "DOM-based XSS", 80, scope=("endpoint", "payload"), parameter_sql="'hash'",
        endpoints=("/#",),
    ),
    _xss(
        "parameter",
        _parameter_sql(TARGETED_PARAMETERS, ALL_PAYLOADS),
        "Parameter XSS", 90, live="strict", scope=("endpoint", "parameter"),
        endpoints=TARGETED_ENDPOINTS, method="GET",
    ),
    _xss(
        "login_reflection",
        f"{_in('payload', LOGIN_PAYLOADS)} AND {_REFLECTED}",
        "Stored XSS (Login)", 85, live="strict", parameter_sql="'username'",
        endpoints=("/login",), method="POST",
    ),
    _framework(
        "search_reflection", "XSS",
        f"{_in('payload', QUICK_PAYLOADS)} "
        "AND contains(body, payload)",
        "'Reflected XSS'", "'XSS via search parameter'", "CRITICAL", 95, "CWE-79",
        "Sanitize user input, use proper encoding",
        endpoints=("/search",), method="GET",
    ),
    _framework(
        "fragment_reflection", "XSS",
        _fragment_sql(FRAGMENT_PAYLOADS),
        "'DOM XSS'", "'DOM-based XSS via URL fragment'", "CRITICAL", 85, "CWE-79",
        "Avoid document.write(), use safe DOM methods", live="", evidence_sql="''",
        endpoints=("/#",),
    ),
    _framework(
        "login_script", "XSS",
        f"payload = {_SCRIPT} AND contains(body, {_SCRIPT})",
        "'Stored XSS (Login)'", "'XSS in login response message'", "CRITICAL", 90, "CWE-79",
        "HTML escape all user-provided data", evidence_sql="''",
        endpoints=("/login",), method="POST",
    ),
    _framework(
        "database_error", "SQL Injection",
        f"parameter = 'id' AND payload IS NOT NULL "
        f"AND {contains_any_sql('low', [s.lower() for s in DATABASE_SIGNATURES])}",
        "concat('SQL Injection in ', endpoint)",
        f"concat('SQL error: ', {_first_signature()})", "CRITICAL", 95, "CWE-89",
        "Use parameterized queries, prepared statements", scope=("endpoint", "payload"),
        endpoints=DATABASE_ENDPOINTS, method="GET",
    ),
    _framework(
        "login_bypass", "SQL Injection",
        f"parameter = 'id' AND payload IS NOT NULL "
        "AND contains(body, 'Logged in as:')",
        "'Auth Bypass via SQL Injection'", "concat('Login bypass with: ', payload)", "CRITICAL",
        100, "CWE-89", "Use parameterized queries for authentication",
        endpoints=("/login",), method="GET",
    ),
    _framework(
        "template", "SSTI",
        f"{_in('payload', TEMPLATE_PAYLOADS)} "
        f"AND {contains_any_sql('body', TEMPLATE_RESULTS)}",
        "'Server-Side Template Injection'",
        f"concat('Template injection with ', {_described('payload', TEMPLATE_PAYLOADS)})",
        "CRITICAL", 90, "CWE-94", "Avoid eval(), use safe template engines",
        endpoints=("/search",), method="GET",
    ),
    _framework(
        "graphql", "GraphQL",
        "contains(body, 'password')",
        "'GraphQL Data Exposure'", "'Sensitive data exposed via GraphQL'", "HIGH", 90, "CWE-200",
        "Implement proper authorization checks",
        endpoints=("/api/graphql",), method="POST",
    ),
    _framework(
        "command", "Command Injection",
        f"{_in('payload', COMMAND_PAYLOADS)} "
        f"AND {contains_any_sql('low', COMMAND_OUTPUT)}",
        f"concat('Command Injection (', {_described('payload', COMMAND_PAYLOADS)}, ')')",
        "concat('Command execution with: ', payload)", "CRITICAL", 90, "CWE-78",
        "Never use user input in system commands",
        endpoints=("/api/webhook",), method="GET",
    ),
    _framework(
        "open_redirect", "Open Redirect",
        f"parameter = 'redirect' AND "
        f"status IN ({', '.join(map(str, REDIRECT_STATUSES))}) AND "
        f"contains({_header('location')}, '{REDIRECT_MARKER}')",
        "'Open Redirect'", "'Redirects to attacker.com'", "MEDIUM", 90, "CWE-601",
        "Validate redirect URLs against whitelist", evidence_sql="''",
        endpoints=REDIRECT_ENDPOINTS, method="GET",
    ),
    _framework(
        "internal_fetch", "SSRF",
        f"parameter = 'url' AND payload IS NOT NULL "
        f"AND status = 200 AND length(body) > {MIN_FETCH_CHARS}",
        "'Server-Side Request Forgery'", "concat('SSRF to internal resource: ', payload)", "HIGH",
        85, "CWE-918", "Validate and sanitize URLs, use allowlist",
        endpoints=("/api/users",), method="GET",
    ),
    _framework(
        "file_read", "Path Traversal",
        f"parameter = 'file' AND payload IS NOT NULL "
        f"AND {contains_any_sql('body', FILE_CONTENTS)}",
        "'Path Traversal'", "concat('File access: ', payload)", "HIGH", 90, "CWE-22",
        "Sanitize file paths, use allowlist",
        endpoints=("/download",), method="GET",
    ),
    _framework(
        "object_reference", "IDOR",
        f"parameter = 'id' AND payload IS NOT NULL AND status = 200 AND {contains_any_sql('low', OBJECT_WORDS)}",
        "concat('IDOR in ', endpoint)", "concat('Access to resource ID: ', payload)", "HIGH", 85,
        "CWE-639", "Implement proper authorization checks",
        endpoints=OBJECT_ENDPOINTS, method="GET",
    ),
    _framework(
        "upload_accepted", "File Upload",
        f"payload IS NOT NULL "
        f"AND {contains_any_sql('low', UPLOAD_WORDS)}",
        "'Unrestricted File Upload'", "concat('Uploaded executable file: ', payload)", "HIGH", 85,
        "CWE-434", "Validate file types, use secure storage", evidence_sql="''",
        endpoints=("/upload",), method="POST",
    ),
    _framework(
        "cors", "CORS Misconfiguration",
        f"{_header('access-control-allow-origin')} = '*'",
        "'Wildcard CORS'", "concat('CORS allows any origin on ', endpoint)", "MEDIUM", 95,
        "CWE-942", "Restrict CORS to trusted origins", scope=(), payload_sql="'*'",
        evidence_sql="''",
        rank_sql=f"array_position(array({', '.join(map(sql_text, CORS_ENDPOINTS))}), endpoint)",
        endpoints=CORS_ENDPOINTS, method="OPTIONS",
    ),
    _framework(
        "token", "JWT Weak Secret",
        f"payload IS NULL AND {_JWT} <> ''",
        "'JWT with Weak Secret'", f"concat('JWT token found: ', substring({_JWT}, 1, 20), '...')",
        "CRITICAL", 90, "CWE-312", "Use strong secrets, rotate regularly", live="",
        payload_sql=f"substring({_JWT}, 1, 50)", whole_payload_sql=_JWT, evidence_sql="''",
        endpoints=("/api/users",), method="GET",
    ),
    _framework(
        "admin_panel", "No Authentication",
        f"payload IS NULL "
        f"AND {contains_any_sql('body', ('Admin Panel', 'Dashboard'))}",
        "'Unprotected Admin Panel'", "'Admin panel accessible without authentication'",
        "CRITICAL", 100, "CWE-306", "Implement authentication and authorization",
        payload_sql="''",
        endpoints=("/admin",), method="GET",
    ),
    _probe(
        "file_read_probe", "file",
        f"parameter = 'file' AND payload IS NOT NULL "
        f"AND {contains_any_sql('body', FILE_CONTENTS)}",
        "'Path Traversal'", "concat('File access: ', payload)", "HIGH", 90,
        endpoints=("/download",), method="GET",
    ),
    _probe(
        "upload_probe", "file",
        f"payload IS NOT NULL "
        f"AND {contains_any_sql('low', UPLOAD_WORDS)}",
        "'Unrestricted File Upload'", "'Uploaded PHP file successfully'", "HIGH", 85,
        endpoints=("/upload",), method="POST",
    ),
    _probe(
        "sensitive_api", "api",
        f"payload IS NULL AND status = 200 "
        f"AND {contains_any_sql('body', ('password', 'secret'))}",
        "concat('Sensitive Data Exposure in ', endpoint)", "'API exposes sensitive data'", "HIGH",
        85,
        endpoints=API_ENDPOINTS, method="GET",
    ),
    _probe(
        "object_probe", "api",
        f"payload IS NULL AND status = 200 "
        "AND contains(low, 'user')",
        "concat('IDOR in ', substring_index(endpoint, '/1', 1))",
        "'Access to user ID 1 without auth'", "HIGH", 80, live="strict",
        endpoint_sql="substring_index(endpoint, '/1', 1)",
        endpoints=OBJECT_PROBES, method="GET",
    ),
    _probe(
        "cors_probe", "misconfig",
        f"{_header('access-control-allow-origin')} = '*'",
        "'Wildcard CORS'", "'CORS allows any origin'", "MEDIUM", 95,
        evidence="'Access-Control-Allow-Origin: *'",
        endpoints=("/api/users",), method="OPTIONS",
    ),
    _probe(
        "admin_probe", "misconfig",
        f"payload IS NULL AND status = 200 "
        f"AND {contains_any_sql('body', ('Admin', 'Dashboard'))}",
        "'Unprotected Admin Panel'", "'Admin panel accessible without auth'", "CRITICAL", 100,
        endpoints=("/admin",), method="GET",
    ),
    _probe(
        "debug_mode", "misconfig",
        f"payload IS NULL AND contains(low, 'debug') "
        "AND contains(low, 'true')",
        "'Debug Mode Enabled'", "'Debug mode is enabled in production'", "HIGH", 80,
        evidence="'Debug: True'",
        endpoints=("/",), method="GET",
    ),
)
BY_ID = {d.id: d for d in DETECTORS}


@dataclass(frozen=True)
class Limits:
    """What the detectors look at and how much they show; nothing is cut by default.

    `parameters` and `payloads` are those of the `parameter` detector, `fragments` those of `fragment_reflection`.
    `payload_chars` is by shape of the finding; `body_chars` is for evidence that is the body, `evidence_chars` for other.
    """

    parameters: Sequence[str] = TARGETED_PARAMETERS
    payloads: Sequence[str] = ALL_PAYLOADS
    fragments: Sequence[str] = FRAGMENT_PAYLOADS
    payload_chars: tuple[tuple[str, int], ...] = ()
    body_chars: int | None = None
    evidence_chars: int | None = None

    def of(self, d: Detector) -> Detector:
        if d.id == "parameter":
            return replace(d, where_sql=_parameter_sql(self.parameters, self.payloads))
        if d.id == "fragment_reflection":
            return replace(d, where_sql=_fragment_sql(self.fragments))
        return d


UNCUT = Limits()
# Those of a live scan.
LIVE_SCAN = Limits(
    TARGETED_PARAMETERS[:5], REQUEST_SIGNATURES["basic"][:3], FRAGMENT_PAYLOADS[:1],
    (("xss", 100), ("framework", 200), ("probe", 200)), 200, 300,
)
XSS_OWASP = "A03:2021 - Injection"


def _cut_sql(text: str, chars: int | None) -> str:
    return text if chars is None else f"substring({text}, 1, {chars})"


def _hit_sql(i: int, d: Detector, limits: Limits) -> str:
    def scoped(name: str) -> str:
        return f"coalesce({name}, '')" if name in d.scope else "''"

    where = f"method = '{d.method}' AND {d.where_sql}" if d.method else d.where_sql
    return (
        f"CASE WHEN {where} THEN named_struct('ord', {i}, 'rank', int({d.rank_sql}), "
        f"'scope_endpoint', endpoint, 'scope_parameter', {scoped('parameter')}, "
        f"'scope_payload', {scoped('payload')}, 'endpoint', {d.endpoint_sql}, "
        f"'parameter', {d.parameter_sql}, 'name', {d.name_sql}, "
        f"'description', {d.description_sql}, "
        f"'payload', {_cut_sql(d.payload_sql, dict(limits.payload_chars).get(d.shape))}, "
        f"'evidence', {_cut_sql(d.evidence_sql, limits.body_chars if d.evidence_sql == 'body' else limits.evidence_chars)}, "
        f"'whole_payload', {d.whole_payload_sql or d.payload_sql}, 'whole_evidence', {d.evidence_sql}) END"
    )


def hits(responses: DataFrame, detectors=DETECTORS, limits: Limits = UNCUT) -> DataFrame:
    """One row per (response, detector) with evidence, before the first-hit cut."""
    prepared = responses.select(
        "resp_id", urls.site(F.col("url")).alias("site"), "endpoint", "url", "method",
        "parameter", "payload", F.coalesce("payload_ord", F.lit(0)).alias("payload_ord"),
        "status", "headers", "body", F.lower("body").alias("low"),
    )
    # A response is only tested by the detectors of its endpoint.
    at: dict[str, list[str]] = {}
    for i, d in enumerate(detectors):
        for endpoint in d.endpoints:
            at.setdefault(endpoint, []).append(_hit_sql(i, d, limits))
    cases = " ".join(
        f"WHEN {sql_text(endpoint)} THEN array({', '.join(tests)})"
        for endpoint, tests in at.items()
    )
    found = f"filter(CASE endpoint {cases} END, _h -> _h IS NOT NULL)"
    rows = prepared.filter(F.col("endpoint").isin(*at)).select(
        "resp_id", "site", "url", "payload_ord", F.expr(f"explode_outer({found}) AS _hit")
    )
    return rows.filter(F.col("_hit").isNotNull()).select(
        "resp_id", "site", "url", "payload_ord", "_hit.*"
    )


_KEYS = ("ord", "site", "scope_endpoint", "scope_parameter", "scope_payload")
_ORDER = ("rank", "payload_ord", "resp_id")
_CARRY = ("url", "endpoint", "parameter", "name", "description", "payload", "evidence", "whole_payload", "whole_evidence")


def first_hits(found: DataFrame) -> DataFrame:
    """The first hit of each detector in each scope: what leaving a loop at a hit comes to."""
    first = F.min(F.struct(*_ORDER, *_CARRY)).alias("_first")
    return found.groupBy(*_KEYS).agg(first).select(*_KEYS, "_first.*")


def detect(responses: DataFrame, ids=None, limits: Limits = UNCUT) -> DataFrame:
    """Findings of the named detectors (all by default), with `detector`, `site` and `resp_id`.

    `whole_payload` and `whole_evidence` stand beside the shown ones, which `limits` may cut.
    """
    detectors = [limits.of(BY_ID[i]) for i in ids or BY_ID]
    errors, bypasses = BY_ID["database_error"], BY_ID["login_bypass"]
    if errors not in detectors:
        return _as_findings(_first_live(responses, detectors, limits), _of_detector(detectors))
    every = detectors if bypasses in detectors else [*detectors, bypasses]
    found = _first_live(responses, every, limits)
    # A probe of the login ends at the first bypass of a site: what came after is not looked at. Only the
    # first hits of that probe share a window; any other row is one of its own.
    is_bypass = F.col("ord") == every.index(bypasses)
    is_probe = (F.col("ord") == every.index(errors)) & (F.col("scope_endpoint") == "/login")
    own = F.when(is_bypass | is_probe, F.lit(0)).otherwise(F.xxhash64(*_KEYS))
    window = Window.partitionBy("site", "_own")
    ended = F.min(F.when(is_bypass, F.col("payload_ord"))).over(window)
    kept = found.withColumn("_own", own).withColumn("_ended", ended).filter(
        ~(is_probe & F.coalesce(F.col("payload_ord") > F.col("_ended"), F.lit(False)))
    )
    if bypasses not in detectors:
        kept = kept.filter(~is_bypass)
    return _as_findings(kept, _of_detector(detectors))


def _of_detector(detectors):
    """A value of each row's detector, as an expression."""

    def of_detector(value):
        items = ", ".join("CAST(NULL AS STRING)" if v is None else sql_text(v) if
                          isinstance(v, str) else str(v) for v in map(value, detectors))
        return F.expr(f"element_at(array({items}), ord + 1)")

    return of_detector


def _first_live(responses: DataFrame, detectors, limits: Limits) -> DataFrame:
    """First hits of each scope, where the endpoint is as live as the detector asks."""
    found = first_hits(hits(responses, detectors, limits))
    of_detector = _of_detector(detectors)
    needs = of_detector(lambda d: d.live)
    wanted = {d.live for d in detectors} - {""}
    if wanted:
        # Hits are already down to one per scope; live endpoints are read without any body.
        live = _live_kinds(responses).filter(F.col("_live").isin(*wanted))
        found = found.withColumn("_needs", needs).alias("h")
        live = live.alias("l")
        found = (
            found.join(
                live,
                (F.col("h.site") == F.col("l.site"))
                & (F.col("h.endpoint") == F.col("l.endpoint"))
                & (F.col("h._needs") == F.col("l._live")),
                "left",
            )
            .filter((F.col("h._needs") == "") | F.col("l._live").isNotNull())
            .select("h.*")
        )
    if any("endpoint" not in d.scope for d in detectors):
        # One finding per site: the first among its live endpoints, so only known now.
        per_endpoint = of_detector(lambda d: int("endpoint" in d.scope)) == 1
        scope = F.when(per_endpoint, F.col("scope_endpoint")).otherwise(F.lit(""))
        found = first_hits(found.withColumn("scope_endpoint", scope))
    return found


def _as_findings(found: DataFrame, of_detector) -> DataFrame:
    shape = of_detector(lambda d: d.shape)
    probe = shape == "probe"
    category = of_detector(lambda d: d.category)
    field = lambda test, value: F.when(test, value)
    return found.select(
        of_detector(lambda d: d.id).alias("detector"),
        F.col("ord").alias("detector_ord"), "site", "resp_id",
        category.alias("category"), "name", "description",
        of_detector(lambda d: d.severity).alias("severity"),
        of_detector(lambda d: d.confidence).alias("confidence"),
        field(~probe, F.col("endpoint")).alias("endpoint"),
        field(shape == "xss", F.col("parameter")).alias("parameter"),
        field(~probe, F.coalesce("payload", F.lit(""))).alias("payload"),
        field(shape == "framework", F.coalesce("evidence", F.lit(""))).alias("evidence"),
        field(~probe, F.when(shape == "xss", F.col("url")).otherwise(
            F.concat("site", "endpoint"))).alias("url"),
        of_detector(lambda d: d.cwe).alias("cwe"),
        of_detector(lambda d: d.remediation).alias("remediation"),
        of_detector(lambda d: d.technique).alias("technique"),
        F.when(shape == "xss", F.lit(XSS_OWASP)).when(shape == "framework", owasp(category)).alias(
            "owasp"
        ),
        field(probe, F.col("url")).alias("file"),
        field(probe, F.lit(0)).alias("line"),
        field(probe, F.col("evidence")).alias("snippet"),
        field(probe, F.lit("VULNERABLE")).alias("status"),
        field(~probe, F.coalesce("whole_payload", F.lit(""))).alias("whole_payload"),
        F.coalesce("whole_evidence", F.lit("")).alias("whole_evidence"),
    )


def reflected(responses: DataFrame) -> DataFrame:
    """Responses whose body reflects their payload."""
    with_low = responses.filter(F.col("payload").isNotNull()).withColumn("low", F.lower("body"))
    return with_low.filter(F.expr(reflected_sql())).drop("low")
