"""One query per inventory row: the Spark query, and SQL that gives the same rows.

Every query runs over whole driver tables, or over tables Spark derives from them (`planted`).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.catalogue import noise as catalogue_noise
from hedgerow.catalogue import web
from hedgerow.catalogue.categories import CATEGORY_PATTERNS
from hedgerow.checks import planted, sql
from hedgerow.functions import risk, text, urls
from hedgerow.functions.numbering import number_rows
from hedgerow.functions.scratch import fresh_path
from hedgerow.operators import (
    extract, findings, lines, lookups, matchers, noise, pages, responses, rule_index, rules,
)
from hedgerow.plans import reports
from hedgerow.sinks import exports
from hedgerow.sources import files as tree
from hedgerow.sources import findings as stored
from hedgerow.sources import walk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FINDING_COLUMNS = (
    "finding_id", "cwe", "category", "name", "file", "line", "snippet", "status", "severity",
    "confidence", "description",
)


def check(name: str, oracle: str | None = None):
    """Register a query, and its SQL if there is one."""
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if oracle:
            ORACLE[name] = oracle
        return query

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# What a live scan leaves out of scripts.
CUTS = {"min_chars": catalogue_noise.MIN_LINE_CHARS, "skip_minified": True}


# --- sources -------------------------------------------------------------------------------------


@check(
    "s1_source_tree",
    "WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE doc_id % 10 <> 1) "
    f"SELECT lang, count(*) AS lines, CAST(sum(length({sql.strip('raw')})) AS BIGINT) AS chars "
    "FROM l GROUP BY lang",
)
def _(spark, sf):
    """Documents written as a tree with a hidden folder, a noise folder and a linked one, read by a scan's own path."""
    root = fresh_path(spark, "tree")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    for folder, part in (("src", "doc_id % 10 > 1"), (".github", "doc_id % 10 = 0"), ("node_modules", "doc_id % 10 = 1")):
        docs.where(part).select("lang", "text").write.partitionBy("lang").option("maxRecordsPerFile", 200).text(f"{root}/{folder}")
    if "://" not in root and not root.startswith("file:"):
        os.symlink(f"{root}/src", f"{root}/linked")
    files = tree.list_scanned(spark, root).where(F.col("path").endswith(".txt"))
    rows = lines.numbered_lines(walk.read_ranges(files, range_bytes=64 << 10), "path", "offset", newline_only=True)
    lang = F.regexp_extract("path", r"/lang=([^/]*)/", 1).alias("lang")
    return rows.groupBy(lang).agg(
        # each range ends in a line end, after which there is one more empty line, or is empty
        (F.count("*") - F.count_distinct("path", "offset")).alias("lines"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
    )


@check(
    "s1_range_numbers",
    "WITH t AS (SELECT lang, source, string_agg(text || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY lang, source), "
    "l AS (SELECT lang, source, unnest(string_split(body, chr(10))) AS raw, "
    "generate_subscripts(string_split(body, chr(10)), 1) AS line FROM t) "
    "SELECT lang, source, CAST(line AS BIGINT) AS line FROM l WHERE contains(lower(raw), 'token =')",
)
def _(spark, sf):
    """Lines of one file for each language and source, numbered across its ranges."""
    root = fresh_path(spark, "tree")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    docs.repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id").select("lang", "source", "text").write.partitionBy(
        "lang", "source"
    ).text(root)
    files = tree.list_scanned(spark, root).where(F.col("path").endswith(".txt"))
    found = lines.candidate_lines(
        walk.read_ranges(files, range_bytes=16 << 10), "path", patterns=["token ="], newline_only=True, ranges=True
    )
    return found.select(
        F.regexp_extract("path", r"lang=([^/]*)/", 1).alias("lang"), F.regexp_extract("path", r"source=([^/]*)/", 1).alias("source"),
        F.col("line").cast("bigint").alias("line"),
    )


@check(
    "s2_decode",
    "SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN chr(65533) WHEN 1 THEN chr(57344) ELSE '' END || text || 'tail') AS digest FROM documents",
)
def _(spark, sf):
    head = F.expr("CASE doc_id % 3 WHEN 0 THEN '\ufffd' WHEN 1 THEN '\ue000' ELSE '' END")
    broken = F.concat(F.encode(F.concat(head, "text"), "UTF-8"), F.unhex(F.lit("FFC3")), F.encode(F.lit("tail"), "UTF-8"))
    decoded = table(spark, sf, "documents").select("doc_id", text.decode_utf8(broken).alias("t"))
    return decoded.select("doc_id", F.md5("t").alias("digest"))


@check("s3_pages", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS chars FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("chars"))


@check(
    "s4_stored_findings",
    f"WITH {planted.FINDINGS_SQL} SELECT category, severity, confidence, file, line, snippet, "
    "name, description FROM findings",
)
def _(spark, sf):
    path = exports.write_json(planted.findings(spark, sf), fresh_path(spark, "stored"))
    return stored.read_findings(spark, path).select(
        "category", "severity", "confidence", "file", "line", "snippet", "name", "description"
    )


def _expected(spark, sf) -> DataFrame:
    """Literals that each planted file should hold: one it often has, one it has not."""
    files = planted.files(spark, sf)
    return files.select("path", F.explode(F.array(
        F.lit("hashlib.md5"), F.lit("eval("), F.lit("the"), F.lit("not in any file")
    )).alias("literal")).unionByName(
        files.select(F.concat("path", F.lit(".gone")).alias("path"), F.lit("the").alias("literal"))
    )


_PRESENCE = (
    f"WITH {planted.FILES_SQL}, l AS (SELECT unnest(['hashlib.md5', 'eval(', 'the', "
    "'not in any file']) AS literal), presence AS (SELECT path, literal, "
    "contains(content, literal) AS found FROM files, l "
    "UNION ALL SELECT path || '.gone', 'the', false FROM files) "
)


@check("s5_j7_literal_presence", _PRESENCE + "SELECT * FROM presence")
def _(spark, sf):
    return lookups.literal_presence(planted.files(spark, sf), _expected(spark, sf))


@check(
    "m8_literal_coverage",
    _PRESENCE + "SELECT count(*) FILTER (found) AS found, count(*) AS total FROM presence",
)
def _(spark, sf):
    return lookups.literal_coverage(
        lookups.literal_presence(planted.files(spark, sf), _expected(spark, sf))
    )


# --- path, line and endpoint filters ---------------------------------------------------------------


def _file_filter(name: str, condition: str):
    return check(name, f"WITH {planted.FILES_SQL} SELECT path, length FROM files WHERE {condition}")


@_file_filter("p01_extension", sql.scanned_extension("path"))
def _(spark, sf):
    return planted.files(spark, sf).filter(
        noise.has_scanned_extension(F.col("path"))
    ).select("path", "length")


@_file_filter("p02_directory", f"NOT {sql.skipped_dir('path')}")
def _(spark, sf):
    return planted.files(spark, sf).filter(
        ~noise.in_skipped_dir(F.col("path"))
    ).select("path", "length")


@_file_filter("p03_path_noise", f"NOT {sql.noise_path('path')}")
def _(spark, sf):
    return planted.files(spark, sf).filter(~noise.is_noise_path("path")).select("path", "length")


@_file_filter("p04_size_cap", "length <= 10485760")
def _(spark, sf):
    return planted.files(spark, sf).filter(
        noise.fits_size_cap(F.col("length"))
    ).select("path", "length")


@check(
    "p05_empty_content",
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(10) || chr(9) || chr(160) "
    f"ELSE text END AS content FROM documents) SELECT doc_id FROM d WHERE {sql.strip('content')} <> ''",
)
def _(spark, sf):
    blank = "CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(10) || chr(9) || '\\u00a0' ELSE text END"
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{blank} AS content")
    return rows.filter(noise.has_content(F.col("content"))).select("doc_id")


@check(
    "p06_minified",
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), ' ') ELSE text "
    "END AS content FROM documents) SELECT doc_id FROM d WHERE NOT "
    "(len(string_split(content, chr(10))) < 5 AND length(content) > 10000)",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), ' ') ELSE text END AS content"
    )
    return rows.filter(~noise.is_minified(F.col("content"))).select("doc_id")


def _planted_lines(spark, sf, newline_only=False) -> DataFrame:
    return lines.numbered_lines(planted.files(spark, sf), "path", newline_only=newline_only)


_LINES = f"WITH {planted.FILES_SQL}, {sql.LINES} "


@check("p07_line_noise", _LINES + f"SELECT path, line, text FROM texts WHERE NOT {sql.noise_line('text')}")
def _(spark, sf):
    return _planted_lines(spark, sf).filter(~noise.is_noise_line()).select("path", "line", "text")


@check("p08_short_line", _LINES + "SELECT path, line, text FROM texts WHERE length(text) >= 10")
def _(spark, sf):
    return _planted_lines(spark, sf).filter(
        ~noise.is_short_line(F.col("text"))
    ).select("path", "line", "text")


@check(
    "p09_script_line",
    _LINES + "SELECT path, line, text FROM texts WHERE NOT (contains(text, 'console.log') OR "
    "contains(text, 'console.error') OR contains(text, 'module.exports') OR "
    "contains(text, 'export default') OR contains(text, 'import React'))",
)
def _(spark, sf):
    return _planted_lines(spark, sf).filter(
        ~noise.is_skipped_script_line(F.col("text"))
    ).select("path", "line", "text")


_TAILS = (
    "/_next/a", "/Static/b", "/app.css", "/img.PNG", "/x.map", "/map", "/orders", "/chunk-9",
    "/vendors", "/font.woff2", "/font.woff", "/my-framework-x", "/run/time", "/api/v1", "/a.svg?x",
)


def _endpoints_columns(spark: bool) -> list[str]:
    return ["event_id", f"{planted._pick(_TAILS, 'event_id', spark)} AS endpoint"]


@check(
    "p10_build_artifact",
    f"WITH e AS (SELECT {', '.join(_endpoints_columns(False))} FROM events) "
    f"SELECT event_id, endpoint FROM e WHERE NOT {sql.build_artifact('endpoint')}",
)
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr(*_endpoints_columns(True))
    return rows.filter(~noise.is_build_artifact("endpoint"))


_FINDINGS = f"WITH {planted.FINDINGS_SQL} "


@check(
    "p11_minimum_severity",
    _FINDINGS + "SELECT event_id, severity FROM findings "
    "WHERE upper(coalesce(severity, 'MEDIUM')) IN ('HIGH', 'CRITICAL')",
)
def _(spark, sf):
    return risk.at_least(planted.findings(spark, sf), "high").select("event_id", "severity")


_REAL = (
    _FINDINGS + ", own AS (SELECT * FROM findings WHERE NOT regexp_matches(file, "
    "'[a-f0-9]{10,}\\.js$') AND NOT regexp_matches(file, 'vendor|chunk|polyfill|runtime')), "
    "kept AS (SELECT * FROM own WHERE contains(snippet, 'userInput') OR contains(snippet, "
    "'request.') UNION ALL SELECT * FROM own WHERE category = 'NETWORK') "
)


@check("p12_likely_real", _REAL + "SELECT event_id, category, file, snippet FROM kept")
def _(spark, sf):
    return findings.likely_real(planted.findings(spark, sf)).select(
        "event_id", "category", "file", "snippet"
    )


@check(
    "p13_truncation",
    "SELECT doc_id, substr(text, 1, 200) AS snippet, substr(text, 1, 100) AS payload, "
    "substr(text, 1, 300) AS evidence, substr(text, 1, 30) || '...' AS preview FROM documents",
)
def _(spark, sf):
    col = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.preview(col, 200).alias("snippet"), text.preview(col, 100).alias("payload"),
        text.preview(col, 300).alias("evidence"),
        F.concat(text.preview(col, 30), F.lit("...")).alias("preview"),
    )


@check("p14_relative_path", f"WITH {planted.FILES_SQL} SELECT doc_id, path AS relative FROM files")
def _(spark, sf):
    full = "'file:/data/trees/one/' || path"
    return planted.files(spark, sf).select(
        "doc_id", noise.relative_path(full, "/data/trees/one").alias("relative")
    )


_TARGETS = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'HTTP://a.example' WHEN 2 THEN substr(url, 5) ELSE 'https://b.example/' || page_id END"


@check(
    "p15_web_url",
    f"WITH t AS (SELECT page_id, {_TARGETS} AS target FROM pages) "
    "SELECT page_id, starts_with(target, 'http://') OR starts_with(target, 'https://') AS is_web FROM t",
)
def _(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", f"{_TARGETS} AS target")
    return rows.select("page_id", urls.is_web_url(F.col("target")).alias("is_web"))


_LINK = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/x/' || page_id WHEN 2 THEN 'mailto:a@b.example' ELSE 'https://other.example/' || page_id END"


@check(
    "p16_same_domain",
    f"WITH t AS (SELECT page_id, url, {_LINK} AS link FROM pages) SELECT page_id, "
    f"{sql.authority('link')} IN ('', {sql.authority('url')}) AS same FROM t",
)
def _(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", "url", f"{_LINK} AS link")
    same = urls.same_domain(F.col("link"), urls.authority(F.col("url")))
    return rows.select("page_id", same.alias("same"))


# --- lines and context ------------------------------------------------------------------------------


@check("g1_lines", _LINES + "SELECT path, line, raw FROM texts")
def _(spark, sf):
    return _planted_lines(spark, sf).select("path", "line", "raw")


@check(
    "g2_newline_lines",
    f"WITH {planted.FILES_SQL}, p AS (SELECT path, string_split(content, chr(10)) AS ps FROM files) "
    "SELECT path, CAST(generate_subscripts(ps, 1) AS INTEGER) AS line, unnest(ps) AS raw FROM p",
)
def _(spark, sf):
    return _planted_lines(spark, sf, newline_only=True).select("path", "line", "raw")


@check("g3_strip", _LINES + "SELECT path, line, text FROM texts")
def _(spark, sf):
    return _planted_lines(spark, sf).select("path", "line", "text")


_CONTEXT = f"WITH {planted.FILES_SQL}, {sql.LINES}, {sql.CONTEXT} "


@check("g4_o1_context_window", _CONTEXT + "SELECT path, line, sanitised FROM context")
def _(spark, sf):
    return lines.with_context(_planted_lines(spark, sf), "path").select("path", "line", "sanitised")


# --- rules ------------------------------------------------------------------------------------------


def _counts(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy(*keys).agg(F.count("*").alias("findings"))


@check(
    "r1_all_packs",
    sql.rule_matches(rules.stock_rules(with_secrets=True)).count_by("category", "name", "severity", "cwe", "confidence"),
)
def _(spark, sf):
    found = matchers.match_files(planted.files(spark, sf), rules.stock_rules(with_secrets=True))
    return _counts(found, "category", "name", "severity", "cwe", "confidence")


USER_RULES = (
    rules.Rule("CUSTOM", "Price Test", (".py", ".txt"), (r"price\s*>\s*\d+", r"plain\s+words"),
               vuln_desc="own text", severity="LOW", confidence=33, cwe="CWE-1"),
    rules.Rule("Database", "Own database rule", (".py", ".sql"), severity="LOW", cwe="CWE-2"),
    rules.Rule("CUSTOM", "Broken", ("",), (r"notes\.(bak|old)", "("), severity="INFO"),
)


@check("r2_j3_user_rules", sql.user_rules(USER_RULES[:2]))
def _(spark, sf):
    found = matchers.match_files(planted.files(spark, sf), USER_RULES[:2])
    return found.select(*FINDING_COLUMNS)


@check("r2_rules_from_table", sql.rule_matches(rules.stock_rules()).count_by("category", "name"))
def _(spark, sf):
    """The stock rules as rows, through the index of their literal pieces."""
    found = rule_index.match_files_by_table(planted.files(spark, sf), rule_index.rule_rows(spark, rules.stock_rules()))
    return _counts(found, "category", "name")


#: The first three ASCII words of a document, as a pattern of its own.
_THREE_WORDS = "([A-Za-z]{3,})[^A-Za-z]{1,3}([A-Za-z]{3,})[^A-Za-z]{1,3}([A-Za-z]{3,})"


@check(
    "r2_many_rules",
    f"WITH {sql.source('plain')}, {sql.LINES}, r AS (SELECT doc_id, regexp_extract(text, '{_THREE_WORDS}', 1) AS a, "
    f"regexp_extract(text, '{_THREE_WORDS}', 2) AS b, regexp_extract(text, '{_THREE_WORDS}', 3) AS c FROM documents), "
    "hits AS (SELECT doc_id, path, line FROM texts JOIN r ON a <> '' AND contains(lower(text), lower(a)) AND contains(lower(text), lower(b)) "
    f"AND contains(lower(text), lower(c)) WHERE NOT {sql.noise_line('text')} "
    "AND CASE WHEN contains(lower(text), lower(c)) THEN regexp_matches(text, a || '[^a-z]{1,3}' || b || '[^a-z]{1,3}' || c, 'i') ELSE false END) "
    "SELECT 'm' || doc_id AS name, count(*) AS findings FROM hits GROUP BY doc_id",
)
def _(spark, sf):
    """A rule for each document, of its first words, over all documents' lines."""
    docs = table(spark, sf, "documents")
    words = [F.regexp_extract("text", _THREE_WORDS, k) for k in (1, 2, 3)]
    made = docs.select("doc_id", F.concat_ws("[^a-z]{1,3}", *words).alias("pattern")).where("length(pattern) > 22").selectExpr(
        "CAST(doc_id AS int) AS rule_ord", "'MANY' AS category", "concat('m', doc_id) AS name", "array('') AS file_exts",
        "array(pattern) AS vuln_patterns", "'LOW' AS severity", "50 AS confidence", "'N/A' AS cwe", "'' AS vuln_desc",
    )
    files = docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("path"), F.col("text").alias("content"))
    return _counts(rule_index.match_files_by_table(files, made), "name")


@check(
    "r3_invalid_pattern",
    sql.rule_matches([rules.Rule("CUSTOM", "Broken", ("",), (r"notes\.(bak|old)",), severity="INFO")]).count_by("name"),
)
def _(spark, sf):
    accepted, _rejected = rules.accept_rules(spark, USER_RULES[2:])
    return _counts(matchers.match_files(planted.files(spark, sf), accepted), "name")


def _rule_counts(spark, sf, picked: DataFrame) -> DataFrame:
    """Rules of the table with their findings, none included."""
    found = _counts(matchers.rule_matches(planted.files(spark, sf)), "name")
    return picked.select("rule_id", "name").join(found, "name", "left").select(
        "rule_id", "name", F.coalesce("findings", F.lit(0)).alias("findings")
    )


def _rule_oracle(picked) -> str:
    values = ", ".join(f"({planted.quote(r.rule_id)}, {planted.quote(r.name)})" for r in picked)
    found = sql.rule_matches(rules.stock_rules()).rows()
    return (
        f"WITH found AS ({found}), picked(rule_id, name) AS (VALUES {values}), "
        "c AS (SELECT name, count(*) AS n FROM found GROUP BY name) "
        "SELECT rule_id, name, coalesce(n, 0) AS findings FROM picked LEFT JOIN c USING (name)"
    )


@check("r4_rules_by_category", _rule_oracle([r for r in rules.stock_rules() if r.category == "INPUT"]))
def _(spark, sf):
    return _rule_counts(spark, sf, rules.rules_by_category(rules.rule_table(spark), "INPUT"))


@check("r5_rules_by_severity", _rule_oracle([r for r in rules.stock_rules() if r.severity == "CRITICAL"]))
def _(spark, sf):
    return _rule_counts(spark, sf, rules.rules_by_severity(rules.rule_table(spark), "critical"))


@check(
    "r6_rule_categories",
    f"WITH found AS ({sql.rule_matches(rules.stock_rules()).rows()}), packs(pack, rules) AS (VALUES "
    "('IAM', 1), ('INPUT', 7), ('API', 1), ('FILE', 3), ('FRONTEND', 1), ('INFRASTRUCTURE', 3), "
    "('COMMUNICATIONS', 3)), c AS (SELECT category AS pack, count(*) AS n FROM found GROUP BY category) "
    "SELECT pack, CAST(rules AS BIGINT) AS rules, coalesce(n, 0) AS findings FROM packs LEFT JOIN c USING (pack)",
)
def _(spark, sf):
    found = _counts(matchers.rule_matches(planted.files(spark, sf)), "category")
    packs = rules.rule_categories(rules.rule_table(spark))
    return packs.join(found, packs["pack"] == found["category"], "left").select(
        "pack", "rules", F.coalesce("findings", F.lit(0)).alias("findings")
    )


@check("r7_o8_pattern_hits", sql.pattern_hits([p for r in rules.stock_rules() for p in r.vuln_patterns]))
def _(spark, sf):
    trace = matchers.rule_trace(planted.files(spark, sf), "")
    hits = trace.select("pattern", "path", "line").distinct().groupBy("pattern").agg(
        F.count("*").alias("hits")
    )
    patterns = rules.distinct_patterns(rules.rule_table(spark))
    return patterns.join(hits, "pattern", "left").select(
        "pattern", F.coalesce("hits", F.lit(0)).alias("hits")
    )


@check("r8_scan_modes", " UNION ALL ".join(
    f"SELECT * FROM ({sql.mode_counts(mode, rules.mode_patterns(mode))})" for mode in rules.MODES
))
def _(spark, sf):
    found = extract.mode_matches(planted.files(spark, sf), "path", **CUTS)
    counts = found.groupBy("mode").agg(F.count("*").alias("matches"))
    sizes = rules.mode_table(spark).groupBy("mode", "severity").agg(F.count("*").alias("patterns"))
    return sizes.join(counts, "mode", "left").select(
        "mode", "severity", "patterns", F.coalesce("matches", F.lit(0)).alias("matches")
    )


@check("r9_xss_rules", _rule_oracle([r for r in rules.stock_rules() if r.surface == "xss"]))
def _(spark, sf):
    return _rule_counts(spark, sf, rules.xss_rules(rules.rule_table(spark)))


# --- joins and lookups --------------------------------------------------------------------------------


@check("j1_rules_for_files", sql.rules_for_files(rules.stock_rules()))
def _(spark, sf):
    return rules.rules_for_files(planted.files(spark, sf))


@check(
    "j4_owasp",
    _FINDINGS + f"SELECT event_id, category, {sql.owasp('category')} AS owasp FROM findings",
)
def _(spark, sf):
    return planted.findings(spark, sf).select(
        "event_id", "category", lookups.owasp(F.col("category")).alias("owasp")
    )


_RESPONSES = f"WITH {planted.RESPONSES_SQL}, {sql.LIVE} "


@check(
    "j5_live_endpoints",
    _RESPONSES + "SELECT resp_id, endpoint FROM responses SEMI JOIN live_strict USING (site, endpoint)",
)
def _(spark, sf):
    captured = planted.responses(spark, sf)
    probes = captured.withColumn("site", urls.site(F.col("url")))
    live = responses.live_endpoints(captured)
    return probes.join(live, ["site", "endpoint"], "left_semi").select("resp_id", "endpoint")


_PAGES = f"WITH {planted.PAGES_SQL}, {sql.PAGE_PARTS} "


@check(
    "j6_m6_discovered_endpoints",
    _PAGES + f", live AS (SELECT DISTINCT site, endpoint FROM endpoints WHERE length(endpoint) % 2 = 0), "
    "reported AS (SELECT DISTINCT site, endpoint FROM script_endpoints) "
    "SELECT DISTINCT site, endpoint FROM endpoints e SEMI JOIN live USING (site, endpoint) "
    f"WHERE NOT {sql.build_artifact('endpoint')} AND (site, endpoint) NOT IN (SELECT (site, endpoint) FROM reported)",
)
def _(spark, sf):
    crawled = planted.pages(spark, sf)
    endpoints = pages.distinct_endpoints(crawled)
    live = endpoints.filter(F.length("endpoint") % 2 == 0)
    reported = pages.script_endpoints(crawled).select(
        urls.site(F.col("url")).alias("site"), "endpoint"
    ).distinct()
    return extract.discovered_endpoints(endpoints, reported, live, "site", "endpoint")


_HOST = (
    "CASE page_id % 7 WHEN 0 THEN 'p' || page_id || '.vercel.app' WHEN 1 THEN 'evilvercel.app' "
    "WHEN 2 THEN 'x.netlify.app' WHEN 3 THEN 'y.github.io' WHEN 4 THEN 'z.herokuapp.com' "
    "WHEN 5 THEN 'c.cloudfront.net' ELSE 'h' || page_id || '.example.com' END"
)
_PLATFORM = (
    "CASE WHEN host LIKE '%vercel.app' THEN '76.76.21.21' WHEN host LIKE '%netlify.app' THEN "
    "'75.2.60.5' WHEN host LIKE '%github.io' THEN '185.199.108.153' WHEN host LIKE "
    "'%herokuapp.com' THEN '34.120.151.151' WHEN host LIKE '%cloudfront.net' THEN '54.192.0.0' END"
)


@check("j8_platform_hosts", f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host, {_PLATFORM} AS address FROM h")
def _(spark, sf):
    return lookups.platform_hosts(table(spark, sf, "pages").selectExpr("page_id", f"{_HOST} AS host"))


@check(
    "j9_resolved_hosts",
    f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), r AS (SELECT host, '10.0.0.' || "
    "page_id % 250 AS captured FROM h WHERE page_id % 7 = 6 AND page_id % 2 = 0) "
    f"SELECT DISTINCT host, coalesce({_PLATFORM}, captured) AS address FROM h LEFT JOIN r USING (host)",
)
def _(spark, sf):
    hosts = table(spark, sf, "pages").selectExpr("page_id", f"{_HOST} AS host")
    captured = hosts.filter("page_id % 7 = 6 AND page_id % 2 = 0").selectExpr(
        "host", "'10.0.0.' || page_id % 250 AS address"
    )
    return lookups.resolve_hosts(hosts, captured)


# --- matchers -------------------------------------------------------------------------------------------


@check("m1_j2_rule_matcher", sql.rule_matches(rules.stock_rules()).rows())
def _(spark, sf):
    return matchers.rule_matches(planted.files(spark, sf)).select(*FINDING_COLUMNS)


@check("m2_m3_category_matcher", sql.category_matches(CATEGORY_PATTERNS))
def _(spark, sf):
    return matchers.category_matches(planted.files(spark, sf)).select(*FINDING_COLUMNS)


@check("m3_stored_lines", sql.category_matches(CATEGORY_PATTERNS))
def _(spark, sf):
    rows = _planted_lines(spark, sf).select("path", "line", "text")
    return matchers.category_matches_of_lines(rows).select(*FINDING_COLUMNS)


@check("m4_find_all", sql.find_all_lines(rules.mode_patterns("2"), script=True))
def _(spark, sf):
    return extract.find_all_in_lines(
        planted.files(spark, sf), "path", patterns=rules.mode_patterns("2"), script=True, **CUTS
    ).select("path", "line", "pat_ord", "match_pos", "value")


@check("m5_endpoint_candidates", sql.endpoint_candidates(rules.mode_patterns("1")))
def _(spark, sf):
    sited = planted.pages(spark, sf).withColumn("site", urls.site(F.col("url")))
    matches = extract.find_all_in_lines(
        sited, "page_id", "site", "url", patterns=rules.mode_patterns("1"), content="html",
        min_chars=catalogue_noise.MIN_LINE_CHARS,
    )
    return extract.endpoint_candidates(
        matches, "site", base_url="site", longer_than=extract.MIN_ENDPOINT_CHARS
    ).select(
        "site", "value", "line", "pat_ord", "full_url"
    )


@check("m7_rule_trace", sql.rule_trace([r for r in rules.stock_rules() if "sql" in r.name.lower()]))
def _(spark, sf):
    return matchers.rule_trace(planted.files(spark, sf), "SQL").select(
        "path", "line", "rule_id", "pat_ord", "pattern"
    )


def _register_detectors() -> None:
    for i, category in enumerate(CATEGORY_PATTERNS, 1):
        def by_category(spark, sf, category=category):
            return matchers.category_matches(planted.files(spark, sf), [category]).select(
                *FINDING_COLUMNS
            )

        check(f"d{i:02d}_{category.replace('-', '_')}", sql.category_matches([category]))(by_category)
    for rule in rules.stock_rules():
        def by_rule(spark, sf, rule=rule):
            return matchers.rule_matches(planted.files(spark, sf), [rule]).select(*FINDING_COLUMNS)

        name = f"rule_{rule.rule_id.lower().replace('-', '_')}"
        check(name, sql.rule_matches([rule]).rows())(by_rule)


_register_detectors()


@check("documents_secrets", sql.category_matches(["secrets-config"], source="plain"))
def _(spark, sf):
    files = table(spark, sf, "documents").selectExpr(
        "'d' || doc_id AS path", "text AS content"
    )
    return matchers.category_matches(files, ["secrets-config"]).select(*FINDING_COLUMNS)


@check("conversations_secrets", sql.category_matches(["secrets-config"], source="conversations"))
def _(spark, sf):
    files = table(spark, sf, "conversations").selectExpr(
        "'c' || conv_id || '/' || turn AS path",
        "text || chr(10) || CASE turn % 3 WHEN 0 THEN 'token = \"abc-123\"' WHEN 1 THEN 'plain' "
        "ELSE 'secret: \"s-1\"' END AS content",
    )
    return matchers.category_matches(files, ["secrets-config"]).select(*FINDING_COLUMNS)


# --- secrets ----------------------------------------------------------------------------------------------


def _register_secrets() -> None:
    named = {
        "x1_api_key": extract.PAGE_SECRETS[0][1], "x2_jwt_secret": extract.PAGE_SECRETS[1][1],
        "x3_sk_key": extract.PAGE_SECRETS[2][1], "x4_access_key_id": extract.PAGE_SECRETS[3][1],
        "x5_webhook_secret": extract.PAGE_SECRETS[4][1],
        "x5_webhook_secret_spaced": extract.SITE_SECRETS[6][1],
        "x6_password": extract.PAGE_SECRETS[5][1], "x7_jwt": extract.SITE_SECRETS[4][1],
        "x8_private_key": extract.SITE_SECRETS[5][1],
    }
    for name, pattern in named.items():
        def secrets(spark, sf, pattern=pattern):
            return extract.find_all(
                planted.files(spark, sf), "doc_id", content="content", patterns=[pattern]
            ).select("doc_id", "match_pos", "value")

        check(name, sql.find_all(pattern))(secrets)


_register_secrets()


@check("x9_page_secret_findings", sql.secret_findings(extract.PAGE_SECRETS, page=True))
def _(spark, sf):
    found = extract.page_secrets(planted.files(spark, sf), "doc_id", content="content", url="path")
    return found.drop("pat_ord", "match_pos")


@check("x9_site_secret_findings", sql.secret_findings(extract.SITE_SECRETS, page=False))
def _(spark, sf):
    found = extract.site_secrets(planted.files(spark, sf), "doc_id", content="content")
    return found.drop("pat_ord", "match_pos", "remediation")


# --- pages --------------------------------------------------------------------------------------------------


@check("w01_anchor_links", _PAGES + "SELECT DISTINCT page_id, link FROM links")
def _(spark, sf):
    return pages.anchor_links(planted.pages(spark, sf)).select("page_id", "link")


def _page_query(name: str, oracle: str, rows: Callable[[DataFrame], DataFrame]) -> None:
    check(name, _PAGES + oracle)(lambda spark, sf: rows(planted.pages(spark, sf)))


_page_query(
    "w02_path_endpoints", "SELECT page_id, endpoint FROM path_endpoints",
    lambda p: pages.path_endpoints(pages.anchor_links(p)).select("page_id", "endpoint"),
)
_page_query(
    "w03_prefix_endpoints", "SELECT page_id, endpoint FROM prefix_endpoints",
    lambda p: pages.prefix_endpoints(pages.anchor_links(p)).select("page_id", "endpoint"),
)
_page_query(
    "w04_query_endpoints", "SELECT page_id, endpoint FROM query_endpoints",
    lambda p: pages.query_endpoints(pages.anchor_links(p)).select("page_id", "endpoint"),
)
_page_query(
    "w05_script_files", "SELECT page_id, script, pos FROM script_files",
    lambda p: pages.script_files(p).select("page_id", "script", "pos"),
)
_page_query(
    "w06_script_endpoints", "SELECT page_id, endpoint FROM script_endpoints",
    lambda p: pages.script_endpoints(p).select("page_id", "endpoint"),
)
_page_query(
    "w07_data_urls", "SELECT page_id, endpoint FROM data_urls",
    lambda p: pages.data_url_endpoints(p).select("page_id", "endpoint"),
)
_page_query(
    "w08_form_actions", "SELECT page_id, endpoint FROM form_actions",
    lambda p: pages.form_endpoints(p).select("page_id", "endpoint"),
)
_page_query(
    "w09_site_endpoints", "SELECT DISTINCT site, endpoint FROM endpoints", pages.site_endpoints
)
_page_query("w10_crawl_rows", "SELECT DISTINCT * FROM crawl_rows", pages.crawl_rows)
_page_query(
    "w10_b7_crawl_summary",
    "SELECT site, count(DISTINCT value) FILTER (kind = 'js_file') AS js_files, "
    "count(DISTINCT value) FILTER (kind = 'html_page') AS html_pages, "
    "count(DISTINCT value) FILTER (kind = 'endpoint') AS endpoints FROM crawl_rows GROUP BY site",
    pages.crawl_summary,
)

_SCRIPT = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'a<b>c__d?v=1' WHEN 2 THEN 'x.js?y=2' ELSE 'p|q*r\"' || page_id END"


@check(
    "w11_script_name",
    f"WITH s AS (SELECT page_id, {_SCRIPT} AS script FROM pages), n AS (SELECT page_id, "
    "regexp_replace(regexp_replace(string_split(script, '?')[1], '[<>:\"/\\\\|?*]', '_', 'g'), "
    "'_+', '_', 'g') AS name FROM s) "
    "SELECT page_id, CASE WHEN name LIKE '%.js' THEN name ELSE name || '.js' END AS name FROM n",
)
def _(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", f"{_SCRIPT} AS script")
    return rows.select("page_id", pages.script_name(F.col("script")).alias("name"))


_page_query(
    "w12_stored_scripts",
    "SELECT site, name, script FROM (SELECT *, row_number() OVER (PARTITION BY site, name ORDER BY "
    "page_id, pos) AS rn FROM (SELECT *, regexp_replace(regexp_extract(script, '[^/]*$', 0), "
    "'_+', '_', 'g') AS name FROM script_files)) WHERE rn = 1",
    pages.stored_scripts,
)


@check("w13_hostname", f"SELECT page_id, lower(regexp_extract({sql.authority('url')}, '^[^:]*', 0)) AS host FROM pages")
def _(spark, sf):
    return pages.page_hosts(table(spark, sf, "pages"))


_page_query(
    "w14_risky_parameters",
    f"SELECT DISTINCT page_id, key FROM (SELECT page_id, key FROM query_keys UNION ALL SELECT page_id, "
    f"key FROM own_query_keys) WHERE key IN ({', '.join(planted.quote(p) for p in dict.fromkeys(web.RISKY_PARAMETERS))})",
    pages.risky_query_parameters,
)


# --- captured responses ---------------------------------------------------------------------------------------


@check("a01_live_strict", _RESPONSES + "SELECT * FROM live_strict")
def _(spark, sf):
    return responses.live_endpoints(planted.responses(spark, sf))


@check("a02_live_lax", _RESPONSES + "SELECT * FROM live_lax")
def _(spark, sf):
    return responses.live_endpoints(planted.responses(spark, sf), responses.LAX_STATUSES)


@check("a03_reflection", _RESPONSES + f"SELECT resp_id FROM responses WHERE payload IS NOT NULL AND {sql.REFLECTED}")
def _(spark, sf):
    return responses.reflected(planted.responses(spark, sf)).select("resp_id")


DETECTION_COLUMNS = (
    "detector", "site", "resp_id", "category", "name", "description", "severity", "confidence",
    "endpoint", "parameter", "payload", "evidence", "url", "cwe", "technique", "owasp", "file",
    "snippet", "status",
)
DETECTIONS = {
    "a04_reflected": ["reflected"], "a05_dom_sink": ["dom_sink"], "a06_parameter": ["parameter"],
    "a07_login_reflection": ["login_reflection", "login_script"],
    "a08_search_and_fragment": ["search_reflection", "fragment_reflection"],
    "a09_database_error": ["database_error"], "a10_login_bypass": ["login_bypass"],
    "a11_template": ["template"], "a12_graphql": ["graphql"], "a13_command": ["command"],
    "a14_open_redirect": ["open_redirect"], "a15_internal_fetch": ["internal_fetch"],
    "a16_file_read": ["file_read", "file_read_probe"],
    "a17_object_reference": ["object_reference", "object_probe"],
    "a18_upload": ["upload_accepted", "upload_probe"], "a19_cors": ["cors", "cors_probe"],
    "a20_token": ["token"], "a21_admin_panel": ["admin_panel", "admin_probe"],
    "a22_debug_mode": ["debug_mode"], "a23_sensitive_api": ["sensitive_api"],
}


def _register_responses() -> None:
    for name, ids in DETECTIONS.items():
        def detected(spark, sf, ids=ids):
            return responses.detect(planted.responses(spark, sf), ids, limits=responses.LIVE_SCAN).select(*DETECTION_COLUMNS)

        check(name, _RESPONSES + sql.detections(ids))(detected)


_register_responses()


@check("a25_framework_scan", _RESPONSES + sql.detections(list(responses.BY_ID)))
def _(spark, sf):
    return responses.detect(planted.responses(spark, sf), limits=responses.LIVE_SCAN).select(*DETECTION_COLUMNS)


@check("a24_signatures", sql.signatures())
def _(spark, sf):
    requests = planted.responses(spark, sf).withColumn(
        "request", F.concat_ws(" ", "method", "url", "payload")
    )
    return lookups.signature_matches(requests, "resp_id", text="request")


# --- scalar functions -------------------------------------------------------------------------------------------


@check("f1_risk", _FINDINGS + f"SELECT event_id, category, ({sql.risk('category')})[1] AS severity, CAST(({sql.risk('category')})[2] AS INTEGER) AS confidence FROM findings")
def _(spark, sf):
    rows = planted.findings(spark, sf)
    found = risk.risk(F.col("category"))
    return rows.select("event_id", "category", found["severity"].alias("severity"), found["confidence"].alias("confidence"))


@check("f2_risk_score", _FINDINGS + f"SELECT event_id, {sql.score('severity', 'confidence')} AS risk_score FROM findings")
def _(spark, sf):
    rows = planted.findings(spark, sf)
    return rows.select("event_id", risk.risk_score(F.col("severity"), F.col("confidence")).alias("risk_score"))


@check(
    "f3_classify",
    _FINDINGS + f", r AS (SELECT event_id, {sql.risk(chr(99) + 'oalesce(category, ' + chr(39) + 'UNKNOWN' + chr(39) + ')')} AS r FROM findings) "
    "SELECT event_id, r[1] AS severity, CAST(r[2] AS INTEGER) AS confidence, "
    f"{sql.score('r[1]', 'CAST(r[2] AS INTEGER)')} AS risk_score FROM r",
)
def _(spark, sf):
    return risk.classify(planted.findings(spark, sf)).select(
        "event_id", "severity", "confidence", "risk_score"
    )


@check("f4_severity_priority", _FINDINGS + f"SELECT event_id, {sql.priority('severity')} AS priority FROM findings")
def _(spark, sf):
    return planted.findings(spark, sf).select(
        "event_id", risk.severity_priority(F.col("severity")).alias("priority")
    )


@check(
    "f5_o2_finding_ids",
    _FINDINGS + "SELECT event_id, upper(substr(coalesce(category, 'none'), 1, 4)) || '-' || "
    "CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS finding_id "
    "FROM (SELECT *, row_number() OVER (ORDER BY file, event_id) - 1 AS n FROM findings)",
)
def _(spark, sf):
    rows = planted.findings(spark, sf).withColumn("category", F.coalesce("category", F.lit("none")))
    numbered = findings.with_running_ids(
        rows, findings.category_prefix(), "file", "event_id", width=3
    )
    return numbered.select("event_id", "finding_id")


@check("f6_percent_encode", "SELECT doc_id, md5(replace(url_encode(text), '%2F', '/')) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.percent_encode(F.col("text"))).alias("digest")
    )


@check(
    "f7_escape",
    "SELECT page_id, md5(replace(replace(replace(replace(html, '<', '&lt;'), '>', '&gt;'), '\"', "
    "'&quot;'), '''', '&#39;')) AS digest FROM pages",
)
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.md5(text.escape_payload(F.col("html"))).alias("digest")
    )


@check("f8_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", exports.iso_time(F.col("ts")).alias("iso"))


_CSV = (
    "SELECT '' AS finding_id, coalesce(category, '') AS category, name, file, CAST(line AS VARCHAR) "
    "AS line, '' AS status, coalesce(severity, '') AS severity, CAST(confidence AS VARCHAR) AS "
    "confidence, description, '' AS cwe FROM findings"
)


@check("f9_csv_defaults", _FINDINGS + _CSV)
def _(spark, sf):
    return exports.csv_rows(planted.findings(spark, sf))


# --- reports --------------------------------------------------------------------------------------------------------


@check(
    "b1_severity_counts",
    _FINDINGS + "SELECT upper(coalesce(severity, 'MEDIUM')) AS severity, count(*) AS findings FROM findings GROUP BY 1",
)
def _(spark, sf):
    rows = planted.findings(spark, sf).withColumn("severity", F.upper("severity"))
    return reports.severity_counts(rows)


@check("b2_category_counts", _FINDINGS + "SELECT coalesce(category, 'UNKNOWN') AS category, count(*) AS findings FROM findings GROUP BY 1")
def _(spark, sf):
    return reports.category_counts(planted.findings(spark, sf), "event_id")


@check(
    "b3_severity_summary",
    _FINDINGS + ", s AS (SELECT coalesce(severity, 'MEDIUM') AS severity FROM findings) SELECT "
    "count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, "
    "count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM s",
)
def _(spark, sf):
    return reports.severity_summary(planted.findings(spark, sf))


XSS_IDS = ["reflected", "dom_sink", "parameter", "login_reflection"]
_XSS = _RESPONSES + (
    f", hits AS ({sql.detections(XSS_IDS)}), x AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY site, "
    f"endpoint, parameter, payload ORDER BY list_position({XSS_IDS}, detector), resp_id) = 1) "
)


def _first_xss(captured):
    """Findings of the XSS detectors, without repeats of a (site, endpoint, parameter, payload)."""
    return findings.deduplicate_xss(responses.detect(captured, XSS_IDS, limits=responses.LIVE_SCAN), "detector_ord", "resp_id")


@check(
    "b4_xss_summary",
    _XSS + ", t AS (SELECT count(DISTINCT endpoint || ':' || parameter) AS n FROM responses WHERE payload "
    "IS NOT NULL) SELECT count(*) AS total_findings, count(DISTINCT endpoint || ':' || parameter) AS "
    "vulnerable_params, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity "
    "= 'HIGH') AS high, max(n) AS tested_params FROM x, t",
)
def _(spark, sf):
    captured = planted.responses(spark, sf)
    tested = captured.filter(F.col("payload").isNotNull()).select("endpoint", "parameter")
    return reports.xss_summary(_first_xss(captured), tested)


@check(
    "b5_report_header",
    _FINDINGS + "SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, "
    "count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium FROM findings",
)
def _(spark, sf):
    return reports.report_header(planted.findings(spark, sf))


_TAKEN = f"({sql.scanned_extension('path')} AND NOT {sql.noise_path('path')} AND length <= 10485760)"


@check(
    "b6_scan_counters",
    f"WITH f AS ({sql.rule_matches(rules.stock_rules()).rows()}), {planted.FILES_SQL} SELECT "
    f"count(*) FILTER ({_TAKEN}) AS scanned, count(*) FILTER (NOT {_TAKEN}) AS skipped, "
    f"(SELECT count(*) FROM f) AS findings FROM files WHERE NOT {sql.skipped_dir('path')}",
)
def _(spark, sf):
    files = planted.files(spark, sf)
    return reports.scan_counters(tree.scan_counts(files, catalogue_noise.MAX_FILE_BYTES), matchers.rule_matches(files))


@check(
    "b8_endpoints_with_hit",
    _XSS + ", v AS (SELECT DISTINCT endpoint || ':' || parameter AS pair FROM x) SELECT DISTINCT endpoint, "
    "EXISTS (SELECT 1 FROM v WHERE starts_with(pair, endpoint)) AS hit FROM responses",
)
def _(spark, sf):
    captured = planted.responses(spark, sf)
    vulnerable = reports.vulnerable_parameters(responses.detect(captured, XSS_IDS, limits=responses.LIVE_SCAN))
    return reports.endpoints_with_hit(captured, vulnerable)


# --- listings, dedup and union -------------------------------------------------------------------------------------


@check(
    "o3_listing",
    _FINDINGS + "SELECT 'N/A' AS id, coalesce(severity, 'MEDIUM') AS severity, substr(coalesce(category, "
    "'N/A'), 1, 10) AS category, substr(file || CASE WHEN line > 0 THEN ':' || line ELSE '' END, 1, 23) "
    "AS location, substr(description, 1, 48) AS description FROM findings ORDER BY event_id LIMIT 100",
)
def _(spark, sf):
    rows = planted.findings(spark, sf).withColumn("finding_id", F.lit(None).cast("string"))
    return reports.listing(rows, "event_id", rows=reports.LISTING_ROWS)


@check(
    "o4_xss_listing",
    _XSS + "SELECT 'XSS-' || substr(lpad(CAST(n AS VARCHAR), 3, '0'), 1, 2) AS id, substr(technique, 1, 16) AS "
    "technique, substr(endpoint, 1, 13) AS endpoint, substr(parameter, 1, 10) AS parameter, "
    "substr(payload, 1, 33) AS payload, confidence || '%' AS confidence FROM (SELECT *, row_number() OVER "
    "(ORDER BY detector, resp_id) - 1 AS n FROM x)",
)
def _(spark, sf):
    found = _first_xss(planted.responses(spark, sf))
    return reports.xss_listing(
        findings.with_running_ids(found, "XSS", "detector", "resp_id", width=3)
    )


FRAMEWORK_IDS = [d.id for d in responses.DETECTORS if d.shape == "framework"]


@check(
    "o4_framework_listing",
    _RESPONSES + f", x AS ({sql.detections(FRAMEWORK_IDS)}) SELECT CAST(row_number() OVER (ORDER BY detector, "
    "site, resp_id) AS VARCHAR) AS number, substr(category, 1, 23) AS category, substr(name, 1, 28) AS name, "
    "severity, substr(endpoint, 1, 18) AS endpoint FROM x",
)
def _(spark, sf):
    found = responses.detect(planted.responses(spark, sf), FRAMEWORK_IDS, limits=responses.LIVE_SCAN)
    numbered = number_rows(found, "detector", "site", "resp_id", column="number", start=1)
    return reports.framework_listing(numbered)


@check(
    "o5_keep_first",
    _RESPONSES + "SELECT site, endpoint, parameter, payload, resp_id, status FROM (SELECT *, row_number() OVER "
    "(PARTITION BY site, endpoint, parameter, payload ORDER BY resp_id) AS rn FROM responses) WHERE rn = 1",
)
def _(spark, sf):
    rows = planted.responses(spark, sf).select(
        urls.site(F.col("url")).alias("site"), "endpoint", "parameter", "payload", "resp_id", "status"
    )
    return findings.deduplicate_xss(rows, "resp_id")


@check("o6_result_order", sql.rule_matches(rules.stock_rules()).rows())
def _(spark, sf):
    return findings.ordered(matchers.rule_matches(planted.files(spark, sf))).select(*FINDING_COLUMNS)


@check(
    "o7_union",
    f"WITH f AS ({sql.rule_matches(rules.stock_rules()).rows()}), {planted.RESPONSES_SQL}, {sql.LIVE}, "
    f"x AS ({sql.detections(FRAMEWORK_IDS)}) SELECT category, name, severity, confidence, "
    "endpoint, file FROM x UNION ALL SELECT category, name, severity, confidence, NULL, file FROM f",
)
def _(spark, sf):
    found = findings.union_findings(
        matchers.rule_matches(planted.files(spark, sf)),
        responses.detect(planted.responses(spark, sf), FRAMEWORK_IDS, limits=responses.LIVE_SCAN),
    )
    return found.select("category", "name", "severity", "confidence", "endpoint", "file")


# --- sinks -----------------------------------------------------------------------------------------------------------


@check("k1_json", _FINDINGS + "SELECT category, severity, confidence, file, line, snippet FROM findings")
def _(spark, sf):
    path = exports.write_json(planted.findings(spark, sf), fresh_path(spark, "json"))
    return stored.read_findings(spark, path).select(
        "category", "severity", "confidence", "file", "line", "snippet"
    )


@check(
    "k2_table",
    _FINDINGS + "SELECT file AS file_path, line AS line_num, category, severity, confidence, description, "
    "CAST(0 AS INTEGER) AS risk_score, row_number() OVER (ORDER BY file, line, category NULLS FIRST, name, "
    "snippet, severity NULLS FIRST, confidence, description) AS id FROM findings",
)
def _(spark, sf):
    name = f"security_findings_{uuid.uuid4().hex}"
    exports.write_table(planted.findings(spark, sf), name, fresh_path(spark, "table"))
    return spark.table(name).select(
        "file_path", "line_num", "category", "severity", "confidence", "description", "risk_score", "id"
    )


@check("k3_csv", _FINDINGS + _CSV)
def _(spark, sf):
    path = exports.write_csv(planted.findings(spark, sf), fresh_path(spark, "csv"))
    rows = spark.read.option("header", True).option("escape", '"').schema(
        ", ".join(f"{c} string" for c in exports.CSV_COLUMNS)
    ).csv(path)
    return rows.fillna("")


_HTML_ROW = (
    "'<tr><td><span class=\"' || lower(coalesce(severity, 'MEDIUM')) || '\">' || coalesce(severity, "
    "'MEDIUM') || '</span></td><td>' || coalesce(category, 'N/A') || '</td><td>' || name || '</td><td>' "
    "|| file || ':' || line || '</td></tr>'"
)


@check(
    "k4_html",
    _FINDINGS + f", body AS (SELECT {_HTML_ROW} AS value FROM findings) SELECT value, count(*) AS rows FROM body GROUP BY value "
    f"UNION ALL SELECT {planted.quote(exports._PAGE_HEAD)} || '<p>Total Findings: ' || count(*) || "
    "'</p><p>Critical: ' || count(*) FILTER (severity = 'CRITICAL') || '</p><p>High: ' || count(*) FILTER "
    "(severity = 'HIGH') || '</p><p>Medium: ' || count(*) FILTER (severity = 'MEDIUM') || '</p>' || "
    f"{planted.quote(exports._TABLE_HEAD)}, 1 FROM findings UNION ALL SELECT '</tbody></table></body></html>', 1",
)
def _(spark, sf):
    path = exports.write_html(planted.findings(spark, sf), fresh_path(spark, "html"))
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("rows"))


@check("k5_envelope", _FINDINGS + "SELECT 'https://t.example' AS target, count(*) AS total_findings, count(*) AS stored FROM findings")
def _(spark, sf):
    path = exports.write_envelope(
        planted.findings(spark, sf), fresh_path(spark, "envelope"), "https://t.example"
    )
    counted = stored.read_findings(spark, f"{path}/findings").agg(F.count("*").alias("stored"))
    meta = spark.read.schema("target string, total_findings bigint").json(f"{path}/metadata")
    return meta.withColumn("one", F.lit(1)).join(counted.withColumn("one", F.lit(1)), "one").drop("one")


@check(
    "k6_all_formats",
    _FINDINGS + "SELECT unnest(['json', 'table', 'csv', 'html']) AS format, "
    "unnest([count(*), count(*), count(*), count(*) + 2]) AS rows FROM findings",
)
def _(spark, sf):
    written = exports.write_all(
        planted.findings(spark, sf), fresh_path(spark, "all"), f"security_findings_{uuid.uuid4().hex}"
    )
    read = {
        "json": spark.read.text(written["json"]), "table": spark.table(written["table"]),
        "csv": spark.read.option("header", True).schema("finding_id string, category string").csv(written["csv"]),
        "html": spark.read.text(written["html"]),
    }
    counts = None
    for name, rows in read.items():
        part = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("format"), "rows")
        counts = part if counts is None else counts.unionByName(part)
    return counts


@check("k7_likely_real_json", _REAL + "SELECT category, file, snippet FROM kept")
def _(spark, sf):
    path = exports.write_likely_real(planted.findings(spark, sf), fresh_path(spark, "real"))
    return stored.read_findings(spark, path).select("category", "file", "snippet")
