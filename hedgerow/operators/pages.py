"""Links, scripts, endpoints and parameters of stored pages (page_id, url, html).

Accepted HTML: tags and attribute names in any case; attribute values in double quotes, single
quotes or bare; comments and script bodies hold no tags. Character references in attribute values
are decoded for the names in `functions.text.ENTITIES`. A quoted attribute may hold `>`, and a comment
mark inside a script belongs to the script.

What a page names is worked out inside the page's row, as arrays, and repeats within the page go
there too: one narrow pass over the pages for all kinds. Only what has to be distinct across pages is
shuffled, by the whole value. A site's lists stay rows (site, kind, value), as a site may hold a third
of all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions import urls
from hedgerow.functions.numbering import first_per
from hedgerow.functions.patterns import can_match_sql, java_pattern
from hedgerow.functions.text import fold_sql, let_sql, sql_text, strip_sql, unescape_html_sql
from hedgerow.operators.lookups import risky_parameter_sql

_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Up to a quoted attribute and over it; what is left of a tag after the last one.
_OVER_QUOTED, _UNQUOTED = r"""[^>"']*+(?:"[^"]*+"|'[^']*+')""", r"""[^>"']*"""
_TAG_REST = f"(?:{_OVER_QUOTED})*+{_UNQUOTED}+"
# Comments, and scripts whole, in page order.
_COMMENTS = rf"(?is)(<script\b{_TAG_REST}>.*?</script\s*>)|<!--.*?-->"
_SCRIPTS = rf"(?is)<script\b({_TAG_REST})>(.*?)</script\s*>"
_SCRIPT_BODIES = rf"(?is)(<script\b{_TAG_REST}>).*?</script\s*>"

# Endpoint patterns in inline scripts, in order; the last group is the endpoint.
SCRIPT_ENDPOINT_PATTERNS = (
    r"""['\"](/api/[^'\"]+)['\"]""",
    r"""['\"](/v\d+/[^'\"]+)['\"]""",
    r"""['\"](/admin/[^'\"]+)['\"]""",
    r"""['\"](/user/[^'\"]+)['\"]""",
    r"""['\"](/login)['\"]""",
    r"""['\"](/logout)['\"]""",
    r"""['\"](/register)['\"]""",
    r"""['\"](/dashboard)['\"]""",
    r"""['\"](/profile)['\"]""",
    r"""fetch\s*\(\s*['\"]([^'\"]+)['\"]""",
    r"""axios\.(get|post|put|delete)\s*\(\s*['\"]([^'\"]+)['\"]""",
    r"""url\s*:\s*['\"]([^'\"]+)['\"]""",
    r"""endpoint\s*:\s*['\"]([^'\"]+)['\"]""",
)


def _attribute(tag: str, name: str) -> str:
    return rf"(?is)<{tag}(?=[\s/])(?:{_OVER_QUOTED})*?{_UNQUOTED}?\s{name}\s*=\s*{_VALUE}"


def _values(pattern: str, word: str) -> str:
    """SQL array of attribute values in page order, without quotes and references.

    `word` is a text every such tag holds; a page without it is not searched.
    """
    plain = let_sql(
        "CASE WHEN _v RLIKE '^[\"\\']' THEN substring(_v, 2, length(_v) - 2) ELSE _v END", "_w",
        unescape_html_sql("_w"),
    )
    found = f"transform(regexp_extract_all(markup, {sql_text(pattern)}, 1), _v -> {plain})"
    return (
        f"CASE WHEN contains(lower(markup), '{word}') THEN {found} "
        "ELSE CAST(array() AS ARRAY<STRING>) END"
    )


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, base, clean, markup): the page without comments, and without script bodies
    too."""
    clean = pages.select(
        "page_id", "url", F.rtrim("url", F.lit("/")).alias("base"),
        F.regexp_replace("html", _COMMENTS, "$1").alias("clean"),
    )
    return clean.withColumn("markup", F.regexp_replace("clean", _SCRIPT_BODIES, "$1"))


def _exploded(rows: DataFrame, values: str, name: str) -> DataFrame:
    """(page_id, url, pos, name): one row per element of the SQL array."""
    spread = rows.select("page_id", "url", F.expr(f"posexplode_outer({values}) AS (pos, {name})"))
    return spread.filter(F.col("pos").isNotNull())


def _links() -> str:
    """SQL array: targets of the page's anchors on its own domain, each once.

    Links without an authority, such as `mailto:`, count as own. Whitespace around a link is
    dropped, as browsers and URL parsers do.
    """
    hrefs = f"array_distinct({_values(_attribute('a', 'href'), 'href')})"
    resolved = f"transform({hrefs}, _h -> {urls.resolve_sql('base', strip_sql('_h'))})"
    own = let_sql(
        urls.authority_sql("_l"), "_a", f"_a = '' OR _a = {urls.authority_sql('url')}"
    )
    return f"array_distinct(filter({resolved}, _l -> {own}))"


def _scripts() -> str:
    """SQL array: external scripts that end in `.js` once the query is cut, each once, in page
    order."""
    sources = f"array_distinct({_values(_attribute('script', 'src'), '<script')})"
    absolute = (
        "CASE WHEN startswith(_s, '//') THEN concat('https:', _s) "
        f"WHEN startswith(_s, 'http') THEN _s ELSE {urls.resolve_sql('base', '_s')} END"
    )
    cut = f"transform({sources}, _s -> substring_index({absolute}, '?', 1))"
    return f"array_distinct(filter({cut}, _j -> endswith(_j, '.js')))"


def _inline_scripts() -> str:
    """SQL array: bodies of the page's scripts that have no source."""
    tag = sql_text(_SCRIPTS)
    blocks = (
        f"transform(regexp_extract_all(clean, {tag}, 0), _b -> named_struct("
        f"'head', regexp_extract(_b, {tag}, 1), 'body', regexp_extract(_b, {tag}, 2)))"
    )
    source = sql_text(r"(?i)(?:^|\s)src\s*=")
    inline = f"filter({blocks}, _b -> NOT _b.head RLIKE {source} AND _b.body <> '')"
    return f"transform({inline}, _b -> _b.body)"


def _named_in_scripts_sql(bodies: str) -> str:
    """SQL array of the endpoints that script bodies name and that start with `/`."""
    parts = []
    for pattern in SCRIPT_ENDPOINT_PATTERNS:
        group = 2 if pattern.startswith("axios") else 1
        found = f"regexp_extract_all(_c.t, {sql_text(java_pattern(pattern))}, {group})"
        parts.append(f"CASE WHEN {can_match_sql('_c.f', [pattern])} THEN {found} END")
    per_body = let_sql(
        f"named_struct('t', _body, 'f', {fold_sql('_body')})",
        "_c",
        f"filter(flatten(filter(array({', '.join(parts)}), _p -> _p IS NOT NULL)), "
        "_e -> startswith(_e, '/'))",
    )
    return f"flatten(transform({bodies}, _body -> {per_body}))"


def _data_urls() -> str:
    values = _values(_attribute(r"[a-z][a-z0-9-]*", "data-url"), "data-url")
    return f"filter({values}, _d -> _d <> '')"


def _form_actions() -> str:
    return f"filter({_values(_attribute('form', 'action'), '<form')}, _d -> _d <> '')"


def _link_endpoints(link: str) -> str:
    """SQL array: path, path prefixes and query keys of a link, as endpoints."""
    endpoints = (
        f"concat(filter(array(_path), _e -> _e NOT IN ('', '/')), {urls.path_prefixes_sql('_path')}, "
        f"transform({urls.query_keys_sql(link)}, _q -> concat('?', _q, '=')))"
    )
    return let_sql(urls.path_sql(link), "_path", endpoints)


def crawl_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, scripts, links, endpoints): everything a page names, as arrays."""
    parts = _parsed(pages).selectExpr(
        "page_id", "url", f"{_scripts()} AS scripts", f"{_links()} AS links",
        f"{_inline_scripts()} AS _bodies", f"concat({_data_urls()}, {_form_actions()}) AS _named",
    )
    endpoints = (
        f"array_distinct(concat(flatten(transform(links, _t -> {_link_endpoints('_t')})), "
        f"{_named_in_scripts_sql('_bodies')}, _named))"
    )
    return parts.selectExpr("page_id", "url", "scripts", "links", f"{endpoints} AS endpoints")


def anchor_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, link): anchors' absolute targets on the page's own domain, each once."""
    return _exploded(_parsed(pages), _links(), "link")


def path_endpoints(links: DataFrame) -> DataFrame:
    """Path of each link, unless empty or the root."""
    path = urls.path(F.col("link"))
    return links.select("page_id", "url", path.alias("endpoint")).filter(
        ~F.col("endpoint").isin("", "/")
    )


def prefix_endpoints(links: DataFrame) -> DataFrame:
    """Every prefix of each link's path, with one more slash in front."""
    prefixes = urls.path_prefixes_sql(urls.path_sql("link"))
    return _exploded(links, prefixes, "endpoint").drop("pos")


def query_parameters(links: DataFrame) -> DataFrame:
    """(page_id, url, key): query keys of each link."""
    return _exploded(links, urls.query_keys_sql("link"), "key").drop("pos")


def query_endpoints(links: DataFrame) -> DataFrame:
    """`?key=` for each query key of each link."""
    endpoint = F.concat(F.lit("?"), F.col("key"), F.lit("="))
    return query_parameters(links).select("page_id", "url", endpoint.alias("endpoint"))


def script_files(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, script): external scripts, each once per page."""
    return _exploded(_parsed(pages), _scripts(), "script")


def inline_scripts(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, script): bodies of scripts that have no source."""
    return _exploded(_parsed(pages), _inline_scripts(), "script")


def script_endpoints(pages: DataFrame) -> DataFrame:
    """(page_id, url, endpoint): endpoints named in inline scripts that start with `/`."""
    bodies = _parsed(pages).selectExpr("page_id", "url", f"{_inline_scripts()} AS _bodies")
    return _exploded(bodies, _named_in_scripts_sql("_bodies"), "endpoint").drop("pos")


def data_url_endpoints(pages: DataFrame) -> DataFrame:
    """Non-empty `data-url` attributes of any tag."""
    return _exploded(_parsed(pages), _data_urls(), "endpoint").drop("pos")


def form_endpoints(pages: DataFrame) -> DataFrame:
    """Non-empty form actions."""
    return _exploded(_parsed(pages), _form_actions(), "endpoint").drop("pos")


def distinct_endpoints(pages: DataFrame) -> DataFrame:
    """(site, endpoint), each once."""
    rows = _exploded(crawl_pages(pages), "endpoints", "endpoint")
    return rows.select(urls.site(F.col("url")).alias("site"), "endpoint").distinct()


def site_endpoints(pages: DataFrame) -> DataFrame:
    """(site, endpoint), each once, in order."""
    return distinct_endpoints(pages).orderBy("site", "endpoint")


def crawl_rows(pages: DataFrame) -> DataFrame:
    """(site, kind, value): scripts, pages and endpoints of each site, each once.

    The long form of a site's three lists; the key is the whole row, so no site is a hot key.
    """
    tagged = ", ".join(
        f"transform({name}, _x -> named_struct('kind', '{kind}', 'value', _x))"
        for name, kind in (("scripts", "js_file"), ("links", "html_page"), ("endpoints", "endpoint"))
    )
    rows = _exploded(crawl_pages(pages), f"concat({tagged})", "entry")
    return rows.select(urls.site(F.col("url")).alias("site"), "entry.*").distinct()


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Per site: how many scripts, pages and endpoints."""
    kind = F.col("kind")
    return crawl_rows(pages).groupBy("site").agg(
        F.count_if(kind == "js_file").alias("js_files"),
        F.count_if(kind == "html_page").alias("html_pages"),
        F.count_if(kind == "endpoint").alias("endpoints"),
    )


def script_name(name: Column) -> Column:
    """File name for a script: query cut, reserved characters to `_`, `.js` at the end."""
    cut = F.substring_index(name, "?", 1)
    safe = F.regexp_replace(F.regexp_replace(cut, r'[<>:"/\\|?*]', "_"), "_+", "_")
    return F.when(F.endswith(safe, F.lit(".js")), safe).otherwise(F.concat(safe, F.lit(".js")))


def stored_scripts(pages: DataFrame) -> DataFrame:
    """(site, name, script): the first script of a site to claim each file name."""
    named = script_files(pages).select(
        urls.site(F.col("url")).alias("site"),
        script_name(urls.basename(F.col("script"))).alias("name"),
        "page_id", "pos", "script",
    )
    return first_per(named, ["site", "name"], ["page_id", "pos"], ["script"])


def page_hosts(pages: DataFrame) -> DataFrame:
    """(page_id, host); a URL without a host raises."""
    return pages.select("page_id", urls.hostname(F.col("url")).alias("host"))


def risky_query_parameters(pages: DataFrame) -> DataFrame:
    """(page_id, key): listed query keys of the page's own URL and of its links, each once."""
    links = _parsed(pages).selectExpr("page_id", "url", f"concat(array(url), {_links()}) AS _all")
    keys = f"flatten(transform(_all, _t -> {urls.query_keys_sql('_t')}))"
    risky = f"array_distinct(filter({keys}, _k -> {risky_parameter_sql('_k')}))"
    return _exploded(links, risky, "key").select("page_id", "key")
