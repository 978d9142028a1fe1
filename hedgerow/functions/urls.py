"""URL parts and resolution as expressions.

Parts are cut by the generic URI grammar rather than a strict parser: stored links hold spaces and
other characters a strict parser rejects, and a rejected link would look like one without a host.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgerow.functions.text import let_sql, sql_text

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_SITE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def authority(url: Column) -> Column:
    """Host with port and user part; empty if the URL names none."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")


def hostname(url: Column) -> Column:
    """Lower-case host of a URL; raises if there is none."""
    host = F.lower(F.regexp_extract(authority(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.when(host != "", host).otherwise(
        F.raise_error(F.concat(F.lit("Invalid URL: "), url)).cast("string")
    )


def site(url: Column) -> Column:
    """Scheme and authority: the unit one scan covers."""
    return F.regexp_extract(url, _SITE, 1)


def is_web_url(url: Column) -> Column:
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def same_domain(url: Column, base_authority: Column) -> Column:
    """Same authority as the base, or none at all (so `mailto:` links pass)."""
    return (authority(url) == base_authority) | (authority(url) == "")


def drop_trailing_slashes(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def _part_sql(url: str, pattern: str) -> str:
    return f"regexp_extract({url}, {sql_text(pattern)}, 1)"


def path_sql(url: str) -> str:
    return f"regexp_replace({_part_sql(url, _PATH)}, ';[^/]*$', '')"


def authority_sql(url: str) -> str:
    return _part_sql(url, _AUTHORITY)


def _normal_path_sql(joined: str) -> str:
    """`.` and `..` segments resolved; `..` above the root is dropped."""
    kept = (
        "aggregate(_segments, CAST(array() AS ARRAY<STRING>), (_done, _s) -> CASE "
        "WHEN _s = '.' THEN _done "
        "WHEN _s = '..' THEN slice(_done, 1, greatest(size(_done) - 1, 0)) "
        "ELSE array_append(_done, _s) END)"
    )
    resolved = let_sql(
        f"split({joined}, '/')", "_segments",
        f"array_join(CASE WHEN element_at(_segments, -1) IN ('.', '..') "
        f"THEN array_append({kept}, '') ELSE {kept} END, '/')",
    )
    dots = sql_text(r"(?:^|/)\.\.?(?:/|$)")
    # Dropping the empty first segment loses the leading slash.
    return let_sql(
        f"CASE WHEN {joined} RLIKE {dots} THEN {resolved} ELSE {joined} END", "_p",
        "CASE WHEN startswith(_p, '/') THEN _p ELSE concat('/', _p) END",
    )


def resolve_sql(base: str, link: str) -> str:
    """SQL form of `urllib.parse.urljoin(base, link)` for an http(s) base."""
    parts = (
        f"named_struct('link', {link}, 'base', {base}, "
        f"'scheme', lower({_part_sql(base, _SCHEME)}), 'own', lower({_part_sql(link, _SCHEME)}), "
        f"'origin', {_part_sql(base, _SITE)}, 'path', regexp_extract({link}, '^([^?#]*)', 1), "
        f"'tail', regexp_extract({link}, '^[^?#]*(.*)$', 1))"
    )
    folder = f"regexp_replace({path_sql('_u.base')}, '[^/]*$', '')"
    merged = let_sql(
        folder, "_f",
        "regexp_replace(concat(CASE WHEN _f = '' THEN '/' ELSE _f END, _u.path), "
        "'(?<=.)/{2,}(?=.)', '/')",
    )
    joined = let_sql(merged, "_m", _normal_path_sql("_m"))
    return let_sql(
        parts, "_u",
        "CASE WHEN _u.link = '' THEN _u.base "
        "WHEN _u.own <> '' AND _u.own <> _u.scheme THEN _u.link "
        "WHEN startswith(lower(_u.link), concat(_u.scheme, '://')) THEN _u.link "
        "WHEN startswith(_u.link, '//') THEN concat(_u.scheme, ':', _u.link) "
        f"WHEN startswith(_u.link, '/') THEN concat(_u.origin, {_normal_path_sql('_u.path')}, _u.tail) "
        "WHEN startswith(_u.link, '?') "
        "THEN concat(regexp_extract(_u.base, '^([^?#]*)', 1), _u.link) "
        "WHEN startswith(_u.link, '#') THEN concat(regexp_extract(_u.base, '^([^#]*)', 1), _u.link) "
        f"ELSE concat(_u.origin, {joined}, _u.tail) END",
    )


def resolve(base: str, link: str) -> Column:
    """`urllib.parse.urljoin` of two columns, given as SQL."""
    return F.expr(resolve_sql(base, link))


def path_prefixes_sql(url_path: str) -> str:
    prefixes = (
        "transform(sequence(1, size(_s)), _n -> concat('/', array_join(slice(_s, 1, _n), '/')))"
    )
    return let_sql(f"split({url_path}, '/')", "_s", f"filter({prefixes}, _p -> _p <> '/')")


def path_prefixes(url_path: str) -> Column:
    """Every non-empty prefix of the path, each with one more `/` in front (`/a/b` gives `//a`)."""
    return F.expr(path_prefixes_sql(url_path))


def query_keys_sql(url: str) -> str:
    parts = f"filter(split({_part_sql(url, _QUERY)}, '&'), _q -> contains(_q, '='))"
    return f"transform({parts}, _q -> substring_index(_q, '=', 1))"


def query_keys(url: str) -> Column:
    """Keys of the `key=value` parts of a URL's query, in order."""
    return F.expr(query_keys_sql(url))


def basename(url_or_path: Column) -> Column:
    return F.substring_index(url_or_path, "/", -1)


def extension(name: Column) -> Column:
    """`os.path.splitext` extension, lower case; a name that only starts with dots has none."""
    return F.lower(F.regexp_extract(basename(name), r"^\.*[^.].*(\.[^.]*)$", 1))
