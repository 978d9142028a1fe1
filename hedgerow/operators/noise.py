"""Noise filters for paths, contents, lines and endpoints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgerow.catalogue import noise
from hedgerow.functions.patterns import any_matches, any_matches_sql, java_pattern
from hedgerow.functions.text import contains_any, let_sql, sql_text, strip
from hedgerow.functions.urls import basename, extension


def has_scanned_extension(path: Column) -> Column:
    """Extension allow-list; `.env` and `Dockerfile` have no extension."""
    return extension(path).isin(*noise.SCAN_EXTENSIONS)


def in_skipped_dir(path: Column) -> Column:
    """Whether a directory of the (root-relative) path is on the skip list, in any case."""
    names = "|".join(re.escape(name) for name in noise.SKIP_DIRS)
    return F.lower(path).rlike(rf"(?:^|[/\\])(?:{names})[/\\]")


def is_noise_path(path: str) -> Column:
    """Libraries, bundles, build output and hashed scripts, by path and by basename.

    `path` is a column name or SQL.
    """
    bundle = "|".join(f"(?:{pattern})" for pattern in noise.SKIP_BASENAME_PATTERNS)
    return (
        basename(F.lower(F.expr(path))).rlike(java_pattern(bundle))
        | in_skipped_dir(F.expr(path))
        | any_matches(f"lower({path})", noise.SKIP_PATH_PATTERNS)
    )


def fits_size_cap(length: Column, max_bytes: int | None = noise.MAX_FILE_BYTES) -> Column:
    """Whether a file is scanned for its size; without a cap every file is."""
    return F.lit(True) if max_bytes is None else length <= max_bytes


def has_content(content: Column) -> Column:
    return strip(content) != ""


def is_minified(content: Column) -> Column:
    """Few lines and many characters."""
    line_feeds = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (F.length(content) > noise.MINIFIED_CHARS) & (line_feeds + 1 < noise.MINIFIED_LINES)


def noise_line_sql(text: str, folded: str) -> str:
    """SQL condition: a blank line, a comment, a lone bracket, or a framework or tracker line.

    `text` is stripped.
    """
    comments = " OR ".join(f"startswith({text}, {sql_text(m)})" for m in noise.COMMENT_STARTS)
    lone = ", ".join(sql_text(token) for token in noise.LONE_TOKENS)
    patterns = any_matches_sql(text, folded, noise.SKIP_LINE_PATTERNS)
    return f"({text} = '' OR {comments} OR {text} IN ({lone}) OR {patterns})"


def is_noise_line(text: str = "text", folded: str = "folded") -> Column:
    return F.expr(noise_line_sql(text, folded))


def is_short_line(text: Column) -> Column:
    return F.length(text) < noise.MIN_LINE_CHARS


def is_skipped_script_line(text: Column) -> Column:
    """Case matters here."""
    return contains_any(text, noise.SCRIPT_LINE_SKIPS)


def is_build_artifact(endpoint: str) -> Column:
    return any_matches(endpoint, noise.BUILD_ARTIFACT_PATTERNS)


def relative_path_sql(path: str, root: str) -> str:
    """SQL value: path below the root; both may carry a scheme such as `file:`."""
    plain = root.split(":", 1)[1] if ":/" in root else root
    if plain.startswith("//"):
        plain = "/" + plain[2:].partition("/")[2]
    below = plain.rstrip("/") + "/"
    scheme = sql_text(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?(?=/)")
    return let_sql(
        f"regexp_replace({path}, {scheme}, '')", "_bare",
        f"CASE WHEN startswith(_bare, {sql_text(below)}) "
        f"THEN substring(_bare, {len(below) + 1}) ELSE _bare END",
    )


def relative_path(path: str, root: str) -> Column:
    return F.expr(relative_path_sql(path, root))
