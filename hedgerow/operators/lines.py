"""Numbered lines and the context around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.catalogue.noise import CONTEXT_AFTER, CONTEXT_BEFORE, SANITISER_WORDS
from hedgerow.functions.patterns import can_match_sql, whole_match_sql
from hedgerow.functions.text import (
    contains_any_sql, fold_sql, let_sql, split_lines_sql, split_newlines_sql, strip_sql,
)

# Lines per block of the sliding window over stored lines.
BLOCK_LINES = 50_000


def sanitiser_sql(folded: str) -> str:
    """SQL condition: the folded line holds a sanitiser word."""
    return contains_any_sql(folded, [word.lower() for word in SANITISER_WORDS])


def _entry_sql(raw: str, index: str, with_raw: bool = False) -> str:
    """SQL struct of a line: number, text without surrounding space, folded text."""
    own = f"'raw', {raw}, " if with_raw else ""
    return let_sql(
        strip_sql(raw),
        "_text",
        f"named_struct('line', {index} + 1, {own}'text', _text, 'folded', {fold_sql('_text')})",
    )


def _parts_sql(content: str, newline_only: bool) -> str:
    return split_newlines_sql(content) if newline_only else split_lines_sql(content)


def numbered_lines(
    texts: DataFrame, *keys: str, content: str = "content", newline_only: bool = False
) -> DataFrame:
    """One row per line: keys, line (from 1), raw, text (stripped) and folded."""
    entries = F.expr(
        f"transform({_parts_sql(content, newline_only)}, "
        f"(_raw, _i) -> {_entry_sql('_raw', '_i', with_raw=True)})"
    )
    rows = texts.select(*keys, F.explode_outer(entries).alias("_entry"))
    return rows.filter(F.col("_entry").isNotNull()).select(
        *keys, "_entry.line", "_entry.raw", "_entry.text", "_entry.folded"
    )


def candidate_lines(
    texts: DataFrame,
    *keys: str,
    patterns,
    content: str = "content",
    newline_only: bool = False,
    context: bool = False,
    ranges: bool = False,
) -> DataFrame:
    """The numbered lines that one of the patterns could match, and nothing else.

    Splitting, testing and the sanitiser context all happen inside the row that holds the text:
    no shuffle and no window, and a line that cannot match is never made a row. With `context`
    each line tells whether a sanitiser word is within two lines before to three lines after it,
    counted over all lines of the text. With `ranges` a text is a range of a file (`sources.walk.TEXTS`):
    lines of `before` and `after` are context only, and numbers go on from `first_line`.
    """
    wanted = can_match_sql("_e.folded", patterns)
    if ranges:
        content = f"concat(before, {content}, after)"
        wanted = f"_e.line > lead AND _e.line <= lead + own AND {wanted}"
    entries = f"filter(transform(_lines, (_raw, _i) -> {_entry_sql('_raw', '_i')}), _e -> {wanted})"
    columns = ["line", "text", "folded"]
    if context:
        first = f"greatest(_k.line - {CONTEXT_BEFORE}, 1)"
        near = (
            f"exists(slice(_lines, {first}, _k.line + {CONTEXT_AFTER + 1} - {first}), "
            f"_near -> {let_sql(fold_sql('_near'), '_f', sanitiser_sql('_f'))})"
        )
        entries = (
            f"transform({entries}, _k -> named_struct('line', _k.line, 'text', _k.text, "
            f"'folded', _k.folded, 'sanitised', {near}))"
        )
        columns.append("sanitised")
    # A text without any telling character or word is not even split.
    quick = let_sql(fold_sql(content), "_whole", whole_match_sql("_whole", patterns))
    split = let_sql(_parts_sql(content, newline_only), "_lines", entries)
    kept = F.expr(f"CASE WHEN {quick} THEN {split} END")
    found = texts.select(
        *keys, *(["lead", "first_line"] if ranges else []), F.explode_outer(kept).alias("_entry")
    ).filter(F.col("_entry").isNotNull())
    line = F.expr("_entry.line - lead + first_line" if ranges else "_entry.line").alias("line")
    return found.select(*keys, line, *(f"_entry.{name}" for name in columns[1:]))


def with_context(lines: DataFrame, *keys: str, block: int = BLOCK_LINES) -> DataFrame:
    """Add `sanitised` to stored lines (keys, line, folded).

    The frame goes by line number, so lines that cannot matter may be left out before.

    A text may hold any number of lines, so the window runs over blocks of lines: the few lines at
    a block's edge are also given to its neighbour, and used there as context only.
    """
    if block < CONTEXT_BEFORE + CONTEXT_AFTER:
        raise ValueError("a block must be at least as long as the context")
    home = F.floor((F.col("line") - 1) / block)
    before = F.floor((F.col("line") - 1 + CONTEXT_BEFORE) / block)
    after = F.floor((F.col("line") - 1 - CONTEXT_AFTER) / block)
    blocks = F.array_distinct(F.array(home, before, after))
    spread = lines.withColumn("_block", F.explode(blocks)).withColumn("_home", home)
    frame = Window.partitionBy(*keys, "_block").orderBy("line").rangeBetween(
        -CONTEXT_BEFORE, CONTEXT_AFTER
    )
    flagged = spread.withColumn("sanitised", F.max(F.expr(sanitiser_sql("folded"))).over(frame))
    return flagged.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")
