"""Matching lines against rules and categories.

All rules are tried on a line in one pass. Patterns are literals of the plan, so each regex is
compiled once per task, and a line that lacks a pattern's literal text never reaches the regex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions.patterns import (
    any_matches_sql, can_match_sql, first_label_sql, matches_sql,
)
from hedgerow.functions.text import fold_sql, let_sql, preview, sql_text
from hedgerow.functions.urls import extension
from hedgerow.operators.lines import candidate_lines, sanitiser_sql, with_context
from hedgerow.operators.noise import noise_line_sql
from hedgerow.operators.rules import Rule, applies_sql, category_rules, stock_rules

# Confidence and status of a category match, clear or sanitised.
CLEAR_CONFIDENCE, SANITISED_CONFIDENCE = 80, 50
SNIPPET_CHARS = 200


def _hits_sql(rules: list[Rule]) -> str:
    """SQL array of (rule_ord, name), one entry per rule that matches the line."""
    entries = []
    for i, rule in enumerate(rules):
        if rule.catalogue:
            name = first_label_sql("text", "folded", rule.catalogue)
        else:
            found = any_matches_sql("text", "folded", rule.vuln_patterns)
            name = f"CASE WHEN {found} THEN {sql_text(rule.name)} END"
        covered = applies_sql(rule, "path", "_ext")
        if covered != "true":
            name = f"CASE WHEN {covered} THEN {name} END"
        entries.append(f"named_struct('rule_ord', {i}, 'name', {name})")
    return f"filter(array({', '.join(entries)}), _h -> _h.name IS NOT NULL)"


def match_lines(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Lines (path, line, text, folded, and sanitised if a category rule is used) x rules, at most
    one finding per line and rule. Noise lines give none; they are only tested when something
    matched."""
    text = F.col("text")
    kept = f"CASE WHEN size(_found) > 0 AND NOT {noise_line_sql('text', 'folded')} THEN _found END"
    hits = F.expr(let_sql(_hits_sql(rules), "_found", kept))
    rows = (
        lines.withColumn("_ext", extension(F.col("path")))
        .withColumn("_hit", F.explode_outer(hits))
        .filter(F.col("_hit").isNotNull())
    )

    def of_rule(value) -> Column:
        items = ", ".join(
            sql_text(v) if isinstance(v, str) else str(v).lower() for v in map(value, rules)
        )
        return F.expr(f"element_at(array({items}), _hit.rule_ord + 1)")

    by_catalogue = any(r.catalogue for r in rules)
    from_catalogue = of_rule(lambda r: bool(r.catalogue)) if by_catalogue else F.lit(False)
    sanitised = from_catalogue & (F.col("sanitised") if by_catalogue else F.lit(False))
    category = of_rule(lambda r: r.category.lower() if r.catalogue else r.category)
    name = F.col("_hit.name")
    detected = F.concat(
        name, F.lit(" detected"), F.when(sanitised, F.lit(" (sanitized)")).otherwise(F.lit(""))
    )
    return rows.select(
        F.concat(F.lit("AS-"), category, F.lit("-"), F.col("line").cast("string")).alias(
            "finding_id"
        ),
        of_rule(lambda r: r.cwe).alias("cwe"),
        category.alias("category"),
        name.alias("name"),
        F.col("path").alias("file"),
        F.col("line"),
        preview(text, SNIPPET_CHARS).alias("snippet"),
        F.when(sanitised, F.lit("SANITIZED")).otherwise(F.lit("VULNERABLE")).alias("status"),
        of_rule(lambda r: r.severity).alias("severity"),
        F.when(
            from_catalogue,
            F.when(sanitised, F.lit(SANITISED_CONFIDENCE)).otherwise(F.lit(CLEAR_CONFIDENCE)),
        )
        .otherwise(of_rule(lambda r: r.confidence))
        .alias("confidence"),
        F.when(from_catalogue, detected)
        .otherwise(of_rule(lambda r: r.vuln_desc))
        .alias("description"),
        F.col("_hit.rule_ord").alias("rule_ord"),
    )


def match_files(files: DataFrame, rules: list[Rule] | None = None, ranges: bool = False) -> DataFrame:
    """Files (path, content) x rules: one narrow pass, no shuffle.

    Only lines that hold the literal text of some pattern become rows. With `ranges` each row is a
    range of a file, as `sources.walk.read_ranges` gives it.
    """
    rules = stock_rules() if rules is None else list(rules)
    patterns = [p for r in rules for p in r.patterns]
    lines = candidate_lines(
        files,
        "path",
        patterns=patterns,
        context=any(r.catalogue for r in rules),
        ranges=ranges,
    )
    return match_lines(lines, rules)


def rule_matches(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rule matcher over the packs: status is always VULNERABLE, sanitiser patterns are unused."""
    return match_files(files, stock_rules() if rules is None else rules)


def category_matches(files: DataFrame, categories=None, severity: str = "HIGH") -> DataFrame:
    """Category matcher with sanitiser marking; the first pattern that matches names a finding."""
    return match_files(files, category_rules(categories, severity))


def category_matches_of_lines(lines: DataFrame, categories=None) -> DataFrame:
    """Category matcher over lines that are stored as rows (path, line, text).

    Only lines that could match and lines that hold a sanitiser word are shuffled.
    """
    rules = category_rules(categories)
    patterns = [p for r in rules for p in r.patterns]
    tested = lines.select(
        "path", "line", "text",
        F.expr(let_sql(
            fold_sql("text"), "_f",
            f"named_struct('folded', _f, 'candidate', {can_match_sql('_f', patterns)}, "
            f"'sanitiser', {sanitiser_sql('_f')})",
        )).alias("_t"),
    ).filter("_t.candidate OR _t.sanitiser")
    near = with_context(tested.select("path", "line", "text", "_t.folded", "_t.candidate"), "path")
    return match_lines(near.filter("candidate").drop("candidate"), rules)


def rule_trace(files: DataFrame, name_part: str, rules: list[Rule] | None = None) -> DataFrame:
    """Every (rule, pattern, line) hit of the rules whose name holds `name_part`: no first-match
    cut, no noise filter and no extension test."""
    picked = [
        r for r in (stock_rules() if rules is None else rules)
        if name_part.lower() in r.name.lower()
    ]
    pairs = [(r, j, p) for r in picked for j, p in enumerate(r.vuln_patterns)]
    lines = candidate_lines(files, "path", patterns=[p for _, _, p in pairs])
    hits = ", ".join(
        f"CASE WHEN {matches_sql('text', 'folded', p)} THEN named_struct("
        f"'rule_id', {sql_text(r.rule_id)}, 'rule', {sql_text(r.name)}, "
        f"'pat_ord', {j}, 'pattern', {sql_text(p)}) END"
        for r, j, p in pairs
    )
    return (
        lines.withColumn("_hit", F.expr(f"explode_outer(array({hits}))"))
        .filter(F.col("_hit").isNotNull())
        .select("path", "line", "text", "_hit.*")
    )
