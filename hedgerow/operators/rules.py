"""The rule table: stock packs, user rules, selections, and rules per file."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.catalogue.categories import CATEGORY_PATTERNS
from hedgerow.catalogue.packs import RULE_PACKS
from hedgerow.functions.patterns import check_patterns
from hedgerow.functions.text import sql_text
from hedgerow.functions.urls import extension

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_ord", T.IntegerType(), False),
        T.StructField("rule_id", T.StringType()),
        T.StructField("pack", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("file_exts", T.ArrayType(T.StringType())),
        T.StructField("vuln_patterns", T.ArrayType(T.StringType())),
        T.StructField("sanitizer_patterns", T.ArrayType(T.StringType())),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("cwe", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Rule:
    """One rule. A rule whose category is in the category catalogue is matched by the catalogue's
    patterns and labels; any other by its own patterns. `surface` is the raw table's category."""

    category: str
    name: str
    file_exts: tuple[str, ...] = ()
    vuln_patterns: tuple[str, ...] = ()
    sanitizer_patterns: tuple[str, ...] = ()
    vuln_desc: str = ""
    safe_desc: str = ""
    severity: str = "MEDIUM"
    confidence: int = 70
    cwe: str = "N/A"
    rule_id: str = "N/A"
    surface: str = ""
    summary: str = field(default="", compare=False)

    @property
    def catalogue(self):
        """Ordered (pattern, label) of the category, or nothing for a rule with own patterns."""
        return CATEGORY_PATTERNS.get(self.category.lower(), ())

    @property
    def patterns(self) -> tuple[str, ...]:
        if self.catalogue:
            return tuple(pattern for pattern, _ in self.catalogue)
        return self.vuln_patterns


# What a raw rule that leaves a field out gets.
RAW_DEFAULTS = {
    "file_exts": (), "vuln_patterns": (), "sanitizer_patterns": (), "vuln_desc": "",
    "safe_desc": "", "severity": "MEDIUM", "confidence": 70, "cwe": "N/A",
}


def build_rules(raw_rules, pack: str) -> list[Rule]:
    """Raw rule entries to rules of a pack, with defaults for what is missing.

    The pack name becomes the category. The raw `description` is kept as `summary` only: findings
    describe themselves by `vuln_desc`, which stock rules do not have.
    """
    def lists_fixed(value):
        return tuple(value) if isinstance(value, list) else value

    built = []
    for raw in raw_rules:
        fields = {key: lists_fixed(raw.get(key, default)) for key, default in RAW_DEFAULTS.items()}
        extra = {
            "name": raw.get("name", pack), "rule_id": raw.get("id", "N/A"),
            "surface": raw.get("category", ""), "summary": raw.get("description", ""),
        }
        built.append(Rule(category=pack, **extra, **fields))
    return built


# The secrets pack, whose rule table is not public: the secret patterns of the category catalogue
# as one rule over every scanned extension that holds code or settings.
SECRETS_PACK = (
    {
        "id": "SEC-001",
        "category": "secrets-config",
        "name": "Hardcoded Secret",
        "description": "Secret written into code or settings",
        "file_exts": (".py", ".js", ".ts", ".php", ".java", ".json", ".yml", ".yaml", ".ini",
                      ".env", ".conf", ".toml", ".properties", ".txt"),
        "vuln_patterns": tuple(pattern for pattern, _ in CATEGORY_PATTERNS["secrets-config"]),
        "severity": "CRITICAL",
        "cwe": "CWE-798",
    },
)


def stock_rules(with_secrets: bool = False) -> list[Rule]:
    """The rules of all packs, in pack order."""
    rules: list[Rule] = []
    for pack, raw_rules in RULE_PACKS.items():
        if with_secrets and pack == "INFRASTRUCTURE":
            rules += build_rules(SECRETS_PACK, "SECRETS")
        rules += build_rules(raw_rules, pack)
    return rules


def category_rules(categories=None, severity: str = "HIGH", cwe: str = "N/A") -> list[Rule]:
    """One rule per catalogue category, for every file."""
    return [
        Rule(category=c, name=c, file_exts=("",), severity=severity, cwe=cwe)
        for c in (categories or CATEGORY_PATTERNS)
    ]


def accept_rules(spark: SparkSession, rules) -> tuple[list[Rule], DataFrame]:
    """Rules without the patterns that do not compile, and those patterns as a table."""
    rules = list(rules)
    bad = check_patterns(
        spark, [p for r in rules for p in (*r.vuln_patterns, *r.sanitizer_patterns)]
    )
    rejected = [
        (r.category, r.name, kind, p, bad[p])
        for r in rules
        for kind in ("vuln", "sanitizer")
        for p in (r.vuln_patterns if kind == "vuln" else r.sanitizer_patterns)
        if p in bad
    ]
    good = [
        replace(
            r,
            vuln_patterns=tuple(p for p in r.vuln_patterns if p not in bad),
            sanitizer_patterns=tuple(p for p in r.sanitizer_patterns if p not in bad),
        )
        for r in rules
    ]
    table = spark.createDataFrame(
        rejected, "category string, name string, kind string, pattern string, reason string"
    )
    return good, table


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    """The rules as a table. A catalogue of rules is configuration, so it comes from the driver."""
    rows = [
        (i, r.rule_id, r.category, r.surface, r.name, r.summary, list(r.file_exts),
         list(r.vuln_patterns), list(r.sanitizer_patterns), r.severity, r.confidence, r.cwe)
        for i, r in enumerate(stock_rules() if rules is None else rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def category_table(spark: SparkSession) -> DataFrame:
    """The category catalogue as a table."""
    rows = [
        (category, i, j, pattern, label)
        for i, (category, entries) in enumerate(CATEGORY_PATTERNS.items())
        for j, (pattern, label) in enumerate(entries)
    ]
    return spark.createDataFrame(
        rows, "category string, cat_ord int, pat_ord int, pattern string, name string"
    )


def rules_by_category(table: DataFrame, category: str) -> DataFrame:
    return table.filter(F.col("pack") == category)


def rules_by_severity(table: DataFrame, severity: str) -> DataFrame:
    return table.filter(F.upper("severity") == severity.upper())


def rule_categories(table: DataFrame) -> DataFrame:
    """Categories with their rule counts, in order of first appearance."""
    return (
        table.groupBy("pack")
        .agg(F.min("rule_ord").alias("first_ord"), F.count("*").alias("rules"))
        .orderBy("first_ord")
    )


def distinct_patterns(table: DataFrame) -> DataFrame:
    """Every vulnerability pattern once."""
    return table.select(F.explode("vuln_patterns").alias("pattern")).distinct()


def xss_rules(table: DataFrame) -> DataFrame:
    """Cross-site scripting rules of the input pack."""
    return table.filter(
        (F.col("pack") == "INPUT") & F.contains(F.lower("category"), F.lit("xss"))
    )


# Scan mode -> (name, rule pack, severity). Mode 6 uses the cross-site scripting
# rules of its pack only; mode 7 has the patterns of all other modes.
MODES = {
    "1": ("Endpoint Discovery", "API", "MEDIUM"),
    "2": ("Secrets Detection", "SECRETS", "CRITICAL"),
    "3": ("File Analysis", "FILE", "HIGH"),
    "4": ("API Enumeration", "API", "MEDIUM"),
    "5": ("Security Misconfigurations", "INFRASTRUCTURE", "HIGH"),
    "6": ("XSS & Parameter Mapping", "INPUT", "CRITICAL"),
    "7": ("Full Scan", None, "ALL"),
}


def mode_patterns(mode: str, rules=None) -> list[str]:
    """Distinct patterns of a scan mode, in rule order."""
    rules = stock_rules(with_secrets=True) if rules is None else rules
    if mode == "7":
        return list(dict.fromkeys(p for m in MODES if m != "7" for p in mode_patterns(m, rules)))
    pack = MODES[mode][1]
    picked = [
        r for r in rules if r.category == pack and (mode != "6" or "xss" in r.surface.lower())
    ]
    return list(dict.fromkeys(p for r in picked for p in r.vuln_patterns))


def mode_table(spark: SparkSession) -> DataFrame:
    """(mode, name, severity, pattern), one row per pattern of a mode."""
    rows = [
        (mode, name, severity, pattern)
        for mode, (name, _, severity) in MODES.items()
        for pattern in mode_patterns(mode)
    ]
    return spark.createDataFrame(rows, "mode string, name string, severity string, pattern string")


def applies_sql(rule: Rule, path: str, ext: str) -> str:
    """SQL condition: the path ends with a listed extension, or its extension is one."""
    if "" in rule.file_exts:
        return "true"
    if not rule.file_exts:
        return "false"
    ends = " OR ".join(f"endswith({path}, {sql_text(e)})" for e in rule.file_exts)
    return f"({ends} OR {ext} IN ({', '.join(sql_text(e) for e in rule.file_exts)}))"


def rules_for_files(files: DataFrame, rules=None) -> DataFrame:
    """(path, rule_ord, rule_id): the file and rule pairs of a scan, without a join."""
    rules = stock_rules() if rules is None else rules
    pairs = ", ".join(
        f"CASE WHEN {applies_sql(r, 'path', '_ext')} "
        f"THEN named_struct('rule_ord', {i}, 'rule_id', {sql_text(r.rule_id)}) END"
        for i, r in enumerate(rules)
    )
    with_ext = files.select("path", extension(F.col("path")).alias("_ext"))
    rows = with_ext.select("path", F.expr(f"explode_outer(array({pairs})) AS _rule"))
    return rows.filter(F.col("_rule").isNotNull()).select("path", "_rule.rule_ord", "_rule.rule_id")
