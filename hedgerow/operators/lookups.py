"""Lookups against small fixed tables and captured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.catalogue.web import REQUEST_SIGNATURES, RISKY_PARAMETERS
from hedgerow.functions.text import sql_text

# Finding category -> OWASP Top 10 entry, and the default.
OWASP = {
    "XSS": "A03:2021 - Injection",
    "SQL Injection": "A03:2021 - Injection",
    "SSTI": "A03:2021 - Injection",
    "Command Injection": "A03:2021 - Injection",
    "XXE": "A05:2021 - Security Misconfiguration",
    "IDOR": "A01:2021 - Broken Access Control",
    "Path Traversal": "A01:2021 - Broken Access Control",
    "File Upload": "A05:2021 - Security Misconfiguration",
    "CORS": "A05:2021 - Security Misconfiguration",
    "Hardcoded Secret": "A07:2021 - Identification and Authentication Failures",
    "JWT Weak Secret": "A07:2021 - Identification and Authentication Failures",
    "SSRF": "A10:2021 - Server-Side Request Forgery",
    "Open Redirect": "A04:2021 - Insecure Design",
    "No Authentication": "A01:2021 - Broken Access Control",
}
UNKNOWN_OWASP = "Unknown"

# Host suffix -> address of the hosting platform, in lookup order. There is no dot
# before the suffix, so `evilvercel.app` is found too.
PLATFORM_ADDRESSES = (
    ("vercel.app", "76.76.21.21"),
    ("netlify.app", "75.2.60.5"),
    ("github.io", "185.199.108.153"),
    ("herokuapp.com", "34.120.151.151"),
    ("cloudfront.net", "54.192.0.0"),
)


def owasp(category: Column) -> Column:
    """OWASP entry of a category; exact names only."""
    place = F.array_position(F.lit(list(OWASP)), category).cast("int")
    entries = F.lit([UNKNOWN_OWASP, *OWASP.values()])
    return F.element_at(entries, F.coalesce(place, F.lit(0)) + 1)


def platform_address(host: Column) -> Column:
    """Address of the first platform whose suffix ends the host name; null if none does."""
    return F.coalesce(
        *(F.when(F.endswith(host, F.lit(s)), F.lit(ip)) for s, ip in PLATFORM_ADDRESSES)
    )


def platform_hosts(hosts: DataFrame, host: str = "host") -> DataFrame:
    return hosts.withColumn("address", platform_address(F.col(host)))


def resolve_hosts(hosts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(host, address): each host once, with its captured address, or null when there is none.

    The platform's address goes first, as it needs no resolution.
    """
    captured = resolutions.select("host", F.col("address").alias("_captured"))
    joined = hosts.select("host").distinct().join(captured, "host", "left")
    return joined.select(
        "host", F.coalesce(platform_address(F.col("host")), F.col("_captured")).alias("address")
    )


def literal_presence(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected literals (path, literal) with `found`: whether the file holds the literal.

    A missing file counts as not found. A file's literals are one array, so that its content meets
    them in one row: it moves once at most (and not at all if the paths asked for are broadcast),
    whatever their number, and only the answers go on.
    """
    asked = expected.groupBy("path").agg(F.collect_set("literal").alias("_literals"))
    held = (
        files.select("path", "content").join(asked, "path")
        .select("path", F.explode(F.filter("_literals", lambda one: F.contains(F.col("content"), one))).alias("literal"))
        .distinct()
        .withColumn("_held", F.lit(True))
    )
    return expected.join(held, ["path", "literal"], "left").select(
        "path", "literal", F.coalesce("_held", F.lit(False)).alias("found")
    )


def literal_coverage(presence: DataFrame) -> DataFrame:
    return presence.agg(
        F.count_if("found").alias("found"), F.count("*").alias("total")
    )


def signature_table(spark: SparkSession) -> DataFrame:
    """The request signatures as a table (family, sig_ord, signature)."""
    rows = [
        (family, i, signature)
        for family, signatures in REQUEST_SIGNATURES.items()
        for i, signature in enumerate(signatures)
    ]
    return spark.createDataFrame(rows, "family string, sig_ord int, signature string")


def signature_matches(requests: DataFrame, *keys: str, text: str) -> DataFrame:
    """(keys, family, sig_ord, signature): every dictionary signature the request text holds.

    The dictionary is a fixed list, so its entries are literals of one pass and nothing is joined.
    """
    entries = ", ".join(
        f"CASE WHEN contains({text}, {sql_text(signature)}) THEN named_struct('family', "
        f"{sql_text(family)}, 'sig_ord', {i}, 'signature', {sql_text(signature)}) END"
        for family, signatures in REQUEST_SIGNATURES.items()
        for i, signature in enumerate(signatures)
    )
    found = f"filter(array({entries}), _s -> _s IS NOT NULL)"
    rows = requests.select(*keys, F.expr(f"explode_outer({found}) AS _sig"))
    return rows.filter(F.col("_sig").isNotNull()).select(*keys, "_sig.*")


def risky_parameter_sql(key: str) -> str:
    """SQL condition: the parameter name is on the list of names worth a review."""
    return f"{key} IN ({', '.join(sql_text(name) for name in dict.fromkeys(RISKY_PARAMETERS))})"
