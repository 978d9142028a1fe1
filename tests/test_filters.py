import os
import re

import pytest
from pyspark.sql import functions as F

from hedgerow.catalogue import noise as lists
from hedgerow.functions import risk
from hedgerow.operators import findings, lookups, noise


def values(spark, items, expression):
    rows = spark.createDataFrame(list(enumerate(items)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


PATHS = [
    "src/app.py", "node_modules/x.py", "src/Build/x.py", "build", "src/out/x.py", "abcdefgh.js",
    "ab.js", "src/abcdefgh-12.js", "inline_js_12.js", "lib/jquery.py", "a/map", "a/mapper.py",
    "x.min.js", "a\\dist\\b.py", ".git/config", "layout/x.py", "a.b/three.txt",
]


def is_noise_path(path):
    low = "/" + path.lower()
    name = os.path.basename(low)
    return (
        any(re.match(p, name) for p in lists.SKIP_BASENAME_PATTERNS)
        or any(f"/{d}/" in low or f"\\{d}\\" in low for d in lists.SKIP_DIRS)
        or any(re.search(p, path.lower(), re.I) for p in lists.SKIP_PATH_PATTERNS)
    )


def test_noise_paths(spark):
    assert values(spark, PATHS, noise.is_noise_path("t")) == [is_noise_path(p) for p in PATHS]


def test_extensions(spark):
    names = ["a.py", "A.JS", ".env", "Dockerfile", "a.tar.gz", "x.min.js", "y.bak", "z.toml"]
    assert values(spark, names, noise.has_scanned_extension(F.col("t"))) == [
        True, True, False, False, False, True, False, True
    ]


def test_size_content_and_minified(spark):
    sizes = spark.createDataFrame([(10485760,), (10485761,)], "n long")
    assert [r[0] for r in sizes.select(noise.fits_size_cap(F.col("n"))).collect()] == [True, False]
    assert values(spark, ["", " \n\t ", "x"], noise.has_content(F.col("t"))) == [False, False, True]
    texts = ["x" * 10001, "x" * 10000, "x\n" * 4 + "x" * 10001, "x\n" * 3 + "y" * 10001]
    assert values(spark, texts, noise.is_minified(F.col("t"))) == [True, False, False, True]


LINES = [
    "", "// c", "/* c", "}", "=>", "x }", "import  os", "Console.Log(1)", "exports.x", "important",
    "eval(x)", "SENTRY.io", "cdn.x", "acdn", "\"use strict\"", "createelement(", "# comment",
]


def test_noise_lines(spark):
    rows = spark.createDataFrame(list(enumerate(LINES)), "i int, text string").withColumn(
        "folded", F.lower("text")
    )
    got = [r[0] for r in rows.orderBy("i").select(noise.is_noise_line()).collect()]
    assert got == [
        not t or t.startswith(("//", "/*")) or t in lists.LONE_TOKENS
        or any(re.search(p, t, re.I) for p in lists.SKIP_LINE_PATTERNS)
        for t in LINES
    ]


def test_script_lines(spark):
    assert values(spark, ["123456789", "1234567890"], noise.is_short_line(F.col("t"))) == [True, False]
    texts = ["console.log(1)", "Console.log(1)", "export default x", "import react"]
    assert values(spark, texts, noise.is_skipped_script_line(F.col("t"))) == [True, False, True, False]


def test_build_artifacts(spark):
    ends = ["/_next/x", "/a.CSS", "/a.css?x", "/map", "/x.map", "/chunk-1", "/orders", "/vendor", "/x.woff"]
    assert values(spark, ends, noise.is_build_artifact("t")) == [
        any(re.search(p, e, re.I) for p in lists.BUILD_ARTIFACT_PATTERNS) for e in ends
    ]


@pytest.mark.parametrize("root", ["/data/x", "/data/x/", "file:/data/x", "hdfs://h:1/data/x"])
def test_relative_path(spark, root):
    paths = ["file:/data/x/a/b.py", "file:///data/x/c.py", "hdfs://h:1/data/x/d", "/elsewhere/e"]
    assert values(spark, paths, noise.relative_path("t", root)) == [
        "a/b.py", "c.py", "d", "/elsewhere/e"
    ]


# --- findings ---


def python_risk(category):
    low = category.lower()
    near = [v for k, v in risk.CATEGORY_RISK.items() if k.lower() in low or low in k.lower()]
    return risk.CATEGORY_RISK.get(category) or [*near, risk.DEFAULT_RISK][0]


def test_risk(spark):
    names = ["", "IAM", "XSS", "xss", "CORS Misconfiguration", "SQL Injection", "net", "unknown",
             "LOGGING", "a", "config files", "No Authentication"]
    got = values(spark, names, risk.risk(F.col("t")))
    assert [tuple(g) for g in got] == [python_risk(n) for n in names]


def test_risk_score(spark):
    cases = [(s, c) for s in ("CRITICAL", "high", "Medium", "LOW", "INFO", "odd") for c in range(0, 101)]
    rows = spark.createDataFrame(cases, "s string, c int").select(
        "s", "c", risk.risk_score(F.col("s"), F.col("c")).alias("r")
    )
    for row in rows.collect():
        weight = risk.SEVERITY_WEIGHT.get(row.s.upper(), 5)
        assert row.r == int(weight * (row.c / 100.0))


def test_priority_and_classify(spark):
    assert values(spark, ["critical", "INFO", "x", None], risk.severity_priority(F.col("t"))) == [1, 5, 3, 3]
    row = risk.classify(spark.createDataFrame(
        [("SECRETS", "LOW", 1)], "category string, severity string, confidence int")).first()
    assert (row.severity, row.confidence, row.risk_score) == ("CRITICAL", 90, 9)


def test_minimum_severity(spark):
    rows = spark.createDataFrame([("low",), (None,), ("HIGH",), ("CRITICAL",)], "severity string")
    assert [r[0] for r in risk.at_least(rows).collect()] == [None, "HIGH", "CRITICAL"]
    assert risk.at_least(rows, "info").count() == 4
    with pytest.raises(ValueError):
        risk.at_least(rows, "ALL")
    with pytest.raises(Exception, match="ODD"):
        risk.at_least(spark.createDataFrame([("odd",)], "severity string")).collect()


def test_likely_real_emits_twice(spark):
    rows = spark.createDataFrame([
        (1, "app.js", "request.x", "NETWORK"), (2, "app.js", "userInput", None),
        (3, "app.js", "plain", "NETWORK"), (4, "app.js", "plain", "XSS"),
        (5, "0123456789ab.js", "request.x", "NETWORK"), (6, "vendor.js", "request.x", "NETWORK"),
        (7, None, "request.", "XSS"),
    ], "id int, file string, snippet string, category string")
    assert sorted(r.id for r in findings.likely_real(rows).collect()) == [1, 1, 2, 3, 7]


def test_ids_dedup_and_union(spark):
    rows = spark.createDataFrame(
        [(3, "SQL Injection", "s", "/a", "q", "p"), (1, "XSS", "s", "/a", "q", "p"), (2, "XSS", "s", "/b", None, "p"),
         (4, "XSS", "t", "/a", "q", "p")],
        "n int, category string, site string, endpoint string, parameter string, payload string",
    )
    ids = findings.with_running_ids(rows, findings.category_prefix(), "n", width=3)
    assert {r.n: r.finding_id for r in ids.collect()} == {1: "XSS-000", 2: "XSS-001", 3: "SQL -002", 4: "XSS-003"}
    assert {r.n for r in findings.deduplicate_xss(rows, "n").collect()} == {1, 2, 4}
    both = findings.union_findings(rows, rows)
    assert both.count() == 8 and both.schema == findings.FINDINGS_SCHEMA


def test_lookups(spark):
    names = ["XSS", "CORS Misconfiguration", "GraphQL", "CORS", None]
    assert values(spark, names, lookups.owasp(F.col("t"))) == [
        "A03:2021 - Injection", "Unknown", "Unknown", "A05:2021 - Security Misconfiguration", "Unknown"
    ]
    hosts = ["a.vercel.app", "evilvercel.app", "x.example", "y.github.io"]
    assert values(spark, hosts, lookups.platform_address(F.col("t"))) == [
        "76.76.21.21", "76.76.21.21", None, "185.199.108.153"
    ]
    files = spark.createDataFrame([("a", "one two"), ("b", "three")], "path string, content string")
    expected = spark.createDataFrame(
        [("a", "one"), ("a", "x"), ("b", "three"), ("c", "one")], "path string, literal string")
    presence = lookups.literal_presence(files, expected)
    assert {(r.path, r.literal): r.found for r in presence.collect()} == {
        ("a", "one"): True, ("a", "x"): False, ("b", "three"): True, ("c", "one"): False
    }
    assert tuple(lookups.literal_coverage(presence).first()) == (2, 4)
    assert lookups.signature_table(spark).count() == 87
