import glob
import os

import pytest
from pyspark.sql import functions as F

from hedgerow.catalogue.noise import MAX_FILE_BYTES
from hedgerow.operators import matchers
from hedgerow.operators.findings import FINDINGS_SCHEMA
from hedgerow.operators.responses import BY_ID
from hedgerow.plans import scans
from hedgerow.sinks import exports
from hedgerow.sources import files as tree
from hedgerow.sources import walk
from hedgerow.sources import findings as stored
from test_responses import SCHEMA as RESPONSES


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame([
        ("F-1", "A<b>", "n&m", "x.py", 3, "HIGH", 70, 7, "say \"hi\", you"),
        ("F-2", None, "second", None, None, None, None, None, None),
    ], "finding_id string, category string, name string, file string, line int, severity string, "
       "confidence int, risk_score int, description string")


def test_json_round_trip(spark, found, tmp_path):
    path = exports.write_json(found, str(tmp_path / "j"))
    back = stored.read_findings(spark, path)
    assert back.schema == FINDINGS_SCHEMA
    assert {r.finding_id: r.category for r in back.collect()} == {"F-1": "A<b>", "F-2": None}


def test_reads_one_array_of_two_shapes(spark, tmp_path):
    (tmp_path / "f.json").write_text(
        '[{"finding_id": "a", "file": "x", "line": 0, "timestamp": "2026-07-14T22:01:46.853600"},\n'
        ' {"finding_id": "b", "owasp": "o", "endpoint": "/e", "timestamp": "bad"}]'
    )
    rows = {r.finding_id: r for r in stored.read_findings(spark, str(tmp_path), multi_line=True).collect()}
    assert rows["a"].ts.microsecond == 853600 and rows["b"].ts is None
    assert rows["a"].owasp is None and rows["b"].owasp == "o"


def test_table_replaces_and_numbers(spark, found, tmp_path):
    for _ in range(2):
        exports.write_table(found, "findings_test", str(tmp_path / "t"))
    rows = spark.table("findings_test").orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2]
    assert {r.finding_id: r.risk_score for r in rows} == {"F-1": 7, "F-2": 0}
    assert "file_path" in rows[0].asDict() and "line_num" in rows[0].asDict()


def test_csv(spark, found, tmp_path):
    path = exports.write_csv(found, str(tmp_path / "c"))
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))
    assert text.startswith("finding_id,category,name,file,line,status,severity,confidence,description,cwe")
    assert '"say ""hi"", you"' in text and "F-2,,second,,,,,,," in text
    empty = exports.write_csv(found.limit(0), str(tmp_path / "none"))
    assert spark.read.text(empty).first()[0] == "No findings found"


def test_html_is_escaped_and_ordered(found, tmp_path):
    path = exports.write_html(found, str(tmp_path / "h"))
    page = "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</html>")
    assert "A&lt;b&gt;" in page and "n&amp;m" in page and "Total Findings: 2" in page
    assert page.index("second") < page.index("n&amp;m") and "N/A:N/A" in page


def test_all_formats_and_envelope(spark, found, tmp_path):
    written = exports.write_all(found, str(tmp_path / "all"), "findings_all")
    assert set(written) == {"json", "table", "csv", "html"} and spark.table("findings_all").count() == 2
    path = exports.write_envelope(found, str(tmp_path / "e"), "https://t")
    meta = spark.read.json(f"{path}/metadata").first()
    assert (meta.target, meta.total_findings) == ("https://t", 2)
    real = exports.write_likely_real(
        found.withColumn("snippet", F.lit("request.x")), str(tmp_path / "r"))
    assert stored.read_findings(spark, real).count() == 2


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    content = {
        "src/app.py": b"# \xff start\r\nvalue = eval(x)\r\n", "src/UP.PY": b"exec(y)",
        "node_modules/m.py": b"eval(z)", "src/hashedname.js": b"eval(z)", "src/s.js": b"el.innerHTML = v",
        "src/blank.py": b" \n\t\n", "Dockerfile": b"USER root", "src/.env": b"eval(1)",
        "notes.bak": b"copy_of_x", "src/__init__.py": b"exec(i)", ".github/workflows/ci.yml": b"github_token: abc",
        "src/_parts/.x/p.py": b"a\nexec(p)", ".git/hook.py": b"exec(g)", "_next/n.py": b"exec(n)",
    }
    for name, data in content.items():
        os.makedirs(os.path.dirname(base / name), exist_ok=True)
        (base / name).write_bytes(data)
    with open(base / "src/big.py", "wb") as big:
        big.write(b"eval(x)\n")
        big.truncate(MAX_FILE_BYTES + 1)
    return str(base)


def test_tree_scan(spark, root):
    got = {(r.file, r.line, r.name) for r in scans.scan_tree(spark, root, max_bytes=MAX_FILE_BYTES).collect()}
    assert got == {
        ("src/app.py", 2, "Dynamic Code Execution"), ("src/UP.PY", 1, "Dynamic Code Execution"),
        ("src/s.js", 1, "DOM XSS - Unsafe DOM Manipulation"),
        ("src/__init__.py", 1, "Dynamic Code Execution"),
        ("src/_parts/.x/p.py", 2, "Dynamic Code Execution"),
        (".github/workflows/ci.yml", 1, "Hardcoded Tokens in CI/CD"),
    }
    counts = tree.scan_counts(walk.list_tree(spark, root), MAX_FILE_BYTES).first()
    # node_modules, .git and _next are not entered; blank.py is read, and empty.
    assert (counts.scanned, counts.skipped) == (7, 5)


def test_tree_source_prunes_before_reading(spark, root):
    files = tree.read_tree(spark, root, (".py",), MAX_FILE_BYTES)
    assert {r.path for r in files.select("path").collect()} == {
        "src/app.py", "src/UP.PY", "node_modules/m.py", "src/blank.py"
    }
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan
    pruned = tree.read_tree(spark, root, (".py",), MAX_FILE_BYTES, prune=True)
    assert {r.path for r in pruned.collect()} == {"src/app.py", "src/UP.PY", "src/blank.py"}
    leaf = pruned._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    # node_modules/m.py is not among the files read; big.py is dropped by the source.
    assert leaf.metrics().apply("numFiles").value() == 4


@pytest.mark.parametrize("mode", list("1234567"))
def test_web_scan(spark, mode):
    pages = spark.createDataFrame([(
        1, "https://s.example",
        "<a href='/found'>f</a>\nfetch everything from /api/ and API_KEY = 'abc'\n",
    )], "page_id long, url string, html string")
    rows = [
        (1, "/found", "GET", None, None, 0, 200, {}, "x"), (2, "/api/", "GET", None, None, 0, 200, {}, "x"),
        (3, "/admin", "GET", None, None, 0, 200, {}, "Admin Panel"),
        (4, "/search", "GET", None, None, 0, 200, {}, "x"),
        (5, "/search", "GET", "q", "<script>alert(1)</script>", 0, 200, {}, "<script>alert(1)</script>"),
        (6, "/download", "GET", "file", "../../x", 0, 200, {}, "root:x"),
        (7, "/api/users", "GET", None, None, 0, 200, {}, "password"),
    ]
    captured = spark.createDataFrame(
        [(i, e, f"https://s.example{e}", *rest) for i, e, *rest in rows], RESPONSES)
    found = scans.scan_web(pages, captured, mode).collect()
    names = {r.name for r in found}
    kinds = {}
    for r in found:
        prefix, number = r.finding_id.rsplit("-", 1)
        kinds.setdefault("framework" if r.owasp and r.category != "xss" else prefix, []).append(int(number))
    # Every kind is numbered from 0 without gaps.
    assert all(sorted(numbers) == list(range(len(numbers))) for numbers in kinds.values())
    expected = {
        "1": {"Verified Endpoint Found", "Verified Discovered Endpoint"},
        "2": {"Hardcoded API Key"},
        "3": {"Path Traversal"},
        "4": {"Verified Endpoint Found", "Sensitive Data Exposure in /api/users"},
        "5": {"Unprotected Admin Panel"},
        "6": {"XSS Vulnerability"},
        "7": {"Verified Endpoint Found", "Verified Discovered Endpoint", "Hardcoded API_KEY",
              "Reflected XSS", "Unprotected Admin Panel"},
    }[mode]
    assert expected <= names
    with pytest.raises(ValueError):
        scans.scan_web(pages, captured, "8")


def test_scripts_add_what_pages_did_not_report(spark):
    pages = spark.createDataFrame(
        [(1, "https://s.example", "<p>see /api/ for more</p>")], "page_id long, url string, html string")
    scripts = spark.createDataFrame([
        ("https://s.example", "b.js", "call('/api/x')\nopen('/v1/thing')"),
        ("https://s.example", "a.js", "\n\nopen('/v1/other', '/rest/x')"),
        ("https://t.example", "c.js", "open('/v1/thing')"),
    ], "site string, name string, content string")
    captured = spark.createDataFrame([
        (i, e, f"https://s.example{e}", "GET", None, None, 0, 200, {}, "x")
        for i, e in enumerate(["/api/", "/v1/", "/none/"])
    ], RESPONSES)
    found = scans.scan_web(pages, captured, "4", scripts)
    got = {(r.name, r.file, r.line, r.confidence, r.description) for r in found.collect()
           if r.name.startswith("Verified")}
    assert got == {
        ("Verified Endpoint Found", "https://s.example", 1, 95, "Verified: /api/ (200 OK)"),
        ("Verified Endpoint in JS", "a.js", 3, 90, "Verified: /v1/ (200 OK)"),
    }


def test_every_detector_belongs_to_a_mode():
    used = {d for ids in scans.MODE_DETECTORS.values() for d in ids} | set(scans.FRAMEWORK_DETECTORS)
    assert used == set(BY_ID)


def test_matching_takes_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a.py", "x = eval(1)"), ("b.py", "plain")], "path string, content string").write.parquet(str(source))
    stream = spark.readStream.schema("path string, content string").parquet(str(source))
    query = matchers.rule_matches(stream).writeStream.format("memory").queryName("stream_findings").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.file for r in spark.table("stream_findings").collect()] == ["a.py"]
