import pytest
from pyspark.sql import functions as F

from plans import plan_nodes
from hedgerow.functions import urls
from hedgerow.operators import responses as R
from hedgerow.plans import reports

SCHEMA = (
    "resp_id long, endpoint string, url string, method string, parameter string, payload string, "
    "payload_ord int, status int, headers map<string,string>, body string"
)
SCRIPT = "<script>alert(1)</script>"


def table(spark, *rows):
    return spark.createDataFrame([
        (i, endpoint, f"https://{site}.example{endpoint}", method, parameter, payload, order, status,
         headers or {}, body)
        for i, (site, endpoint, method, parameter, payload, order, status, headers, body) in enumerate(rows)
    ], SCHEMA)


def live(site, endpoint, status=200, body=""):
    return (site, endpoint, "GET", None, None, 0, status, None, body)


@pytest.mark.parametrize("body, payload, hit", [
    (f"x {SCRIPT}", SCRIPT, True),
    ("%3Cb%3E%20/", "<b> /", True),
    ("&lt;b&gt;&quot;&#39;", "<b>\"'", True),
    ("ONERROR=Alert", "zzz", True),
    ("&lt;b&gt;", "<b>&", False),
    ("nothing", "zzz", False),
])
def test_reflection(spark, body, payload, hit):
    rows = table(spark, ("s", "/search", "GET", "q", payload, 0, 200, None, body))
    assert R.reflected(rows).count() == int(hit)


def test_first_hit_per_endpoint_and_live_only(spark):
    rows = table(
        spark, live("a", "/search"), live("b", "/search", 302), live("c", "/search", 404),
        *[(s, "/search", "GET", "q", p, o, 200, None, p)
          for s in "abc" for o, p in ((2, R.QUICK_PAYLOADS[2]), (1, R.QUICK_PAYLOADS[1]))],
    )
    strict = R.detect(rows, ["reflected"]).collect()
    assert [(r.site, r.payload) for r in strict] == [("https://a.example", R.QUICK_PAYLOADS[1])]
    lax = R.detect(rows, ["search_reflection"])
    assert {r.site for r in lax.collect()} == {"https://a.example", "https://b.example"}
    assert {r.site for r in R.live_endpoints(rows, R.LAX_STATUSES).collect()} == {
        "https://a.example", "https://b.example"
    }


def test_database_error_names_the_first_signature(spark):
    rows = table(
        spark, live("a", "/search"),
        ("a", "/search", "GET", "id", "p0", 0, 500, None, "where ORA-1 sql"),
        ("a", "/search", "GET", "id", "p1", 1, 500, None, "clean"),
        ("a", "/search", "GET", "id", "p2", 2, 500, None, "x WHERE y"),
    )
    got = {r.payload: r.description for r in R.detect(rows, ["database_error"]).collect()}
    assert got == {"p0": "SQL error: ORA-", "p2": "SQL error: WHERE"}


def test_headers_in_any_case_and_cors_order(spark):
    rows = table(
        spark, live("a", "/api/webhook"), live("a", "/api/users"), live("a", "/login"),
        ("a", "/api/webhook", "OPTIONS", None, None, 0, 204, {"access-control-allow-origin": "*"}, ""),
        ("a", "/api/users", "OPTIONS", None, None, 0, 204, {"Access-Control-Allow-Origin": "*"}, ""),
        ("a", "/login", "GET", "redirect", "//attacker.com", 0, 302, {"LOCATION": "//attacker.com"}, ""),
        ("a", "/login", "GET", "redirect", "//attacker.com", 1, 302, None, ""),
    )
    cors = R.detect(rows, ["cors"]).collect()
    assert [(r.endpoint, r.owasp, r.payload) for r in cors] == [("/api/users", "Unknown", "*")]
    assert R.detect(rows, ["open_redirect"]).count() == 1


def test_token_is_case_sensitive(spark):
    token = "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.c2lnbmF0dXJlLWhlcmU"
    rows = table(spark, live("a", "/api/users", body=token), live("b", "/api/users", body=token.upper()))
    (row,) = R.detect(rows, ["token"]).collect()
    assert row.payload == token[:50] and row.description == f"JWT token found: {token[:20]}..."


def test_detectors_have_all_fields(spark):
    rows = table(
        spark, live("a", "/admin", body="<b>Dashboard</b>"), live("a", "/", body="DEBUG: True"),
        live("a", "/api/users", body="secret"), live("a", "/api/users/1", body="USER"),
    )
    found = {r.detector: r for r in R.detect(rows).collect()}
    assert set(found) == {"admin_panel", "admin_probe", "debug_mode", "sensitive_api", "object_probe"}
    assert found["admin_panel"].url == "https://a.example/admin"
    assert found["debug_mode"].snippet == "Debug: True"
    assert found["object_probe"].name == "IDOR in /api/users"
    assert found["object_probe"].file == "https://a.example/api/users/1"


def test_hits_are_combined_before_the_shuffle(spark):
    rows = table(spark, live("a", "/admin", body="Dashboard"))
    nodes = plan_nodes(R.first_hits(R.hits(rows)))
    # One aggregate before the exchange and one after it.
    exchange = nodes.index("Exchange")
    assert nodes.count("Exchange") == 1 and "Window" not in nodes
    assert "SortAggregate" in nodes[:exchange] and "SortAggregate" in nodes[exchange:]


def test_first_cors_is_among_live_endpoints(spark):
    allow = {"Access-Control-Allow-Origin": "*"}
    rows = table(
        spark, live("a", "/api/users", 404), live("a", "/api/webhook"),
        ("a", "/api/users", "OPTIONS", None, None, 0, 204, allow, ""),
        ("a", "/api/webhook", "OPTIONS", None, None, 0, 204, allow, ""),
    )
    assert [r.endpoint for r in R.detect(rows, ["cors"]).collect()] == ["/api/webhook"]


def test_reports(spark):
    rows = spark.createDataFrame([
        (1, "CRITICAL", "xss", "/a", "q"), (2, None, None, "/a", "q"), (3, "HIGH", "xss", "/ab", "p"),
        (4, "odd", "api", "/c", "r"),
    ], "n int, severity string, category string, endpoint string, parameter string")
    assert [tuple(r) for r in reports.severity_counts(rows).collect()] == [
        ("CRITICAL", 1), ("HIGH", 1), ("MEDIUM", 1)
    ]
    assert [tuple(r) for r in reports.category_counts(rows, "n").collect()] == [
        ("xss", 2), ("UNKNOWN", 1), ("api", 1)
    ]
    assert tuple(reports.severity_summary(rows).first()) == (1, 1, 1, 0)
    assert tuple(reports.report_header(rows).first()) == (4, 1, 1, 0)
    assert tuple(reports.xss_summary(rows, rows.limit(2)).first()) == (4, 3, 1, 1, 1)
    asked = spark.createDataFrame([("/a",), ("/ab",), ("/abc",), ("/c",)], "endpoint string")
    hit = reports.endpoints_with_hit(asked, reports.vulnerable_parameters(rows))
    assert {r.endpoint: r.hit for r in hit.collect()} == {
        "/a": True, "/ab": True, "/abc": False, "/c": True
    }


def test_listing(spark):
    rows = spark.createDataFrame(
        [(i, f"AS-IAM-{i}", "category long", "some/long/path/to/a/file.py", i, "d" * 60) for i in range(150)],
        "n int, finding_id string, category string, file string, line int, description string",
    ).withColumn("severity", F.lit(None).cast("string"))
    assert reports.listing(rows, "n").count() == 150
    got = reports.listing(rows, "n", rows=reports.LISTING_ROWS).collect()
    assert len(got) == 100
    assert tuple(got[0]) == ("AS-IAM", "MEDIUM", "category l", "some/long/path/to/a/fil", "d" * 48)


def test_site(spark):
    assert spark.range(1).select(urls.site(F.lit("https://u@h:1/p?q"))).first()[0] == "https://u@h:1"


def test_nothing_is_cut_by_default(spark):
    long = "<script>confirm(1)</script>"
    body = "x" * 400 + long + "uid=0 " + "y" * 400
    probe = "| whoami"
    rows = table(
        spark, live("a", "/search"), live("a", "/api/webhook"),
        ("a", "/search", "GET", R.TARGETED_PARAMETERS[9], long, 0, 200, None, body),
        ("a", "/#", "GET", None, R.FRAGMENT_PAYLOADS[1], 0, 200, None, "alert(1)"),
        ("a", "/api/webhook", "GET", "cmd", probe, 0, 200, None, body),
    )
    ids = ["parameter", "fragment_reflection", "command"]
    found = {r.detector: r for r in R.detect(rows, ids).collect()}
    assert set(found) == set(ids)
    assert found["parameter"].parameter == R.TARGETED_PARAMETERS[9] and found["parameter"].payload == long
    assert found["command"].evidence == found["command"].whole_evidence == body
    shown = {r.detector: r for r in R.detect(rows, ids, limits=R.LIVE_SCAN).collect()}
    assert set(shown) == {"command"} and shown["command"].evidence == body[:200] and shown["command"].whole_evidence == body
    assert shown["command"].whole_payload == probe
    few = R.Limits(payload_chars=(("xss", 5),))
    (row,) = R.detect(rows, ["parameter"], few).collect()
    assert (row.payload, row.whole_payload) == (long[:5], long)
    token = "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.c2lnbmF0dXJlLWhlcmUtdGhhdC1pcy1sb25nLWVub3VnaA"
    (row,) = R.detect(table(spark, live("a", "/api/users", body=token)), ["token"]).collect()
    assert row.whole_payload == token


def test_all_detectors_read_the_responses_once_and_liveness_once(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "responses"))
    stored = spark.read.parquet(str(tmp_path / "responses"))
    assert plan_nodes(R.detect(stored)).count("FileScan") == 2
    assert plan_nodes(R.detect(stored, ["database_error"])).count("FileScan") == 2
