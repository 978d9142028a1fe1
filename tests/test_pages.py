from pyspark.sql import functions as F

from hedgerow.operators import extract, pages

HTML = """<!DOCTYPE html><html><body>
<!-- <a href="/hidden">x</a> -->
<A HREF='/one/two?k=1&amp;z=2#f'>a</A> <a class="c" href=bare>b</a>
<a href="http://other.example/x">c</a><a href="mailto:me@x.example">d</a><abbr href="/no">e</abbr>
<a href="/one/two?k=1&amp;z=2#f">again</a>
<script src="/s/app.js?v=1"></script><script src="//cdn.example/lib.js"></script>
<script src="/s/app.js"></script><script src="/s/style.css"></script><script src="rel.js"></script>
<script>var a = "<a href='/in/script'>"; fetch('/api/f'); axios.post("/api/p");
  x = {url: 'nope/rel', endpoint: '/e/1'}; go("/login"); go('/V2/thing')</script>
<div data-url="/data/1"></div><div data-url=""></div>
<form action="/send"></form><form></form><form action=""></form>
</body></html>"""


def page(spark, url="https://site.example/dir/page"):
    return spark.createDataFrame([(1, url, HTML)], "page_id long, url string, html string")


def column(df, name):
    return sorted(r[0] for r in df.select(name).collect())


def test_links(spark):
    links = pages.anchor_links(page(spark))
    assert column(links, "link") == sorted([
        "https://site.example/one/two?k=1&z=2#f", "https://site.example/dir/bare",
        "mailto:me@x.example",
    ])
    assert column(pages.path_endpoints(links), "endpoint") == ["/dir/bare", "/one/two", "me@x.example"]
    assert column(pages.prefix_endpoints(links), "endpoint") == [
        "//dir", "//dir/bare", "//one", "//one/two", "/me@x.example"
    ]
    assert column(pages.query_endpoints(links), "endpoint") == ["?k=", "?z="]


def test_scripts_and_attributes(spark):
    found = pages.script_files(page(spark)).orderBy("pos").collect()
    assert [r.script for r in found] == [
        "https://site.example/s/app.js", "https://cdn.example/lib.js", "https://site.example/dir/rel.js"
    ]
    assert column(pages.script_endpoints(page(spark)), "endpoint") == [
        "/V2/thing", "/api/f", "/api/f", "/api/p", "/api/p", "/e/1", "/login"
    ]
    assert column(pages.data_url_endpoints(page(spark)), "endpoint") == ["/data/1"]
    assert column(pages.form_endpoints(page(spark)), "endpoint") == ["/send"]


def test_crawl_is_the_sum_of_its_parts(spark):
    two = page(spark).union(page(spark, "https://site.example/dir/other"))
    endpoints = set(column(pages.site_endpoints(two), "endpoint"))
    links = pages.anchor_links(two)
    parts = [
        pages.path_endpoints(links), pages.prefix_endpoints(links), pages.query_endpoints(links),
        pages.script_endpoints(two), pages.data_url_endpoints(two), pages.form_endpoints(two),
    ]
    assert endpoints == {e for part in parts for e in column(part, "endpoint")}
    rows = pages.crawl_rows(two)
    assert rows.count() == rows.distinct().count()
    assert set(column(rows.filter("kind = 'endpoint'"), "value")) == endpoints
    summary = pages.crawl_summary(two).first()
    assert (summary.site, summary.js_files, summary.endpoints) == ("https://site.example", 3, len(endpoints))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2 and plan.count("Generate") == 1


def test_script_names(spark):
    names = ["app.js?v=1", "a<b>:c", "x__y.js", "noext", "p|q*.js"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i")
    got = [r[0] for r in rows.select(pages.script_name(F.col("n"))).collect()]
    assert got == ["app.js", "a_b_c.js", "x_y.js", "noext.js", "p_q_.js"]
    stored = pages.stored_scripts(page(spark).union(page(spark)))
    assert column(stored, "name") == ["app.js", "lib.js", "rel.js"]


def test_risky_parameters(spark):
    rows = spark.createDataFrame(
        [(1, "https://s.example/?page=2&odd=1", "<a href='?q=x&page=3'>l</a>")],
        "page_id long, url string, html string")
    assert column(pages.risky_query_parameters(rows), "key") == ["page", "q"]


def test_find_all_like_findall(spark):
    rows = spark.createDataFrame([(
        1, "u", "API_KEY = 'one' api_key=\"two\"\nsk-" + "a" * 20 + " password: ''\npassword='p\nq'"
    )], "id int, url string, t string")
    found = extract.page_secrets(rows, "id", content="t", url="url")
    got = sorted((r.name, r.snippet) for r in found.collect())
    assert got == sorted([
        ("Hardcoded API Key", "one"), ("Hardcoded API Key", "two"),
        ("Hardcoded OpenAI API Key", "sk-" + "a" * 20), ("Hardcoded Password", "p\nq"),
    ])
    first = found.filter("snippet = 'one'").first()
    assert first.description == "Found API Key: one..." and first.file == "u" and first.line == 0


def test_lines_and_candidates(spark):
    rows = spark.createDataFrame([
        ("s", "u", "short\nx = '/api/a' and /api/b\n  console.log('/api/c')\n/v1/z and more /v2/z text"),
        ("s", "u", "0123456789 /v2/q"),
    ], "site string, url string, content string")
    patterns = ["/api/", r"/v\d+/"]
    every = extract.find_all_in_lines(rows, "site", "url", patterns=["or[t]"])
    assert [r.line for r in every.collect()] == [1]
    plain = extract.find_all_in_lines(rows, "site", "url", patterns=patterns, min_chars=10)
    assert extract.find_all_in_lines(rows, "site", "url", patterns=["or[t]"], min_chars=10).count() == 0
    assert sorted((r.line, r.pat_ord, r.match_pos, r.value) for r in plain.collect()) == [
        (1, 1, 0, "/v2/"), (2, 0, 0, "/api/"), (2, 0, 1, "/api/"), (3, 0, 0, "/api/"),
        (4, 1, 0, "/v1/"), (4, 1, 1, "/v2/"),
    ]
    script = extract.find_all_in_lines(rows, "site", patterns=patterns, script=True)
    assert script.filter("line = 3").count() == 0
    firsts = extract.endpoint_candidates(plain, "site", base_url="url").collect()
    assert {(r.value, r.line, r.full_url) for r in firsts} == {
        ("/api/", 2, "u/api/"), ("/v1/", 4, "u/v1/"), ("/v2/", 1, "u/v2/")
    }


def test_quoted_marks_and_comment_marks(spark):
    html = (
        "<a title=\"a>b\" href=\"/one\">x</a><a data-x='>' href='/two'>y</a><form name='f>' action=\"/form\"></form>"
        "<b title='>' data-url=\"/data\"></b><script data-q=\">\" src=\"/file.js\"></script>"
        "<script><!-- fetch(\"/api/kept\") //--></script><!-- <script>fetch('/api/hidden')</script><a href='/no'>n</a> -->"
    )
    rows = spark.createDataFrame([(1, "http://h.example/", html)], "page_id bigint, url string, html string")
    assert [r.link for r in pages.anchor_links(rows).collect()] == ["http://h.example/one", "http://h.example/two"]
    assert [r.script for r in pages.script_files(rows).collect()] == ["http://h.example/file.js"]
    assert [r.endpoint for r in pages.form_endpoints(rows).collect()] == ["/form"]
    assert [r.endpoint for r in pages.data_url_endpoints(rows).collect()] == ["/data"]
    assert {r.endpoint for r in pages.script_endpoints(rows).collect()} == {"/api/kept"}


def test_long_tags_do_not_exhaust_the_stack(spark):
    tag = "<a " + " ".join(f'data-{i}="{">" * 20}"' for i in range(300)) + " href='/far'>x</a>" + "<a " + "z" * 50_000
    rows = spark.createDataFrame([(1, "http://h.example/", tag)], "page_id bigint, url string, html string")
    assert [r.link for r in pages.anchor_links(rows).collect()] == ["http://h.example/far"]
