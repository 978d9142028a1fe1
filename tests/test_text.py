import re
from urllib.parse import quote, urljoin, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hedgerow.functions import patterns, text, urls

ODD = [
    "", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\nd", "x\x0by\x0cz\x1cw\x1dv\x1eu\x85t s r",
    "  pad \t", " nbsp　", "\x1f unit \x1f", "no break", "\r\n\r\n", "é è", "a\x1fb",
]


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_split_lines_is_splitlines(spark):
    assert column(spark, ODD, text.split_lines("t")) == [s.splitlines() for s in ODD]


def test_strip_is_strip(spark):
    assert column(spark, ODD, text.strip(F.col("t"))) == [s.strip() for s in ODD]


def test_decode_drops_bad_bytes(spark):
    raw = [b"plain", b"a\xffb", b"\xc3\xa9", b"\xc3", b"", b"\xf0\x9f\x98\x80\xf0\x9f"]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    got = [r[0] for r in rows.orderBy("i").select(text.decode_utf8(F.col("b"))).collect()]
    assert got == [b.decode("utf-8", errors="ignore") for b in raw]


def test_percent_encode_is_quote(spark):
    values = ["a b/c", "<script>alert('x')</script>", "~*-_.!", "é+%", "{{7*7}}", ""]
    assert column(spark, values, text.percent_encode(F.col("t"))) == [quote(v) for v in values]


def test_escapes(spark):
    assert column(spark, ["<a b=\"c\">'&"], text.escape_payload(F.col("t"))) == [
        "&lt;a b=&quot;c&quot;&gt;&#39;&"
    ]
    assert column(spark, ["<&>"], text.escape_html(F.col("t"))) == ["&lt;&amp;&gt;"]
    assert column(spark, ["a&amp;lt;&#x2F;"], F.expr(text.unescape_html_sql("t"))) == ["a&lt;/"]


def test_sql_text_keeps_every_character(spark):
    value = "a'b\\c\"d${x}\n\te "
    assert spark.range(1).select(F.expr(text.sql_text(value))).first()[0] == value


SOME_PATTERNS = [
    r"eval\s*\(", "cvv", r"password\s*[:=]\s*['\"]\S+['\"]", r"(a|b)c+", r"x{0,2}y", r"(?i)^USER\s+r",
    r"AKIA[0-9A-Z]{4}", r"kiss|miss", r"\bsick\b", r"i+s", r"gh[po]_[a-z]{2,}", r"\.bak$",
]


@settings(max_examples=6, deadline=None)
@given(st.lists(
    st.one_of(
        st.text("aebcvyx(= '\"sSkKiIſıK.", max_size=12),
        st.sampled_from(["EVAL (", "ſick", "Kİss", "akiaAB12", "user r", "x.BAK", "gho_ab"]),
    ), min_size=30, max_size=60,
))
def test_matches_agrees_with_re(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "t string").withColumn(
        "f", text.fold(F.col("t"))
    )
    for pattern in SOME_PATTERNS:
        got = [r[0] for r in rows.select(F.expr(patterns.matches_sql("t", "f", pattern))).collect()]
        assert got == [bool(re.search(pattern, v, re.I)) for v in values], pattern
    guards = rows.select(F.expr(patterns.can_match_sql("f", SOME_PATTERNS[:3]))).collect()
    for value, guard in zip(values, guards):
        if any(re.search(p, value, re.I) for p in SOME_PATTERNS[:3]):
            assert guard[0]


def test_literal_runs():
    assert patterns.literal_runs(r"eval\s*\(") == (("eval", "("), False)
    assert patterns.literal_runs("cvv") == (("cvv",), True)
    assert patterns.literal_runs(r"(a|b)?\d*")[0] == ()


def test_invalid_patterns_are_named(spark):
    bad = patterns.check_patterns(spark, ["(", "ok", "[a", r"(?P<n>x)(?P=n)"])
    assert set(bad) == {"(", "[a"}


LINKS = [
    "/a", "b", "../b", "../../../b", "./b/./c", "?q=1", "#f", "", "//h2/x", "https://o.example/p",
    "mailto:a@b", "b/", "..", ".", "b//c", "/a/../b/", "http://s.example/z", "x;p=1?q#f",
]


@pytest.mark.parametrize("base", ["http://s.example/d/e/f", "http://s.example", "https://s.example:8/d?x=1#y"])
def test_resolve_is_urljoin(spark, base):
    got = column(spark, LINKS, urls.resolve(text.sql_text(base), "t"))
    assert got == [urljoin(base, link) for link in LINKS]


def test_url_parts(spark):
    values = ["http://u:p@H.example:80/a/b;c=1?k=v&w&x=y#z", "/only/path", "mailto:x@y", "https://h"]
    assert column(spark, values, urls.authority(F.col("t"))) == [urlsplit(v).netloc for v in values]
    assert column(spark, values, urls.path(F.col("t"))) == ["/a/b", "/only/path", "x@y", ""]
    assert column(spark, values, urls.query_keys("t"))[0] == ["k", "x"]
    assert column(spark, values[:1], urls.hostname(F.col("t"))) == ["h.example"]
    with pytest.raises(Exception, match="Invalid URL"):
        column(spark, ["no host"], urls.hostname(F.col("t")))


def test_path_prefixes(spark):
    got = column(spark, ["/a/b", "", "/", "x"], urls.path_prefixes("t"))
    assert got == [["//a", "//a/b"], [], ["//"], ["/x"]]


def test_extension(spark):
    names = ["a/b.PY", ".env", "x/Dockerfile", "a.tar.gz", "..x", "..x.y", "d.e/f"]
    assert column(spark, names, urls.extension(F.col("t"))) == [".py", "", "", ".gz", "", ".y", ""]
