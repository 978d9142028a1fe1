"""Patterns in Java's syntax find what Python's `re` finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hedgerow.functions import dialect, patterns
from hedgerow.operators.rules import category_rules, stock_rules

CHARS = "ab1_ -[]&^$.\\|\n\r\t\x1c\x85\xa0éÉ日٣²̀ſK\u2028"
FIXED = [
    r"[[]", r"[]]", r"[a&&b]", r"[&&]", r"[^\W\d]", r"[\W_]", r"[\s&]", r"[^\s]", r"a\Z", r"a$", r"(?m)^a", r"(?m)b$", r"\Aa", r"a\b", r"\B_", r"\b\w+\b",
    r"(?P<q>[ab])1(?P=q)", r"(a)(b)?\2", r"(?i:A)b", r"(?-i:a)B", r"(?s)a.b", r"(?s:a.)b", r"a.b", r"(?a)\w", r"(?a:\d)\w", r"(?<=a)b", r"(?<!a)b",
    r"(?=a)\w", r"a(?!b)", r"(?>a+)b", r"a++b", r"a*?b", r"a{2}", r"a{,2}b", r"[\]\[]", r"[-a]", r"[a\-b]", r"\x41", r"é", r"[à-ï]", r"(?x) a  b # c",
    r"\d+", r"\s+$", r"\S", r"(?:a|b|)1", r"()a", r"\\", r"\.", r"a|b", r"[^a-z]", r"#", r"~", r"(?m)$", r"^$", r"\.\.", r"a\\Eb", r"\$\{",
]


def made(rng, depth=0):
    kind = rng.randrange(12 if depth < 3 else 5)
    if kind < 3:
        return re.escape(rng.choice(CHARS))
    if kind == 3:
        return rng.choice([".", r"\w", r"\W", r"\s", r"\S", r"\d", r"\D", r"\b", r"\B", "^", "$", r"\A", r"\Z"])
    if kind == 4:
        return "[" + rng.choice(["", "^"]) + "".join(rng.choice([re.escape(rng.choice(CHARS)), r"\w", r"\s", r"\W", "a-f", "[", "&&"]) for _ in range(rng.randrange(1, 4))) + "]"
    if kind < 8:
        return made(rng, depth + 1) + made(rng, depth + 1)
    if kind == 8:
        return f"(?:{made(rng, depth + 1)}|{made(rng, depth + 1)})"
    if kind == 9:
        return rng.choice(["(", "(?:", "(?=", "(?!", "(?i:", "(?-i:", "(?s:"]) + made(rng, depth + 1) + ")"
    return f"(?:{made(rng, depth + 1)})" + rng.choice(["*", "+", "?", "{1,2}", "*?", "+?"])


def compare(spark, given, texts):
    frame, wrong = spark.createDataFrame([(t,) for t in texts], "t string"), {}
    for begin in range(0, len(given), 60):
        part = given[begin: begin + 60]
        rows = frame.select("t", *[F.col("t").rlike(dialect.to_java(p)).alias(f"p{i}") for i, p in enumerate(part)]).collect()
        for row in rows:
            for i, p in enumerate(part):
                if row[f"p{i}"] != bool(re.search(p, row.t, re.I)):
                    wrong[p] = (dialect.to_java(p), row.t)
    assert not wrong


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_same_as_python(spark):
    rng = random.Random(12)
    given = FIXED + [made(rng) for _ in range(240)]
    texts = ["", "a", "ab", "a\n", "b1a", "A_b", "a-b", "é1", "a\nb", "aab", "${x}", "a\\Eb", "&&", "[a]"] + [
        "".join(rng.choice(CHARS) for _ in range(rng.randrange(1, 9))) for _ in range(120)
    ]
    compare(spark, [p for p in given if not _odd(p)], texts)


def _odd(pattern):
    try:
        re.compile(pattern)
        return False
    except re.error:
        return True


def test_stock_patterns(spark):
    given = list(dict.fromkeys(p for r in stock_rules() + category_rules() for p in r.patterns))
    rng = random.Random(2)
    runs = [r for p in given for r in patterns.literal_runs(p)[0]]
    texts = [" ".join(rng.choice([rng.choice(runs), rng.choice(runs).upper(), "(", "=", "'x'", "/v1/", "\u00a0"]) for _ in range(6)) for _ in range(60)]
    compare(spark, given, texts)


def test_groups_keep_their_numbers(spark):
    frame = spark.createDataFrame([("x=1; y=22",)], "t string")
    pattern = dialect.to_java(r"(?P<name>\w)=(?:(?P<digits>\d+))")
    assert frame.select(F.regexp_extract_all("t", F.lit(pattern), F.lit(2))).head()[0] == ["1", "22"]


def test_only_patterns_without_a_counterpart_are_rejected(spark):
    bad = patterns.check_patterns(spark, ["[[]", r"a\Z", "[a&&b]", r"(a)?(?(1)b|c)", "(", "ok"])
    assert set(bad) == {r"(a)?(?(1)b|c)", "("}
    assert "counterpart" in bad[r"(a)?(?(1)b|c)"]
