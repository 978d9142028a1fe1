"""Rules from a table find what the same rules as literals of the plan find."""

import re

import pytest

from hedgerow.checks import planted
from hedgerow.operators import matchers, rule_index
from hedgerow.operators.rules import Rule, stock_rules
from plans import plan_nodes


@pytest.fixture(scope="module")
def files(spark, sf):
    return planted.files(spark, sf).select("path", "content")


def same(spark, files, rules):
    by_table = rule_index.match_files_by_table(files, rule_index.rule_rows(spark, rules))
    literal = matchers.match_files(files, rules)
    mine = sorted(map(tuple, by_table.select(*literal.columns).collect()), key=str)
    assert mine == sorted(map(tuple, literal.collect()), key=str)
    return mine


def test_stock_rules(spark, files):
    assert same(spark, files, stock_rules())


def test_odd_patterns(spark):
    rows = spark.createDataFrame(
        [("a.py", "x7 is 12345\nK and İ\n\n  // eval(x)"), ("b.js", "ab\rcd\x0bef"), ("c.py", ""), ("d", None)], "path string, content string"
    )
    rules = [Rule("C", n, exts, p) for n, exts, p in (
        ("digits", ("",), (r"\d{3,}",)), ("short", (".py",), ("x7",)), ("one", ("js",), ("d",)), ("two", ("",), (r"i\w", "kelvin|k")),
        ("none", (), ("x",)), ("bare", ("",), ()),
    )]
    assert same(spark, rows, rules)
    broken = rule_index.compiled(rule_index.rule_rows(spark, [Rule("C", "n", ("",), ("(", "ok", r"(a)?(?(1)b|c)"))])).collect()
    assert {r.pattern for r in broken if r.reason} == {"(", r"(a)?(?(1)b|c)"}


def test_patterns_whose_pieces_stand_apart(spark):
    texts = ["foo bar", "foobar", "FOO --- bar", "foo ---- bar", "abcdef..ghi", "abc\u00e9\u00e9def", "abc  def ghi", "\u212aeys \u0130nto x", "xabcy def", "ab", ""]
    rows = spark.createDataFrame([("a.py", "\n".join(texts))], "path string, content string")
    patterns = (
        r"foo(?:\s)?bar", r"foo.{0,5}bar", r"foo.{6}bar", r"(abc)(def).{2}ghi?", r"abc[^a-z]{1,3}def", r"abc\b\s*def", r"keys[^a-z]{1,3}into",
        r"abc(?=y)y.def", r"(?:abc|foo)\W{1,3}(?:def|bar)", r"abc(x|yz)?def", r"ab?c def",
    )
    mine = same(spark, rows, [Rule("C", p, ("",), (p,)) for p in patterns])
    want = sorted((p, i + 1) for p in patterns for i, t in enumerate(texts) if re.search(p, t, re.I))
    assert sorted((row[3], row[5]) for row in mine) == want  # name, line


def test_common_words_in_rules(spark):
    """Rules of the same pattern share one entry; no key stands for the many patterns that share a common word."""
    ends = [a + b + c for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    rules = [Rule("C", f"{end}{k}", ("",), (f"the[^a-z]{{1,3}}and[^a-z]{{1,3}}{end}",)) for end in ends for k in range(5)]
    index = rule_index.rule_index(rule_index.compiled(rule_index.rule_rows(spark, rules)))
    assert index.count() == len(ends)
    assert index.groupBy(index.columns[0]).count().agg({"count": "max"}).first()[0] == 1


def test_tiles_hold_every_finding_once(spark, monkeypatch):
    """Equal texts and equal rules, more of both than a tile has; repeated files and rules of many patterns count once."""
    monkeypatch.setattr(rule_index, "SIDE", 4)
    rows = spark.createDataFrame(
        [(f"a{i}.py", f"one two three {i % 3}\nlast words here") for i in range(23)] + [("a0.py", "one two three 0"), (None, "one two three")], "path string, content string"
    )
    rules = [Rule("C", f"same{k}", (".py", ""), (r"one\W+two\W+three", "two three")) for k in range(11)]
    rules += [Rule("C", "other", (".py",), ("last words",)), Rule("C", "elsewhere", (".js",), ("last words",))]
    mine = sorted((r.file, r.line, r.name) for r in rule_index.match_files_by_table(rows, rule_index.rule_rows(spark, rules)).collect())
    want = [(f"a{i}.py", 1, f"same{k}") for i in range(23) for k in range(11)] + [(f"a{i}.py", 2, "other") for i in range(23)]
    assert mine == sorted(want)


def test_findings_move_no_more_once_made(spark):
    """Equal texts times equal rules are made by the last join: above it there is no join, no grouping and no shuffle."""
    rows = spark.createDataFrame([(f"a{i}.py", "one two three") for i in range(20)], "path string, content string")
    rules = [Rule("C", f"same{k}", ("",), (r"one\W+two\W+three",)) for k in range(20)]
    found = rule_index.match_files_by_table(rows, rule_index.rule_rows(spark, rules))
    assert found.count() == 400
    nodes = plan_nodes(found)
    last = next(i for i, n in enumerate(nodes) if n.endswith("Join"))
    assert not any("Exchange" in n or "Aggregate" in n for n in nodes[:last])
    below = re.findall(r"(?m)^[\s:+\-]*(Join|Aggregate|Deduplicate)", found._jdf.queryExecution().optimizedPlan().toString())
    assert below.count("Aggregate") + below.count("Deduplicate") == 0  # the rows that it joins are lines and rules


def test_only_lines_with_a_whole_chain_are_tried(spark):
    """Lines that hold all neighbouring pieces of a pattern, but not one after the other, are not tried."""
    index = rule_index.rule_index(rule_index.compiled(rule_index.rule_rows(spark, [Rule("C", "n", ("",), (r"the[^a-z]{1,3}and[^a-z]{1,3}was[^a-z]{1,3}his",))])))
    lines = spark.createDataFrame([(1, "the and x and was x was his"), (2, "so the and, was his"), (3, "theand was")], "line_id bigint, folded string")
    assert [r.line_id for r in rule_index.keyed_lines(lines, index).collect()] == [2]


def test_repeated_characters_are_one_chain(spark):
    rows = spark.createDataFrame([("a.py", "-" * 3000 + "\n" + "-" * 7)], "path string, content string")
    mine = same(spark, rows, [Rule("C", n, ("",), (p,)) for n, p in (("long", "-" * 40), ("short", "-{3,}---"), ("begin", "-----begin"))])
    assert sorted((r[3], r[5]) for r in mine) == [("long", 1), ("short", 1), ("short", 2)]


def test_five_thousand_rules_have_the_plan_of_one(spark, files):
    def plan(n):
        rules = spark.range(n).selectExpr(
            "CAST(id AS int) AS rule_ord", "'C' AS category", "concat('r', id) AS name", "array('') AS file_exts",
            "array(concat('key_', id, '\\\\s*='), concat('word', id)) AS vuln_patterns", "'LOW' AS severity", "1 AS confidence", "'N/A' AS cwe", "'' AS vuln_desc",
        )
        found = rule_index.match_files_by_table(
            files.limit(0).union(spark.createDataFrame([("p", "key_17 = 1\nword4999 word12\nword499 key_3\nKEY_4998   =")], "path string, content string")), rules
        )
        return found

    many = plan(5000)
    got = sorted((r.line, r.name) for r in many.collect())
    text = ["key_17 = 1", "word4999 word12", "word499 key_3", "KEY_4998   ="]
    want = sorted((i + 1, f"r{n}") for i, t in enumerate(text) for n in range(5000) if re.search(rf"key_{n}\s*=|word{n}", t, re.I))
    assert got == want
    size = [len(plan(n)._jdf.queryExecution().optimizedPlan().toString()) for n in (1, 5000)]
    assert abs(size[0] - size[1]) < 100
