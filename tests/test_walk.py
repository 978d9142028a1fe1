"""The walk of a tree and files read in ranges, against Python's own."""

import os
import random

import pytest
from pyspark.sql import functions as F

from hedgerow.catalogue.noise import SKIP_DIRS
from hedgerow.operators import matchers
from hedgerow.operators.rules import category_rules, stock_rules
from hedgerow.plans.scans import scan_tree, scan_tree_with_counts
from hedgerow.sources import walk
from plans import plan_nodes


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("walked")
    rng = random.Random(4)
    lines = ["h = hashlib.md5(x)", "eval(code)", "el.innerHTML = v", "x = sanitize(v)", "plain", "", "é\x85half line", "a\rb", "r = requests.get(u)",
             "password = 'x'", "// eval(a)", "\x0b", "query = 'SELECT ' + id"]
    texts = {
        "a.py": 40, "deep/er/and/deeper/still/b.js": 120, ".github/workflows/ci.yml": 10, "__init__.py": 5, "_private/c.py": 30,
        "node_modules/lib/d.js": 20, "sub/Node_Modules/e.js": 20, "empty.py": 0, "noext": 12, "big.php": 900, "x y+z%20.py": 9,
    }
    for name, n in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        ends = rng.choice(["\n", "\r\n"])
        body = "".join(rng.choice(lines) + ends for _ in range(n)) + rng.choice(["", "eval(last)"])
        path.write_bytes(body.encode() + b"\xff\xfe eval(z)\xe2\x80")
    os.symlink(root / "deep", root / "linked")
    os.symlink(root / "a.py", root / "link.py")
    return root


def walked(root):
    found = {}
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n.lower() not in {s.lower() for s in SKIP_DIRS}]
        for name in files:
            path = os.path.join(folder, name)
            found[os.path.relpath(path, root)] = open(path, "rb").read()
    return found


def test_listing_is_that_of_os_walk(spark, tree):
    listed = walk.list_tree(spark, f"file:{tree}", SKIP_DIRS).collect()
    assert {r.path: r.length for r in listed} == {p: len(c) for p, c in walked(tree).items()} and len(listed) == len(walked(tree))
    assert walk.list_tree(spark, str(tree / "deep")).select("path").collect()[0].path == "er/and/deeper/still/b.js"


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_ranges_hold_every_line_once(spark, tree, size):
    listing = walk.staged_listing(spark, str(tree), SKIP_DIRS).where(F.col("length") < 40 * size)
    rows = walk.read_ranges(listing, size).orderBy("path", "offset").collect()
    wanted = {p: c.decode("utf-8", "ignore") for p, c in walked(tree).items() if len(c) < 40 * size}
    got, lines = {}, {}
    for r in rows:
        own = r.content.splitlines()
        assert (r.own, r.lead) == (len(own), len(r.before.splitlines()))
        assert r.first_line == len(lines.setdefault(r.path, []))
        lines[r.path] += own
        got[r.path] = got.get(r.path, "") + r.content
        if own:
            assert wanted[r.path].startswith(got[r.path]) and (r.before + r.content + r.after) in wanted[r.path]
    assert got == wanted and lines == {p: t.splitlines() for p, t in wanted.items()}


@pytest.mark.parametrize("size", [50, 333, 1 << 20])
def test_findings_of_ranges_are_those_of_whole_files(spark, tree, size):
    whole = spark.createDataFrame(
        [(p, c.decode("utf-8", "ignore")) for p, c in walked(tree).items()], "path string, content string"
    )
    texts = walk.read_ranges(walk.staged_listing(spark, str(tree), SKIP_DIRS), size)
    for rules in (stock_rules(), category_rules()):
        mine = sorted(map(tuple, matchers.match_files(texts, rules, ranges=True).collect()), key=str)
        assert mine and mine == sorted(map(tuple, matchers.match_files(whole, rules).collect()), key=str)


def test_scan_and_counts(spark, tree):
    findings, counts = scan_tree_with_counts(spark, str(tree), range_bytes=100)
    files = {r.file for r in findings.select("file").distinct().collect()}
    assert "deep/er/and/deeper/still/b.js" in files and "_private/c.py" in files and not any("odules" in f or f.startswith("linked") for f in files)
    names = [p for p in walked(tree)]
    assert sum(counts.collect()[0]) == len(names)
    assert scan_tree(spark, str(tree)).drop("timestamp").exceptAll(findings.drop("timestamp")).count() == 0
    small, few = scan_tree_with_counts(spark, str(tree), max_bytes=300)
    assert few.collect()[0].scanned < counts.collect()[0].scanned
    assert small.where("file = 'big.php'").count() == 0


def test_no_listing_on_the_driver(spark, tree):
    nodes = plan_nodes(walk.list_tree(spark, str(tree)))
    assert "FileScan" not in nodes and nodes.count("MapInArrow") == walk.SPREAD + 1


def test_an_empty_folder(spark, tmp_path):
    assert walk.list_tree(spark, str(tmp_path)).count() == 0
    assert scan_tree(spark, str(tmp_path)).count() == 0
