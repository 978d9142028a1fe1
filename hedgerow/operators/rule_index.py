"""Thousands of rules from a table, by an index from pieces of their literal text to their patterns.

Rules as literals of the plan (`matchers`) suit a few dozen: the plan grows with them, and every line is tested for each.
Here rules are rows. Each different pattern is indexed once, whatever the number of rules that have it, by a chain of pieces
of its literal text: LINKS pieces or fewer, PIECE characters long, each at most APART characters after the one before. Of its
chains the longest is taken that few patterns hold. A line is searched for chains of the index piece by piece (a bitmap of
bounded size tells nearly all others), and the lines that hold one are joined with the index by the chain's number. Only the
patterns that share it are tried on the line, their literal runs first and then the regex. Text moves once, by line. The plan
is the same for any number of rules.

Rules with the same patterns and extensions are a bundle. Up to the last join there is one row for a line and a bundle;
the findings, lines times rules of a bundle, are made by that join in tiles of about SIDE by SIDE and move no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.functions.patterns import java_pattern, literal_runs, piece_chains, pieces_of
from hedgerow.functions.scratch import stage
from hedgerow.functions.text import LINE_BREAKS, fold, fold_sql, let_sql, preview, strip
from hedgerow.functions.urls import extension
from hedgerow.operators.matchers import SNIPPET_CHARS
from hedgerow.operators.noise import noise_line_sql
from hedgerow.operators.rules import Rule

#: Characters of a piece. A pattern whose longest run is shorter stands under EVERY, a key that every line has.
PIECE = 3
#: Characters between two neighbouring pieces, at most.
APART = 3
#: Pieces of a chain, at most.
LINKS = 6
EVERY = 0
#: Bits of the place of a key in the bitmap (8 MB).
_BITS = 26
#: Where in a key its two places are: of a chain's begin, and of a whole chain.
_BEGIN, _WHOLE = (64 - _BITS, 12), (25, 0)
_ONE_BIT = np.uint8(1) << np.arange(8, dtype=np.uint8)
#: Characters of lines whose keys are made at a time.
_CHARS = 1 << 20
#: Lines and rules of a tile of findings, about.
SIDE = 4096
#: Findings that a task of the last join makes, about.
_FINDINGS = 1 << 26

RULE_ROWS = (
    "rule_ord int, category string, name string, file_exts array<string>, vuln_patterns array<string>, severity string, "
    "confidence int, cwe string, vuln_desc string"
)
_COMPILED = "rule_ord int, pattern string, regex string, runs array<string>, plain boolean, chains array<array<bigint>>, reason string"


def rule_rows(spark, rules: list[Rule]) -> DataFrame:
    """Rules with patterns of their own as RULE_ROWS."""
    return spark.createDataFrame(
        [(i, r.category, r.name, list(r.file_exts), list(r.vuln_patterns), r.severity, r.confidence, r.cwe, r.vuln_desc)
         for i, r in enumerate(rules)], RULE_ROWS,
    )


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _piece_keys(points: np.ndarray) -> np.ndarray:
    """A number for the piece at each place of a text's code points."""
    x = points.astype(np.uint64)
    out = x[: max(len(x) - PIECE + 1, 0)].copy()
    for k in range(1, PIECE):
        out = out << np.uint64(21) | x[k: k + len(out)]
    return _mix(out)


def _linked(begin: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The numbers of chains with one more piece."""
    return _mix(begin ^ (piece << np.uint64(1)))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _chain_keys(pieces: tuple[str, ...]) -> list[list[int]]:
    """The numbers of the first piece, the first two and so on, of all LINKS neighbours of a chain."""
    keys = _piece_keys(_points("".join(pieces)))[::PIECE]
    links = min(len(pieces), LINKS)
    count = len(pieces) - links + 1
    numbers = [keys[:count]]
    for k in range(1, links):
        numbers.append(_linked(numbers[-1], keys[k: k + count]))
    return np.stack(numbers, 1).view(np.int64).tolist()


def _pattern_chains(pattern: str, run: str) -> list[list[int]]:
    """The numbers of a pattern's chains, else of that of its longest run, else EVERY."""
    chains = piece_chains(pattern, PIECE, APART) or ((pieces_of(run, PIECE),) if len(run) >= PIECE else ())
    return [keys for chain in chains for keys in _chain_keys(chain)] or [[EVERY]]


def compiled(rules: DataFrame) -> DataFrame:
    """Each pattern of RULE_ROWS in Java's syntax, with its literal runs and chains, or the reason why it is left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known, rows = {}, []
            for order, pattern in zip(batch["rule_ord"], batch["pattern"]):
                if pattern not in known:
                    try:
                        runs, plain = literal_runs(pattern)
                        chains = _pattern_chains(pattern, runs[0] if runs else "")
                        known[pattern] = (java_pattern(pattern), list(runs), plain, chains, None)
                    except Exception as error:  # whatever the parser says against it is the reason
                        known[pattern] = (None, None, False, None, str(error))
                rows.append((order, pattern, *known[pattern]))
            yield pd.DataFrame(rows, columns=["rule_ord", "pattern", "regex", "runs", "plain", "chains", "reason"])

    rows = rules.select("rule_ord", F.explode("vuln_patterns").alias("pattern")).distinct()
    # the rows are small and their work is not, so they are dealt to all cores
    return rows.repartition(rules.sparkSession.sparkContext.defaultParallelism, "pattern").mapInPandas(work, _COMPILED)


def rule_index(patterns: DataFrame) -> DataFrame:
    """(key, chain, regex, runs, plain): each different pattern once, under that of its chains which is rarest.

    A piece more counts as much as being held by a 16th of the patterns.
    """
    held = patterns.where("reason IS NULL").groupBy("regex").agg(F.first(F.struct("runs", "plain", "chains")).alias("of"))
    held = held.select("regex", "of.runs", "of.plain", F.explode("of.chains").alias("chain"))
    held = held.withColumn("key", F.element_at("chain", -1))
    often = held.groupBy("key").agg(F.count("*").alias("holders"))
    rarity = F.struct((F.col("holders") * F.pow(F.lit(16.0), -F.size("chain"))).alias("rarity"), "key", "chain")
    best = held.join(often, "key").groupBy("regex", "runs", "plain").agg(F.min(rarity).alias("best"))
    return best.select("best.key", "best.chain", "regex", "runs", "plain")


def _bitmap(index: DataFrame) -> np.ndarray:
    """The places of the index's chains and of all their begins as 2 ** _BITS bits: at most 2,048 rows of 4 KB reach the driver,
    whatever the number of chains."""
    marks = [("chain", shift) for shift in _BEGIN] + [("array(key)", shift) for shift in _WHOLE]
    places = ", ".join(f"transform({keys}, k -> (shiftrightunsigned(k, {shift}) & {(1 << _BITS) - 1}) + 1)" for keys, shift in marks)
    rows = index.where(f"key <> {EVERY}").select(F.explode(F.expr(f"concat({places})")).alias("place")).distinct()  # places begin at 1
    rows = rows.selectExpr("bitmap_bucket_number(place) AS b", "bitmap_bit_position(place) AS p")
    out = np.zeros((1 << _BITS) // 8, np.uint8)
    for bucket, part in rows.groupBy("b").agg(F.expr("bitmap_construct_agg(p)")).collect():
        begin = (bucket - 1) * len(part)
        out[begin: begin + len(part)] = np.frombuffer(bytes(part), np.uint8)
    return out


def _marked(bits: np.ndarray, keys: np.ndarray, shifts: tuple[int, int]) -> np.ndarray:
    """Which of the keys have both of their places in the bitmap."""
    kept, left = np.arange(len(keys)), keys
    for shift in shifts:
        place = (left >> np.uint64(shift) & np.uint64((1 << _BITS) - 1)).view(np.int64)
        on = np.flatnonzero(bits[place >> 3] & _ONE_BIT[place & 7])
        kept, left = kept[on], left[on]
    return kept


def _different(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, places))
    places, keys = places[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])
    return places[new], keys[new]


def _text_keys(points: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different chains of the bitmap in a text, each by the place where its last piece begins."""
    pieces = _piece_keys(points)
    ways, found = [(np.arange(len(pieces)), pieces)], []
    for _ in range(LINKS):
        begun = []
        for places, keys in ways:
            kept = _marked(bits, keys, _BEGIN)
            begun.append((places[kept], keys[kept]))
        # runs of one character give the same chain in many ways
        places, keys = begun[0] if len(begun) == 1 else _different(*(np.concatenate(side) for side in zip(*begun)))
        whole = _marked(bits, keys, _WHOLE)
        found.append((places[whole], keys[whole]))
        ways = []
        for step in range(1, PIECE + APART + 1):
            inside = int(np.searchsorted(places, len(pieces) - step))
            later = places[:inside] + step
            ways.append((later, _linked(keys[:inside], pieces[later])))
    return tuple(np.concatenate(side) for side in zip(*found))


def keyed_lines(lines: DataFrame, index: DataFrame) -> DataFrame:
    """The lines (.., folded) that may hold a chain of the index, with `keys` instead of `folded`: the different numbers of
    all that they hold and of few others."""
    columns = [c for c in lines.columns if c != "folded"]
    shared = lines.sparkSession.sparkContext.broadcast(_bitmap(index))
    every = index.where(f"key = {EVERY}").limit(1).count()

    def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # chains that cross the end of a line are no text's own; patterns are tried afterwards
        points = _points(b"\n".join(texts).decode("utf-8", "replace"))
        places, keys = _text_keys(points, shared.value)
        rows = np.cumsum(points == 10)[places]
        if every:
            rows = np.concatenate([rows, np.arange(len(texts))])
            keys = np.concatenate([keys, np.full(len(texts), EVERY, np.uint64)])
        return _different(rows, keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(columns)).cast(pa.binary()).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            begin = 0
            while begin < len(texts):
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + _CHARS, side="right")))
                rows, keys = keys_of(texts[begin:end])
                rows, starts = np.unique(rows, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(keys.view(np.int64)))
                kept = pa.array(rows + begin)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(kept) for i in range(len(columns))), lists], names=[*columns, "keys"])
                begin = end

    schema = T.StructType([lines.schema[c] for c in columns]).add("keys", T.ArrayType(T.LongType()))
    return lines.select(*columns, "folded").mapInArrow(work, schema)


def bundled(rules: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundle, regexes, file_exts, rules): each different set of patterns and extensions, and its number of rules; and the
    rules with their bundle and a number. Rows of one rule_ord share their patterns."""
    sets = patterns.where("reason IS NULL").groupBy("rule_ord").agg(F.sort_array(F.collect_set("regex")).alias("regexes"))
    whole = rules.drop("vuln_patterns").join(sets, "rule_ord")
    bundles = whole.groupBy("regexes", "file_exts").agg(F.count("*").alias("rules"))
    bundles = stage(bundles.withColumn("bundle", F.monotonically_increasing_id()), "rule-bundles")
    own = bundles.select("bundle", F.col("regexes").alias("_regexes"), F.col("file_exts").alias("_exts"))
    members = whole.join(own, (F.col("regexes") == F.col("_regexes")) & F.col("file_exts").eqNullSafe(F.col("_exts")))
    members = members.drop("regexes", "_regexes", "file_exts", "_exts").withColumn("number", F.monotonically_increasing_id())
    return bundles, stage(members, "rule-members")


def line_hits(files: DataFrame, patterns: DataFrame, bundles: DataFrame) -> DataFrame:
    """(path, line, line_id, snippet, bundle): each line once with each bundle of which a pattern matches it."""
    index = stage(rule_index(patterns), "rule-index")
    lines = files.select("path", F.posexplode(F.split("content", LINE_BREAKS)).alias("at", "raw"))
    lines = lines.select("path", (F.col("at") + 1).alias("line"), strip(F.col("raw")).alias("text")).where("text <> ''")
    lines = lines.select(F.xxhash64("path", "line", "text").alias("line_id"), "*", fold(F.col("text")).alias("folded"))
    telling = f"NOT {noise_line_sql('text', '_folded')}"
    lines = stage(keyed_lines(lines, index).where(let_sql(fold_sql("text"), "_folded", telling)), "rule-lines", "zstd")
    # a line that holds a chain of two pieces nearly always holds the runs; the regex alone decides
    runs = F.expr("IF(size(chain) > 1, NULL, runs)").alias("runs")
    index = index.select("key", "regex", runs, (F.col("plain") & (F.size("chain") < 2)).alias("plain"))
    owners = bundles.select("bundle", "file_exts", F.explode("regexes").alias("regex")).join(index, "regex")
    tried = lines.select("line_id", F.explode("keys").alias("key")).distinct().join(owners, "key")
    tried = tried.select("line_id", "bundle", "file_exts", "regex", "runs", "plain")
    held = let_sql(fold_sql("text"), "_folded", "forall(runs, r -> contains(_folded, r))")
    test = f"(runs IS NULL OR {held}) AND (plain OR text RLIKE regex)"
    covered = F.expr("exists(file_exts, e -> endswith(path, e) OR ext = e)")
    met = lines.drop("keys").join(tried, "line_id").where(test)
    met = met.withColumn("ext", extension(F.col("path"))).where(covered)
    # a line may be there twice, and a bundle have many patterns; its rows are in one place already
    return met.select("path", "line", "line_id", preview(F.col("text"), SNIPPET_CHARS).alias("snippet"), "bundle").distinct()


def match_files_by_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (path, content) x RULE_ROWS: the findings of `matchers.match_files` with the same rules.

    Patterns that do not compile are left out; `compiled` names them. Lines that may match are staged once, and a line's text
    moves once, to the patterns that are to be tried on it. The findings themselves are made in the last join.
    """
    spark = rules.sparkSession
    rules = rules.select("rule_ord", "category", "name", "file_exts", "vuln_patterns", "severity", "confidence", "cwe", "vuln_desc")
    patterns = stage(compiled(rules), "rule-patterns")
    bundles, members = bundled(rules, patterns)
    hits = stage(line_hits(files, patterns, bundles), "rule-hits", "zstd")
    tiles = hits.groupBy("bundle").agg(F.count("*").alias("lines")).join(bundles.select("bundle", "rules"), "bundle")
    tiles = stage(tiles.selectExpr("bundle", "lines", "rules", f"ceil(lines / {SIDE}) AS tall", f"ceil(rules / {SIDE}) AS wide"), "rule-tiles")
    made = tiles.agg(F.sum(F.col("lines") * F.col("rules").cast("double"))).first()[0] or 0
    # a number given here holds, while small partitions would be put together whatever they make
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(made // _FINDINGS))
    tiles, tile = tiles.drop("lines", "rules"), ("bundle", "row", "col")
    left = hits.join(tiles, "bundle").withColumn("row", F.expr("pmod(line_id, tall)")).withColumn("col", F.expr("explode(sequence(0L, wide - 1))"))
    right = members.join(tiles, "bundle").withColumn("col", F.expr("pmod(number, wide)")).withColumn("row", F.expr("explode(sequence(0L, tall - 1))"))
    left = left.select(*tile, "path", "line", "snippet").repartition(tasks, *tile)
    right = right.drop("tall", "wide", "number").repartition(tasks, *tile)
    return left.join(right, list(tile)).select(
        F.concat(F.lit("AS-"), "category", F.lit("-"), F.col("line").cast("string")).alias("finding_id"), "cwe", "category", "name",
        F.col("path").alias("file"), "line", "snippet",
        F.lit("VULNERABLE").alias("status"), "severity", "confidence", F.col("vuln_desc").alias("description"), "rule_ord",
    )
