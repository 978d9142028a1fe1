"""Regular expressions as cheap literal tests first and a regex only where one is needed.

A pattern such as ``eval\\s*\\(`` can only match a line that holds ``eval`` and ``(``. These literal
runs are tested on the case-folded line with `contains`, a plain byte scan,
and the regex runs on the few lines that pass. A pattern that is nothing but literal text needs no
regex at all. Both give the same rows as the bare regex.

Conditions are built as SQL text: a rule list becomes one parsed expression rather than thousands
of calls between Python and the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hedgerow.functions.dialect import NoCounterpart, to_java
from hedgerow.functions.text import fold_sql, sql_text

try:
    from re import _parser as _regex_tree
except ImportError:  # before Python 3.11
    import sre_parse as _regex_tree

def java_pattern(pattern: str) -> str:
    """The pattern in Java's dialect, without regard to case."""
    return to_java(pattern)


def _walk(nodes, runs: list[str]) -> bool:
    """Collect the literal runs every match holds; true if the nodes are literal text only."""
    pure, run = True, ""
    for op, value in nodes:
        if str(op) == "LITERAL":
            run += chr(value)
            continue
        pure = False
        if run:
            runs.append(run)
        run = ""
        if str(op) == "SUBPATTERN":
            _walk(value[-1], runs)
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            _walk(value[2], runs)
    if run:
        runs.append(run)
    return pure


def literal_runs(pattern: str) -> tuple[tuple[str, ...], bool]:
    """Lower-case ASCII texts that every match must hold, longest first, and whether that is all.

    The flag is true when the pattern is one literal text, so `contains` alone decides.
    """
    found: list[str] = []
    pure = _walk(_regex_tree.parse(pattern), found)
    runs = sorted({r.lower() for r in found if r.isascii()}, key=lambda r: (-len(r), r))
    kept: list[str] = []
    for run in runs:
        if not any(run in longer for longer in kept):
            kept.append(run)
    return tuple(kept), pure and len(kept) == 1


def _sequence(nodes, state) -> list[tuple[str, int, int]]:
    """The nodes in order as (character, 1, 1), or as ("", least, most) for what is no ASCII literal."""
    out: list[tuple[str, int, int]] = []
    for op, value in nodes:
        if str(op) == "LITERAL" and value < 128:
            out.append((chr(value).lower(), 1, 1))
        elif str(op) == "SUBPATTERN":
            out += _sequence(value[-1], state)
        else:
            low, high = _regex_tree.SubPattern(state, [(op, value)]).getwidth()
            out.append(("", int(low), int(high)))
    return out


def piece_chains(pattern: str, size: int, apart: int) -> tuple[tuple[str, ...], ...]:
    """Chains of lower-case ASCII texts of `size` characters that every match holds one after the other.

    The next text of a chain begins within the one before, or at most `apart` characters after its end.
    """
    tree = _regex_tree.parse(pattern)
    runs, gaps = [""], [apart + 1]  # the gap before each run
    for character, low, high in _sequence(tree, tree.state):
        if character:
            runs[-1] += character
        elif high and runs[-1]:
            runs.append("")
            gaps.append(high)
        elif high:
            gaps[-1] += high
    chains: list[tuple[str, ...]] = []
    gap = 0
    for run, before in zip(runs, gaps):
        gap += before
        if len(run) < size:
            gap += len(run)
            continue
        chain = pieces_of(run, size)
        if gap <= apart:
            chains[-1] += chain
        else:
            chains.append(chain)
        gap = 0
    return tuple(chains)


def pieces_of(run: str, size: int) -> tuple[str, ...]:
    """Texts of `size` characters from a run's begin to its end; only the last may lie apart from or over the one before."""
    places = {*range(0, max(len(run) - 2 * size + 1, 1), size), len(run) - size}
    return tuple(run[i: i + size] for i in sorted(places))


def _trie_regex(words) -> str:
    """One regex for many words, sharing their common beginnings."""
    if "" in words:
        return ""
    tails: dict[str, list[str]] = {}
    for word in sorted(words):
        tails.setdefault(word[0], []).append(word[1:])
    branches = [
        re.escape(head) + (re.escape(rest[0]) if len(rest) == 1 else _trie_regex(rest))
        for head, rest in tails.items()
    ]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def _shortest(words) -> set[str]:
    """Words that hold no other of the words."""
    return {w for w in words if not any(other != w and other in w for other in words)}


def _has_any(folded: str, words) -> list[str]:
    """Conditions, any of which holds when one of the words is in the text."""
    words = _shortest(set(words))
    if len(words) > 3:
        return [f"{folded} RLIKE {sql_text(_trie_regex(words))}"]
    return [f"contains({folded}, {sql_text(word)})" for word in sorted(words)]


# Characters that running text rarely holds, rarest first.
_RARE = "`$@*+{}[]<>=\\_:()/\"-"


def _longest_runs(patterns) -> set[str] | None:
    """The longest literal run of each pattern; None if a pattern has none."""
    words = set()
    for pattern in dict.fromkeys(patterns):
        runs = literal_runs(pattern)[0]
        if not runs:
            return None
        words.add(runs[0])
    return words


def quick_match_sql(folded: str, patterns) -> str:
    """SQL condition on folded text, cheap on running text, that holds whenever any of the patterns
    could match.

    Most patterns need a character that prose does not have, and one class finds any of those; the
    others are looked for by their longest literal run.
    """
    if _longest_runs(patterns) is None:
        return "true"
    rare, plain = set(), set()
    for pattern in dict.fromkeys(patterns):
        runs = literal_runs(pattern)[0]
        held = [c for c in _RARE if any(c in run for run in runs)]
        rare.update(held[:1])
        if not held:
            plain.add(runs[0])
    tests = [f"contains({folded}, {sql_text(word)})" for word in sorted(_shortest(plain))]
    if rare:
        kind = "[" + "".join(re.escape(c) for c in _RARE if c in rare) + "]"
        tests.insert(0, f"{folded} RLIKE {sql_text(kind)}")
    return f"({' OR '.join(tests or ['false'])})"


def can_match_sql(folded: str, patterns) -> str:
    """SQL condition on the folded text that holds whenever any of the patterns could match.

    The quick test first, then one regex over the longest literal run of every pattern.
    """
    words = _longest_runs(patterns)
    if words is None:
        return "true"
    if not words:
        return "false"
    return f"({quick_match_sql(folded, patterns)} AND ({' OR '.join(_has_any(folded, words))}))"


def whole_match_sql(folded: str, patterns) -> str:
    """SQL condition on a whole folded text, cheap, that holds whenever any of the patterns could match a line of it.

    Few words are looked for as they are: a text may hold a telling character on any line, and then all lines are tested.
    """
    words = _longest_runs(patterns)
    if words and len(_shortest(words)) <= 3:
        return can_match_sql(folded, patterns)
    return quick_match_sql(folded, patterns)


def matches_sql(text: str, folded: str, pattern: str) -> str:
    """SQL condition: the pattern is found anywhere in the text, without regard to case."""
    runs, literal = literal_runs(pattern)
    tests = [f"contains({folded}, {sql_text(run)})" for run in runs]
    if not literal:
        tests.append(f"{text} RLIKE {sql_text(java_pattern(pattern))}")
    return "(" + " AND ".join(tests) + ")"


def any_matches_sql(text: str, folded: str, patterns) -> str:
    """SQL condition: any of the patterns is found. Literal patterns share one test."""
    patterns = list(dict.fromkeys(patterns))
    literal = [literal_runs(p)[0][0] for p in patterns if literal_runs(p)[1]]
    rest = [p for p in patterns if not literal_runs(p)[1]]
    tests = _has_any(folded, literal) if literal else []
    tests += [matches_sql(text, folded, p) for p in rest]
    return "(" + " OR ".join(tests or ["false"]) + ")"


def first_label_sql(text: str, folded: str, labelled) -> str:
    """SQL value: label of the first pattern that matches, in order; null if none does."""
    cases = " ".join(
        f"WHEN {matches_sql(text, folded, p)} THEN {sql_text(label)}" for p, label in labelled
    )
    return f"CASE {cases} END"


def any_matches(text: str, patterns) -> Column:
    """Whether any of the patterns is found in the text, given as a column name or SQL."""
    bound = f"array(named_struct('t', {text}, 'f', {fold_sql(text)}))"
    return F.expr(f"exists({bound}, p -> {any_matches_sql('p.t', 'p.f', patterns)})")


def check_patterns(spark: SparkSession, patterns) -> dict[str, str]:
    """Patterns that do not compile, with the reason. Small input: run when rules are loaded."""
    rejected: dict[str, str] = {}
    valid = []
    for pattern in dict.fromkeys(patterns):
        try:
            re.compile(pattern)
            to_java(pattern)
            valid.append(pattern)
        except (re.error, NoCounterpart) as error:
            rejected[pattern] = str(error)

    def compiles(batch) -> bool:
        probe = spark.range(1).select(F.concat(F.lit(""), F.col("id").cast("string")).alias("s"))
        try:
            probe.select(*(F.col("s").rlike(java_pattern(p)) for p in batch)).collect()
            return True
        except Exception:
            return False

    if valid and not compiles(valid):
        for pattern in valid:
            if not compiles([pattern]):
                rejected[pattern] = "not accepted by the Java regex engine"
    return rejected
