"""Secret scans: fixed patterns, and values in credential context by their guess cost.

The base patterns (assign, access, hex) find what looks like a secret by form. The method adds spans of kind ``guess``:
whole values in credential context (``password =``, ``pwd:``, ``passphrase is``) whose cheapest explanation still takes many
guesses. The cost of a value is found by dynamic programming over its segmentations into words (by rank, with the usual
letter substitutions and capitals), dates, repeats, keyboard walks, sequences and brute-force spans: the logarithm of the
guesses, summed over the segments, with a charge for each further segment.

Each text is scanned whole within its row, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hedgerow.llm.common import frugal

# Base patterns of the contract.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ASSIGN_LEAST = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a run that is too short is never part of a longer one
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "guess")

# Credential contexts, those of the base pattern too. A quoted value may hold any character of its line, blanks too; another
# one any visible character up to a quote, comma, semicolon or the next parameter of a URL.
_CONTEXT_WORDS = ("pwd", "pass", "credential", "auth", "bearer", "key", "pin", "secret", "token")
_CONTEXT = re.compile(
    r"(?:password|passwd|secret|token|api[_-]?key|secret[_-]?key|(?<![A-Za-z0-9])(?:pwd|passphrase|passcode|pass|credentials?|auth|bearer"
    r"|(?:private|access|client|encryption)_key|pin))[\"']?(?:\x20*[:=]\x20*|\x20+is\x20+)", re.IGNORECASE | re.ASCII
)
_VALUE = re.compile(
    r"\"((?:[^\"\\\r\n]|\\[^\r\n])+)\"(?![A-Za-z0-9])|'((?:[^'\\\r\n]|\\[^\r\n])+)'(?![A-Za-z0-9])"
    r"|[\"']?((?:[^\s\"',;&]|&(?![A-Za-z0-9_]+=))+)", re.ASCII
)

# Common words of passwords, most common first.
WORDS = (
    "password qwerty dragon monkey letmein football baseball welcome master login shadow sunshine princess admin hello "
    "freedom whatever trust secret summer winter spring autumn flower hunter tiger ginger pepper cookie cheese coffee "
    "soccer hockey killer jordan michael jennifer thomas robert daniel andrew charlie george michelle jessica ashley "
    "love angel baby star rock game play test user root guest default change temp pass word the and you for with this "
    "that from have house music money blue green red black white silver gold orange purple apple banana computer internet "
    "server system access correct horse battery staple dog cat fish bird lion bear wolf eagle falcon phoenix ninja samurai "
    "pirate wizard magic power super happy lucky crazy sweet honey sugar candy lovely friend family mother father sister "
    "brother forever always never today tomorrow january february march april may june july august september october "
    "november december monday friday sunday example sample demo dummy placeholder changeme your none null true false"
).split()
_RANK = {word: rank for rank, word in reversed(list(enumerate(WORDS, 2)))}
_LONGEST = max(map(len, WORDS))
_SUBSTITUTES = str.maketrans("@4310$57", "aaeiosst")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")

#: Logarithms (base 10) of guesses.
_ANY = math.log10(95)
_PER_SEGMENT = 0.3


def _pool(segment: str) -> int:
    size = 26 * any(c.islower() for c in segment) + 26 * any(c.isupper() for c in segment) + 10 * any(c.isdigit() for c in segment)
    return max(10, size + 33 * any(not c.isalnum() for c in segment))


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


@lru_cache(maxsize=20_000)
def guess_cost(value: str) -> float:
    """Base-10 logarithm of the guesses that the cheapest segmentation takes; 0 for an empty value.

    A walk, repeat or sequence may be of any length; words and dates are as long as the longest in their lists, so the
    work grows with the value's length times those bounds (repeats are looked for with periods up to 8).
    """
    n = len(value)
    if n == 0:
        return 0.0
    lower = value.lower()
    plain = lower.translate(_SUBSTITUTES) if len(lower) == n else value.translate(_SUBSTITUTES)
    lower = lower if len(lower) == n else value
    brute = math.log10(_pool(value))
    best = [0.0] + [math.inf] * n
    # where the walk and the sequence that end at each place begin
    walk = [0] * n
    series = [0] * n
    for i in range(1, n):
        walk[i] = walk[i - 1] if _near(lower[i - 1], lower[i]) else i
        step = ord(value[i]) - ord(value[i - 1])
        before = ord(value[i - 1]) - ord(value[i - 2]) if i - series[i - 1] >= 1 else step
        series[i] = (series[i - 1] if step == before else i - 1) if step in (1, -1) else i
    same = {period: [0] * n for period in range(1, 9)}
    for period, run in same.items():
        for i in range(period, n):
            run[i] = run[i - 1] + 1 if value[i] == value[i - period] else 0
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
            if m.end() - i > 4:
                dates.setdefault(i + 4, []).append(i)
    open_brute = [math.inf] * (n + 1)  # the last segment is brute force that ends here
    for end in range(1, n + 1):
        i = end - 1
        open_brute[end] = brute + min(open_brute[i], best[i] + (_PER_SEGMENT if i else 0))
        cheapest = open_brute[end]

        def offer(start: int, cost: float) -> None:
            nonlocal cheapest
            cheapest = min(cheapest, best[start] + cost + (_PER_SEGMENT if start else 0))

        for size in range(3, min(_LONGEST, end) + 1):
            start = end - size
            rank = _RANK.get(plain[start:end]) or _RANK.get(lower[start:end])
            if rank:
                changed = (plain[start:end] != lower[start:end]) + (lower[start:end] != value[start:end])
                offer(start, math.log10(rank) + 0.5 * changed)
        for start in dates.get(end, ()):
            offer(start, math.log10(150 if end - start == 4 else 55_000))
        if i - walk[i] >= 3:
            for start in {walk[i], max(walk[i], i - 7)}:
                offer(start, math.log10(len(_PLACE) * 6 * (i - start)))
        if i - series[i] >= 2:
            offer(series[i], math.log10(4 * _pool(value[series[i]]) * (end - series[i])))
        for period, run in same.items():
            if run[i] >= max(period, 2):
                start = end - run[i] - period
                offer(start, period * math.log10(_pool(value[start: start + period])) + math.log10((end - start) / period))
        best[end] = cheapest
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, by start and kind."""
    spans = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def guessed_spans(text: str, least_cost: float, least_chars: int, base: Sequence[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """Whole values in credential context that take at least 10 ** least_cost guesses.

    A value that one of the `base` spans holds, to its end or to a last emoji, is a secret already and is not given again.
    """
    lower = text.lower()
    if not any(word in lower for word in _CONTEXT_WORDS):
        return []
    found: list[tuple[int, int, int]] = []
    last = 0
    for context in _CONTEXT.finditer(text):
        if context.end() < last:
            continue  # within the value of the context before, whose cost is not less
        m = _VALUE.match(text, context.end())
        if m is None:
            continue
        start, last = m.span(m.lastindex)
        end = last
        while end > start and text[end - 1] > "\x7f" and not text[end - 1].isalnum():
            end -= 1
        if any(a <= start and end <= b for a, _, b in base):
            continue
        if last - start >= least_chars and guess_cost(text[start:last]) >= least_cost:
            found.append((start, 3, last))
    return found


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False),
    T.StructField("end", T.LongType(), False), T.StructField("cost", T.DoubleType(), True),
]), False)


def find_secrets(docs: DataFrame, text: str = "text", *, least_cost: float = 8.0, least_chars: int = 6) -> DataFrame:
    """The rows with a column `secrets`: an array of (kind, start, end, cost), by start, then kind as in KINDS.

    Places are code points of the whole text, end exclusive. `cost` is the guess cost of an assign or guess value.
    A null or empty text has an empty array; repeated rows are scanned each; a table without rows gives none; other
    columns pass through, whatever their names (a column `secrets` of the input is replaced).
    """
    names = [c for c in docs.columns if c != "secrets"]
    kept = docs.select(*[f"`{c}`" for c in names])
    at = names.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField("secrets", SPANS, False)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(at).to_pylist():
                value = value or ""
                rows = []
                base = base_spans(value)
                for start, kind, end in sorted(base + guessed_spans(value, least_cost, least_chars, base)):
                    cost = None
                    if kind == 0:
                        cost = guess_cost(_ASSIGN.match(value, start)[2])
                    elif kind == 3:
                        cost = guess_cost(value[start:end])
                    rows.append({"kind": KINDS[kind], "start": start, "end": end, "cost": cost})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*names, "secrets"])

    return kept.mapInArrow(frugal(scan), schema)


def redact(docs: DataFrame, text: str = "text", *, mark: str = "[SECRET]", **options) -> DataFrame:
    """The rows with every secret of `find_secrets` replaced by `mark`; spans that touch or overlap are one secret.

    A text without secrets stays as it is, null included. `n_chars`, where the table has it, follows the new text.
    """
    names = docs.columns
    found = find_secrets(docs, text, **options)
    at = names.index(text)
    length_at = names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema
    length_type = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(schema["n_chars"].dataType) if length_at is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            columns = batch.columns[: len(names)]
            if any(spans):
                texts = columns[at].to_pylist()
                sizes = columns[length_at].to_pylist() if length_type else []
                for row, own in enumerate(spans):
                    if own:
                        texts[row] = _marked(texts[row], own, mark)
                        if length_type:
                            sizes[row] = len(texts[row])
                columns[at] = pa.array(texts, columns[at].type)
                if length_type:
                    columns[length_at] = pa.array(sizes, length_type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(frugal(cut), schema)


def _marked(text: str, spans: list[dict], mark: str) -> str:
    joined: list[list[int]] = []
    for span in spans:
        if joined and span["start"] <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], span["end"])
        else:
            joined.append([span["start"], span["end"]])
    parts, at = [], 0
    for start, end in joined:
        parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])
