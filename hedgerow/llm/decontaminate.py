"""Benchmark decontamination by template canonicalisation.

A text becomes a row of canonical tokens: lower-case words, with numbers, units after numbers, and names (capitalised words
that do not begin a sentence; neighbours are one) replaced by typed placeholders. A second view keeps names as words, so
that a passage pasted into the middle of a sentence, or set in capitals, matches too. A third view takes capitalised words
that begin a sentence for names as well, as a name may stand there; its windows need one word less. An item that these views could not find
in an exact copy of itself (too few words or too many placeholders) is looked for as it is, without placeholders. Windows of WINDOW tokens of the
benchmark are hash-joined with those of the documents; what the placeholders stand for is compared along the match: each
value of an item has to go with one value of the document throughout. So a question with other numbers or names is found,
and text that only has the same shape is not.

Documents are tokenised with array operations over an Arrow batch's bytes and filtered by a bitmap of the benchmark's
window hashes (8 MB, whatever the benchmark's size), so only windows that probably match become rows. These are keyed by
the text's digest: copies of a text are one text, and a text's work does not grow with its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.llm import common

#: Tokens of a window; an item of fewer tokens is one window, without placeholders if it has fewer than SHORTEST.
WINDOW, SHORTEST = 8, 5
#: Words (not placeholders) that a window needs to count.
LEAST_WORDS = 5
#: A document is contaminated if this many tokens of an item are covered, or this share of them.
LEAST_TOKENS, LEAST_SHARE = 13, 0.8

#: The views of a text, and the words that a window needs in each.
NAMES, NO_NAMES, OPENINGS, RAW = VIEWS = (0, 1, 2, 3)
LEAST_OF_VIEW = (LEAST_WORDS, LEAST_WORDS, LEAST_WORDS - 1, 0)

UNITS = (
    "mm cm m km inch inches in ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds "
    "oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day "
    "days week weeks month months year years km/h kmh mph percent dollar dollars euro euros cent cents usd eur hz khz mhz w kw v "
    "volts watts j joule joules k celsius fahrenheit degrees"
).split()
_NUMBER, _UNIT, _NAME = (common.mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[10, 13, 33, 46, 58, 63]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


#: Code points of scripts that are written without blanks: each is a word. Then those that belong to no word.
_ALONE = ((0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x19E0), (0x1A20, 0x1AB0), (0x2E80, 0x2FE0), (0x3005, 0x3008),
          (0x3040, 0x3130), (0x31A0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xA9E0, 0xAA00), (0xAA60, 0xAA80), (0xF900, 0xFB00),
          (0xFF66, 0xFFA0))
_APART = ((0x3000, 0x3005), (0x3008, 0x3040), (0xFF00, 0xFF10), (0xFF1A, 0xFF21), (0xFF3B, 0xFF41), (0xFF5B, 0xFF66))


def _blankless(data: np.ndarray, inside: np.ndarray) -> np.ndarray | None:
    """Where words begin or end besides the blanks; takes the punctuation of such scripts out of `inside`."""
    lead = np.flatnonzero(data >= 0xE0)
    if len(lead) == 0:
        return None
    size = np.where(data[lead] >= 0xF0, 4, 3)
    byte = [data[lead + k].astype(np.int64) & 63 for k in (1, 2)]
    code = ((data[lead].astype(np.int64) & 15) << 12) | (byte[0] << 6) | byte[1]
    kinds = [np.zeros(len(lead), bool), np.zeros(len(lead), bool)]
    for kind, ranges in zip(kinds, (_ALONE, _APART), strict=True):
        for begin, end in ranges:
            kind |= (code >= begin) & (code < end)
        kind &= size == 3
    kinds[0] |= (data[lead] == 0xF0) & (byte[0] >= 32)  # ideographs of the further planes
    for k in range(3):
        inside[lead[kinds[1]] + k] = False
    cut = np.zeros(len(data) + 1, bool)
    cut[lead[kinds[0]]] = True
    cut[(lead + size)[kinds[0]]] = True
    return cut[:-1]


@cache
def _unit_hashes() -> np.ndarray:
    return np.sort(_words(pa.array(UNITS))[0].hash)


def _words(texts: pa.Array) -> tuple[common.Words, np.ndarray]:
    data, starts = common.text_bytes(texts)
    inside = _WORD_BYTE[data]
    if len(data) > 2:
        middle = _POINT[data[1:-1]] & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
        inside[1:-1] |= middle
        edges = starts[1:-1]  # a text's last byte and the next one's first do not meet
        for shift in (-1, 0):
            at = edges + shift
            at = at[(at >= 0) & (at < len(data))]
            inside[at] = _WORD_BYTE[data[at]]
    cut = _blankless(data, inside)
    return common.Words(data, starts, inside, common.LOWER[data], cut), data


@dataclass
class Tokens:
    """Canonical tokens of a batch: `code` (hash or placeholder), `row`, and the bytes `start` to `end`."""

    code: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    slot: np.ndarray
    data: np.ndarray


def canonical(texts: pa.Array, view: int) -> Tokens:
    """Tokens of a view: with placeholders for names, without them, with those for capitalised openings too, or with none."""
    words, data = _words(texts)
    code = words.hash.copy()
    n = len(code)
    if n == 0 or view == RAW:
        return Tokens(code, words.row, words.start, words.end, np.zeros(n, bool), data)
    number = _DIGIT[data[words.start]]
    after_number = np.zeros(n, bool)
    after_number[1:] = number[:-1] & (words.row[1:] == words.row[:-1])
    unit = after_number & np.isin(words.hash, _unit_hashes())
    code[number] = _NUMBER
    code[unit] = _UNIT
    slot = number | unit
    keep = np.ones(n, bool)
    end = words.end
    if view in (NAMES, OPENINGS):
        # the last byte before the word that is neither a blank nor a quote
        opening = np.zeros(n, bool)
        opening[0] = True
        opening[1:] = words.row[1:] != words.row[:-1]
        ended = np.concatenate(([0], np.cumsum(_SENTENCE_END[data])))
        opening[1:] |= ended[words.start[1:]] > ended[words.end[:-1]]
        name = _UPPER[data[words.start]] & ~slot
        if view == NAMES:
            name &= ~opening
        code[name] = _NAME
        slot = slot | name
        follows = np.zeros(n, bool)
        follows[1:] = name[1:] & name[:-1] & ~opening[1:]
        keep = ~follows
        # a run of names ends where its last word does
        last_of = np.append(np.flatnonzero(keep)[1:], n) - 1
        end = words.end[last_of]
        return Tokens(code[keep], words.row[keep], words.start[keep], end, slot[keep], data)
    return Tokens(code, words.row, words.start, end, slot, data)


def windows(tokens: Tokens, size: int, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that begins at each token, and whether it is one: within a text, with enough words."""
    n = len(tokens.code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + tokens.code[k: k + n]
    slots = np.concatenate(([0], np.cumsum(tokens.slot)))
    enough = size - (slots[size:] - slots[:-size])[:n] >= LEAST_OF_VIEW[view]
    return common.mix(total + np.uint64(size)), (tokens.row[size - 1:] == tokens.row[:n]) & enough


def _slots(tokens: Tokens, at: int, size: int) -> list[dict]:
    return [
        {"o": k - at, "v": tokens.data[tokens.start[k]: tokens.end[k]].tobytes().decode("utf-8", "replace").lower()}
        for k in range(at, at + size) if tokens.slot[k]
    ]


_SLOTS = T.ArrayType(T.StructType([T.StructField("o", T.IntegerType()), T.StructField("v", T.StringType())]))
_ARROW_SLOTS = pa.list_(pa.struct([("o", pa.int32()), ("v", pa.string())]))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, view, size, hash, place, n_tokens, slots): all windows of the items.

    Items of equal text are one, with the smallest id. Null ids, null texts and texts without a token give no
    windows. An item that no view with placeholders could find in an exact copy has windows of the view RAW.
    """
    items = (
        benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull())
        .groupBy(F.col(text).alias("body")).agg(F.min(item).cast("long").alias("item_id")).select("item_id", "body")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            ids = batch.column(0).to_pylist()
            found = np.zeros(len(ids), bool)  # whether a view with placeholders finds an exact copy
            for view in VIEWS:
                tokens = canonical(batch.column(1), view)
                counts = np.bincount(tokens.row, minlength=len(ids)) if len(tokens.row) else np.zeros(len(ids), int)
                first = np.concatenate(([0], np.cumsum(counts)))
                covered = np.zeros(len(tokens.row), bool)
                for size in range(1 if view == RAW else SHORTEST, WINDOW + 1):
                    hashes, real = windows(tokens, size, view)
                    for at in np.flatnonzero(real):
                        row = int(tokens.row[at])
                        if (size == WINDOW or counts[row] == size) and not (view == RAW and found[row]):
                            covered[at: at + size] = True
                            rows.append({
                                "item_id": ids[row], "view": view, "size": size, "hash": int(hashes[at].astype(np.int64)),
                                "place": int(at - first[row]), "n_tokens": int(counts[row]), "slots": _slots(tokens, int(at), size),
                            })
                held = np.bincount(tokens.row[covered], minlength=len(ids))
                found |= (held >= LEAST_TOKENS) | ((held > 0) & (held >= counts * LEAST_SHARE))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("item_id", pa.int64()), ("view", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("place", pa.int64()),
                ("n_tokens", pa.int64()), ("slots", _ARROW_SLOTS),
            ]))

    return items.mapInArrow(common.frugal(work), T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("view", T.IntegerType()), T.StructField("size", T.IntegerType()),
        T.StructField("hash", T.LongType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("slots", _SLOTS),
    ]))


_BITS = 26


def _bitmap(marks: DataFrame) -> np.ndarray:
    """Bits of the windows' hashes: 2 ** 26 of them, so at most 8 MB come to the driver."""
    place = F.pmod("hash", F.lit(1 << _BITS))
    rows = (
        marks.select(place.alias("p")).select(F.expr("bitmap_bucket_number(p)").alias("b"), F.expr("bitmap_bit_position(p)").alias("i"))
        .groupBy("b").agg(F.expr("bitmap_construct_agg(i)").alias("bits")).collect()
    )
    whole = np.zeros((1 << _BITS) // 8 + 4096, np.uint8)
    for bucket, bits in rows:
        # position 0 is counted by bucket 0, position k * 32768 + 1 by bucket k + 1
        own = np.frombuffer(bytes(bits), np.uint8)
        whole[bucket * 4096: bucket * 4096 + len(own)] = own
    return whole


def _in_bitmap(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    bucket = np.where(place > 0, 1 + (place - 1) // 32768, 0)
    position = np.where(place > 0, (place - 1) % 32768, 0)
    return (whole[bucket * 4096 + position // 8] >> (position % 8).astype(np.uint8)) & 1 == 1


def text_key(text: Column) -> Column:
    """Digest by which texts are told apart; null for a null text."""
    return F.md5(F.encode(text, "UTF-8"))


def _hits(docs: DataFrame, text: str, marks: DataFrame) -> DataFrame:
    """Windows of the documents that may be benchmark windows: (text_key, view, size, hash, place, slots)."""
    sizes = marks.select("view", "size").distinct().orderBy("view", "size").collect()  # at most WINDOW of each view
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(marks))
    schema = pa.schema([("text_key", pa.string()), ("view", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()),
                        ("place", pa.int64()), ("slots", _ARROW_SLOTS)])

    def part_hits(texts: pa.Array, whole: np.ndarray) -> Iterator[dict]:
        keys: dict[int, str] = {}
        for view in sorted({v for v, _ in sizes}):
            tokens = canonical(texts, view)
            for size in (s for v, s in sizes if v == view):
                hashes, real = windows(tokens, size, view)
                real[real] = _in_bitmap(whole, hashes[real])
                once = set()  # a short item as it is: one place in a text tells
                for at in np.flatnonzero(real).tolist():
                    row = int(tokens.row[at])
                    if view == RAW and size < WINDOW:
                        if (row, hashes[at]) in once:
                            continue
                        once.add((row, hashes[at]))
                    if row not in keys:
                        keys[row] = hashlib.md5(texts[row].as_py().encode()).hexdigest()
                    first = int(np.searchsorted(tokens.row, row))
                    yield {"text_key": keys[row], "view": view, "size": size, "hash": int(hashes[at].astype(np.int64)),
                           "place": at - first, "slots": _slots(tokens, at, size)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 250):
                rows = list(part_hits(batch.column(0).slice(begin, 250), shared.value))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col(text)).mapInArrow(common.frugal(work), T.StructType([
        T.StructField("text_key", T.StringType()), T.StructField("view", T.IntegerType()), T.StructField("size", T.IntegerType()),
        T.StructField("hash", T.LongType()), T.StructField("place", T.LongType()), T.StructField("slots", _SLOTS),
    ]))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_key, item_id, covered, n_tokens, n_slots, n_changed): items that a text holds.

    `covered` counts the item's tokens in matching windows whose slots are consistent; only pairs with LEAST_TOKENS of
    them, or LEAST_SHARE of the item, are given, in the view RAW only whole copies of the item. `n_slots` counts different values in the item's covered placeholders,
    `n_changed` those that have another value in the document. A null or empty text holds nothing, copies of a text are
    one, items of one text are one (smallest id), and an empty table on either side gives no rows.
    """
    marks = common.staged(benchmark_windows(benchmark, item, item_text), "benchmark-windows")
    hits = _hits(docs, text, marks).distinct()
    matched = (
        hits.withColumnRenamed("slots", "ours").withColumnRenamed("place", "at")
        .join(marks.withColumnRenamed("slots", "theirs"), ["view", "size", "hash"])
    )
    pairs = F.transform(F.arrays_zip("theirs", "ours"), lambda z: F.struct(z["theirs"]["v"].alias("a"), z["ours"]["v"].alias("b")))
    # one row for each shift of a text against an item: what lies on it belongs together
    runs = (
        matched.groupBy("text_key", "item_id", "n_tokens", "view", (F.col("at") - F.col("place")).alias("shift"))
        .agg(F.collect_set(F.struct("place", "size")).alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    )
    consistent = runs.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))))
    joined = (
        consistent.groupBy("text_key", "item_id", "n_tokens", "view", F.when(F.col("view") == RAW, F.col("shift")).alias("copy"))
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
             F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    )
    covered = F.aggregate(
        "places", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("to")),
        lambda s, p: F.struct(
            (s["sum"] + F.greatest(F.lit(0).cast("long"), p["place"] + p["size"] - F.greatest(s["to"], p["place"]))).alias("sum"),
            F.greatest(s["to"], p["place"] + p["size"]).alias("to"),
        ),
    )["sum"]
    counted = joined.select(
        "text_key", "item_id", "view", covered.alias("covered"), "n_tokens",
        F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))).cast("long").alias("n_slots"),
        F.size(F.array_distinct(F.transform(F.filter("pairs", lambda p: p["a"] != p["b"]), lambda p: p["a"]))).cast("long").alias("n_changed"),
    )
    share = F.when(F.col("view") == RAW, 1.0).otherwise(LEAST_SHARE)
    enough = ((F.col("view") != RAW) & (F.col("covered") >= LEAST_TOKENS)) | (F.col("covered") >= F.col("n_tokens") * share)
    best = counted.where(enough).groupBy("text_key", "item_id").agg(
        F.max(F.struct("covered", "n_tokens", "n_slots", "n_changed")).alias("best")
    )
    return best.select("text_key", "item_id", "best.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, n_tokens, n_slots, n_changed): one row for each document and item it holds.

    Repeated rows of a document are each given; a null id stays null.
    """
    found = common.staged(leaks(docs, benchmark, text), "leaks")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"))
    near = common.may_have(keyed, "text_key", common.key_filter(found, "text_key"))
    return near.join(found, "text_key").drop("text_key")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds no item; null and empty texts stay.

    Only rows that a bitmap of the contaminated texts lets through are shuffled to be told apart exactly.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = common.staged(leaks(docs, benchmark, text).select(F.col("text_key").alias("leak_key")).distinct(), "leaks")
    bitmap = common.key_filter(found, "leak_key")
    keyed = docs.withColumn("leak_key", text_key(F.col(text)))
    sure = common.may_have(keyed, "leak_key", bitmap, negate=True)
    rest = common.may_have(keyed, "leak_key", bitmap).join(found, "leak_key", "left_anti")
    return sure.select(*columns).unionByName(rest.select(*columns))
