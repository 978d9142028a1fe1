"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.functions.scratch import fresh_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Setting of Spark: remove a query's shuffle files when it ends, not when the driver's heap is next collected.
_CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files; for rows that are written, and read from there afterwards."""
    before = spark.conf.get(_CLEAR, None)
    spark.conf.set(_CLEAR, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAR)
        else:
            spark.conf.set(_CLEAR, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back. The shuffles that made them leave no files."""
    target = fresh_path(df.sparkSession, name)
    with shuffles_cleared(df.sparkSession):
        df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def staged_by(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like `staged`, bucketed by a column, so that grouping or joining by it shuffles the other side only.

    The folder is an external table of the session's catalogue: dropping the table leaves the files.
    """
    spark, target = df.sparkSession, fresh_path(df.sparkSession, name)
    table_name = f"{name}_{target.rsplit('-', 1)[1]}"
    with shuffles_cleared(spark):
        df.write.format("parquet").bucketBy(buckets, column).option("path", target).saveAsTable(table_name)
    return spark.table(table_name)


# ---------------------------------------------------------------------------------------------
# Memory of Python workers


def give_back() -> None:
    """Hand memory that is free in this process back to the system: a worker waits for its next task with what it last had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it keeps or returns memory by itself
        pass


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, which leaves its worker without the memory that it freed."""

    @wraps(work)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return task


# ---------------------------------------------------------------------------------------------
# Byte-wise words of Arrow text columns, without one Python object per word


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n + 1 places where they start; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0]: starts[-1]], starts - starts[0]


_RANDOM = np.random.default_rng(20240607)
_BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a batch of texts: arrays over all words, in order.

    `start` and `end` are places in `data`, `row` is the text's number, `hash` a 64-bit hash of the bytes.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, inside: np.ndarray, folded: np.ndarray, cut: np.ndarray | None = None) -> None:
        """`inside`: for each byte of `data`, whether it belongs to a word; `folded`: the bytes to hash; `cut`: whether a new word begins."""
        first = inside.copy()
        first[1:] &= ~inside[:-1] if cut is None else ~inside[:-1] | cut[1:]
        heads = starts[:-1][starts[:-1] < starts[1:]]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:] if cut is None else ~inside[1:] | cut[1:]
        tails = starts[1:][starts[:-1] < starts[1:]] - 1
        last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(starts, self.start, side="right") - 1
        self.hash = _hash_runs(folded, inside, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def _hash_runs(folded: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    lengths = end - start
    powers = np.ones(int(lengths.max()), np.uint64)
    if len(powers) > 1:
        powers[1:] = _BASE
        powers = np.multiply.accumulate(powers)
    kept = folded[inside]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    places = np.arange(len(kept)) - np.repeat(offsets[:-1], lengths)
    terms = _BYTE_CODES[kept]
    terms *= powers[places]
    return mix(np.add.reduceat(terms, offsets[:-1]) + lengths.astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def spaced_words(column: pa.Array) -> tuple[Words, int]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z hashed as a-z, and the number of texts."""
    data, starts = text_bytes(column)
    return Words(data, starts, ~SPACES[data], LOWER[data]), len(column)


# ---------------------------------------------------------------------------------------------
# A filter of bounded size that lets all wanted keys pass, and few others

_FILTER_BITS = 24


def _filter_place(key) -> F.Column:
    return F.pmod(F.xxhash64(key, F.lit(71)), F.lit(1 << _FILTER_BITS))


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """Bitmaps of the keys: at most 513 rows of 4 KB (2**24 bits), whatever the number of keys."""
    place = _filter_place(F.col(column)).alias("place")
    return (
        keys.where(F.col(column).isNotNull()).select(place)
        .select(F.expr("bitmap_bucket_number(place)").alias("key_bucket"),
                F.expr("bitmap_bit_position(place)").alias("position"))
        .groupBy("key_bucket").agg(F.expr("bitmap_construct_agg(position)").alias("key_bits"))
    )


def may_have(df: DataFrame, column: str, bitmaps: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose key may be among the keys of `key_filter` (all that are, and few that are not).

    `negate` gives the others: rows whose key is surely none of them; a null key is one of those.
    The forced broadcast is bounded by 2 MB; with more keys than bits all rows pass, and the exact join that follows does the work.
    """
    place = _filter_place(F.col(column))
    columns = df.columns
    with_bits = (
        df.withColumn("key_place", place)
        .withColumn("key_bucket", F.expr("bitmap_bucket_number(key_place)"))
        .join(F.broadcast(bitmaps), "key_bucket", "left")
    )
    byte = "ascii(decode(substring(key_bits, cast(bitmap_bit_position(key_place) div 8 as int) + 1, 1), 'ISO-8859-1'))"
    has = F.expr(f"coalesce(shiftright({byte}, cast(bitmap_bit_position(key_place) % 8 as int)) & 1 = 1, false)")
    has = has & F.col(column).isNotNull()
    return with_bits.where(~has if negate else has).select(*[F.col(f"`{c}`") for c in columns])


#: Leading bits of well mixed keys that `leading_bitmap` tells (8 MB).
LEADING_BITS = 26


def leading_bitmap(keys: DataFrame, column: str = "key") -> np.ndarray:
    """2**LEADING_BITS bits, whatever the number of keys: whether a key with these leading bits is among them."""
    rows = (
        keys.select(F.shiftrightunsigned(column, 64 - LEADING_BITS).alias("place"))
        .groupBy(F.expr("place div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))
        .toArrow()
    )
    out = np.zeros(((1 << LEADING_BITS) // 32768, 4096), np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[bucket, : len(bits)] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def has_leading(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key: whether one with its leading bits is in the bitmap."""
    place = keys >> np.uint64(64 - LEADING_BITS)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------------------------------------
# Components of a graph whose nodes are 64-bit numbers


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that the links reach, for each node with a link.

    Every round joins each node's label with its neighbours' and then follows labels of labels, so that long chains
    need few rounds. State is written to the shared folder every round, and ends when no label changes.
    """
    both = staged(
        edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .union(edges.select(F.col(b), F.col(a)))
        .where("node != other").distinct(), "links",
    )
    labels = staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    none = F.lit(None).cast("long").alias("was")
    while True:
        heard = (
            both.join(labels, both.other == labels.node).select(both.node, "component", none)
            .union(labels.select("component", "component", none))
            .union(labels.select("node", "component", F.col("component").alias("was")))
            # the node a label names hears of smaller labels, too
            .union(both.join(labels, "node").select(F.col("component"), F.col("other"), none))
            .groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        )
        jump = heard.select(F.col("node").alias("component"), F.col("component").alias("further"))
        now = staged(
            heard.join(jump, "component", "left")
            .select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"), "labels",
        )
        labels = now.select("node", "component")
        if now.where("component != was").isEmpty():
            return labels

