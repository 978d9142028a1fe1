"""Document fingerprints: 64-bit SimHash, and search within a Hamming radius by permuted block tables.

A term is a pair of neighbouring words (the last word alone too), in lower case; it votes on each of the 64 bits of its
hash with its weight, the pair's length up to `HEAVIEST`, once for each time it occurs. Votes are sums of a hash aggregate
in generated code: a long holds the votes of two bits, 32 of each, so 32 sums count all bits. Everything is DataFrame work.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest weight of a term. Sums stay exact up to 2 ** 31 / HEAVIEST terms in a text.
HEAVIEST = 12
BITS = 64
_LANES = 0x0000000100000001
_LEAST = -(2**63)


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64 if bit == 63 else 0)


def _terms(text: Column) -> Column:
    """Array of (w1, w2); w2 is null for the last word. A text without words has one empty term."""
    words = F.split(F.trim(F.lower(text)), r"[\x20\x09-\x0D]+")
    return F.arrays_zip(words.alias("w1"), F.slice(words, F.lit(2), F.size(words)).alias("w2"))


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fingerprint): the SimHash of each group of rows, as a long. Keys should be numbers."""
    terms = (
        rows.select(*keys, F.inline(_terms(F.col(text))).alias("w1", "w2"))
        .select(*keys, F.xxhash64("w1", "w2").alias("h"),
                F.least(F.length("w1") + F.coalesce(F.length("w2"), F.lit(0)), F.lit(HEAVIEST)).cast("long").alias("weight"))
    )
    sums = [
        F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"v{k}") for k in range(32)
    ]
    counted = terms.groupBy(*keys).agg(*sums, F.sum("weight").alias("total"))
    bits = []
    for k in range(32):
        low = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"v{k}", 32)
        for bit, lane in ((k, low), (k + 32, high)):
            bits.append(F.when(lane * 2 > F.col("total"), F.lit(_signed(bit))).otherwise(F.lit(0)))
    fingerprint = bits[0]
    for bit in bits[1:]:
        fingerprint = fingerprint.bitwiseOR(bit)
    return counted.select(*keys, fingerprint.alias("fingerprint"))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits: 1 for equal fingerprints, about 0.5 for unrelated texts."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows (bucket, place, ghost, doc_id, body, next_body) where next is the next document in ascending order of the key.

    The key's range is cut into buckets at its quantiles, so that a bucket is sorted by one task; the first row of each
    bucket is also put at the end of the bucket before as a ghost (and the very first at the end of the last one), so
    that every row finds its next one in its own bucket, whose rows a window reads in order. Ghosts are rows with
    `ghost` = 1 and no next. Null keys come first, rows of one key go by text, a null text is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("body")
    )
    count = buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = max(1, (count - 1).bit_length())
    shares = [i / count for i in range(1, count)]
    found = rows.agg(F.percentile_approx("k", shares, 20 * count).alias("b")).first()["b"] if shares else []
    bounds = sorted(set(found or []))
    array = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else None

    def bucket_of(k: Column) -> Column:
        if array is None:
            return F.lit(0)
        return F.aggregate(
            F.array(*[F.lit(1 << s) for s in reversed(range(steps))]), F.lit(0),
            lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) < k), at + step).otherwise(at),
        )

    placed = rows.select(bucket_of(F.col("k")).alias("bucket"), F.lit(0).alias("ghost"), "k", "body")
    # one row a bucket: bounded by the number of buckets
    starts = rows.select(bucket_of(F.col("k")).alias("bucket"), "k").groupBy("bucket").agg(F.min("k").alias("k"))
    order = Window.orderBy("bucket")
    before = starts.select("k", F.lag("bucket").over(order).alias("bucket"), F.max("bucket").over(Window.partitionBy()).alias("end"))
    before = before.select("k", F.coalesce("bucket", "end").alias("bucket"))
    ghosts = (
        rows.join(F.broadcast(before), "k").groupBy("bucket", "k").agg(F.min("body").alias("body"))
        .select("bucket", F.lit(1).alias("ghost"), "k", "body")
    )
    within = Window.partitionBy("bucket").orderBy("ghost", "k", "body")
    return placed.union(ghosts).select(
        "bucket", F.row_number().over(within).alias("place"), "ghost", "k", "body", F.lead("body").over(within).alias("next_body")
    )


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text; one row for each row, repeated ones too.

    (doc_id, n_chars, edited_sha256, f, edited_f, next_f) with fingerprints as longs. The edited text has its last
    floor(n / 2) code points replaced by the first as many of the next document's (see `with_next`). Whole texts move in
    one shuffle, by bucket; votes and the next fingerprint stay in the bucket's partition.
    """
    rows = with_next(docs, key, text, buckets)
    size = F.length("body").cast("long")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(
        F.substr("body", F.lit(1), size.cast("int") - half), F.substr(F.coalesce("next_body", F.lit("")), F.lit(1), half)
    )
    sha = F.sha2(F.encode("edited", "UTF-8"), 256)
    parts = [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]
    keys = ["bucket", "place", "ghost", "k", "n_chars", "s0", "s1", "s2", "s3"]
    texts = (
        rows.select("bucket", "place", "ghost", "k", size.alias("n_chars"), "body", edited.alias("edited"))
        .select(*keys[:5], *parts, "body", "edited")
        .select(*keys, F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("body").alias("t")),
                                        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))))
        .where("ghost = 0 OR kind = 0")
    )
    both = (
        votes(texts, [*keys, "kind"], "t").groupBy(*keys)
        .agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("f"),
             F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_f"))
    )
    following = F.lead("f").over(Window.partitionBy("bucket").orderBy("place"))
    sha_again = F.lower(F.concat(*[F.lpad(F.hex(f"s{i}"), 16, "0") for i in range(4)]))
    return (
        both.withColumn("next_f", following).where("ghost = 0")
        .select(F.when(F.col("k") != _LEAST, F.col("k")).alias("doc_id"), "n_chars", sha_again.alias("edited_sha256"),
                "f", "edited_f", "next_f")
    )


def block_keys(fingerprint: Column, radius: int, blocks: int) -> Column:
    """Array of one key for each permuted table.

    The bits are cut into `blocks` blocks; two fingerprints within the radius agree in at least blocks - radius of them,
    so each choice of that many blocks is a table whose key is those blocks' bits, moved to the front.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("table"), fingerprint.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def within_radius(queries: DataFrame, rows: DataFrame, radius: int = 3, blocks: int = 5, fingerprint: str = "f") -> DataFrame:
    """(query, found): all pairs of different values of `queries` and of `rows` that differ in at most `radius` bits.

    Equal fingerprints are one value on either side, so a group of copies is one row in the tables; pairs of values are
    verified and made distinct. Null fingerprints are found by nothing. `blocks` > `radius`.
    """
    q = queries.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("query")).distinct()
    r = rows.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("found")).distinct()
    q = q.select("query", F.inline(block_keys(F.col("query"), radius, blocks)))
    r = r.select("found", F.inline(block_keys(F.col("found"), radius, blocks)))
    close = F.bit_count(F.col("query").bitwiseXOR(F.col("found"))) <= radius
    return q.join(r, ["table", "bits"]).where(close).select("query", "found").distinct()
