"""N-gram Jaccard join by universe partitions and the pigeonhole principle.

A text is the set of its word shingles (as 64-bit hashes). Two sets of Jaccard similarity >= NUM / DEN whose smaller one has
a elements differ in at most a * (DEN - NUM) / NUM elements. Sizes are cut into bands; a band whose largest set allows H
differences cuts the universe of shingles into H + 1 segments by hash, so two similar sets agree exactly in at least one
segment: its elements' hashes, summed, are the segment's signature. A set is indexed in its own band and, for partners
smaller than itself, in the band below. Signatures are complete: no pair is missed and none is dropped.

Cost-based allocation. A signature that more than HOT sets share (an empty segment, a common passage) costs too much for
what it tells. A set with h hot segments of m does without them if h <= c, an eighth of m: sets that agree in z <= h hot
segments only, and differ in at most m - 1 elements, differ by one element in one of any z other segments; so it indexes the
one-deletion neighbourhoods of its first 2 h segments instead, in which two sets that differ by one element meet. Sets that
are hot in more than c segments (large groups of near copies) keep all signatures, in which they meet each other; with a set
that does without them they agree in z <= c hot segments, so the deletions of their first 2 c segments are enough. A deletion
becomes a row only if a bitmap of bounded size, of the exact signatures that deletions are to meet, lets it through.

Verification is exact: first the number of equal segments, which bounds the difference, then the sets themselves. What is wanted are components, so sets that are already connected need no comparison:
first each set is compared with its most promising pivot (smallest set of a shared signature), then with all its pivots,
smallest and largest, and last all remaining pairs of one signature whose components differ are compared. A group of
thousands of near copies costs a few comparisons a set, not a pair each. A pair becomes a row only if the sets'
sketches allow a link: a sketch is the parities of the numbers of a set's elements by bit, so two sets that differ in d
elements differ in at most d bits. This loses no link, and sets that share a signature by chance differ in many more.

A sketch of bounded size tells nothing of large sets, so a band's m segments lie in blocks of at most BLOCK, and a sketch is
of a block's elements. Sets that differ in d < m elements differ, in some block of p segments, in at most d * p / m < p of
them, and so agree exactly in one of its segments: a pair that links meets in a signature whose block's sketches allow it.
All of the above, hot segments and deletions too, holds within that block, with p for m.

Equal texts are one set. Sets are made in array operations over an Arrow batch's bytes, from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.llm import common
from hedgerow.llm.common import staged

#: More sets than this in one signature make it hot.
HOT = 64
_STEPS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------------------------------------
# Sets


class Sets:
    """Shingle sets of a batch: `hashes` of all sets, each sorted, where set k lies at `starts[k]` to `starts[k + 1]`."""

    def __init__(self, texts: pa.Array, width: int) -> None:
        words, n = common.spaced_words(texts)
        counts = np.bincount(words.row, minlength=n) if len(words) else np.zeros(n, np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        total = len(words) - width + 1
        row = np.zeros(0, np.int64)
        value = np.zeros(0, np.uint64)
        if total > 0:
            mixed = np.zeros(total, np.uint64)
            for k in range(width):
                mixed += words.hash[k: k + total] * _STEPS[k]
            inside = words.row[:total] == words.row[width - 1:]
            row, value = words.row[:total][inside], common.mix(mixed[inside])
        short = np.flatnonzero((counts > 0) & (counts < width))  # the whole sequence is the one shingle
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                has = counts[short] > k
                extra[has] += words.hash[first[short[has]] + k] * _STEPS[width + k]
            extra = common.mix(extra + counts[short].astype(np.uint64))
            row, value = np.concatenate((row, short)), np.concatenate((value, extra))
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        self.row, self.hashes = row[new], value[new]
        self.sizes = np.bincount(self.row, minlength=n) if len(self.row) else np.zeros(n, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def sketches(self) -> pa.Array:
        """SKETCH numbers for each set: bit k is whether an odd number of its elements fall on k."""
        return _lists(_sketches(self.row, self.hashes, len(self.sizes)))


def _sketches(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """A row of SKETCH numbers for each of n owners of elements."""
    bits = 64 * SKETCH
    place = (common.mix(hashes + np.uint64(0x632BE59BD9B4E019)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(owner * bits + place, minlength=n * bits) % 2 if len(place) else np.zeros(n * bits, np.int64)
    return np.packbits(odd.astype(bool)).view(np.int64).reshape(n, SKETCH)


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


@cache
def bands(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the bands up to one that holds `largest`, and the number of segments of each.

    A set's partners that are not smaller lie in its own band or the next. A band of one segment holds sets that are
    similar to equal ones only.
    """
    low, segments = [], []
    at = 1
    largest = 1 << largest.bit_length()  # few different answers to keep
    while at <= largest:
        high = max(at, at * den // num)
        low.append(at)
        segments.append(high * (den - num) // num + 1)
        at = high + 1
    return np.array(low, np.int64), np.array(segments, np.int64)


def _segment_sums(value: np.ndarray, owner: np.ndarray, segment: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (owner, segment), empty ones too: the sum of its elements, with the place of each element's segment.

    Owners are numbered from 0 and have `many[owner]` segments. Gives sums, the owner of each sum, the slot of each element.
    """
    base = np.concatenate(([0], np.cumsum(many)))
    slot = base[owner] + segment
    sums = np.zeros(base[-1], np.uint64)
    if len(slot):
        order = np.argsort(slot, kind="stable")
        ordered = slot[order]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        sums[ordered[heads]] = np.add.reduceat(value[order], heads)
    return sums, np.repeat(np.arange(len(many)), many), slot


class Segments:
    """Segment signatures of a batch of sets in one band each."""

    def __init__(self, sets: Sets, chosen: np.ndarray, band: np.ndarray, many: np.ndarray) -> None:
        """`chosen`: numbers of the sets; `band` and `many` for each of them: its band and that band's segments."""
        size = sets.sizes[chosen]
        owner = np.repeat(np.arange(len(chosen)), size)
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        places = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(sets.starts[chosen], size)
        element = sets.hashes[places]
        segment = (common.mix(element ^ np.uint64(0x5851F42D4C957F2D)) % np.repeat(many, size).astype(np.uint64)).astype(np.int64)
        self.element = common.mix(element + np.uint64(0x14057B7EF767814F))
        self.sums, self.owner, self.slot = _segment_sums(self.element, owner, segment, many)
        base = np.concatenate(([0], np.cumsum(many)))[:-1]
        self.number = np.arange(len(self.sums)) - np.repeat(base, many)
        self.seed = common.mix((np.repeat(band, many).astype(np.uint64) << np.uint64(32)) + self.number.astype(np.uint64))
        # blocks of each owner's segments, numbered over all owners
        blocks = -(-many // BLOCK)
        of, count = np.repeat(many, many), np.repeat(blocks, many)
        self.block = self.number * count // of
        self.rank = self.number - -(-self.block * of // count)  # place in the block
        self.flat = np.repeat(np.concatenate(([0], np.cumsum(blocks)))[:-1], many) + self.block
        self.block_owner = np.repeat(np.arange(len(chosen)), blocks)
        self.block_number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.part = np.bincount(self.flat, minlength=blocks.sum())
        self._hashes = element

    def sketches(self) -> np.ndarray:
        """The sketch of each block's elements."""
        return _sketches(self.flat[self.slot], self._hashes, len(self.part))

    def exact(self) -> np.ndarray:
        return common.mix(self.sums ^ self.seed).view(np.int64)

    def deletions(self) -> np.ndarray:
        """For each element: its segment's signature without it."""
        return common.mix((self.sums[self.slot] - self.element) ^ self.seed[self.slot]).view(np.int64)


def _pick(sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, band, segments, own) of every set in every band it is indexed in; own: as one of the band's own sets."""
    low, segments = bands(num, den, int(sizes.max(initial=1)))
    filled = np.flatnonzero(sizes > 0)
    band = np.searchsorted(low, sizes[filled], side="right") - 1
    below = band - 1
    # partners in the band below have num / den of the size at least
    probes = (below >= 0) & (-(-sizes[filled] * num // den) < low[band])
    chosen = np.concatenate((filled, filled[probes]))
    in_band = np.concatenate((band, below[probes]))
    own = np.concatenate((np.ones(len(filled), bool), np.zeros(probes.sum(), bool)))
    keep = own | (segments[in_band] > 1)  # where equal sets alone are similar, none of another band is
    return chosen[keep], in_band[keep], segments[in_band[keep]], own[keep]


# ---------------------------------------------------------------------------------------------
# Rows of signatures

_SIGNATURES = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("signature", T.LongType()), T.StructField("own", T.BooleanType()),
    T.StructField("block", T.IntegerType()), T.StructField("told", T.ArrayType(T.LongType())),
])
#: 64-bit numbers of a sketch.
SKETCH = 4
#: Segments that one sketch tells of, at most: a fourth of its bits, as sets that share nothing else differ in half of them.
BLOCK = 64
#: Texts that one pass of array operations holds.
_TEXTS = 250


def _signatures(docs: DataFrame, node: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """(node, signature, own, block, told): one row for each segment of each set, and one for each block that has no signature,
    but tells the set's size, the block's segments, its band's segments and the block's sketch.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(begin, _TEXTS)
                nodes = batch.column(0).to_numpy(zero_copy_only=False)
                sets = Sets(batch.column(1), width)
                empty = nodes[sets.sizes == 0]
                n = len(empty)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(empty), pa.array(empty), pa.array(np.ones(n, bool)), pa.array(np.zeros(n, np.int32)),
                     _lists(np.tile([0, 1, 1] + [0] * SKETCH, (n, 1)))],
                    names=_SIGNATURES.names,
                )
                chosen, band, many, own = _pick(sets.sizes, num, den)
                if len(chosen):
                    found = Segments(sets, chosen, band, many)
                    at = found.block_owner
                    told = np.column_stack((sets.sizes[chosen[at]], found.part, many[at], found.sketches()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[chosen[at]]), pa.array(nodes[chosen[at]]), pa.array(own[at]),
                         pa.array(found.block_number.astype(np.int32)), _lists(told)],
                        names=_SIGNATURES.names,
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[chosen[found.owner]]), pa.array(found.exact()), pa.array(own[found.owner]),
                         pa.array(found.block.astype(np.int32)), pa.nulls(len(found.owner), pa.list_(pa.int64()))],
                        names=_SIGNATURES.names,
                    )

    return docs.select(F.col(node), F.col(text)).mapInArrow(common.frugal(work), _SIGNATURES)


_HOT_SIGNATURES = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("signature", T.LongType()), T.StructField("own", T.BooleanType()),
    T.StructField("block", T.IntegerType()), T.StructField("kind", T.IntegerType()),
])
#: Kinds of signatures: exact, for pairs of exact ones; exact, to meet deletions only; deletion.
EXACT, MET, DELETED = 0, 1, 2
_APART = 0x2545F4914F6CDD1D
#: One in so many segments may be hot without being many.
FEW = 8


def _few(part: np.ndarray) -> np.ndarray:
    """c: so many hot segments of a block's `part` are met by deletions; at most half, and none where equal sets alone are similar."""
    return np.maximum(part // FEW, np.minimum(part // 2, 1))


def _deletions(rows: DataFrame, width: int, num: int, den: int, met=None) -> DataFrame:
    """Signatures of sets with hot segments, of each block's first 2 h segments (at most 2 c): exact ones, or, with a broadcast bitmap
    `met` of all of those, the one-deletion neighbourhoods that some exact one may meet.

    `rows`: (node, text, hot_own, hot_below), the numbers of hot segments in the set's own band and in the one below: a map of
    its blocks with some, or one number for every block.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(begin, _TEXTS)
                nodes = batch.column(0).to_numpy(zero_copy_only=False)
                hot = [[v if isinstance(v, int) else dict(v or ()) for v in batch.column(k).to_pylist()] for k in (3, 2)]  # by own
                sets = Sets(batch.column(1), width)
                chosen, band, many, own = _pick(sets.sizes, num, den)
                if not len(chosen):
                    continue
                found = Segments(sets, chosen, band, many)
                of = found.block_owner
                counts = [hot[o][k] for o, k in zip(own[of].astype(int).tolist(), chosen[of].tolist(), strict=True)]
                count = [c if isinstance(c, int) else c.get(b, 0) for c, b in zip(counts, found.block_number.tolist(), strict=True)]
                prefix = 2 * np.minimum(np.array(count, np.int64), _few(found.part))
                first = found.rank < prefix[found.flat]
                if met is None:
                    slot, signature = np.flatnonzero(first), found.exact()[first]
                else:
                    kept = first[found.slot]
                    slot, signature = found.slot[kept], found.deletions()[kept]
                signature = signature ^ np.int64(_APART)
                if met is not None:
                    meets = common.has_leading(met.value, signature.view(np.uint64))
                    slot, signature = slot[meets], signature[meets]
                owner = found.owner[slot]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[chosen[owner]]), pa.array(signature), pa.array(own[owner]), pa.array(found.block[slot].astype(np.int32)),
                     pa.array(np.full(len(owner), MET if met is None else DELETED, np.int32))],
                    names=_HOT_SIGNATURES.names,
                )

    return rows.select("node", "text", "hot_own", "hot_below").mapInArrow(common.frugal(work), _HOT_SIGNATURES)


def _with_sets(rows: DataFrame, text: str, width: int, into: str) -> DataFrame:
    """The rows with the text replaced by its set, as an array of hashes."""
    names = [c for c in rows.columns if c != text]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField(into, T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(begin, _TEXTS)
                sets = Sets(batch.column(len(names)), width)
                lists = pa.ListArray.from_arrays(pa.array(sets.starts.astype(np.int32)), pa.array(sets.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], lists], names=[*names, into])

    return rows.select(*names, text).mapInArrow(common.frugal(work), schema)


# ---------------------------------------------------------------------------------------------
# The join


def _profiles(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(node, size, many, own, every): a set's size, its own band's segments, and its shared signatures."""
    shared = shared.withColumn("size", F.col("told")[0])
    largest = shared.agg(F.max("size")).first()[0] or 1
    low, segments = bands(num, den, int(largest))  # as many as the logarithm of the largest size
    band = F.size(F.filter(F.array(*map(F.lit, low.tolist())), lambda x: x <= F.col("size")))
    return (
        shared.groupBy("node").agg(
            F.max("size").alias("size"), F.collect_set(F.when(F.col("told").isNull() & F.col("own"), F.col("signature"))).alias("own"),
            F.collect_set(F.when(F.col("told").isNull(), F.col("signature"))).alias("every"),
        )
        .where("size(every) > 0").withColumn("many", F.element_at(F.array(*map(F.lit, segments.tolist())), band))
    )


def _promising(pairs: DataFrame, profiles: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and numbers of equal segments allow a link; none that links is lost.

    Two sets that differ in d elements differ in at most d segments, and d is bounded by their sizes.
    """
    def side(name: str) -> DataFrame:
        return profiles.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("size", "many", "own", "every")])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    equal = F.when(F.col("size_a") <= F.col("size_b"), F.size(F.array_intersect("own_a", "every_b"))).otherwise(
        F.size(F.array_intersect("own_b", "every_a")))
    many = F.when(F.col("size_a") <= F.col("size_b"), F.col("many_a")).otherwise(F.col("many_b"))
    near = F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num
    return both.where(near & (equal >= many - _allowed(F.col("size_a"), F.col("size_b"), num, den))).select("a", "b")


def _allowed(a: Column, b: Column, num: int, den: int) -> Column:
    """In how many elements two sets of these sizes may differ and still link."""
    return F.floor((a + b) * (den - num) / F.lit(den + num))


def _verify(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs whose sets are similar; `docs` has (node, text), one row a node."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct()
    near = common.may_have(docs, "node", common.key_filter(nodes, "node"))
    right = _with_sets(near.join(pairs, near.node == pairs.b).select("a", "b", "text"), "text", width, "of_b")
    left = near.join(pairs.select(F.col("a").alias("node")).distinct(), "node").select(F.col("node").alias("a"), "text")
    left = _with_sets(left, "text", width, "of_a")
    common_size = F.size(F.array_intersect("of_a", "of_b"))
    union_size = F.size("of_a") + F.size("of_b") - F.col("common")
    return (
        right.join(left, "a").select("a", "b", "of_a", "of_b", common_size.alias("common"))
        .where(F.col("common").cast("long") * den >= union_size.cast("long") * num).select("a", "b")
    )


#: Columns of a sketch.
_BITS = [f"s{k}" for k in range(SKETCH)]


def _pairs(buckets: DataFrame, pivot: str, num: int, den: int) -> DataFrame:
    """(a, b) of each signature's pivot and the nodes it may link with; buckets: (signature, node, own, kind, size, sketch's columns)
    with the sketched block's segments, `part`, of its band's, `many`; a sketch is the whole set's where they are not told.
    """
    buckets = _parts(buckets)
    told = F.struct("node", "size", *_BITS)
    pick = (F.min if pivot == "min" else F.max)(F.when(F.col("own") & (F.col("kind") != DELETED), told))
    pivots = buckets.groupBy("signature").agg(pick.alias("pivot")).where("pivot IS NOT NULL")
    pivots = pivots.select("signature", *[F.col(f"pivot.{c}").alias(f"{c}_b") for c in ("node", "size", *_BITS)])
    others = buckets.where(F.col("kind") != MET)
    return (
        others.join(pivots, "signature").where("node != node_b").where(_may_link(num, den))
        .select(F.col("node_b").alias("a"), F.col("node").alias("b"))
    )


def _parts(buckets: DataFrame) -> DataFrame:
    return buckets if "part" in buckets.columns else buckets.withColumns({"part": F.lit(1), "many": F.lit(1)})


def _may_link(num: int, den: int, of: str = "{}", other: str = "{}_b") -> Column:
    """Whether the sizes and sketches of two sets, whose columns' names these patterns make, allow a link that meets in this block."""
    size, size_b = F.col(of.format("size")), F.col(other.format("size"))
    near = F.least(size, size_b) * den >= F.greatest(size, size_b) * num
    apart = sum((F.bit_count(F.col(of.format(c)).bitwiseXOR(F.col(other.format(c)))) for c in _BITS), F.lit(0))
    return near & (apart * F.col(of.format("many")) <= _allowed(size, size_b, num, den) * F.col(of.format("part")))


def similar_sets(docs: DataFrame, width: int, num: int, den: int, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, links and components of `docs` (node, text), one row a node: (node, size), (a, b), (node, component).

    Links are verified pairs of similar sets; every similar pair is linked, or connected by links. Nodes without a link
    have no component.
    """
    docs = docs.select("node", "text")
    rows = _signatures(docs, "node", "text", width, num, den)
    counted = rows.withColumn("count", F.count("*").over(Window.partitionBy("signature"))).where("told IS NOT NULL OR count > 1")
    shared = staged(counted, "signatures")
    sizes = shared.where("told IS NOT NULL AND own AND block = 0").select("node", F.col("told")[0].alias("size"))
    buckets = shared.where("told IS NULL")
    sketches = shared.where("told IS NOT NULL").select(
        "node", "own", "block", *[F.col("told")[k].alias(c) for k, c in enumerate(("size", "part", "many", *_BITS))])

    profiles = staged(_profiles(shared, num, den), "profiles")

    # allocation
    hot_segments = buckets.where(F.col("count") > hot).groupBy("node", "own", "block").agg(F.count("*").alias("hot"))
    hot_segments = staged(hot_segments, "hot-segments")
    cool = buckets.where(F.col("count") <= hot).select("signature", "node", "own", "block", F.lit(EXACT).alias("kind"))
    if not hot_segments.isEmpty():
        by_node = hot_segments.groupBy("node").agg(*[
            F.map_from_entries(F.collect_list(F.when(mine, F.struct("block", "hot")))).alias(name)
            for name, mine in (("hot_own", F.col("own")), ("hot_below", ~F.col("own")))])
        near = common.may_have(docs, "node", common.key_filter(hot_segments, "node")).join(by_node, "node")
        exact = staged(_deletions(near, width, num, den), "met")
        met = docs.sparkSession.sparkContext.broadcast(common.leading_bitmap(exact, "signature"))
        extra = exact.union(_deletions(near, width, num, den, met))
        # hot signatures stay with sets that are hot in more than a few of a block's segments
        dense = buckets.where(F.col("count") > hot).join(_dense(hot_segments, sketches), ["node", "own", "block"], "left_semi")
        cool = cool.union(dense.select("signature", "node", "own", "block", F.lit(EXACT).alias("kind"))).union(
            extra.select("signature", "node", "own", "block", "kind"))
    cool = staged(cool, "buckets")
    # a signature tells only where two of its sets may pair: one of the band's own, and not two of a kind that waits;
    # of three exact ones, the smallest and the largest own set leave no pair (a node of two texts is two sets)
    left = 3 if sizes.groupBy("node").agg(F.count("*").alias("texts")).where("texts > 1").isEmpty() else 1
    told = (
        cool.groupBy("signature").agg(F.count_if("own").alias("o"), F.count("*").alias("n"), F.count_if(F.col("kind") == MET).alias("m"),
                                      F.count_if(F.col("kind") == DELETED).alias("d"))
        .where("o > 0 AND n > 1 AND (m + d = 0 OR m * d > 0)").select("signature", F.expr(f"n > {left} OR m + d > 0").alias("more"))
    )
    live = staged(cool.join(told, "signature").distinct().join(sketches, ["node", "own", "block"]).drop("block"), "buckets")

    links = tried = labels = None
    for number in range(3):
        if number == 0:
            times = _pairs(live, "min", num, den).groupBy("a", "b").agg(F.count("*").alias("times"))
            candidates = times.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a"))
        elif number == 1:
            candidates = _pairs(live, "min", num, den).union(_pairs(live, "max", num, den))
        else:
            candidates = _remaining(staged(_open(live.where("more").drop("more"), labels), "open"), num, den)
        candidates = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            candidates = _apart(candidates, labels).join(tried, ["a", "b"], "left_anti")
        candidates = staged(_promising(candidates, profiles, num, den), "candidates")
        tried = candidates if tried is None else tried.union(candidates)
        if candidates.isEmpty():
            continue
        found = staged(_verify(candidates, docs, width, num, den), "links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = common.components(links, "a", "b")
    if links is None:
        links = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return sizes, links, labels


def _remaining(buckets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of all pairs of a signature whose labels differ and that may pair, by their kinds, sizes and sketches."""
    # both sides have the same columns, so that Spark shuffles the rows once
    rows = _parts(buckets).select("signature", "node", "own", "kind", "label", "size", "part", "many", *_BITS)
    return (
        rows.alias("x").join(rows.alias("y"), F.expr("x.signature = y.signature AND x.part = y.part AND x.many = y.many"))
        .where("x.node < y.node AND x.label != y.label AND (x.own OR y.own)")
        .where((F.col("x.kind") + F.col("y.kind")).isin(EXACT + EXACT, MET + DELETED)).where(_may_link(num, den, "x.{}", "y.{}"))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    )


def _dense(hot_segments: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, own, block) where more than a few segments are hot."""
    few = F.greatest(F.floor(F.col("part") / FEW), F.least(F.floor(F.col("part") / 2), F.lit(1)))
    return hot_segments.join(sketches, ["node", "own", "block"]).where(F.col("hot") > few).select("node", "own", "block")


def _labelled(rows: DataFrame, labels: DataFrame | None, node: str, into: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(into, F.col(node))
    names = labels.select(F.col("node").alias(node), F.col("component").alias(into))
    return rows.join(names, node, "left").withColumn(into, F.coalesce(into, node))


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    both = _labelled(_labelled(pairs, labels, "a", "label_a"), labels, "b", "label_b")
    return both.where("label_a != label_b").select("a", "b")


def _open(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Buckets whose nodes are not all connected yet, with the nodes' labels. Sketches are moved with those buckets' rows only."""
    rows = _labelled(live.select("signature", "node"), labels, "node", "label")
    apart = rows.groupBy("signature").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("signature")
    near = common.may_have(live, "signature", common.key_filter(apart, "signature"))
    return _labelled(near, labels, "node", "label")


def components_of(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 5, num: int = 8, den: int = 10, hot: int = HOT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a set holds the distinct shingles of `width` words, or the whole
    sequence where there are fewer; a text without words, empty or null, has none and links nothing (its component is its
    own id). Sets link when den * intersection >= num * union. `component_id` is the smallest doc_id that links reach.

    Rows of one doc_id are one document and share a component; where several of its texts are nobody else's, they all show
    the largest one's n_shingles. A row with a null doc_id names no document: it has its n_shingles, no component, and links nothing. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    keyed = staged(rows.select("doc_id", key.alias("key")), "keys")
    copies = keyed.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    members = staged(keyed.join(copies, "key", "left").select("doc_id", "node", "copies", "key"), "members")

    # one row a text: texts without copies as they are; of others, told by a bitmap, the one whose id names the node
    named = rows.where("doc_id IS NOT NULL")
    multiple = members.where("copies > 1 AND doc_id IS NOT NULL")
    bitmap = common.key_filter(multiple.select("doc_id").distinct(), "doc_id")
    alone = common.may_have(named, "doc_id", bitmap, negate=True)
    maybe = common.may_have(named, "doc_id", bitmap)
    heads = members.where("doc_id = node").select("doc_id", "key").distinct()
    once = (
        maybe.withColumn("key", key).join(heads, ["doc_id", "key"], "left_semi").drop("key")
        .groupBy("doc_id", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).agg(F.first("text").alias("text")).select("doc_id", "text")
    )
    texts = alone.union(once).withColumnRenamed("doc_id", "node")
    sizes, links, labels = similar_sets(texts, width, num, den, hot)

    # rows of one id with different texts belong together
    same_id = members.where("doc_id IS NOT NULL AND doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("key").alias("texts")).where("texts > 1")
    shown = sizes.groupBy("node").agg(F.max("size").alias("size"))
    empty = shown.where("size = 0").select("node")
    tied = same_id.join(empty.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b").join(repeated.withColumnRenamed("doc_id", "a"), "a", "left_semi")
    if not repeated.isEmpty():
        labels = common.components(links.union(tied), "a", "b")
    nameless = _nameless_sizes(rows, key, width)
    placed = members.join(shown, "node", "left").join(labels, "node", "left")
    own = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return (
        placed.where("doc_id IS NOT NULL").select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id")).union(nameless)
    )


def _nameless_sizes(rows: DataFrame, key: Column, width: int) -> DataFrame:
    """Rows without an id: their sets' sizes."""
    sets = _with_sets(rows.where("doc_id IS NULL"), "text", width, "shingles")
    return sets.select("doc_id", F.size("shingles").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document for each component: the one with the smallest id.

    Of repeated rows of that id one stays, the smallest by its columns in order. Rows without an id stay, and so do texts
    without words, which are like nothing. Only rows that a bitmap of copies' ids lets through are shuffled.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = components_of(docs, doc_id, text, **options)
    by_id = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("copy_id")).agg(
        F.count("*").alias("copy_rows"), F.max("component_id").alias("copy_of")
    )
    copies = staged(by_id.where("copy_rows > 1 OR copy_id != copy_of"), "copies")
    bitmap = common.key_filter(copies, "copy_id")
    keyed = docs.select(F.struct(*columns).alias("copy_row"), F.col(doc_id).cast("long").alias("copy_id"))
    sure = common.may_have(keyed, "copy_id", bitmap, negate=True).select("copy_row.*")
    rest = common.may_have(keyed, "copy_id", bitmap).join(copies, "copy_id", "left")
    single = rest.where("copy_rows IS NULL OR (copy_rows = 1 AND copy_id = copy_of)").select("copy_row.*")
    repeated = (
        rest.where("copy_rows > 1 AND copy_id = copy_of").groupBy("copy_id").agg(F.min("copy_row").alias("copy_row")).select("copy_row.*")
    )
    return sure.unionByName(single).unionByName(repeated)
