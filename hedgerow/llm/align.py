"""Alignment of two tokenizers over the same bytes.

A document is encoded by a byte-level tokenizer (A, with a blank in front) and by a piece tokenizer (B, which puts the blank
there itself). Each side gets a dictionary from the byte offset where tokens end to the index of those tokens. The offsets
that both dictionaries hold, in order, cut both id lists into groups; inside a group's slices, the tokens that end at its last
offset are linked. A dictionary is two columns here (offsets in order, index of the last token that ends there), and the
intersection of the key sets is taken for a chunk of documents at a time, with the document's place added to each offset.

Corpus statistics. `aligned` is staged once: ids of linked tokens lie in it as arrays, so texts are encoded once. A link's
count is looked up in two ways: pairs that more than one in FREQUENT links holds are at most FREQUENT pairs, whatever the
corpus, and are broadcast; the links of all other pairs are added up by document and pair, and joined with the counts.

Both tokenizers work word by word. A's words are those of its pattern, split in Spark. B's are blanks with what follows up to
the next blank: no piece of such a vocabulary has its blank mark after another character, so no merge crosses into the next
word (`read_pieces_side` makes sure). Each distinct word of a block of texts (about BLOCK bytes) is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.bpe import piece_table, read_tokenizer, split_words
from hedgerow.llm.common import frugal, staged

#: Broadcast pairs at most: those with more than total / FREQUENT links (4 MB).
FREQUENT = 1 << 18
#: Bytes of text aligned at a time; a longer text is aligned whole.
CHUNK = 1 << 19
#: Bytes of text whose distinct words are encoded at a time.
BLOCK = 4 << 20

SPACE_MARK = "▁"


@dataclass
class Side:
    """A tokenizer's file and the bytes of each of its ids."""

    model: bytes
    pieces: list[bytes]


def read_bytes_side(path: str) -> Side:
    """Tokenizer file of the byte-level kind; its special strings are ordinary text."""
    parsed = json.loads(read_tokenizer(path))
    pieces = piece_table(json.dumps(parsed))
    parsed["added_tokens"] = []
    return Side(json.dumps(parsed).encode(), pieces)


def read_pieces_side(path: str) -> Side:
    """Model file of the piece kind. Raises if a piece crosses from one word into the next."""
    import sentencepiece

    with open(path, "rb") as file:
        model = file.read()
    machine = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = []
    for number in range(machine.get_piece_size()):
        piece = machine.id_to_piece(number)
        special = machine.is_control(number) or machine.is_unknown(number)
        if not special and SPACE_MARK in piece.lstrip(SPACE_MARK):
            raise ValueError(f"piece {number} holds a blank after another character; words cannot be encoded on their own")
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        pieces.append(bytes([int(byte[1], 16)]) if byte and machine.is_byte(number) else piece.replace(SPACE_MARK, " ").encode())
    if machine.is_unknown(machine.piece_to_id(SPACE_MARK)):
        raise ValueError("a vocabulary without the blank alone")
    return Side(model, pieces)


class _Encoded:
    """Ids of a block of texts given as words; each distinct word of the block is encoded once."""

    def __init__(self, words: pa.Array, many: np.ndarray, encode) -> None:
        """`many`: how many words each text has."""
        encoded = words.dictionary_encode()
        self.number = encoded.indices.to_numpy(zero_copy_only=False)
        self.first = np.concatenate(([0], np.cumsum(many)))
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for begin in range(0, len(encoded.dictionary), 10_000):  # as Python's objects, only that many are held
            part = encode(encoded.dictionary.slice(begin, 10_000).to_pylist())
            sizes.append(np.fromiter(map(len, part), np.int64, len(part)))
            flat.append(np.fromiter(chain.from_iterable(part), np.int32, int(sizes[-1].sum())))
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def ids(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts from `begin` to `end`, one after the other, and how many each text has."""
        words = self.first[begin: end + 1]
        number = self.number[words[0]: words[-1]]
        own = self.size[number]
        upto = np.concatenate(([0], np.cumsum(own)))
        return self.flat[_spread(self.start[number], own)], np.diff(upto[words - words[0]])


def _encoder_a(side: Side):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    machine = Tokenizer.from_str(side.model.decode())
    machine.no_padding()
    machine.no_truncation()
    return lambda words: [code.ids for code in machine.encode_batch_fast(words, add_special_tokens=False)]


def _encoder_b(side: Side):
    import sentencepiece

    machine = sentencepiece.SentencePieceProcessor(model_proto=side.model)
    blank = [machine.piece_to_id(SPACE_MARK)]  # the blank that the machine puts in front, of a word that is nothing else
    return lambda words: [ids or blank for ids in machine.encode([w[1:] for w in words], num_threads=1)]


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    end = np.cumsum(length)
    return np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)


class _Pieces:
    """Bytes of ids."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        shown = [str(n).encode() for n in range(len(pieces))]
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)


def _bytes_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts given as lists of words, the n + 1 places where texts start, and those where words start."""
    words = lists.flatten()
    places = np.frombuffer(words.buffers()[1], np.int32)[words.offset: words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[places[0]: places[-1]]
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    return data, (places - places[0])[ends], places - places[0]


def _blank_words(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each run of blanks, and how many words each has. Every text starts with a blank."""
    head = data == 32
    head[1:] &= data[:-1] != 32
    head[starts[:-1]] = True
    cuts = np.concatenate((np.flatnonzero(head), [len(data)])).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.diff(np.searchsorted(cuts, starts))


def _spelled(ids: np.ndarray, counts: np.ndarray, pieces: _Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, bytes of each text, and for each token where it ends in its text."""
    sizes = pieces.size[ids]
    data = pieces.data[_spread(pieces.start[ids], sizes)]
    ends = np.cumsum(sizes)
    upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
    return data, np.diff(upto), ends - np.repeat(upto[:-1], counts)


def _matches(whole: np.ndarray, starts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text (with its blank in front): whether it is not empty, and the tokens' bytes are the text."""
    lengths = np.diff(starts)
    good = (lengths > 1) & (sizes == lengths)
    begin = np.cumsum(sizes) - sizes
    own = np.flatnonzero(good)
    if len(own):
        same = whole[_spread(starts[own], lengths[own])] == data[_spread(begin[own], lengths[own])]
        good[own] = np.logical_and.reduceat(same, np.cumsum(lengths[own]) - lengths[own])
    return good


def _last_of(ends: np.ndarray) -> np.ndarray:
    """For offsets in order: whether the next one differs."""
    return np.concatenate((ends[1:] != ends[:-1], [True])) if len(ends) else np.zeros(0, bool)


def _align(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray):
    """Groups and links of texts whose tokens (ids, counts, ends) spell the same bytes.

    (rows of groups, end index in A, end index in B of each group, A and B indices of the links).
    """
    place = np.cumsum(sizes + 1) - sizes - 1
    a_at = a[2] + np.repeat(place, a[1])
    b_at = b[2] + np.repeat(place, b[1])
    a_last, b_last = np.flatnonzero(_last_of(a_at)), np.flatnonzero(_last_of(b_at))  # the dictionaries: offset to index
    common, a_key, b_key = np.intersect1d(a_at[a_last], b_at[b_last], assume_unique=True, return_indices=True)
    a_end, b_end = a_last[a_key], b_last[b_key]
    row = np.searchsorted(place, common, side="right") - 1
    # tokens without bytes end where the one before them ends; all that end together are linked
    a_many, b_many = np.diff(a_last, prepend=-1)[a_key], np.diff(b_last, prepend=-1)[b_key]
    pairs = a_many * b_many
    nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    wide = np.repeat(b_many, pairs)
    a_link = np.repeat(a_end - a_many + 1, pairs) + nth // np.maximum(wide, 1)
    b_link = np.repeat(b_end - b_many + 1, pairs) + nth % np.maximum(wide, 1)
    return row, a_end, b_end, np.repeat(row, pairs), a_link, b_link


def _groups(end: np.ndarray, n: int) -> np.ndarray:
    """The group of each of n tokens, from the index of each group's last one."""
    last = np.zeros(n + 1, np.int64)
    last[end + 1] = 1
    return np.cumsum(last)[:n]


def _written(a_ids: np.ndarray, b_ids: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, row: np.ndarray, a: _Pieces, b: _Pieces):
    """Bytes of `a1,a2|b1;a3|b2`, all texts one after the other, and where each group ends. Each group ends with its mark."""
    group_a, group_b = _groups(a_end, len(a_ids)), _groups(b_end, len(b_ids))
    b_before = np.concatenate(([-1], b_end)) + 1  # B tokens of the groups before
    at_a = np.arange(len(a_ids)) + b_before[group_a]
    at_b = np.arange(len(b_ids)) + a_end[group_b] + 1
    total = len(a_ids) + len(b_ids)
    start, size, mark = np.empty(total, np.int64), np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    start[at_a], size[at_a] = a.shown_start[a_ids], a.shown_size[a_ids]
    start[at_b], size[at_b] = b.shown_start[b_ids] + len(a.shown), b.shown_size[b_ids]
    mark[at_a[a_end]], mark[at_b[b_end]] = ord("|"), ord(";")
    end = np.cumsum(size + 1)
    out = np.empty(int(end[-1]) if total else 0, np.uint8)
    digits = np.concatenate((a.shown, b.shown))
    out[_spread(end - size - 1, size)] = digits[_spread(start, size)]
    out[end - 1] = mark
    return out, end[at_b[b_end]]


#: One row for each document: its place in the table, counts, digest, and the ids of its links, in order.
ALIGNED = (
    "place bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "a array<int>, b array<int>"
)
_ALIGNED = ["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"]


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


class _Aligner:
    def __init__(self, a: Side, b: Side) -> None:
        self.encoders = _encoder_a(a), _encoder_b(b)
        self.pieces = _Pieces(a.pieces), _Pieces(b.pieces)

    def align(self, block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Block (place, doc_id, words of A) to ALIGNED, about CHUNK bytes of text at a time."""
        lists = block.column(2)
        words = (lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)), _blank_words(*_bytes_of(lists)[:2])
        encoded = [_Encoded(*words[k], self.encoders[k]) for k in range(2)]
        for begin, end in _parts(block, CHUNK):
            yield self._aligned(block.slice(begin, end - begin), [own.ids(begin, end) for own in encoded])

    def _aligned(self, batch: pa.RecordBatch, sides: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """The batch with each side's ids (of all texts, and how many each has) to ALIGNED."""
        n = batch.num_rows
        whole, starts, _ = _bytes_of(batch.column(2))
        spelled = [_spelled(*sides[k], self.pieces[k]) for k in range(2)]
        good = _matches(whole, starts, *spelled[0][:2]) & _matches(whole, starts, *spelled[1][:2])
        sizes = spelled[0][1][good]
        kept = [np.repeat(good, sides[k][1]) for k in range(2)]
        ids = [sides[k][0][kept[k]] for k in range(2)]
        counts = [np.where(good, sides[k][1], 0) for k in range(2)]
        row, a_end, b_end, link, a_link, b_link = _align(
            *((ids[k], sides[k][1][good], spelled[k][2][kept[k]]) for k in range(2)), sizes
        )
        out, group_end = _written(ids[0], ids[1], a_end, b_end, row, *self.pieces)
        names = np.flatnonzero(good)
        row, link = names[row], names[link]
        groups, links = np.bincount(row, minlength=n), np.bincount(link, minlength=n)
        digests, begin, done = [], 0, 0
        for many in groups.tolist():
            done += many
            end = int(group_end[done - 1]) if many else begin
            digests.append(hashlib.sha256(out[begin: end - 1]).hexdigest() if many else "")
            begin = end
        columns = [
            batch.column(0), batch.column(1), *(pa.array(c.astype(np.int64)) for c in (*counts, groups, links)),
            pa.array(digests, pa.string()), _lists(link, ids[0][a_link], n), _lists(link, ids[1][b_link], n),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_ALIGNED)


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int]]:
    """Runs of the batch's rows, about `size` bytes of text each."""
    done, begin = _bytes_of(batch.column(2))[1][1:].astype(np.int64), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + size, side="right")))
        yield begin, end
        begin = end


def aligned(docs: DataFrame, a: Side, b: Side, text: str = "text") -> DataFrame:
    """ALIGNED, staged: each document's groups and links; one row for each row.

    Null and empty texts, and those that a tokenizer does not give back byte for byte, have no tokens. Rows may share an id.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((a, b))
    led = F.concat(F.lit(" "), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    # A's words hold the whole text, so nothing else of it goes to Python
    rows = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", split_words(led).alias("words"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or _Aligner(*shared.value)
            for begin, end in _parts(batch, BLOCK):
                yield from aligner.align(batch.slice(begin, end - begin))

    return staged(rows.mapInArrow(frugal(work), ALIGNED), "aligned")


#: Links counted at a time.
LINKS = 1 << 17


def _by_links(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows, about LINKS links at a time."""
    done, begin = np.cumsum(batch.column("a").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + LINKS, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in ("a", "b"))
    return (a << 32) | b


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, n, best): links of each pair of ids (code = A's << 32 | B's) in the corpus; best: no pair of that B has more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _by_links(whole)):
            codes, n = np.unique(_codes(batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    counts = rows.select("a", "b").mapInArrow(frugal(work), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    counts = staged(counts.withColumn("own", F.expr("code & 4294967295")), "pairs")
    best = counts.groupBy("own").agg(F.max("n").alias("most"))
    return staged(counts.join(best, "own").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def link_statistics(docs: DataFrame, a: Side, b: Side, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of `docs`.

    `n_best`: links whose pair has the most links of all pairs with its B id (ties count); `count_sum`: their pairs' counts.
    """
    rows = aligned(docs, a, b, text)
    counts = pair_counts(rows)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    known = counts.where(F.col("n") * frequent > total).toArrow()  # at most `frequent` rows
    order = np.argsort(known.column("code").to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(
        tuple(known.column(name).to_numpy()[order] for name in ("code", "n", "best"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in (part for whole in batches for part in _by_links(whole)):
            codes = _codes(batch)
            sizes = batch.column("a").value_lengths().to_numpy(zero_copy_only=False)
            place = np.repeat(batch.column("place").to_numpy(zero_copy_only=False), sizes)
            if not len(codes):
                continue
            at = np.minimum(np.searchsorted(code, codes), max(len(code) - 1, 0))
            has = code[at] == codes if len(code) else np.zeros(len(codes), bool)
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            sums = np.add.reduceat(np.where(has, n[at] if len(n) else 0, 0), first)
            bests = np.add.reduceat(np.where(has, best[at] if len(n) else False, False).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[first]), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int64()), pa.array(sums), pa.array(bests)],
                names=["place", "code", "times", "count_sum", "n_best"],
            )
            rare = np.flatnonzero(~has)
            rare = rare[np.lexsort((codes[rare], place[rare]))]
            head = np.flatnonzero(np.concatenate(([True], (codes[rare][1:] != codes[rare][:-1]) | (place[rare][1:] != place[rare][:-1]))) if len(rare) else np.zeros(0, bool))
            times = np.diff(np.concatenate((head, [len(rare)])))
            own = rare[head]
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[own]), pa.array(codes[own]), pa.array(times), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64())],
                names=["place", "code", "times", "count_sum", "n_best"],
            )

    found = staged(
        rows.select("place", "a", "b").mapInArrow(frugal(work), "place bigint, code bigint, times bigint, count_sum bigint, n_best bigint"), "links"
    )
    rest = counts.where(F.col("n") * frequent <= total)
    rare = found.where("code IS NOT NULL").join(rest, "code").select(
        "place", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best")
    )
    none = F.lit(None).cast("long")
    parts = found.where("code IS NULL").select("place", "count_sum", "n_best").union(rare).select(
        "place", none.alias("doc_id"), *[none.alias(c) for c in _ALIGNED[2:6]], F.lit(None).cast("string").alias("groups_sha256"), "count_sum", "n_best"
    )
    own = rows.select(*_ALIGNED[:7], F.lit(0).cast("long").alias("count_sum"), F.lit(0).cast("long").alias("n_best"))
    return own.union(parts).groupBy("place").agg(
        *[F.max(c).alias(c) for c in _ALIGNED[1:6]], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"),
        F.max("groups_sha256").alias("groups_sha256"),
    ).drop("place")
