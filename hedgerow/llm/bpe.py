"""Byte-pair encoding and decoding through a distinct-word table.

Encoding. Spark splits each text into words (the tokenizer's own pattern; texts are first cut at its special strings). A
block is a bounded run of a partition's texts; in it a word is a number, and a text is the row of its words' numbers in
order of place. The block's distinct words go to the partition of their hash, where the distinct-word table is built: each
word is encoded once, whatever the number of blocks that hold it. The ids go back to the block, and the join by position
puts them in the place of the numbers.

What is written or moves: for each word of a text about a byte and a half, once, to a table bucketed by block; for each
distinct word of a block its letters and its ids, packed into one row for each block and partition. Texts never move. A
plain join of (text, place, word) rows would move each word's letters and place twice.

Decoding joins ids with the id-to-piece table (as many rows as the vocabulary, so it is broadcast and read as arrays) and
joins a text's pieces in order; bytes that are not UTF-8 become U+FFFD, as the tokenizers library has it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.llm.common import frugal, give_back, staged_by

#: Fixed value: the pattern by which byte-level tokenizers of this family split words.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of a block; more texts make another block. A single longer text is a block of its own.
BLOCK_WORDS = 2_000_000
#: Texts whose numbers are packed together.
CHUNK_TEXTS = 256
#: Words that a partition's table holds at a time; beyond, it begins anew (a word may then be encoded again).
TABLE_WORDS = 2_000_000


def read_tokenizer(path: str) -> str:
    """The tokenizer's file as text, read on the driver and sent to the tasks, so executors need no such file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _special_strings(tokenizer: str) -> list[str]:
    return [t["content"] for t in json.loads(tokenizer)["added_tokens"]]


def split_words(text: Column, specials: Sequence[str] = ()) -> Column:
    """Array of the text's words; together they are the text. A special string is a word of its own."""
    body = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(body, F.lit(WORD_PATTERN), F.lit(0))
    if not specials:
        return plain
    quoted = ["\\Q" + s + "\\E" for s in sorted(specials, key=len, reverse=True)]
    mark = "(" + "|".join(quoted) + ")"
    parts = F.split(body, f"(?<={mark})|(?={mark})")
    cut = F.flatten(F.transform(
        parts, lambda p: F.when(p.isin(*specials), F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(WORD_PATTERN), F.lit(0)))
    ))
    return F.when(F.coalesce(*[F.nullif(F.contains(body, F.lit(s)), F.lit(False)) for s in specials], F.lit(False)), cut).otherwise(plain)


def _pack_words(words: list[str]) -> bytes:
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(d) for d in data], np.uint32).tobytes()
    whole = b"".join(data)
    return _squeeze(np.uint32(len(words)).tobytes() + sizes + whole)


def _unpack_words(packed: bytes) -> list[str]:
    raw = _expand(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4).astype(np.int64)) + 4 + 4 * n
    starts = np.concatenate(([4 + 4 * n], ends[:-1]))
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _squeeze(raw: bytes) -> bytes:
    return np.uint64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int(np.frombuffer(packed, np.uint64, 1)[0]), codec="zstd", asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    """Word numbers with all low bytes first and all high bytes last: frequent words have small numbers, so that packs well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    n = len(planes) // 4
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").reshape(-1)


def _blocks(docs: DataFrame, words: Column, keep: Sequence[str], buckets: int) -> DataFrame:
    """Rows of two kinds: a block's texts as word numbers (bucket null), and its distinct words by bucket.

    A row of the first kind has CHUNK_TEXTS texts: their numbers' planes in `packed`, the numbers' counts in `sizes`, and
    the kept columns as arrays. Words are numbered by falling frequency.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], words.alias("__words"))
    schema = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("packed", T.BinaryType()),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), *[T.StructField(c, T.ArrayType(docs.schema[c].dataType)) for c in keep],
    ])
    width = len(keep)

    def batch_of(block: str, bucket: pa.Array, packed: list[bytes], sizes: pa.Array, kept: list[pa.Array]) -> pa.RecordBatch:
        n = len(packed)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.string()), bucket, pa.array(packed, pa.binary()), sizes, *kept], names=schema.names
        )

    def texts(block: str, batch: pa.RecordBatch, numbers: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate(([0], np.cumsum(sizes)))
        for begin in range(0, len(sizes), CHUNK_TEXTS):
            end = min(begin + CHUNK_TEXTS, len(sizes))
            whole = pa.array([0, end - begin], pa.int32())
            yield batch_of(
                block, pa.nulls(1, pa.int32()), [_squeeze(_planes(numbers[ends[begin]: ends[end]]))],
                pa.ListArray.from_arrays(whole, pa.array(sizes[begin:end].astype(np.int32))),
                [pa.ListArray.from_arrays(whole, batch.column(k).slice(begin, end - begin)) for k in range(width)],
            )

    def emit(batch: pa.RecordBatch, block: str) -> Iterator[pa.RecordBatch]:
        lists = batch.column(width)
        encoded = lists.flatten().dictionary_encode()
        numbers = encoded.indices.to_numpy(zero_copy_only=False)
        names = encoded.dictionary.to_pylist()
        order = np.argsort(-np.bincount(numbers, minlength=len(names)), kind="stable")
        place = np.empty(len(names), np.uint32)
        place[order] = np.arange(len(names), dtype=np.uint32)
        yield from texts(block, batch, place[numbers], lists.value_lengths().to_numpy(zero_copy_only=False))
        own: dict[int, list[tuple[str, int]]] = {}
        for word, number in zip(names, place.tolist(), strict=True):
            own.setdefault(xxhash.xxh64_intdigest(word.encode()) % buckets, []).append((word, number))
        packed = []
        for pairs in own.values():
            pairs.sort()
            numbered = _squeeze(_planes(np.array([n for _, n in pairs], np.uint32)))
            packed.append(np.uint64(len(numbered)).tobytes() + numbered + _pack_words([w for w, _ in pairs]))
        yield batch_of(
            block, pa.array(list(own), pa.int32()), packed, pa.nulls(len(own), pa.list_(pa.int32())),
            [pa.nulls(len(own), pa.list_(batch.column(k).type)) for k in range(width)],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = np.cumsum(batch.column(width).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + BLOCK_WORDS, side="right")))
                yield from emit(batch.slice(begin, end - begin), f"{partition}-{number}")
                begin, number = end, number + 1

    return rows.mapInArrow(frugal(work), schema)


def _encoded_words(words: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """The distinct-word table, bucket by bucket: (block, answer), the ids of each block's words."""
    shared = words.sparkSession.sparkContext.broadcast(tokenizer)
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("answer", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        machine = None
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            answers = []
            for packed in batch.column(1).to_pylist():
                if machine is None:
                    machine = Tokenizer.from_str(shared.value)
                    machine.no_padding()
                    machine.no_truncation()
                size = int(np.frombuffer(packed, np.uint64, 1)[0])
                numbers, own = packed[8: 8 + size], _unpack_words(packed[8 + size:])
                if len(table) > TABLE_WORDS:
                    table.clear()
                new = [w for w in own if w not in table]
                for begin in range(0, len(new), 10_000):
                    part = new[begin: begin + 10_000]
                    for word, code in zip(part, machine.encode_batch_fast(part, add_special_tokens=False), strict=True):
                        table[word] = np.array(code.ids, "<u4").tobytes()
                ids = [table[w] for w in own]
                sizes = np.array([len(i) // 4 for i in ids], "<u4")
                flat = np.frombuffer(b"".join(ids), "<u4")
                answers.append(_squeeze(np.uint64(len(ids)).tobytes() + _expand(numbers) + _planes(sizes) + _planes(flat)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.binary())], names=schema.names)

    return words.select("block", "packed", "bucket").repartition(buckets, "bucket").select("block", "packed").mapInArrow(frugal(work), schema)


def _lengths_to_places(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of all items of pieces that lie at `starts` and have those lengths, one piece after the other."""
    out = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    kind = np.int32 if out[-1] < 2**31 and starts.dtype == np.int32 else np.int64
    places = np.repeat((starts - out[:-1]).astype(kind), lengths)
    places += np.arange(out[-1], dtype=kind)
    return places


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] = ("doc_id",), buckets: int | None = None) -> DataFrame:
    """(keep..., ids): the token ids of every whole text, without special tokens added; one row for each row.

    A null or empty text has no ids; repeated rows are each given; a table without rows gives none. Columns not in `keep`
    are left behind, `keep` may hold any names but block, bucket, packed, sizes and ids. `docs` has to give the same rows in the
    same partitions when a lost task is run again, as a stored table does; the blocks are staged once in the shared folder.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(docs, split_words(F.col(text), _special_strings(tokenizer)), keep, buckets)
    tagged = staged_by(blocks, "blocks", "block", buckets)  # texts are read by block again, and so need no shuffle
    answers = _encoded_words(tagged.where("bucket IS NOT NULL"), tokenizer, buckets)
    texts = tagged.where("bucket IS NULL").drop("bucket")
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def place(own: pa.Table, found: pa.Table) -> pa.Table:
        parts = []
        for answer in found.column("answer"):
            raw = _expand(answer.as_py())
            n = int(np.frombuffer(raw, np.uint64, 1)[0])
            numbers, sizes, ids = _numbers(raw[8: 8 + 4 * n]), _numbers(raw[8 + 4 * n: 8 + 8 * n]), _numbers(raw[8 + 8 * n:])
            parts.append((numbers, sizes, ids))
        total = sum(len(p[0]) for p in parts)
        length, start = np.zeros(total, np.int32), np.zeros(total, np.int32)  # a block has fewer than 2 ** 31 distinct words' ids
        at = 0
        for numbers, sizes, ids in parts:
            length[numbers] = sizes
            start[numbers] = at + np.cumsum(sizes, dtype=np.int64) - sizes
            at += len(ids)
        table = np.concatenate([p[2] for p in parts]).view(np.int32) if parts else np.zeros(0, np.int32)
        parts.clear()
        rows, sizes = [], []
        for packed, counts in zip(own.column("packed"), own.column("sizes"), strict=True):
            numbers = _numbers(_expand(packed.as_py()))
            lengths = length[numbers]
            rows.append(table[_lengths_to_places(lengths, start[numbers])])
            ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))[np.concatenate(([0], np.cumsum(counts.values.to_numpy())))]
            sizes.append(np.diff(ends))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        whole, at = np.empty(int(offsets[-1]), np.int32), 0
        for ids in rows:
            whole[at: at + len(ids)] = ids
            at += len(ids)
        rows.clear()
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole))
        kept = [own.column(c).combine_chunks().flatten() for c in keep]
        give_back()
        return pa.Table.from_arrays([*kept, lists], names=[*keep, "ids"])

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, schema)


def piece_table(tokenizer: str) -> list[bytes]:
    """The bytes of each id, by id."""
    parsed = json.loads(tokenizer)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ids = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
    out = [b""] * (max(ids.values()) + 1)
    for piece, number in ids.items():
        out[number] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    return out


def decoder(spark: SparkSession, tokenizer: str, ids: str = "ids", into: str = "decoded"):
    """A function for mapInArrow: batches with a column of ids get one with their text, as the last column."""
    pieces = piece_table(tokenizer)
    lengths = np.array([*map(len, pieces), 0], np.int64)  # the last stands for ids that are not there
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(pieces), np.uint8), starts, lengths))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begins, sizes = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                lists = batch.column(ids)
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                flat[(flat < 0) | (flat >= len(sizes))] = len(sizes) - 1
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                size = sizes[flat]
                text = data[_lengths_to_places(size, begins[flat])].tobytes()
                ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
                texts = [text[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, into])

    return work


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in column `into`, special tokens shown.

    A null or empty row of ids gives an empty text; ids that the vocabulary lacks, and null ids, give nothing.
    """
    kept = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != into])
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())])
    return kept.mapInArrow(frugal(decoder(rows.sparkSession, tokenizer, ids, into)), schema)
