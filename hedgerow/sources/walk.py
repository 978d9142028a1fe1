"""Source trees read by one walk in tasks, in byte ranges that end at line ends.

A listing starts at the root, goes down SPREAD levels with a shuffle of the folders between them, and then each task walks
its folders to the bottom: one job, however deep the tree, and no path on the driver. All names are listed, also those that
Spark's file sources leave out, and linked folders are not entered.

A file is cut into ranges of `range_bytes`. A range owns the lines that begin in it, as they are cut at line feeds: its text
begins after the first line feed from its start on, and goes on to the first line feed after its end. Lines before and
after it come along as context. Only files of more than one range are read twice: once to count each range's lines, whose
sums number the lines of the whole file, and once for the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hedgerow.catalogue.noise import CONTEXT_AFTER, CONTEXT_BEFORE
from hedgerow.functions.scratch import stage

#: Levels below the root after which a task walks its folders to the bottom.
SPREAD = 2
#: Bytes of a range, and of the ranges that one task reads.
RANGE_BYTES = 16 << 20
PARTITION_BYTES = 64 << 20
#: A line is read whole up to this size; a longer one is cut there, as a row of Spark holds less than 2 GB.
LINE_BYTES = 1 << 30
_BLOCK = 1 << 16

_ENTRY = "uri string, path string, length bigint, is_dir boolean"
_RANGE_COLUMNS = ["uri", "path", "length", "offset", "first_line"]
TEXTS = (
    "path string, length bigint, offset bigint, first_line bigint, before string, content string, after string, "
    "lead int, own bigint"
)


def open_uri(uri: str):
    """File system and plain path of a URI, and what the URI has in front of that path."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        plain = uri if not uri.startswith("file:") else "/" + uri.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), plain, ""
    system, plain = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return system, plain, uri[: len(uri) - len(plain)] if uri.endswith(plain) else ""


def _listing(skip: frozenset[str], deep: bool):
    """Folders to what they hold, to the bottom if `deep`; files stay as they are."""

    def children(uri: str, path: str) -> Iterator[tuple]:
        from pyarrow import fs

        system, plain, head = open_uri(uri)
        local = isinstance(system, fs.LocalFileSystem)
        for info in system.get_file_info(fs.FileSelector(plain)):
            is_dir = info.type == fs.FileType.Directory
            if is_dir and (info.base_name.lower() in skip or (local and os.path.islink(info.path))):
                continue
            if is_dir or info.type == fs.FileType.File:
                yield head + info.path, f"{path}/{info.base_name}".lstrip("/"), info.size or 0, is_dir

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            waiting = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            first = len(waiting)  # rows of the batch itself; they are entered even if only one level is asked for
            while waiting:
                uri, path, length, is_dir = waiting.pop(0) if first > 0 else waiting.pop()
                first -= 1
                if not is_dir:
                    rows.append((uri, path, length, False))
                    continue
                found = list(children(uri, path))
                rows += [r for r in found if not (deep and r[3])]
                waiting += [r for r in found if deep and r[3]]
                if len(rows) > 10_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    return listed


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uri", "path", "length", "is_dir"]
    )


def list_tree(spark: SparkSession, root: str, skip_dirs=()) -> DataFrame:
    """(uri, path, length) of every file below the root, hidden ones too; `path` is relative to it.

    Folders whose names are in `skip_dirs`, in any case, and linked folders are not entered; linked files are files.
    """
    skip = frozenset(name.lower() for name in skip_dirs)
    entries = spark.createDataFrame([(root.rstrip("/") or "/", "", 0, True)], _ENTRY)
    for level in range(SPREAD + 1):
        entries = entries.mapInArrow(_listing(skip, deep=level == SPREAD), _ENTRY)
        if level < SPREAD:
            entries = entries.repartition(spark.sparkContext.defaultParallelism, "uri")
    return entries.where("NOT is_dir").select("uri", "path", "length")


def file_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Files (uri, path, length) to rows (uri, path, length, offset), one for each range; an empty file has one."""
    many = F.greatest(F.expr(f"(length + {range_bytes - 1}) div {range_bytes}"), F.lit(1))
    return files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("nth")).select(
        "uri", "path", "length", (F.col("nth") * range_bytes).alias("offset")
    )


def _line_feed(stream, at: int, size: int) -> int:
    """Place after the first line feed from `at` on, the file's size if there is none, `at` + LINE_BYTES at most."""
    stream.seek(at)
    done = at
    while done < size and done - at < LINE_BYTES:
        block = stream.read(_BLOCK)
        found = block.find(b"\n")
        if found >= 0:
            return done + found + 1
        if not block:
            return size
        done += len(block)
    return min(done, size)


def _bounds(stream, offset: int, size: int, range_bytes: int) -> tuple[int, int]:
    """Where the lines that begin in a range start and end."""
    begin = 0 if offset == 0 else _line_feed(stream, offset - 1, size)
    end = size if offset + range_bytes >= size else _line_feed(stream, offset + range_bytes - 1, size)
    return begin, max(begin, end)


def _text(stream, begin: int, end: int) -> str:
    stream.seek(begin)
    return stream.read(end - begin).decode("utf-8", "ignore")


def _before(stream, begin: int) -> str:
    """The last CONTEXT_BEFORE lines before a place, by line feeds; a longer context by other breaks does no harm."""
    size = _BLOCK
    while True:
        start = max(begin - size, 0)
        stream.seek(start)
        parts = stream.read(begin - start).split(b"\n")
        if start == 0 or len(parts) > CONTEXT_BEFORE + 1 or size >= LINE_BYTES:
            return b"\n".join(parts[-CONTEXT_BEFORE - 1:]).decode("utf-8", "ignore")
        size *= 4


def _after(stream, end: int, size: int) -> str:
    at = end
    for _ in range(CONTEXT_AFTER):
        at = _line_feed(stream, at, size) if at < size else at
    return _text(stream, end, at)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        system, plain, _ = open_uri(row[0])
        with system.open_input_file(plain) as stream:
            yield row, stream


def _counted(range_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, path, length, offset), stream in _opened(batch):
                lines = len(_text(stream, *_bounds(stream, offset, length, range_bytes)).splitlines())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([offset]), pa.array([lines])], names=["path", "offset", "lines"]
                )

    return work


def _read(range_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, path, length, offset, first), stream in _opened(batch):
                begin, end = _bounds(stream, offset, length, range_bytes)
                content = _text(stream, begin, end)
                before = _before(stream, begin) if offset and begin < end else ""
                after = _after(stream, end, length) if begin < end else ""
                values = (path, length, offset, first, before, content, after, len(before.splitlines()), len(content.splitlines()))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                    names=["path", "length", "offset", "first_line", "before", "content", "after", "lead", "own"],
                )

    return work


def read_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Files (uri, path, length) to TEXTS, one row for each range; bytes that are not UTF-8 are left out.

    `first_line` lines of the file come before `content`, which has `own` lines; `before` has `lead` lines. A file of more
    than one range may be of any size: no row holds more than a range, a line and the context. `files` is read three times:
    stage a listing first.
    """
    spark = files.sparkSession
    ranges = file_ranges(files, range_bytes)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).head()
    tasks = max(1, -(-total[0] // partition_bytes), min(total[1], spark.sparkContext.defaultParallelism))
    dealt = [F.xxhash64("path", "offset")]
    long = ranges.where(F.col("length") > range_bytes)
    counts = long.repartition(tasks, *dealt).mapInArrow(_counted(range_bytes), "path string, offset bigint, lines bigint")
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("path", "offset", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("first_line"))
    numbered = long.join(firsts, ["path", "offset"]).select(*_RANGE_COLUMNS).union(
        ranges.where(F.col("length") <= range_bytes).select(*_RANGE_COLUMNS[:4], F.lit(0).cast("long"))
    )
    return numbered.repartition(tasks, *dealt).mapInArrow(_read(range_bytes), TEXTS)


def staged_listing(spark: SparkSession, root: str, skip_dirs=()) -> DataFrame:
    """`list_tree`, written once, so that counters and reading do not walk again."""
    return stage(list_tree(spark, root, skip_dirs), "listing")
