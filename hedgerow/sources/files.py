"""Source trees as a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.catalogue.noise import SCAN_EXTENSIONS, SKIP_DIRS
from hedgerow.functions.text import decode_utf8
from hedgerow.operators.noise import (
    fits_size_cap, has_content, has_scanned_extension, in_skipped_dir, is_noise_path, relative_path,
    relative_path_sql,
)
from hedgerow.sources.walk import staged_listing


def _any_case(extension: str) -> str:
    return "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)


def read_tree(
    spark: SparkSession,
    root: str,
    extensions=None,
    max_bytes: int | None = None,
    prune: bool = False,
) -> DataFrame:
    """(path, length, content) of every file below the root that Spark's own source lists; the path is relative to it.

    Extensions narrow the listing, the size cap is pushed into the source, and `prune` leaves noise
    paths out by the files' metadata: what they leave out is never opened. Spark lists no names that start
    with `.` or `_`, and a file has to fit a row; `sources.walk` has neither limit.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        glob = "{" + ",".join(_any_case(e) for e in extensions) + "}"
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    if prune:
        # The metadata path is percent-encoded; a plus sign is a plus sign.
        listed = "url_decode(replace(_metadata.file_path, '+', '%2B'))"
        files = files.filter(~is_noise_path(relative_path_sql(listed, root)))
    files = files.select("path", "length", "content")
    wanted = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    files = files.filter(wanted)
    return files.select(
        relative_path("path", root).alias("path"),
        "length",
        decode_utf8(F.col("content")).alias("content"),
    )


def scanned(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files (path, length, content) that a scan looks into; larger ones than `max_bytes` are left out if it is given."""
    return files.filter(
        has_scanned_extension(F.col("path"))
        & ~is_noise_path("path")
        & fits_size_cap(F.col("length"), max_bytes)
        & has_content(F.col("content"))
    )


def read_scanned(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Files of a source tree that a scan looks into, by Spark's own source."""
    return scanned(read_tree(spark, root, SCAN_EXTENSIONS, max_bytes, prune=True), max_bytes)


def list_scanned(spark: SparkSession, root: str) -> DataFrame:
    """(uri, path, length) of every file below the root outside noise folders, hidden ones too, listed once and staged."""
    return staged_listing(spark, root, SKIP_DIRS)


def wanted_files(listing: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The listed files that a scan looks into; larger ones than `max_bytes` are left out if it is given."""
    return listing.filter(
        has_scanned_extension(F.col("path")) & ~is_noise_path("path") & fits_size_cap(F.col("length"), max_bytes)
    )


def scan_counts(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(scanned, skipped) over listed files (path, length); contents are not read."""
    open_dirs = files.filter(~in_skipped_dir(F.col("path")))
    taken = (
        has_scanned_extension(F.col("path"))
        & ~is_noise_path("path")
        & fits_size_cap(F.col("length"), max_bytes)
    )
    return open_dirs.agg(
        F.count_if(taken).alias("scanned"), F.count_if(~taken).alias("skipped")
    )
