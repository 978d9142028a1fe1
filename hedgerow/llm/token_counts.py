"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A change is a signed count: an insert adds a document and its tokens, a delete takes both away, and a revised count takes the
old tokens away and adds the new ones. A batch of changes is added up by key before the shuffle, so a source with a third of
all rows sends one row a task, and its sums are committed under the batch's name. Totals are the sum over committed batches.

Commits are idempotent. A batch is written to a folder of its own name in one job; its success mark makes it part of the
totals, and a name that has one is skipped, so a batch that is sent again, or written again after a failure, counts once.
The state is a folder in a store that all executors share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
_STATE = "source string, lang string, version string, n_docs bigint, n_tokens bigint"

#: Version of `word_count`: runs of visible characters.
WORDS = "words-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bpe_count(tokenizer: str, spark: SparkSession):
    """A function of a text column: the number of its tokens by a tokenizer's file content, whole texts."""
    shared = spark.sparkContext.broadcast(tokenizer)
    held: list = []

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not held:
            held.append(Tokenizer.from_str(shared.value))
        for texts in batches:
            sizes: list[int] = []
            for begin in range(0, len(texts), 200):
                part = texts.iloc[begin: begin + 200].fillna("").tolist()
                sizes += [len(code) for code in held[0].encode_batch_fast(part, add_special_tokens=False)]
            yield pd.Series(sizes, dtype="int64")

    return F.pandas_udf(count, "bigint")


def inserts(docs: DataFrame, count: Column, version: str) -> DataFrame:
    """Changes that add the rows of (source, lang, ...)."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(1).alias("sign"), count.alias("tokens"))


def deletes(docs: DataFrame, count: Column, version: str) -> DataFrame:
    """Changes that take the rows away; `count` has to be what was added for them."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(-1).alias("sign"), count.alias("tokens"))


def revisions(docs: DataFrame, before: Column, before_version: str, after: Column, after_version: str) -> DataFrame:
    """Changes that put the new counts in the place of the old ones, in one pass over the rows."""
    change = F.inline(F.array(
        F.struct(F.lit(before_version).alias("version"), F.lit(-1).alias("sign"), before.alias("tokens")),
        F.struct(F.lit(after_version).alias("version"), F.lit(1).alias("sign"), after.alias("tokens")),
    ))
    return docs.select("source", "lang", change)


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, state: str) -> list[str]:
    """Names of the committed batches; one name for each batch, no rows."""
    system, place = _folder(spark, f"{state}/batches")
    if not system.exists(place):
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(n for n in names if system.exists(hadoop.Path(f"{state}/batches/{n}/_SUCCESS")))


def apply_batch(spark: SparkSession, state: str, batch: str, changes: DataFrame) -> bool:
    """Commit a batch of (source, lang, version, sign, tokens); False if a batch of that name is committed already.

    A null source, language or version is a key of its own; a null sign or count counts as 0; repeated rows each count; an
    empty batch is committed with no rows; other columns are ignored. One writer at a time may commit one batch name.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    if batch in committed(spark, state):
        return False
    signed = F.coalesce(F.col("sign"), F.lit(0)).cast("long")
    sums = changes.groupBy(*KEYS).agg(
        F.coalesce(F.sum(signed), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(signed * F.coalesce(F.col("tokens"), F.lit(0)).cast("long")), F.lit(0)).alias("n_tokens"),
    )
    sums.write.mode("overwrite").parquet(f"{state}/batches/{batch}")
    return True


def totals(spark: SparkSession, state: str) -> DataFrame:
    """(source, lang, version, n_docs, n_tokens) over all committed batches; keys that came to nothing are left out."""
    names = committed(spark, state)
    if not names:
        return spark.createDataFrame([], _STATE)
    rows = spark.read.schema(_STATE).parquet(*[f"{state}/batches/{n}" for n in names])
    return (
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        .where("n_docs != 0 OR n_tokens != 0")
    )

