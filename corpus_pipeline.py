"""A training corpus from `documents`: five stages, each over all that the one before kept.

1. toxicity: documents that the machine finds toxic go.
2. near duplicates: one document (the smallest id) of each group that shingles of five words link at 0.8 or more stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: every secret in a text becomes [SECRET].
5. byte pairs: the kept texts as token ids, which decode to them.

Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.llm import bpe, decontaminate, jaccard, secret_scan, toxicity
from hedgerow.llm.common import DOCUMENT_COLUMNS, staged, table

#: SQL cannot express the first stage's machine; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out, of the stored table."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*DOCUMENT_COLUMNS), model).where("toxicity < 0.5").select(*DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs.select(*DOCUMENT_COLUMNS), width=5, num=8, den=10)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs.select(*DOCUMENT_COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids)."""
    tokenizer = bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = bpe.encode(docs.select(*DOCUMENT_COLUMNS), tokenizer, keep=("doc_id", "lang", "source", "n_chars"))
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_pairs", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage is written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
