"""One query for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.llm import (
    align, bpe, chat, decontaminate, html_cut, jaccard, licenses, repair, secret_scan, simhash, suffixes, token_counts, toxicity,
)
from hedgerow.functions.scratch import fresh_path
from hedgerow.llm.common import staged, table


TOKENIZER = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Digests of every document's token ids and of the text that they decode to."""
    tokenizer = bpe.read_tokenizer(tokenizer_path or public_tokenizers.path(TOKENIZER))
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)
    decoded = bpe.decoder(spark, tokenizer)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoded(batches):
            ids = [hashlib.sha256(np.asarray(own.values, "<u4").tobytes()).hexdigest() for own in batch.column("ids")]
            texts = [hashlib.sha256(text.as_py().encode()).hexdigest() for text in batch.column("decoded")]
            sizes = batch.column("ids").value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents under links of 4-word shingle sets with a similarity of 0.85."""
    return jaccard.components_of(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, num=85, den=100)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all conversations' examples, read back from the formatted texts."""
    planted = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    examples = chat.format_chats(rows)
    read = examples.select(
        "conv_id", "example", "formatted",
        chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    by_conversation = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    back = by_conversation.select("conv_id", chat.turns_of(F.col("whole")).alias("turns"), loss.alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


_CONTROL_HEADS = "([<\\[])(\\|im_start\\|>|\\|im_sep\\|>|\\|im_end\\|>|\\|endoftext\\|>|/?s>|/?INST\\]|<SYS>>|</SYS>>)"


def _escaped_size(column: str) -> str:
    doubled = f"replace({column}, '\\', '\\\\')"
    return f"(length({doubled}) + len(regexp_extract_all({doubled}, '{_CONTROL_HEADS}')))"


OP3_SQL = f"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER w AS place, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last,
    {len(chat.START + chat.SEPARATOR + chat.END)} + {_escaped_size('role')} + {_escaped_size('text')} AS size
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS so_far FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in the documents."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: inserts by words, revision to byte pairs, deletion of exact copies.

    Each batch is sent twice; the second time changes nothing.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    tokenizer = bpe.read_tokenizer(public_tokenizers.path(TOKENIZER))
    words, pairs = token_counts.word_count(F.col("text")), token_counts.bpe_count(tokenizer, spark)
    counted = staged(
        docs.select("doc_id", "source", "lang", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("key"),
                    words.alias("words"), pairs(F.col("text")).alias("pairs")), "counts",
    )
    first = counted.groupBy("key").agg(F.min("doc_id").alias("first"))
    copies = counted.join(first, "key").where("doc_id != first")
    version = TOKENIZER.removesuffix(".json")
    state = fresh_path(spark, "token-counts")
    batches = {
        "1-insert": token_counts.inserts(counted, F.col("words"), token_counts.WORDS),
        "2-revise": token_counts.revisions(counted, F.col("words"), token_counts.WORDS, F.col("pairs"), version),
        "3-delete": token_counts.deletes(copies, F.col("pairs"), version),
        "4-insert-words": token_counts.inserts(counted, F.col("words"), token_counts.WORDS),
    }
    for name, changes in batches.items():
        token_counts.apply_batch(spark, state, name, changes)
        token_counts.apply_batch(spark, state, name, changes)
    return token_counts.totals(spark, state)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_cut.extract(pages).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets in every document."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def spans(keep) -> F.Column:
        kept = F.filter("secrets", keep)
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secret_scan.KINDS]
    return found.select(
        "doc_id", *counts[:3], F.sha2(F.encode(spans(lambda s: s["kind"] != "guess"), "UTF-8"), 256).alias("base_sha256"),
        spans(lambda s: F.lit(True)).alias("spans"), counts[3],
        F.array_max(F.transform("secrets", lambda s: s["cost"])).alias("max_guess_cost"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the next document.

    `n_near`: for documents whose id is divisible by 100, how many other documents' fingerprints lie within 3 bits.
    """
    rows = staged(simhash.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "fingerprints")
    queries = rows.where("doc_id % 100 = 0")
    pairs = simhash.within_radius(queries, rows)
    sizes = rows.groupBy(F.col("f").alias("found")).agg(F.count("*").alias("size"))
    near = pairs.join(sizes, "found").groupBy(F.col("query").alias("f")).agg((F.sum("size") - 1).alias("n_near"))
    counted = queries.join(near, "f").select(F.col("doc_id"), F.col("f"), "n_near").distinct()
    return rows.join(counted, ["doc_id", "f"], "left").select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_hex(F.col("f")).alias("fingerprint"),
        simhash.as_hex(F.col("edited_f")).alias("edited_fingerprint"),
        simhash.likeness(F.col("f"), F.col("edited_f")).alias("near_edited"),
        simhash.likeness(F.col("f"), F.col("next_f")).alias("near_next"), "n_near",
    )


def op11_align(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers, with the links' counts in the corpus."""
    a = align.read_bytes_side(a_path or public_tokenizers.path(TOKENIZER))
    b = align.read_pieces_side(b_path or public_tokenizers.path("piece_bpe_32k.model"))
    return align.link_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage."""
    return repair.repair_damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 100 bytes that stand earlier, too."""
    left = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return left.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_jaccard": op2_jaccard,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_html_extract": op7_html_extract,
    "op8_decontaminate": op8_decontaminate,
    "op9_secret_scan": op9_secret_scan,
    "op10_simhash": op10_simhash,
    "op11_align": op11_align,
    "op12_repair": op12_repair,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE = {
    "op3_chat_format": OP3_SQL,
}
