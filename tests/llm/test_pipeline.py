"""The pipeline's stages against brute force, and its contract."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hedgerow.llm import toxicity
from hedgerow.llm.common import DOCUMENT_COLUMNS, table
from test_pair_operators import brute_components

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The documents that each stage is given, and what the last one gives."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return [*out, docs]


def test_stages_hand_on_documents(stages):
    assert all(set(s.columns) == set(DOCUMENT_COLUMNS) for s in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "byte_pairs"]


def test_toxicity_stage(spark, sf, stages):
    labels = table(spark, sf, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.train(table(spark, sf, "documents").select("doc_id", "text"), labels)
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score(stages[0], model).collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == {i for i, s in scores.items() if s < 0.5}


def test_near_duplicate_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    components = brute_components(rows, 5, 8, 10)
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i, (size, c) in components.items() if c == i or not size}


def test_decontamination_stage(spark, sf, stages):
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [plain(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert {r["doc_id"] for r in stages[3].collect()} == {
        r["doc_id"] for r in stages[2].collect() if not any(i in plain(r["text"]) for i in items)
    }


def test_secret_stage(stages):
    before = {r["doc_id"]: r for r in stages[3].collect()}
    for row in stages[4].collect():
        was = before[row["doc_id"]]["text"]
        assert row["n_chars"] == len(row["text"]) and not re.search(r"token = \"[0-9a-f]{40}", row["text"])
        assert (row["text"] == was) == ("[SECRET]" not in row["text"])
    assert len(before) == stages[4].count()


def test_byte_pair_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row["ids"] == library.encode(texts[row["doc_id"]], add_special_tokens=False).ids and row["n_tokens"] == len(row["ids"])


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows_and_no_rows(spark, sf, documents, number):
    stage = corpus_pipeline.STAGES[number][1]
    rows = [(1, None), (2, ""), (None, "no id at all"), (3, "repeated row of some words here"), (3, "repeated row of some words here")]
    odd = documents(rows).withColumn("lang", F.lit(None).cast("string"))
    found = stage(spark, odd.withColumn("toxicity", F.lit("clash")), sf)
    ids = [r["doc_id"] for r in found.collect()]
    assert {1, 2, 3, None} == set(ids)
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_a_task_leaves_no_free_memory_in_its_worker():
    """Freed memory between kept objects stays with a process unless it is handed back."""
    from hedgerow.llm import common

    def resident():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096

    def work(batches):
        for batch in batches:
            rows = [bytes(2_000) for _ in range(100_000)]
            kept.extend(rows[::500])
            del rows
            yield batch

    kept, before = [], resident()
    assert list(common.frugal(work)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60_000_000
