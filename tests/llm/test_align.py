"""Cross-tokenizer alignment, against the two libraries over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hedgerow.llm import align, queries

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return align.read_bytes_side(A_FILE), align.read_pieces_side(B_FILE)


def groups_of(text, machines, pieces):
    """([(a ids, b ids)], [(a id, b id)]) of a text by looking at every pair of tokens."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    ids = [machines[0].encode(" " + text, add_special_tokens=False).ids, machines[1].encode(text)]
    ends = []
    for k in range(2):
        if b"".join(pieces[k][i] for i in ids[k]) != whole:
            return [], []
        own, at = [], 0
        for i in ids[k]:
            at += len(pieces[k][i])
            own.append(at)
        ends.append(own)
    shared = sorted(set(ends[0]) & set(ends[1]))
    groups = [[[i for i, e in zip(ids[k], ends[k]) if low < e <= high] for k in range(2)] for low, high in zip([0, *shared], shared)]
    links = [(a, b) for a, e in zip(ids[0], ends[0]) for b, f in zip(ids[1], ends[1]) if abs(e - f) < 1] if len(whole) < 3000 else None
    if links is None:
        at = dict(zip(ends[1], ids[1]))
        links = [(a, at[e]) for a, e in zip(ids[0], ends[0]) if e in at]
    return groups, links


def brute(rows, sides):
    machine = Tokenizer.from_file(A_FILE)
    machine.encode_special_tokens = True
    machines = machine, sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    made = [(doc, *groups_of(text, machines, [s.pieces for s in sides])) for doc, text in rows]
    counts = Counter(link for _, _, links in made for link in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc, groups, links in made:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


TEXTS = [
    "Hello world, it's 2024!", "", None, " ", "  ", "   lead and trail   ", "a\tb\nc\r\n\n  d", "naïve café – €30 „quoted“", "\xa0y　z",
    "▁under▁mark", "日本語のテキスト and 한국어", "<|endoftext|> </s><s> <unk> [INST] <0x41>", "\U0001f600\U0001f468‍\U0001f469 ok", "é ﬁ ½",
    "x" * 5000, "word " * 3000, "\0 nul \x7f", "'s 're don't I'LL", "a  b   c    d                                 e", "\n \n  \n", "tail \n", "Ünïcödé", "﻿bom", "",
]


@pytest.mark.parametrize("frequent,chunk", [(align.FREQUENT, align.CHUNK), (20, 60), (1, 10**9)])
def test_against_libraries(documents, sides, monkeypatch, frequent, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    rng = random.Random(9)
    letters = "abcdeE ,.'\n\t é日1 2-▁"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "same id"), (None, None), (5, "again"), (5, "again")]
    assert got(align.link_statistics(documents(rows, extra=True), *sides, frequent=frequent)) == brute(rows, sides)


def test_a_block_encodes_each_word_once(sides, monkeypatch):
    monkeypatch.setattr(align, "CHUNK", 300)
    rng = random.Random(3)
    words = [f" {rng.choice('abc')}{k}é" for k in range(300)]
    texts = [rng.choices(words, k=40) for _ in range(50)]
    block = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(range(50)), pa.array(texts)], names=["place", "doc_id", "words"])
    aligner, seen = align._Aligner(*sides), [Counter(), Counter()]

    def counted(encode, own):
        return lambda part: own.update(part) or encode(part)

    aligner.encoders = [counted(e, own) for e, own in zip(aligner.encoders, seen)]
    parts = list(aligner.align(block))
    assert len(parts) > 10 and sum(p.num_rows for p in parts) == 50
    assert all(set(own) == {w for t in texts for w in t} and max(own.values()) == 1 for own in seen)


@pytest.mark.parametrize("block", [1, 200])
def test_blocks_do_not_change_results(documents, sides, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    rows = list(enumerate(TEXTS))
    assert got(align.link_statistics(documents(rows), *sides)) == brute(rows, sides)


def test_odd_tables(documents, sides):
    assert align.link_statistics(documents([]), *sides).count() == 0
    assert got(align.link_statistics(documents([(1, None), (2, "")]), *sides)) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_query(spark, sf, sides):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op11_align(spark, sf)) == brute(rows, sides)


def test_a_vocabulary_that_crosses_words_is_refused(monkeypatch):
    monkeypatch.setattr(align, "SPACE_MARK", "e")
    with pytest.raises(ValueError, match="after another"):
        align.read_pieces_side(B_FILE)
