"""Removal of repeated passages, against brute force."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from hedgerow.llm import suffixes


def brute(rows, size):
    """{(doc_id, text): removed bytes} by looking at every window, rows in order of id (null first), hash aside."""
    first, removed = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - size + 1):
            window = raw[i: i + size]
            if first.setdefault(window, (doc, i)) != (doc, i):
                gone[i: i + size] = True
        removed[doc, text] = gone
    return removed


def check(found, rows, size):
    want = brute(rows, size)
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        raw, gone = (texts[r["doc_id"]] or "").encode(), want[r["doc_id"], texts[r["doc_id"]]]
        assert r["n_bytes"] == len(raw)
        mine = np.zeros(len(raw), bool)
        for a, b in r["spans"]:
            assert not mine[max(a - 1, 0): b + 1].any()
            mine[a:b] = True
        assert (mine == gone).all(), (r["doc_id"], np.flatnonzero(mine != gone)[:5])
        assert bytes(r["kept"]) == np.frombuffer(raw, np.uint8)[~gone].tobytes()


def made_texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.choice([10, 18, 19, 20, 22, 30, 80]))) for _ in range(12)]
    texts = []
    for _ in range(n):
        own = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
               for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice(["", " ", "x"]).join(own))
    texts += [texts[0], texts[0], texts[1] + "tail", "a" * 99, "a" * 100, "a" * 101, "ab" * 120, "b" + "ab" * 70, "", None, "short"]
    texts += ["abcdefghij" * 40, "".join(chr(97 + k % 26) for k in range(60)) * 4, "\n".join([passages[0]] * 4)]
    return texts


@pytest.mark.parametrize("hot,most,chunk", [(suffixes.HOT, suffixes.COLLECTION, suffixes.CHUNK), (3, 5, 300), (suffixes.HOT, 2, 150)])
def test_against_brute_force(documents, monkeypatch, hot, most, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    texts = made_texts(5, 60)
    rng = random.Random(1)
    rows = list(zip(rng.sample(range(-50, 500), len(texts)), texts))
    found = suffixes.without_repeats(documents(rows, extra=True), hot=hot, most=most).collect()
    check(found, rows, 100)


def test_short_strings(documents):
    rows = list(enumerate(["abcabcabc", "xabcabcy", "cab", "caabca", "é" * 9, "\U0001f600" * 3]))
    check(suffixes.without_repeats(documents(rows), size=5).collect(), rows, 5)


def test_long_text(documents):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, text), (0, text[1_048_000: 1_049_500] + "!"), (2, text[:400])]
    check(suffixes.without_repeats(documents(rows)).collect(), rows, 100)


def test_odd_rows(documents):
    text = "".join(chr(97 + (k * k) % 26) for k in range(50)) + "".join(chr(65 + k % 23) for k in range(90))
    rows = [(None, text), (3, text), (3, text), (3, text + "?"), (9, "z" + text)]
    found = suffixes.without_repeats(documents(rows)).collect()
    sizes = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], len(r["kept"])) for r in found))
    assert sizes == [(False, 0, 140, 140), (True, 3, 140, 0), (True, 3, 140, 0), (True, 3, 141, 1), (True, 9, 141, 1)]
    assert suffixes.without_repeats(documents([])).count() == 0
    same = suffixes.without_repeats(documents([(3, text), (3, text)])).collect()
    assert [len(r["kept"]) for r in same] == [140, 140]  # equal rows of an id are one


@pytest.mark.parametrize("limit", [3, 100])
def test_collection_is_the_order_of_all_suffixes(limit):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))).encode() for _ in range(40)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts])
    built = suffixes.Collection(data, np.cumsum(length) - length, length, limit)
    owner, left = built.suffixes()
    want = sorted((t[k:], i) for i, t in enumerate(texts) for k in range(len(t) + 1))
    assert [(texts[i][len(texts[i]) - n:], i) for i, n in zip(owner.tolist(), left.tolist())] == want
    for k in range(1, len(want)):
        a, b = want[k - 1][0], want[k][0]
        shared = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert built.common[k] == min(shared, limit)
    before = [texts[i][len(texts[i]) - n - 1] if n < len(texts[i]) else 255 for i, n in zip(owner.tolist(), left.tolist())]
    assert built.symbols.tolist() == before


def test_only_the_first_of_equal_pieces_has_its_text_moved(documents, monkeypatch):
    rng = random.Random(6)
    passage, tails = "".join(rng.choice("abcdefgh ") for _ in range(300)), ["".join(rng.choice("ijklmnop ") for _ in range(150)) for _ in range(2)]
    rows = [(k, passage + tails[k % 2]) for k in range(40)]

    def moved(size, most):
        def work(batches):
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(n, -7)), batch.column("key"), pa.array([hash(t.as_py()) for t in batch.column("piece")])],
                    names=["doc_id", "text_hash", "start", "end"],
                )

        return work

    monkeypatch.setattr(suffixes, "_compare", moved)
    found = suffixes.repeated_spans(documents(rows).repartition(8, "doc_id")).where("text_hash = -7").collect()
    assert found and len({(r["start"], r["end"]) for r in found}) == len(found)
    assert {r["doc_id"] for r in found} <= {0, 1}


def test_windows_of_a_hot_key_go_by_one_hash(documents):
    text = "".join(chr(97 + (k * k) % 26) for k in range(50)) + "".join(chr(65 + k % 23) for k in range(90))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6]), pa.array([text, text + "?"])], names=["doc_id", "text_hash", "text"])
    every, none = (SimpleNamespace(value=np.full((1 << suffixes.BITS) // 8, fill, np.uint8)) for fill in (255, 0))
    for hot, own in ((every, False), (none, True)):
        settled = [b for b in suffixes._pieces_of(100, every, hot)(iter([batch])) if b.column("end").null_count]
        keys = {k for b in settled for k in b.column("key").to_pylist()}
        contents = {c for b in settled for c in b.column("content").to_pylist()}
        assert len(keys) == 42 if not own else len(keys) < 10
        assert (contents == {0}) != own


def test_digest(spark, sf):
    from hedgerow.llm.queries import op13_suffix_dedup

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 100)
    found = {r["doc_id"]: r for r in op13_suffix_dedup(spark, sf).collect()}
    assert len(found) == len(rows)
    for doc, text in rows:
        raw, gone = (text or "").encode(), want[doc, text]
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        kept = hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
        r = found[doc]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), gone.sum(), (edges > 0).sum(), kept)
