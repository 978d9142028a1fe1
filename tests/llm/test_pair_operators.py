"""Jaccard join, fingerprints, decontamination, licences and token counts, against brute force and over the odd rows."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hedgerow.llm import common, decontaminate, jaccard, licenses, queries, simhash, token_counts


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, width):
    w = words_of(text)
    return {tuple(w[i: i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(rng, vocabulary, n):
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 80]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts[:n]


@pytest.mark.parametrize("hot", [jaccard.HOT, 2])
def test_jaccard_against_brute_force(documents, hot):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = near_copies(rng, vocabulary, 260)
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += ["Hello World", "hello  world", "HELLO\tworld x y", "", None, " ", "", "one", "one", "ONE"]
    rows = list(enumerate(texts))
    want = brute_components(rows, 4, 85, 100)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
             jaccard.components_of(documents(rows, extra=True), width=4, num=85, den=100, hot=hot).collect()}
    assert found == want


def test_jaccard_of_odd_rows(documents):
    long = "a b c d e f g h"
    rows = [(5, long), (3, long), (None, long), (None, None), (7, "x y z u v w"), (7, "x y z u v w"), (9, "one thing only here now"), (9, long)]
    found = jaccard.components_of(documents(rows), width=4, num=85, den=100).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by_id[5] == by_id[3] == {(5, 3)} and by_id[7] == {(3, 7)} and by_id[None] == {(5, None), (0, None)}
    assert {c for _, c in by_id[9]} == {3}
    assert jaccard.components_of(documents([]), width=4, num=85, den=100).count() == 0
    rows = [(1, long), (2, long), (3, "other words are here today"), (3, "other words are here today"), (4, None), (None, long), (None, long)]
    kept = jaccard.keep_one(documents(rows, extra=True))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 3, 4] and "signature" in kept.columns


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(0, 80))) for _ in range(60)] + ["", None]
    sets = jaccard.Sets(pa.array(texts), 2)
    own = [set(sets.hashes[a:b].tolist()) for a, b in zip(sets.starts[:-1], sets.starts[1:])]
    bits = np.unpackbits(np.array(sets.sketches().to_pylist()).view(np.uint8).reshape(len(texts), -1), axis=1)
    assert bits.shape == (len(texts), 64 * jaccard.SKETCH)
    for a in range(len(texts)):
        assert bits[a].sum() <= len(own[a])
        for b in range(a):
            assert (bits[a] != bits[b]).sum() <= len(own[a] ^ own[b])


def test_remaining_pairs_of_one_signature_are_not_all_rows(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randrange(50)) for _ in range(80)) for _ in range(60)]
    texts[41] = texts[7] + " end"
    sets = jaccard.Sets(pa.array(texts), 3)
    rows = [
        (5, k, True, jaccard.EXACT, k, int(size), *sketch)
        for k, (size, sketch) in enumerate(zip(sets.sizes, sets.sketches().to_pylist()))
    ]
    names = ["s%d bigint" % k for k in range(jaccard.SKETCH)]
    buckets = spark.createDataFrame(rows, "signature bigint, node bigint, own boolean, kind int, label bigint, size bigint, " + ", ".join(names))
    pairs = {(r["a"], r["b"]) for r in jaccard._remaining(buckets, 8, 10).collect()}
    assert (7, 41) in pairs and len(pairs) < 60  # 1770 pairs share the signature


def test_a_pivot_is_paired_only_with_what_it_may_link(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rng.randrange(50)) for _ in range(80)) for _ in range(60)]
    texts[41] = texts[0] + " end"
    texts[59] = texts[17] + " end"
    sets = jaccard.Sets(pa.array(texts), 3)
    rows = [(5, k, True, jaccard.EXACT, int(size), *sketch) for k, (size, sketch) in enumerate(zip(sets.sizes, sets.sketches().to_pylist()))]
    names = ["s%d bigint" % k for k in range(jaccard.SKETCH)]
    buckets = spark.createDataFrame(rows, "signature bigint, node bigint, own boolean, kind int, size bigint, " + ", ".join(names))
    least = {(r["a"], r["b"]) for r in jaccard._pairs(buckets, "min", 8, 10).collect()}
    most = {(r["a"], r["b"]) for r in jaccard._pairs(buckets, "max", 8, 10).collect()}
    assert (0, 41) in least and (59, 17) in most and len(least) < 5 and len(most) < 5  # 59 share the signature with either


def test_many_hot_segments_make_few_deletions(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(200)), 1000, 1000) for k in range(20)]
    frame = spark.createDataFrame(rows, "node bigint, text string, hot_own bigint, hot_below bigint")
    every, none = (spark.sparkContext.broadcast(np.full((1 << common.LEADING_BITS) // 8, fill, np.uint8)) for fill in (255, 0))
    elements = sum(len(shingles(t, 3)) for _, t, _, _ in rows)
    assert 0 < jaccard._deletions(frame, 3, 8, 10, every).count() < elements  # in two bands each; all segments' would be twice as many
    assert jaccard._deletions(frame, 3, 8, 10, none).count() == 0  # what no exact signature meets is no row


def test_sets_larger_than_a_sketch_are_paired_by_blocks(documents, monkeypatch):
    rng = random.Random(6)
    common_part = [f"c{i}" for i in range(900)]
    texts = []
    for k in range(16):  # four share a signature by chance, more by the part that they have in common
        base = [f"w{k}x{i}" for i in range(1200)] + common_part
        texts.append(" ".join(base))
        if k % 4 == 0:
            for place in rng.sample(range(2000), 20):
                base[place] = "new"
            texts.append(" ".join(base))
    made = []
    plain = jaccard._remaining

    def remaining(*args):
        pairs = plain(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_remaining", remaining)
    rows = list(enumerate(texts))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
             jaccard.components_of(documents(rows), width=3, num=8, den=10).collect()}
    assert found == brute_components(rows, 3, 8, 10) and len(set(found.values())) < len(found)
    assert made == [0]  # 256 bits of the whole sets tell none of them apart


def test_blocks_are_judged_on_their_own(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    near = list(base)
    for place in rng.sample(range(3000), 80):
        near[place] = "new"
    rows = [(k, " ".join(t)) for k, t in enumerate((base, near))]
    frame = spark.createDataFrame(rows, "node bigint, text string")
    told = jaccard._signatures(frame, "node", "text", 3, 8, 10).collect()
    blocks = {(r["node"], r["own"], r["block"]): r["told"] for r in told if r["told"]}
    segments = {}
    for r in told:
        if not r["told"]:
            segments.setdefault((r["node"], r["own"], r["block"]), []).append(r["signature"])
    assert segments.keys() == blocks.keys() and len(blocks) > 8
    for key, (size, part, many, *sketch) in blocks.items():
        assert part == len(segments[key]) <= jaccard.BLOCK and len(sketch) == jaccard.SKETCH and size > 2900
        assert many == sum(len(v) for k, v in segments.items() if k[:2] == key[:2])
    # the hot segments of one block make deletions of that block alone
    hot = spark.createDataFrame([(0, rows[0][1], {2: 3}, {})], "node bigint, text string, hot_own map<int,bigint>, hot_below map<int,bigint>")
    exact = jaccard._deletions(hot, 3, 8, 10).collect()
    assert len(exact) == 6 and {(r["own"], r["block"]) for r in exact} == {(True, 2)}


def test_ids_of_two_texts_are_linked_by_either(documents):
    rng = random.Random(5)
    texts = [[f"t{t}w{rng.randrange(400)}" for _ in range(60)] for t in range(2)]
    rows = [(1, " ".join(texts[0])), (1, " ".join(texts[1])), (2, " ".join(texts[0][:-1] + ["x"])), (3, " ".join(texts[1][:-1] + ["y"])), (4, "none of these")]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.components_of(documents(rows), width=3, num=8, den=10).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("hot", [2, 6])
def test_large_groups_of_near_copies_against_brute_force(documents, hot):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for changes in (0, 1, 2, 3, 4, 5, 6, 8, 10, 12):
        base = [rng.choice(vocabulary) for _ in range(160)]
        for _ in range(24):
            own = list(base)
            for _ in range(rng.randrange(changes + 1)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own[rng.randrange(3):] if changes else own + [str(len(texts))]))
    rows = list(enumerate(texts))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
             jaccard.components_of(documents(rows), width=3, num=8, den=10, hot=hot).collect()}
    assert found == brute_components(rows, 3, 8, 10)


def test_staged_rows_leave_no_shuffle_files(spark):
    def files():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (found.apply(k).getName() for k in range(found.size())) if name.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(common._CLEAR, None)
    rows = common.staged(spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert sorted(r["count"] for r in rows.collect())[-1] == 1429
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(common._CLEAR, None) == setting


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = dict(common.components(frame, "a", "b").collect())
    assert all(found[i] == 0 for i in range(51)) and {found[100], found[95]} == {90}


def test_key_filter_lets_all_keys_pass(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("key_bits"))
    bits = common.key_filter(keys, "k")
    inside = {r["k"] for r in common.may_have(rows.drop("key_bits"), "k", bits).collect()}
    outside = {r["k"] for r in common.may_have(rows.drop("key_bits"), "k", bits, negate=True).collect()}
    assert set(range(0, 3000, 3)) <= inside and len(inside) < 1010 and inside | outside == set(range(3000)) and not inside & outside


def test_fingerprints(documents):
    rows = [(4, "the cat sat on the mat"), (1, "first words here and more of them"), (9, None), (2, ""), (2, ""), (30, "é漢 x"), (None, "none of it"),
            (31, "word " * 3_000), (40, "the cat sat on the mat")]
    found = simhash.edited_fingerprints(documents(rows, extra=True), buckets=4).collect()
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((i if i is not None else -1, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"]) for r in found]
    assert sorted(got) == sorted(want)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[4]["f"] == by_id[40]["f"] and by_id[1]["next_f"] == by_id[2]["f"] and by_id[40]["next_f"] == by_id[None]["f"]
    assert simhash.edited_fingerprints(documents([])).count() == 0


def test_votes_are_simhash(spark):
    row = spark.createDataFrame([(1, "one two three one two")], "k bigint, t string")
    hashed = row.select(F.explode(simhash._terms(F.col("t"))).alias("p")).select(
        F.xxhash64("p.w1", "p.w2"), F.least(F.length("p.w1") + F.coalesce(F.length("p.w2"), F.lit(0)), F.lit(simhash.HEAVIEST))).collect()
    want = 0
    for bit in range(64):
        if sum(w if (h >> bit) & 1 else -w for h, w in hashed) > 0:
            want |= 1 << bit
    assert simhash.votes(row, ["k"], "t").first()["fingerprint"] % (1 << 64) == want


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:30]:
        for flips in (1, 2, 3, 4):
            w = v
            for bit in rng.sample(range(64), flips):
                w ^= 1 << bit
            values.append(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed] + [(None,), (signed[0],)], "f bigint")
    found = {(r["query"] % (1 << 64), r["found"] % (1 << 64)) for r in simhash.within_radius(frame, frame).collect()}
    assert found == {(a, b) for a in values for b in values if bin(a ^ b).count("1") <= 3}


ITEM = "A train leaves Boston at 9 am and travels 120 km in 2 hours. How fast does the train go if Anna waits 15 minutes at the station?"


def test_leaks_with_other_slots(spark, documents):
    items = spark.createDataFrame(
        [(1, ITEM), (2, ITEM), (3, None), (None, "x"), (4, "too short"), (5, "seven words that nobody would ever say"), (6, "")],
        "item_id bigint, text string",
    )
    changed = ITEM.replace("Boston", "New York").replace("120", "3,450.5").replace("km", "miles").replace("Anna", "Bert").replace("15", "20")
    other_shape = "Every day leaves Paris at 7 pm and nothing else that the question says is here, 30 km off."
    twisted = ITEM.replace("120", "9").replace("9 am", "8 am")
    texts = ["prefix words " + ITEM + " and after", changed, other_shape, None, "", "prefix words " + ITEM + " and after", ITEM.upper(),
             "and so seven words that nobody would ever say to us", "words " * 9_000 + ITEM, twisted]
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(documents(texts, extra=True), items).collect()}
    assert {(0, 1), (1, 1), (5, 1), (6, 1), (7, 5), (8, 1), (9, 1)} == set(found)
    assert found[0, 1]["n_changed"] == 0 and found[1, 1]["n_changed"] >= 4 and found[0, 1]["covered"] == found[0, 1]["n_tokens"]
    kept = decontaminate.clean(documents(texts, extra=True), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and "signature" in kept.columns
    assert decontaminate.contaminated(documents([]), items).count() == 0
    assert decontaminate.contaminated(documents(texts), items.limit(0)).count() == 0


SHORT_AND_DENSE = [
    "What is 12 + 30 * 4?", "too short", "Paris", "1, 2, 4, 8, 16, 32, 64, 128, 256, 512 and then 1024 2048 4096 8192", "3 km 4 kg 5 ml",
    "小明有三个苹果，他又买了五个苹果，现在一共有几个苹果？", "แมวกินปลา", "東京の人口は何人ですか", "天",
    "5 6 7 8 9 then in the end we all go home 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6",
]


def test_leaks_of_short_dense_and_blankless_items(spark, documents):
    items = spark.createDataFrame(list(enumerate(SHORT_AND_DENSE)), "item_id bigint, text string")
    around = [f"some words before {t} and after {t}" for t in SHORT_AND_DENSE] + ["据说" + t + "是的" for t in SHORT_AND_DENSE[5:9]]
    others = ["What is 13 + 30 * 4?", "too long, short", "1, 2, 4, 8, 16, 32, 64, 128, 256, 512 and then", "小红有三个梨", "...", None]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents(around + others), items).collect()}
    n = len(SHORT_AND_DENSE)
    assert found == {(i, i) for i in range(n)} | {(n + i, 5 + i) for i in range(4)}


def test_leaks_whose_names_begin_sentences(spark, documents):
    item = "Tom has 3 red marbles. Ann gives Tom 4 more. How many marbles does Tom have now?"
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    other = item.replace("Tom", "Ben").replace("Ann", "Sue").replace("3", "5").replace("4", "6")
    mixed = other.replace("gives Ben", "gives Kim").replace("does Ben", "does Lea")
    unlike = "Mia has 3 red apples. Sue eats Lea 4 times. How many houses does Kim see now?"
    texts = [item, "Read this. " + other + " And so on.", mixed, unlike, "He said: " + other]
    found = {r["doc_id"]: r for r in decontaminate.contaminated(documents(texts), items).collect()}
    assert set(found) == {0, 1, 4} and found[1]["covered"] == found[1]["n_tokens"] == 17 and found[1]["n_changed"] == 4


def test_slots_have_to_be_consistent(spark, documents):
    item = "if 5 boxes hold 5 red balls and each of the 5 girls takes 5 balls home then how many are left"
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    same = item.replace("5", "8")
    mixed = item.replace("5 boxes", "1 boxes").replace("5 red", "2 red").replace("5 girls", "3 girls").replace("5 balls", "4 balls")
    assert [r["doc_id"] for r in decontaminate.contaminated(documents([same, mixed]), items).collect()] == [0]


def test_leaks_of_the_table(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontaminate(spark, folder).collect()}
    assert found == {(d, i) for d, t in docs for i, x in items if x in t}


def test_licenses(documents):
    apache, mit = licenses.TEMPLATES[0][1], licenses.TEMPLATES[3][1]
    filler = "some other text of no meaning that goes on and on for a while "
    texts = [apache, filler + apache.upper().replace(" ", "\n * ") + " " + filler, None, "", "license", filler * 3 + mit, mit.replace("free of charge", "for free"),
             filler, apache + " " + apache, filler * 2_000 + mit, "licensed under some other license version 9"]
    found = defaultdict(dict)
    for r in licenses.scan(documents(texts, extra=True)).collect():
        found[r["doc_id"]][r["license"]] = r["containment"]
    assert found == {0: {"Apache-2.0": 1.0}, 1: {"Apache-2.0": 1.0}, 5: {"MIT": 1.0}, 8: {"Apache-2.0": 1.0}, 9: {"MIT": 1.0}}
    assert licenses.scan(documents([])).count() == 0


def test_licenses_at_every_offset_with_insertions(documents):
    """A template with as many words put in after its third as its own, or a few further in, at each offset to the windows."""
    texts, want = [], []
    for number, (name, text) in enumerate(licenses.TEMPLATES):
        words = re.findall("[a-z0-9]+", text.lower())
        share = lambda own: sum(words[i: i + 5] in [own[k: k + 5] for k in range(len(own))] for i in range(len(words) - 4)) / (len(words) - 4)
        for put in ([], *([f"x{k}" for k in range(size)] for size in (2, len(words) // 2))):
            for place in {1, len(words) // 2} if put else {0}:
                own = words[:place] + put + words[place:]
                for offset in range(len(words) // 4 + 1):
                    texts.append(" ".join([f"f{k}" for k in range(60 + offset)] + own + ["end"] * 60))
                    want.append((name, share(own)))
    found = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(documents(texts)).collect()}
    for i, (name, share) in enumerate(want):
        if share >= licenses.LEAST:
            assert found[i, name] >= share - 1e-9, texts[i]
    notice = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation ' \
             'files (the "Software"), to deal in the Software without restriction'
    rows = licenses.scan(documents([" ".join(["w"] * k) + " " + notice for k in range(40)])).collect()
    assert {r["doc_id"]: r["containment"] for r in rows} == dict.fromkeys(range(40), 1.0)


def test_licenses_of_the_table(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    flat = lambda t: " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "
    want = {(r["doc_id"], name) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
            for name, text in licenses.TEMPLATES if flat(text) in flat(r["text"])}
    assert {(r["doc_id"], r["license"]) for r in queries.op4_license_scan(spark, folder).collect()} == want


def test_token_counts(spark, tmp_path):
    frame = spark.createDataFrame(
        [("a", "en", "one two"), ("a", "en", None), (None, "de", "x"), ("b", None, " y  z "), ("b", None, "")], "source string, lang string, text string"
    ).withColumn("tokens", F.lit(99))
    words, state = token_counts.word_count(F.col("text")), str(tmp_path / "state")
    assert token_counts.totals(spark, state).count() == 0

    def now():
        return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in token_counts.totals(spark, state).collect()}

    assert token_counts.apply_batch(spark, state, "1", token_counts.inserts(frame, words, "w"))
    first = now()
    assert first == {("a", "en", "w"): (2, 2), (None, "de", "w"): (1, 1), ("b", None, "w"): (2, 2)}
    assert not token_counts.apply_batch(spark, state, "1", token_counts.inserts(frame, words, "w")) and now() == first
    token_counts.apply_batch(spark, state, "2", token_counts.revisions(frame, words, "w", words * 3, "t"))
    assert now() == {("a", "en", "t"): (2, 6), (None, "de", "t"): (1, 3), ("b", None, "t"): (2, 6)}
    token_counts.apply_batch(spark, state, "3", token_counts.deletes(frame.where("source = 'a'"), words * 3, "t"))
    token_counts.apply_batch(spark, state, "4", token_counts.deletes(frame.limit(0), words, "t"))
    assert now() == {(None, "de", "t"): (1, 3), ("b", None, "t"): (2, 6)}
    # a batch that failed before its success mark counts only once it is sent again
    (tmp_path / "state" / "batches" / "5").mkdir()
    assert token_counts.committed(spark, state) == ["1", "2", "3", "4"]
    assert token_counts.apply_batch(spark, state, "5", token_counts.inserts(frame, words, "w"))


def test_token_counts_of_the_table(spark, sf):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.public_tokenizers.path(queries.TOKENIZER))
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want, seen = defaultdict(lambda: [0, 0]), set()
    for r in docs:
        own = want[r["source"], r["lang"], "words-1"]
        own[0] += 1
        own[1] += len(words_of(r["text"]))
        if r["text"] not in seen:
            seen.add(r["text"])
            own = want[r["source"], r["lang"], "byte_bpe_50k"]
            own[0] += 1
            own[1] += len(library.encode(r["text"], add_special_tokens=False).ids)
    found = {(r["source"], r["lang"], r["version"]): [r["n_docs"], r["n_tokens"]] for r in queries.op5_token_counts(spark, sf).collect()}
    assert found == {k: v for k, v in want.items() if v != [0, 0]}
