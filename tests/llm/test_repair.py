"""Repair of conversations, against dynamic programming over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from hedgerow.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def dp(rows):
    """(cost, audit) of the cheapest edits, ASCII-least, by the best prefix for each state."""
    need = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                own = (cost + 3, audit + "I")
                if need[state] not in best or own < best[need[state]]:
                    best[need[state]] = own
        return best

    best = {"": (0, "")}
    for role, _, fault in rows:
        now = {}

        def put(state, cost, audit):
            if state not in now or (cost, audit) < now[state]:
                now[state] = (cost, audit)

        for state, (cost, audit) in inserted(best).items():
            put(state, cost + 4, audit + "D")
            if fault not in ("blank", "duplicate"):
                cost += 3 * (fault == "truncated")
                put(need[state], cost + 3, audit + "R")
                if role[:1] == need[state] or (role[:1] == "s" and state == ""):
                    put(role[:1], cost, audit + "K")
        best = now
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows):
    by_conv = defaultdict(list)
    for row in damaged(rows):
        by_conv[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(by_conv[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked = set(), []
        for _, _, role, text in own:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit = dp(marked) if marked else (0, "")
        kept, at, last = [], 0, ""
        for edit in audit:
            role, text, _ = marked[at] if edit != "I" else ("", "", "")
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            kept.append(f"{role}:{text}")
            last = role[:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(k[:1] for k in kept))
        turns = [t for _, t, _, _ in own if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        faults = [f for _, _, f in marked]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


def compare(frame, rows):
    got = frame.collect()
    found = {r[0]: tuple(r)[1:] for r in got}
    assert len(got) == len(found)
    want = brute(rows)
    assert found.keys() == want.keys()
    for conv in want:
        assert found[conv] == want[conv], conv


def made(seed, sizes):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "unfinished", " ", "", None, "é ends.  ", "tail\n", "ok.\x0b", "\xa0", "a b c."]
    rows = []
    for conv, n in enumerate(sizes):
        for k in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            role = "system" if k == 0 and rng.random() < 0.5 else rng.choice(["system", "tool", "", None]) if rng.random() < 0.06 else role
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randrange(400)}{rng.choice(['.', '.', '!', ''])}"
            turn = None if rng.random() < 0.03 else rng.choice([k, k, k, k + 1, k - 1])
            rows.append((None if conv == 3 else conv - 1, turn, role, text))
    return rows


@pytest.mark.parametrize("block", [repair.BLOCK, 3])
def test_against_dynamic_programming(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(2)
    rows = made(4, [rng.randrange(1, 14) for _ in range(150)] + [300 if block > 3 else 70, 1, 1, 1])
    compare(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA).repartition(4)), rows)


def test_hot_conversation_of_equal_rows(spark):
    rows = [(1, 5, "user", "same.")] * 300 + [(1, 6, "assistant", "so.")] + [(2, k, "user", "same.") for k in range(150)]
    compare(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA)), rows)


def test_odd_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_damaged(none).count() == 0
    rows = [(1, None, None, None), (2, None, "user", "a."), (2, None, "assistant", "b."), (None, None, "user", "x " * 100_000 + "."),
            (-(2**63), 2**62, "system", "s."), (-(2**63), -(2**62), "user", "u.")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS block", "3 AS place", "'x' AS copies", "1 AS fault")
    compare(repair.repair_damaged(frame), rows)


def test_prices_are_distances():
    rng = random.Random(6)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randrange(1, 8))]
        got = repair.distances(rows)
        cost, audit, _ = repair.Lattice(rows, repair.ENDS, True).cheapest(repair.START)
        faults = ["", "blank", "duplicate", "truncated"]
        assert (cost, audit) == dp([(i, "", faults[f]) for i, f in rows])
        ends = (0, 2 * repair.INSERT, repair.INSERT, 0)
        assert cost == min(got[e] + ends[e] for e in range(4))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op12_repair(spark, sf), rows)
