"""Repair of a conversation's structure by an auction for the cheapest edits.

A conversation's rows, in order of turn, have to become an optional system turn and then user and assistant in turns, or
nothing. Rows are kept, given another role or deleted, and empty turns inserted, each at an integer cost. Nodes of the
lattice are (rows read, role expected next); arcs are edits.

`Lattice.cheapest` is the auction algorithm for one path: every node has a price, 0 at first. The end of the path looks at
its arcs; if each costs more than the node's price (cost plus price of the next node), the price rises to the least of them
and the path contracts by that node, otherwise it is extended along the first arc, in ASCII order of the edits, that costs
the price. Prices never pass the true distances, so the path that reaches the end is a cheapest one, and the prices along it
are distances. A node's price does not change after the path left it for the last time, while others rise, so an arc passed
over then is not tight now: the path is the ASCII-least of all cheapest ones.

Long conversations. Rows are sorted by range, so that a conversation with a third of all rows lies in many partitions, and
cut into blocks of BLOCK rows. The auction gives each block's distances between the states at its ends; one pass from the
last block to the first adds them up to the price of each state at each end; with these as prices of its end, every block is
traced on its own, from each state it may begin with; one pass from the first block to the last picks the traces. No task
holds more of a conversation than a block, but for the audit, which is a value of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.llm.common import staged

#: Rows of a block; a conversation of no more rows is a block of its own.
BLOCK = 64
#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60

#: What may come next: at the start, after the system turn, after the user, after the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (0, FAR, FAR, 0)  # nothing, or after an assistant

NO_FAULT, BLANK, DUPLICATE, CUT = range(4)


def _arcs(initial: str, fault: int, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(edit, cost, rows read, state after) of a node, in order of the edits' letters."""
    after = _NEXT[state]
    extra = TRUNCATED if fault == CUT else 0
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, after)]
    if fault not in (BLANK, DUPLICATE):
        if initial == "s" and state == START:
            out.append(("K", extra, 1, SYSTEM))
        elif initial == ("u" if after == USER else "a"):
            out.append(("K", extra, 1, after))
        out.append(("R", REROLE + extra, 1, after))
    return tuple(out)


_TABLE = {(i, f, s): _arcs(i, f, s) for i in ("s", "u", "a", "") for f in range(4) for s in range(4)}


class Lattice:
    """Rows (initial of the role, fault), and what each state costs at the end; empty turns may follow the last row if `last`."""

    def __init__(self, rows: list[tuple[str, int]], ends, last: bool) -> None:
        self.size, self.ends = len(rows), ends
        self.arcs = [[_TABLE[i if i in ("s", "u", "a") else "", f, s] for s in range(4)] for i, f in rows]
        inserts = [(("I", INSERT, 0, _NEXT[s]),) if last else () for s in range(4)]
        self.arcs.append(inserts)
        self.prices = [[0] * 4 for _ in range(self.size + 1)]
        #: No finite distance is longer: all rows deleted, turns inserted at both ends, the dearest end.
        self.bound = DELETE * self.size + 4 * INSERT + max((e for e in ends if e < FAR), default=0)

    def cheapest(self, state: int) -> tuple[int, str, int] | None:
        """(cost, edits, state at the end), from that state on, or None. Prices stay for the next call."""
        prices, arcs, ends, size = self.prices, self.arcs, self.ends, self.size
        path, edits = [(0, state)], []
        while True:
            at, own = path[-1]
            best, chosen = FAR, None
            for arc in arcs[at][own]:
                cost = arc[1] + prices[at + arc[2]][arc[3]]
                if cost < best:
                    best, chosen = cost, arc
            if at == size and ends[own] < best:  # the end, which no edit ties with: an inserted turn would have to be undone
                best, chosen = ends[own], None
            if best > self.bound:
                best = FAR
            if prices[at][own] < best:
                prices[at][own] = best
                if len(path) > 1:
                    path.pop()
                    edits.pop()
                elif best == FAR:
                    return None
            elif best == FAR:
                return None
            elif chosen is None:
                return prices[0][state], "".join(edits), own
            else:
                edits.append(chosen[0])
                path.append((at + chosen[2], chosen[3]))


def distances(rows: list[tuple[str, int]]) -> list[int]:
    """Costs from each state before the rows to each state after them, row by row; FAR where there is no way."""
    out = [FAR] * 16
    for end in range(4):
        lattice = Lattice(rows, tuple(0 if s == end else FAR for s in range(4)), last=False)
        for state in range(4):
            found = lattice.cheapest(state)
            if found is not None:
                out[4 * state + end] = found[0]
    return out


def apply_edits(rows: list[tuple[str, str]], edits: str, state: int) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits."""
    out, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        role, text = rows[at] if edit != "I" else ("", "")
        if edit == "K" and state == START and role[:1] == "s":
            state = SYSTEM
        else:
            state = _NEXT[state]
            if edit != "K":
                role = "user" if state == USER else "assistant"
        out.append((role, text))
        at += edit != "I"
    return out


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the checksum of `conv_id:turn`, as the contract says; nulls are a blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    code = F.col("code")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.encode(key, "UTF-8")) % 20).alias("code")).where(
        "code != 0"
    ).select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _own_fault() -> Column:
    """Blank or cut; whether a row is a duplicate depends on others."""
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(NO_FAULT)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) in blocks: conv_id, part, block, place, turn, role, text, copies, fault, whole.

    (part, block, place) is the order of a conversation: by turn (null first), then role and text. `copies` equal rows are
    one, BLOCK at most; `fault` is that of the first of them. `whole`: the block is its whole conversation.
    """
    equal = staged(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    said = equal.groupBy("conv_id", "role", F.md5("text").alias("said")).agg(
        F.bool_or(F.isnull("turn")).alias("untimed"), F.min("turn").alias("earliest"), F.count("*").alias("times")
    ).where("times > 1").select(F.col("conv_id").alias("of"), F.col("role").alias("by"), "said", "untimed", "earliest")
    again = F.col("said").isNotNull() & F.col("turn").isNotNull() & (F.col("untimed") | (F.col("turn") > F.col("earliest")))
    own = _own_fault()
    marked = equal.withColumn("key", F.md5("text")).join(
        said, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("key") == F.col("said")), "left"
    ).select(
        "conv_id", "turn", "role", "text", "copies",
        F.when((own != BLANK) & again, DUPLICATE).otherwise(own).alias("fault"),
    )
    # many copies are several rows, whose first ones are copies, too
    cut = marked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {BLOCK}"))).alias("nth")).select(
        "conv_id", "turn", "role", "text", "nth", F.least(F.col("copies") - F.col("nth") * BLOCK, F.lit(BLOCK)).alias("copies"),
        F.when((F.col("nth") > 0) & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")).alias("fault"),
    )
    order = ("conv_id", "turn", "role", "text", "nth")
    ordered = staged(
        staged(cut, "marked").repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv_id", "turn", "role", "text", "copies", "fault", F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        ), "ordered",
    )
    # one row for each partition
    edges = ordered.groupBy(F.col("part").alias("of_part")).agg(F.max("place").alias("last_place"))
    own_part = Window.partitionBy("conv_id", "part")
    so_far = F.sum("copies").over(own_part.orderBy("place"))
    whole = (F.min("place").over(own_part) > 0) & (F.max("place").over(own_part) < F.col("last_place"))
    return ordered.join(F.broadcast(edges), ordered.part == edges.of_part).select(
        "conv_id", "part", ((so_far - F.col("copies")) / BLOCK).cast("long").alias("block"), "place", "turn", "role", "text",
        "copies", "fault", (whole & (F.sum("copies").over(own_part) <= BLOCK)).alias("whole"),
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows with equal first columns that follow each other, across batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _unrolled(rows: list[tuple]) -> tuple[list[tuple[str, int]], list[tuple[str, str]], list[int | None]]:
    """Lattice rows, (role, text) and turns of (turn, role, text, copies, fault), each copy on its own."""
    lattice, said, turns = [], [], []
    for turn, role, text, copies, fault in rows:
        lattice += [(role[:1], fault)] + [(role[:1], BLANK if fault == BLANK else DUPLICATE)] * (copies - 1)
        said += [(role, text)] * copies
        turns.append(turn)
    return lattice, said, turns


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_IN_ORDER = ("conv_id", "part", "block", "place")
_FIELDS = ("conv_id", "part", "block", "turn", "role", "text", "copies", "fault")


def _block_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches, 3):
        lattice = _unrolled([r[3:8] for r in rows])[0]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("conv_id", "part", "block"), rows[0][:3]), costs=distances(lattice))],
            schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))]),
        )


class _Backwards:
    """Carries the prices from one block to the one before it."""

    def __init__(self) -> None:
        self.conv, self.prices = object(), ENDS

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, last = [], []
        for conv, costs in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            final = conv != self.conv
            if final:
                # turns may be inserted after the last row
                self.conv, self.prices = conv, (0, 2 * INSERT, INSERT, 0)
            ends.append(ENDS if final else self.prices)
            last.append(final)
            self.prices = tuple(
                min(FAR, *(costs[4 * s + e] + self.prices[e] for e in range(4))) for s in range(4)
            )
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([list(e) for e in ends], pa.list_(pa.int64())), pa.array(last)],
            names=["conv_id", "part", "block", "ends", "last"],
        )


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    carried = _Backwards()
    for batch in batches:
        yield carried.of(batch)


_TRACE = pa.struct([("state", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()),
                    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_PART = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("traces", pa.list_(_TRACE)),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()),
])
PARTS = (
    "conv_id bigint, part int, block bigint, traces array<struct<state: int, after: int, cost: bigint, audit: string, "
    "roles: array<string>, texts: array<string>>>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first string, last string, turns bigint, least bigint, most bigint"
)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for rows in _runs(batches, 3):
        (conv, part, block), (ends, final, whole) = rows[0][:3], rows[0][8:11]
        lattice, said, turns = _unrolled([r[3:8] for r in rows])
        lattice_ = Lattice(lattice, ENDS if whole else tuple(ends), last=whole or final)
        traces = []
        for state in (START,) if whole else range(4):
            found = lattice_.cheapest(state)
            if found is not None:
                cost, audit, after = found
                kept = apply_edits(said, audit, state)
                traces.append({
                    "state": state, "after": after, "cost": cost - lattice_.ends[after], "audit": audit,
                    "roles": [r for r, _ in kept], "texts": [t for _, t in kept],
                })
        initials = [i for i, _ in lattice]
        faults = [f for _, f in lattice]
        timed = [t for t in turns if t is not None]
        out.append({
            "conv_id": conv, "part": part, "block": block, "traces": traces, "blank": faults.count(BLANK),
            "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": sum(pair not in _LEGAL for pair in zip(initials, initials[1:])), "first": initials[0],
            "last": initials[-1], "turns": len(set(timed)), "least": min(timed, default=None), "most": max(timed, default=None),
        })
        size += sum(len(t["texts"]) for t in traces) + 1
        if size > 5_000:
            yield pa.RecordBatch.from_pylist(out, schema=_PART)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema=_PART)


def repaired_parts(rows: DataFrame) -> DataFrame:
    """Blocks of conversations (PARTS): how each is repaired from the states that it may begin with, and its counts.

    `rows` are (conv_id, turn, role, text, copies). `traces` holds one entry for each such state: the state after it, cost,
    audit, and roles and texts of the repaired turns. The first block of a conversation begins with START.
    """
    blocks = staged(dealt(rows), "blocks")
    in_order = blocks.repartition("conv_id", "part", "block").sortWithinPartitions(*_IN_ORDER)
    costs = in_order.where("NOT whole").select(*_FIELDS).mapInArrow(
        _block_distances, "conv_id bigint, part int, block bigint, costs array<bigint>"
    )
    prices = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block")).mapInArrow(
        _priced, "conv_id bigint, part int, block bigint, ends array<bigint>, last boolean"
    ).select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.col("block").alias("of_block"), "ends", "last")
    met = blocks.join(
        prices, blocks.conv_id.eqNullSafe(prices.of) & (blocks.part == prices.of_part) & (blocks.block == prices.of_block), "left"
    )
    return met.repartition("conv_id", "part", "block").sortWithinPartitions(*_IN_ORDER).select(
        *_FIELDS, "ends", "last", "whole"
    ).mapInArrow(_traced, PARTS)


class _Joined:
    """One conversation's result, block by block."""

    def __init__(self, conv: int | None) -> None:
        self.row = {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        self.state, self.audit, self.digest, self.empty = START, [], hashlib.sha256(), True
        self.last, self.turns, self.least, self.most = None, 0, None, None

    def add(self, part: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.row[name] += part[name]
        self.row["illegal"] += self.last is not None and (self.last, part["first"]) not in _LEGAL
        self.last = part["last"]
        if part["turns"]:
            self.turns += part["turns"] - (self.most == part["least"])  # a turn may lie in two blocks
            self.least = part["least"] if self.least is None else self.least
            self.most = part["most"]
        own = next(t for t in part["traces"] if t["state"] == self.state)
        self.state = own["after"]
        self.row["cost"] += own["cost"]
        self.audit.append(own["audit"])
        for role, text in zip(own["roles"], own["texts"], strict=True):
            self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

    def result(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.row | {"gaps": gaps, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


_RESULT = pa.schema([
    ("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joined: _Joined | None = None
    for batch in batches:
        out = []
        for part in batch.to_pylist():
            if joined is None or joined.row["conv_id"] != part["conv_id"]:
                if joined is not None:
                    out.append(joined.result())
                joined = _Joined(part["conv_id"])
            joined.add(part)
        yield pa.RecordBatch.from_pylist(out, schema=_RESULT)
    if joined is not None:
        yield pa.RecordBatch.from_pylist([joined.result()], schema=_RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `rows` (conv_id, turn, role, text, copies): RESULT.

    Turns may be null (they come first), repeated or missing (`gaps`); equal rows of a turn are copies of each other; a null
    conversation is one. Roles and texts must not be null. `repaired_sha256` is the digest of `role:text`, joined by line ends;
    the texts themselves are in `repaired_parts`. A table without rows gives none.
    """
    return (
        repaired_parts(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_picked, RESULT)
    )


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """`repair` of the damaged rows, with a row for every conversation, also one that has no rows left."""
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct()
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, every.conv_id.eqNullSafe(found.of), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
