"""Removal of repeated passages by a column-wise built Burrows-Wheeler transform.

A byte goes when a string of `size` bytes that covers it also starts earlier. Every start of such a string (a window) is
dealt to a collection in which all windows equal to it lie, too; a collection's transform and common prefixes are built by
columns, and neighbours in its suffix order with a common prefix of `size` are equal windows.

1. *Keys.* A window's key is the least hash of the strings of ANCHOR bytes in it, so equal windows have equal keys, and a
   run of windows with one key is a *piece* of text. Spark counts the places where each key stands; windows whose key
   stands once cannot repeat. What is left is a bitmap of bounded size (false positives cost work only).
2. *Copies.* A second pass takes the pieces whose key passes the bitmap, as a hash of their bytes. Equal ones of a batch of
   texts are settled there (all but the first are repeated bytes), so a group of copies sends one row for each batch; the
   others meet by key, where equal pieces are settled, too. Most keys then have one text, which nothing else shares.
3. *Collections.* A third pass cuts the text of the pieces of contested keys: those with different pieces, or with a piece in
   which the key's string stands twice. Of equal pieces only the first has its text moved: a second bitmap, of hashes of the
   different pieces' keys and places, tells it (again false positives cost work only). They are partitioned by key and sorted. A collection is a run of whole keys with at
   most COLLECTION different pieces (more only for a single key, below HOT). `Collection` inserts one symbol of every piece
   in each round, from the right end, and reads and writes its transform and its common prefixes in order, as one file each.
   There are at most size + RUN - 1 rounds, whatever the corpus. A hot key (it stands HOT times or more) is split: in both
   passes its windows are pieces of their own, each with a key of its own.
4. *Documents.* Spans meet their document by its id and a hash of its text; the rest is joined again. Documents that surely
   have no span are not moved.

The files of a collection are arrays of a task: the folder of a task's machine must not be used, and a Spark job for each of
163 rounds would read the same bytes from the shared folder 163 times. Pieces, spans and texts, which grow with the corpus,
are Spark's tables and shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import LEADING_BITS as BITS
from hedgerow.llm.common import has_leading as _held
from hedgerow.llm.common import key_filter, may_have, mix, staged
from hedgerow.llm.common import leading_bitmap as _bitmap

#: Bytes whose hash is a candidate for a window's key.
ANCHOR = 40
#: Windows of a piece; a longer run of one key is cut.
RUN = 64
#: Places of a key from which its windows are dealt one by one.
HOT = 20_000
#: Different pieces of a collection.
COLLECTION = 20_000
#: Bytes of text whose hashes are held at a time.
CHUNK = 1 << 20

_CODES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_END = 255  # no byte of UTF-8


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or binaries) one after the other, and the n + 1 places where they start."""
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[starts[0]: starts[-1]], starts - starts[0]


class _Hashes:
    """Hashes of any substring of `data` that depend on its bytes only."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.back = np.full(n + 1, _UNBASE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        powers = np.full(n, _BASE, np.uint64)
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        powers *= _CODES[data]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(powers, out=self.sums[1:])

    def all_of(self, size: int) -> np.ndarray:
        """Of every substring of that many bytes."""
        last = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:last]) * self.back[:last])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """`least` (np.minimum or np.maximum) of every `width` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = least(values[:-step], values[step:])
        done += step
    return values


def _chunks(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts, row, offset): texts with a window, about CHUNK bytes at a time.

    `starts` are the n + 1 places of the parts in `data`; a part is a whole text, or CHUNK starts of a longer one with the
    size - 1 bytes after them; `offset` is where it lies in text number `row`.
    """
    data, places = _bytes_of(column)
    lengths = np.diff(places)
    row = np.flatnonzero(lengths >= size)
    parts = (lengths[row] - size) // CHUNK + 1
    offset = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK
    row = np.repeat(row, parts)
    length = np.minimum(lengths[row] - offset, CHUNK + size - 1)
    begin, done = 0, np.cumsum(length)
    while begin < len(row):
        end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + CHUNK, side="right")))
        own = [data[places[r] + o: places[r] + o + n] for r, o, n in zip(row[begin:end], offset[begin:end], length[begin:end])]
        starts = np.concatenate(([0], np.cumsum(length[begin:end])))
        yield (own[0] if len(own) == 1 else np.concatenate(own)), starts, row[begin:end], offset[begin:end]
        begin = end


def _windows(starts: np.ndarray, total: int, size: int) -> np.ndarray:
    """For each start of a window in the joined parts: whether it lies in one part."""
    whole = np.ones(total - size + 1, bool)
    for cut in starts[1:-1].tolist():
        whole[max(cut - size + 1, 0): cut] = False
    return whole


def _key_places(size: int):
    """Batches of texts to one row for every place where a window's key stands."""
    anchor = min(ANCHOR, size)
    width = size - anchor + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, _, _ in _chunks(batch.column(0), size):
                hashes = _Hashes(data).all_of(anchor)
                keys = _sliding(hashes, width, np.minimum)
                keys[~_windows(starts, len(data), size)] = 0  # no window: never above a hash
                padded = np.concatenate((np.zeros(width - 1, np.uint64), keys, np.zeros(width - 1, np.uint64)))
                stands = hashes[_sliding(padded, width, np.maximum) == hashes]
                yield pa.RecordBatch.from_arrays([pa.array(stands.view(np.int64))], names=["key"])

    return work


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of all bytes of the runs at `start`, one run after the other."""
    end = np.cumsum(length)
    return np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)


class _Pieces:
    """Pieces of text in columns: where each stands, its key, its bytes, a hash of them, and whether its key stands in it twice."""

    def __init__(self, known, doc, text, start, key, data, length, content=None, twice=None) -> None:
        self.known, self.doc, self.text, self.start, self.key = known, doc, text, start, key
        self.data, self.length = data, length
        self.content = np.zeros(len(length), np.uint64) if content is None else content
        self.twice = np.zeros(len(length), bool) if twice is None else twice
        self.begin = np.cumsum(length) - length

    @staticmethod
    def joined(parts: list[_Pieces]) -> _Pieces:
        names = ("known", "doc", "text", "start", "key", "data", "length", "content", "twice")
        return _Pieces(*(np.concatenate([getattr(p, name) for p in parts]) for name in names))

    def __len__(self) -> int:
        return len(self.length)

    def take(self, index: np.ndarray) -> _Pieces:
        length = self.length[index]
        data = self.data[_spread(self.begin[index], length)]
        return _Pieces(
            self.known[index], self.doc[index], self.text[index], self.start[index], self.key[index], data, length,
            self.content[index], self.twice[index],
        )

    def same_text(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of pieces: whether their bytes are equal."""
        equal = self.length[a] == self.length[b]
        at, to, size = self.begin[a][equal], self.begin[b][equal], self.length[a][equal]
        if len(at):
            equal[equal] = np.logical_and.reduceat(self.data[_spread(at, size)] == self.data[_spread(to, size)], np.cumsum(size) - size)
        return equal

    def same_place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (
            (self.known[a] == self.known[b]) & (self.doc[a] == self.doc[b])
            & (self.text[a] == self.text[b]) & (self.start[a] == self.start[b])
        )

    def binaries(self, index: np.ndarray) -> list[pa.Array]:
        """Columns of PIECES."""
        own = self.take(index)
        ends = np.concatenate(([0], np.cumsum(own.length))).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(own.data.tobytes())])
        return [
            pa.array(own.key.view(np.int64)), binary, pa.array(own.doc, mask=~own.known), pa.array(own.text), pa.array(own.start),
            pa.array(own.twice),
        ]

    def spans(self, index: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[pa.Array]:
        """Columns of ROWS of repeated bytes: `size` bytes from `first` on of the pieces `index`; runs that touch are joined."""
        start = self.start[index] + first
        order = np.lexsort((start, self.text[index], self.doc[index], self.known[index]))
        index, start, size = index[order], start[order], size[order]
        other = np.ones(len(index), bool)
        other[1:] = ~((self.known[index[1:]] == self.known[index[:-1]]) & (self.doc[index[1:]] == self.doc[index[:-1]])
                      & (self.text[index[1:]] == self.text[index[:-1]]))
        lift = (np.cumsum(other) - 1) << 40  # a text ends before the next one begins
        reach = np.maximum.accumulate(start + size + lift)
        fresh = other.copy()
        fresh[1:] |= (start + lift)[1:] > reach[:-1]
        heads = np.flatnonzero(fresh)
        tails = np.concatenate((heads[1:], [len(index)])) - 1 if len(heads) else heads
        own = index[heads]
        return [
            pa.array(self.doc[own], mask=~self.known[own]), pa.array(self.text[own]), pa.array(start[heads]), pa.array((reach - lift)[tails]),
        ]


#: Repeated bytes of a text.
SPANS = "doc_id bigint, text_hash bigint, start bigint, end bigint"
#: The same, or (`end` null) a piece: its key, a hash of its bytes, how many those are, and whether the key stands in it twice.
COPIES = "key bigint, content bigint, " + SPANS + ", length bigint, twice boolean"
PIECES = "key bigint, piece binary, doc_id bigint, text_hash bigint, start bigint, twice boolean"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _batch(columns: list[pa.Array], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=_names(schema))


def _nulls(n: int, kind=pa.int64()) -> pa.Array:
    return pa.nulls(n, kind)


def _mark(key: np.ndarray, known: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each piece's key and place."""
    place = mix(doc.astype(np.uint64) + known.astype(np.uint64)) ^ text.astype(np.uint64)
    return mix(mix(place + key) + start.astype(np.uint64))


def _cut(column: pa.Array, size: int, wanted: np.ndarray, hot: np.ndarray, marks: np.ndarray | None, known, doc, text) -> Iterator[_Pieces]:
    """Pieces of the texts whose key passes the bitmap `wanted`; those whose key passes `hot` as single windows.

    With `marks`, only those whose mark passes that bitmap.
    """
    anchor = min(ANCHOR, size)
    for data, starts, row, offset in _chunks(column, size):
        hashes = _Hashes(data)
        anchors = hashes.all_of(anchor)
        keys = _sliding(anchors, size - anchor + 1, np.minimum)
        whole = _windows(starts, len(data), size)
        head = whole.copy()
        head[1:] &= ~whole[:-1] | (keys[1:] != keys[:-1])
        begin = np.flatnonzero(head)
        stop = np.concatenate((begin[1:], [len(keys)]))
        stop = np.minimum(stop, (starts[1:] - size + 1)[np.searchsorted(starts, begin, side="right") - 1])
        taken = _held(wanted, keys[begin])
        begin, count = begin[taken], (stop - begin)[taken]
        alone = _held(hot, keys[begin])
        step = np.where(alone, 1, RUN)
        parts = (count - 1) // step + 1
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        step, alone = np.repeat(step, parts), np.repeat(alone, parts)
        at = np.repeat(begin, parts) + nth * step
        count = np.minimum(np.repeat(count, parts) - nth * step, step)
        key = keys[at]
        key[alone] = mix(hashes.of(at[alone], at[alone] + size) + np.uint64(1))
        length = count + size - 1
        part = np.searchsorted(starts, at, side="right") - 1
        own = row[part]
        if marks is not None:
            kept = _held(marks, _mark(key, known[own], doc[own], text[own], at - starts[part] + offset[part]))
            at, key, length, part, own = at[kept], key[kept], length[kept], part[kept], own[kept]
        if len(at):
            twice = np.add.reduceat(anchors[_spread(at, length - anchor + 1)] == np.repeat(key, length - anchor + 1),
                                    np.cumsum(length - anchor + 1) - length + anchor - 1, dtype=np.int64) > 1
            yield _Pieces(
                known[own], doc[own], text[own], at - starts[part] + offset[part], key, data[_spread(at, length)], length,
                hashes.of(at, at + length), twice & (length > size),
            )


def _equal_pieces(pieces: _Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of equal pieces, places of the others that stand elsewhere)."""
    own = pieces.content
    order = np.lexsort((pieces.start, pieces.text, pieces.doc, pieces.known, own))
    head = np.ones(len(order), bool)
    head[1:] = own[order[1:]] != own[order[:-1]]
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    copy = np.flatnonzero(~head)
    copy = copy[pieces.same_text(order[copy], first[copy])]
    later = copy[~pieces.same_place(order[copy], first[copy])]
    stays = np.ones(len(order), bool)
    stays[copy] = False
    return order[stays], order[later]


def _settle(pieces: _Pieces) -> Iterator[pa.RecordBatch]:
    """COPIES: the first of equal pieces, and the bytes of the others as spans."""
    stays, later = _equal_pieces(pieces)
    n = len(stays)
    content = pieces.content[stays]
    content[pieces.key[stays] == mix(content + np.uint64(1))] = 0  # a window of its own: its key tells what its bytes' hash would
    yield _batch([
        pa.array(pieces.key[stays].view(np.int64)), pa.array(content.view(np.int64)),
        pa.array(pieces.doc[stays], mask=~pieces.known[stays]), pa.array(pieces.text[stays]), pa.array(pieces.start[stays]), _nulls(n),
        pa.array(pieces.length[stays]), pa.array(pieces.twice[stays]),
    ], COPIES)
    if len(later):
        spans = pieces.spans(later, np.zeros(len(later), np.int64), pieces.length[later])
        n = len(spans[0])
        yield _batch([spans[1], _nulls(n), *spans, _nulls(n), _nulls(n, pa.bool_())], COPIES)


def _columns(doc: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(zero_copy_only=False),
        text.to_numpy(zero_copy_only=False),
    )


def _pieces_of(size: int, wanted, hot, marks=None):
    """Batches (doc_id, text_hash, text) to COPIES, or, with `marks`, to PIECES; up to 8 times CHUNK bytes of pieces are held."""

    def given(held: list[_Pieces]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces.joined(held)
        if marks is not None:
            yield _batch(pieces.binaries(_equal_pieces(pieces)[0]), PIECES)
        else:
            yield from _settle(pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total = [], 0
            passed = None if marks is None else marks.value
            for pieces in _cut(batch.column(2), size, wanted.value, hot.value, passed, *_columns(batch.column(0), batch.column(1))):
                held.append(pieces)
                total += len(pieces.data)
                if total > 8 * CHUNK:
                    yield from given(held)
                    held, total = [], 0
            if total:
                yield from given(held)

    return work


#: After the copies are settled: spans (`end` set), and the different pieces of contested keys (the others).
SETTLED = SPANS + ", key bigint, mark bigint"


def _settle_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COPIES sorted by key, content, length and place to SETTLED."""
    last: pa.RecordBatch | None = None  # the first of the pieces that the next one may be a copy of
    open_key, open_told = None, False  # the key of that piece, and whether it was given as one of a contested key
    for batch in batches:
        is_span = batch.column("end").is_valid().to_numpy(zero_copy_only=False)
        done = batch.filter(pa.array(is_span))
        if done.num_rows:
            yield _batch([*(done.column(c) for c in _names(SPANS)), _nulls(done.num_rows), _nulls(done.num_rows)], SETTLED)
        own = batch.filter(pa.array(~is_span))
        if own.num_rows == 0:
            continue
        carried = last is not None
        if carried:
            own = pa.Table.from_batches([last, own]).combine_chunks().to_batches()[0]
        numbers = {c: own.column(c).to_numpy(zero_copy_only=False) for c in ("key", "content", "length", "twice")}
        place = _columns(own.column("doc_id"), own.column("text_hash"))
        pieces = _Pieces(*place, own.column("start").to_numpy(zero_copy_only=False), numbers["key"], np.zeros(0, np.uint8), numbers["length"])
        same_key = numbers["key"][1:] == numbers["key"][:-1]
        head = np.ones(len(pieces), bool)
        head[1:] = ~same_key | (numbers["content"][1:] != numbers["content"][:-1]) | (numbers["length"][1:] != numbers["length"][:-1])
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        copy = np.flatnonzero(~head)
        copy = copy[~pieces.same_place(copy, first[copy])]
        if len(copy):
            spans = pieces.spans(copy, np.zeros(len(copy), np.int64), pieces.length[copy])
            yield _batch([*spans, _nulls(len(spans[0])), _nulls(len(spans[0]))], SETTLED)
        contested = numbers["twice"].copy()
        contested[1:] |= head[1:] & same_key
        contested = np.isin(numbers["key"], numbers["key"][contested])
        if open_told:
            contested |= numbers["key"] == open_key
        given = head & contested
        if open_told:
            given[0] = False
        open_key, open_told = numbers["key"][-1], bool(contested[-1])
        last = own.slice(int(first[-1]), 1)
        told = np.flatnonzero(given)
        if len(told):
            key = numbers["key"][told]
            marks = _mark(key.view(np.uint64), *(x[told] for x in (*place, pieces.start)))
            yield _batch([*(_nulls(len(told)) for _ in range(4)), pa.array(key), pa.array(marks.view(np.int64))], SETTLED)


class Collection:
    """Suffixes of many short pieces in order, inserted one symbol of every piece in each round.

    `symbols` is the transform: the symbol before each suffix, in the order of the suffixes, with _END before a whole piece.
    `common` is the length of the prefix that a suffix has in common with the one before it, `limit` at most. Suffixes of
    equal bytes go by the number of their piece, as if each piece ended with a symbol of its own.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, limit: int) -> None:
        self.n, self.limit = len(length), limit
        self.length = length
        # round 0: the empty suffixes
        self.symbols = np.where(length > 0, data[np.maximum(begin + length - 1, 0)] if len(data) else 0, _END).astype(np.uint8)
        self.common = np.zeros(self.n, np.min_scalar_type(limit))
        piece, place = np.arange(self.n), np.arange(self.n)  # the newest suffixes, by place
        for done in range(1, int(length.max(initial=0)) + 1):
            alive = length[piece] >= done
            piece, place = piece[alive], place[alive]
            before = np.where(length[piece] > done, data[np.maximum(begin[piece] + length[piece] - done - 1, 0)], _END)
            piece, place = self._insert(piece, place, before.astype(np.uint8))

    def _insert(self, piece: np.ndarray, place: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the symbol at each place in front of its suffix: new suffixes, which `before` stands before."""
        order = np.argsort(self.symbols, kind="stable")  # suffix c + X, for all X, in order
        new = np.zeros(len(order), bool)
        new[place] = True
        rank = np.flatnonzero(new[order])
        number = np.searchsorted(place, order[rank])
        # with the suffix before and the one after: one more symbol than what their rests share
        upper, lower = self._shared(order, rank - 1, rank), self._shared(order, rank, rank + 1)
        at = rank + self.n
        size = len(order) + len(rank)
        fresh = np.zeros(size, bool)
        fresh[at] = True
        symbols, common = np.empty(size, np.uint8), np.empty(size, self.common.dtype)
        symbols[fresh], symbols[~fresh] = before[number], self.symbols
        common[~fresh] = self.common
        follows = at + 1 < size
        common[at[follows] + 1] = lower[follows]
        common[at] = upper
        self.symbols, self.common = symbols, common
        return piece[number], at

    def _shared(self, order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes that stand at a and b = a + 1 of the new order."""
        out = np.zeros(len(a), np.int64)
        inside = np.flatnonzero((a >= 0) & (b < len(order)))
        low, high = order[a[inside]], order[b[inside]]
        same = (self.symbols[low] == self.symbols[high]) & (self.symbols[low] != _END)
        inside, low, high = inside[same], low[same] + 1, high[same]
        if not len(inside):
            return out
        level = np.floor(np.log2(high - low + 1)).astype(np.int64)
        order_ = np.argsort(level, kind="stable")
        least, at = self.common, 0
        for k in range(int(level.max()) + 1):
            upto = int(np.searchsorted(level[order_], k, side="right"))
            own = order_[at:upto]
            out[inside[own]] = np.minimum(least[low[own]], least[high[own] - (1 << k) + 1])
            at = upto
            if k < level.max():
                least = np.minimum(least[: -(1 << k)], least[1 << k:])
        out[inside] = np.minimum(out[inside] + 1, self.limit)
        return out

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(piece, length) of every suffix in order, by walking the transform from the empty suffixes on."""
        piece, size = np.empty(len(self.symbols), np.int64), np.zeros(len(self.symbols), np.int64)
        step = np.empty(len(self.symbols), np.int64)
        step[np.argsort(self.symbols, kind="stable")] = np.arange(len(self.symbols)) + self.n
        number, place = np.arange(self.n), np.arange(self.n)
        piece[place] = number
        for done in range(1, int(self.length.max(initial=0)) + 1):
            alive = self.length[number] >= done
            number, place = number[alive], step[place[alive]]
            piece[place], size[place] = number, done
        return piece, size


def _repeats(pieces: _Pieces, size: int) -> pa.RecordBatch | None:
    """Spans of the windows of different pieces that are equal to an earlier one."""
    built = Collection(pieces.data, pieces.begin, pieces.length, size)
    owner, left = built.suffixes()
    group = np.cumsum(built.common < size)
    windows = np.flatnonzero(left >= size)
    group, owner = group[windows], owner[windows]
    first = pieces.length[owner] - left[windows]
    many = np.bincount(group)[group] > 1
    group, owner, first = group[many], owner[many], first[many]
    order = np.lexsort((pieces.start[owner] + first, pieces.text[owner], pieces.doc[owner], pieces.known[owner], group))
    group, owner, first = group[order], owner[order], first[order]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    if not later.any():
        return None
    return _batch(pieces.spans(owner[later], first[later], np.full(int(later.sum()), size)), SPANS)


def _may_repeat(pieces: _Pieces) -> np.ndarray:
    """Pieces that have something to be compared with: another piece of the key, or themselves."""
    shared = pieces.twice.copy()
    same = pieces.key[1:] == pieces.key[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    return shared


def _compare(size: int, most: int):
    """PIECES sorted by key, bytes and place to the spans of windows that a different piece, or the piece itself, has before."""

    def pieces_of(batch: pa.RecordBatch) -> _Pieces:
        data, ends = _bytes_of(batch.column("piece"))
        return _Pieces(
            *_columns(batch.column("doc_id"), batch.column("text_hash")), batch.column("start").to_numpy(zero_copy_only=False),
            batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64), data, np.diff(ends),
            twice=batch.column("twice").to_numpy(zero_copy_only=False),
        )

    def compared(held: _Pieces) -> Iterator[pa.RecordBatch]:
        kept = held.take(np.flatnonzero(_may_repeat(held)))
        if len(kept) and (found := _repeats(kept, size)) is not None:
            yield found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Pieces] = []
        last: _Pieces | None = None  # the piece that the next one may be a copy of
        total = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            own = pieces_of(batch)
            if last is not None:
                own = _Pieces.joined([last, own])
            head = np.ones(len(own), bool)
            head[1:] = (own.key[1:] != own.key[:-1]) | ~own.same_text(np.arange(1, len(own)), np.arange(len(own) - 1))
            fresh = np.flatnonzero(head)
            new = own.take(fresh[fresh > 0] if last is not None else fresh)
            last = own.take(fresh[-1:])
            while len(new):
                cuts = np.flatnonzero(new.key[1:] != new.key[:-1]) + 1  # where whole keys end
                if held and held[-1].key[-1] != new.key[0]:
                    cuts = np.concatenate(([0], cuts))
                full = cuts[cuts + total >= most]
                if not len(full):
                    held.append(new)
                    total += len(new)
                    break
                upto = int(full[0])
                if upto:
                    held.append(new.take(np.arange(upto)))
                yield from compared(_Pieces.joined(held))
                held, total = [], 0
                new = new.take(np.arange(upto, len(new)))
        if held:
            yield from compared(_Pieces.joined(held))

    return work


def _text_hash(body: Column) -> Column:
    """Tells rows that share an id apart; 32 bits, as it goes with every piece."""
    return F.hash(body).cast("long")


def repeated_spans(docs: DataFrame, size: int = 100, text: str = "text", hot: int = HOT, most: int = COLLECTION) -> DataFrame:
    """(doc_id, text_hash, start, end): bytes of texts that a string of `size` bytes covers which also starts earlier.

    Earlier is by doc_id (null first), then, where rows share an id, by the hash of their text, then by place; rows of one id
    and text are one. Spans of a text may touch or overlap. Null texts are empty, other columns are left behind. `docs` has
    to be a stored table, or staged.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    long = docs.select("doc_id", _text_hash(body).alias("text_hash"), body.alias("body")).where(F.octet_length(body) >= size)
    counts = staged(
        long.select("body").mapInArrow(_key_places(size), "key bigint").groupBy("key").count().where("count > 1"), "keys"
    )
    wanted = spark.sparkContext.broadcast(_bitmap(counts))
    hot_keys = spark.sparkContext.broadcast(_bitmap(counts.where(F.col("count") >= hot)))
    copies = long.mapInArrow(_pieces_of(size, wanted, hot_keys), COPIES)
    settled = staged(
        copies.repartition("key").sortWithinPartitions("key", "content", "length", "doc_id", "text_hash", "start")
        .mapInArrow(_settle_copies, SETTLED), "settled",
    )
    different = settled.where("key IS NOT NULL")
    contested = spark.sparkContext.broadcast(_bitmap(different))
    marks = spark.sparkContext.broadcast(_bitmap(different.select(F.col("mark").alias("key"))))
    pieces = long.mapInArrow(_pieces_of(size, contested, hot_keys, marks), PIECES)
    found = pieces.repartition("key").sortWithinPartitions("key", "piece", "doc_id", "text_hash", "start").mapInArrow(_compare(size, most), SPANS)
    return settled.where("key IS NULL").select(*_names(SPANS)).union(found)


def without_repeats(docs: DataFrame, size: int = 100, text: str = "text", hot: int = HOT, most: int = COLLECTION) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed runs of each row's text, joined and in order, and the bytes that are left.

    One row for each row of `docs`; see `repeated_spans`. `kept` is binary, as a cut may fall inside a character.
    """
    spans = staged(
        repeated_spans(docs, size, text, hot, most).groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
        .select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text"), "spans"), "spans",
    )
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select("doc_id", body.alias("body"), _text_hash(body).alias("text_hash"))
    bits = key_filter(spans, "of_text")
    moved = may_have(rows, "text_hash", bits)
    met = moved.join(spans, moved.doc_id.eqNullSafe(spans.of) & (moved.text_hash == spans.of_text), "left").select("doc_id", "body", "spans")
    still = may_have(rows, "text_hash", bits, negate=True).select("doc_id", "body", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for body, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = body.as_buffer().to_pybytes()
                own, left = [], []
                if spans.is_valid:
                    start = spans.values.field("start").to_numpy(zero_copy_only=False)
                    reach = np.maximum.accumulate(spans.values.field("end").to_numpy(zero_copy_only=False))
                    heads = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                    own = list(zip(start[heads].tolist(), reach[np.concatenate((heads[1:], [len(start)])) - 1].tolist(), strict=True))
                at = 0
                for begin, end in own:
                    left.append(raw[at:begin])
                    at = end
                sizes.append(len(raw))
                runs.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(left) + raw[at:])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return met.unionByName(still).mapInArrow(
        work, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    )
