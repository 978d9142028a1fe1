"""Toxicity: a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

The kernel compares two words by the subsequences of three characters they share, gaps allowed: a subsequence that spans
s characters counts DECAY ** (s - 3), up to a span of SPAN, over the word with its two edges marked; it is divided by the
norm of a word of that length without repeats. So an insult keeps most of its likeness when characters are inserted into
it or left out. Punctuation inside a token is taken out first, and runs of single characters are read as one word too. A
word with accents, digits, look-alike letters of another script or long runs has a second, plain reading beside its own.

Training. Labels mark whole documents, so learning is by multiple instances: every word of a document labelled 0 is a
negative example, and of a document labelled 1 the word that speaks most for toxicity (first by the log odds of its
subsequences, then by the machine itself, in rounds) is a positive one, also with one or two characters inserted. Landmarks
are such witnesses and the clean words most like them. The machine is linear in the Nyström features of the cosine raised
to POWER (squared hinge loss, Newton's method), a document scores as its highest word, and a logistic curve, set on the clean
documents, turns that into 0 to 1. All of it is one task over bags of words, as the labelled sample is bounded.

Scoring. A table of bounded size (subsequence -> its highest weight in a witness) bounds a word's cosine with every
witness; a word whose bound is below NEAR is like none of them and shows nothing, the others meet the landmarks. Each
distinct word of an Arrow batch is scored once and the highest taken for each text. Nothing is shuffled.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.llm.common import frugal

DECAY, SPAN = 0.7, 5
#: Pairs of steps of a subsequence of three characters, with the weight of its span.
_STEPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, SPAN) for b in range(1, SPAN - a)]
#: Words are scored in pieces of this many characters that overlap by half, so a long token costs no more for its length.
PIECE = 24
#: Bits of a subsequence's place in the weight table.
TABLE_BITS = 20
_EDGE_LEFT, _EDGE_RIGHT = 1, 2


# ---------------------------------------------------------------------------------------------
# Words


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch, the number of each text's words in a row, and the codes of all words in order.

    Letters in lower case, everything but letters and digits taken out of a token; four or more single characters in a
    row are also read as one word.
    """
    texts = texts.cast(pa.large_string())
    lowered = pc.fill_null(pc.utf8_lower(texts), "")
    bare = pc.replace_substring_regex(lowered, r"[^\p{L}\p{N}\s]+", "")
    lists = pc.utf8_split_whitespace(bare)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = encoded.dictionary.cast(pa.large_string())
    sizes = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts)), counts)
    full = sizes[codes] > 0 if len(codes) else np.zeros(0, bool)  # punctuation alone is no word, and does not break a run
    codes, row = codes[full], row[full]
    counts = np.bincount(row, minlength=len(counts))
    single = sizes[codes] == 1 if len(codes) else np.zeros(0, bool)
    extra: dict[int, list[str]] = {}
    if single.sum() >= 4:
        new = np.ones(len(codes), bool)
        new[1:] = (row[1:] != row[:-1]) | (single[1:] != single[:-1])
        heads = np.flatnonzero(new)
        runs = np.diff(np.append(heads, len(codes)))
        names = None
        for head, run in zip(heads[single[heads] & (runs >= 4)], runs[single[heads] & (runs >= 4)], strict=True):
            names = names if names is not None else distinct.to_pylist()
            extra.setdefault(int(row[head]), []).append("".join(names[k] for k in codes[head: head + run]))
    if extra:
        joined = sorted({w for ws in extra.values() for w in ws})
        at = {w: len(distinct) + i for i, w in enumerate(joined)}
        distinct = pa.concat_arrays([distinct, pa.array(joined, pa.large_string())])
        more_rows = np.array([k for k, ws in extra.items() for _ in ws])
        more_codes = np.array([at[w] for ws in extra.values() for w in ws])
        order = np.argsort(np.concatenate((row, more_rows)), kind="stable")
        codes = np.concatenate((codes, more_codes))[order]
        counts = counts + np.bincount(more_rows, minlength=len(counts))
    return distinct, counts, codes


#: Digits and letters of other scripts that stand for a Latin letter of the same look.
_ALIKE = str.maketrans("01345789аеорсухіѕјԁнтмкваοαερυινικτ", "oieastbgaeopcyxisjdhtmkbaoaepuinikt")
_UNUSUAL = "[0-9]|[^\\x00-\\x7F]|" + "|".join(chr(c) * 3 for c in range(97, 123))
_RUN = re.compile(r"(.)\1\1+")


def plain_readings(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Numbers of the words that have a second reading, and that reading: compatibility forms and accents undone, letters
    for digits and look-alikes, a run of three or more characters as one. Words without a letter have none.
    """
    unusual = np.flatnonzero(pc.match_substring_regex(words, _UNUSUAL).to_numpy(zero_copy_only=False))
    kept, readings = [], []
    for k, word in zip(unusual.tolist(), words.take(pa.array(unusual)).to_pylist(), strict=True):
        if word.isdigit():
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
        reading = _RUN.sub(r"\1", bare.translate(_ALIKE))
        if reading and reading != word:
            kept.append(k)
            readings.append(reading)
    return np.array(kept, np.int64), readings


def _pieces(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, length, word) of all pieces: rows of code points with the word's edges marked, zeros after."""
    words = words.cast(pa.large_string())
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    total = int(sizes.sum())
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    assert len(points) == total
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    long = np.flatnonzero(sizes > PIECE)
    word = np.arange(len(sizes))
    begin, size = starts, np.minimum(sizes, PIECE)
    left, right = np.ones(len(sizes), bool), sizes <= PIECE
    if len(long):
        step = PIECE // 2
        more = [(w, k, min(PIECE, int(sizes[w]) - k)) for w in long.tolist() for k in range(step, int(sizes[w]) - step, step)]
        extra = np.array(more, np.int64).reshape(-1, 3)
        word = np.concatenate((word, extra[:, 0]))
        begin = np.concatenate((begin, starts[extra[:, 0]] + extra[:, 1]))
        size = np.concatenate((size, extra[:, 2]))
        left = np.concatenate((left, np.zeros(len(extra), bool)))
        right = np.concatenate((right, extra[:, 1] + extra[:, 2] >= sizes[extra[:, 0]]))
    width = PIECE + 2
    columns = np.arange(width)
    shift = left.astype(np.int64)
    at = columns[None, :] - shift[:, None]
    inside = (at >= 0) & (at < size[:, None])
    characters = np.zeros((len(size), width), np.uint32)
    source = np.clip(begin[:, None] + at, 0, max(total - 1, 0))
    if total:
        characters[inside] = points[source[inside]] + 3
    characters[left, 0] = _EDGE_LEFT
    ends = size + shift
    characters[np.flatnonzero(right), ends[right]] = _EDGE_RIGHT
    lengths = ends + right
    return np.ascontiguousarray(characters[:, : max(int(lengths.max(initial=0)), SPAN + 1)]), lengths, word


_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _subsequences(characters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of steps: places in the weight table, which of them are real, and the weight."""
    width = characters.shape[1]
    for a, b, weight in _STEPS:
        x, y, z = characters[:, : width - a - b], characters[:, a: width - b], characters[:, a + b:]
        place = x * _M1
        place ^= place >> np.uint32(15)
        place += y
        place *= _M2
        place ^= place >> np.uint32(13)
        place += z
        place *= _M3
        place ^= place >> np.uint32(16)
        yield place & np.uint32((1 << TABLE_BITS) - 1), z > 0, weight


def _norm(lengths: np.ndarray) -> np.ndarray:
    """Norm of a word of that length (edges counted) whose subsequences are all different."""
    square = sum(weight**2 * np.maximum(lengths - a - b, 0) for a, b, weight in _STEPS)
    return np.sqrt(np.maximum(square, 1e-12))


def _features(words: list[str]) -> list[dict[int, float]]:
    """Each word's subsequences (places in the table) with their weights, of length 1; a long word by its first piece."""
    characters, _, word = _pieces(pa.array(words, pa.large_string()))
    first = {int(w): i for i, w in reversed(list(enumerate(word)))}
    out: list[dict[int, float]] = [{} for _ in words]
    for place, real, weight in _subsequences(characters):
        for w, i in first.items():
            for p in place[i][real[i]].tolist():
                out[w][p] = out[w].get(p, 0.0) + weight
    for own in out:
        norm = sum(v * v for v in own.values()) ** 0.5 or 1.0
        for p in own:
            own[p] /= norm
    return out


# ---------------------------------------------------------------------------------------------
# Training


@dataclass(frozen=True)
class Landmarks:
    """Words that others are compared with; the first `witnesses` of them are toxic."""

    #: For each subsequence its highest weight in a witness.
    bound: np.ndarray
    #: Subsequences of all landmarks, ascending, and their weights: a row each, and a last one of zeros.
    places: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, words: list[str], witnesses: int) -> Landmarks:
        features = _features(words)
        bound = np.zeros(1 << TABLE_BITS, np.float32)
        for own in features[:witnesses]:
            for p, v in own.items():
                bound[p] = max(bound[p], v)
        places = np.array(sorted({p for own in features for p in own}), np.int32)
        weights = np.zeros((len(places) + 1, len(words)), np.float32)
        for j, own in enumerate(features):
            weights[np.searchsorted(places, list(own)), j] = list(own.values())
        return cls(bound, places, weights)

    def bounds(self, words: pa.Array) -> np.ndarray:
        """No less than the highest cosine with a witness, for each word."""
        out = np.zeros(len(words), np.float32)
        for begin in range(0, len(words), 4_000):  # bounds memory
            characters, lengths, word = _pieces(words.slice(begin, 4_000))
            total = np.zeros(len(characters), np.float32)
            for place, real, weight in _subsequences(characters):
                total += np.float32(weight) * (self.bound[place] * real).sum(axis=1)
            np.maximum.at(out, word + begin, total / _norm(lengths).astype(np.float32))
        return out

    def kernel(self, words: pa.Array) -> np.ndarray:
        """Cosine with each landmark, raised to POWER: the highest of the word's pieces."""
        out = np.zeros((len(words), self.weights.shape[1]), np.float32)
        order = np.argsort(pc.utf8_length(words).to_numpy(zero_copy_only=False), kind="stable")  # words of one length are compact
        for begin in range(0, len(words), 2_000):
            chosen = order[begin: begin + 2_000]
            characters, _, word = _pieces(words.take(pa.array(chosen)))
            rows = np.zeros((len(characters), self.weights.shape[1]), np.float32)
            keys, values = [], []
            for place, real, weight in _subsequences(characters):
                at = np.minimum(np.searchsorted(self.places, place), max(len(self.places) - 1, 0))
                at[~real | (self.places[at] != place)] = len(self.places)
                for k in range(at.shape[1]):
                    rows += np.float32(weight) * self.weights[at[:, k]]
                keys.append((np.arange(len(characters))[:, None] * np.int64(1 << TABLE_BITS) + place)[real])
                values.append(np.full(len(keys[-1]), weight))
            same, slot = np.unique(np.concatenate(keys), return_inverse=True)  # a subsequence met twice counts together
            square = np.bincount(slot, weights=np.concatenate(values), minlength=len(same)) ** 2
            norm = np.sqrt(np.bincount(same >> TABLE_BITS, weights=square, minlength=len(characters)))
            rows /= np.maximum(norm, 1e-6)[:, None].astype(np.float32)
            rows = rows * rows * rows if POWER == 3 else rows**POWER
            np.maximum.at(out, chosen[word], rows)
        return out


@dataclass(frozen=True)
class Model:
    """Landmarks with the machine's weights, its bias, and the curve from a text's decision to its score."""

    landmarks: Landmarks | None
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def decide(self, words: pa.Array) -> np.ndarray:
        """The machine's decision for each word, the higher of its readings; LOWEST for a word like no witness."""
        words = words.cast(pa.large_string())
        out = self._decide(words)
        again, readings = plain_readings(words)
        if len(again):
            out[again] = np.maximum(out[again], self._decide(pa.array(readings, pa.large_string())))
        return out

    def _decide(self, words: pa.Array) -> np.ndarray:
        out = np.full(len(words), LOWEST, np.float32)
        if self.landmarks is not None and len(words):
            near = np.flatnonzero(self.landmarks.bounds(words) >= NEAR)
            if len(near):
                own = self.landmarks.kernel(words.take(pa.array(near))) @ self.weights + self.bias
                out[near] = np.maximum(own, LOWEST)
        return out

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -40, 40)))


#: Power of the cosine, and the least bound of a word's cosine with a witness that makes it worth a comparison.
POWER, NEAR = 3, 0.55
#: The decision for a word like no witness, and for a text without words.
LOWEST = -3.0
#: Penalty of the machine, and the weight of changed and of clean examples against that of witnesses (1).
RIDGE, CHANGED, CLEAN = 0.02, 1.0, 6.0
#: Share of the clean labelled documents that score below 0.5.
CALM = 0.998
#: The model where labels of one kind are missing.
FLAT = Model(None, np.zeros(0, np.float32), 0.0, 1.0, 0.0)


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Linear machine by Newton's method; the last column of x is constant and not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        short = np.maximum(1 - y * (x @ w), 0)
        active = short > 0
        gradient = penalty * w - x.T @ (weight * y * short)
        curve = np.diag(penalty)
        rows = np.flatnonzero(active)
        for begin in range(0, len(rows), 4_000):  # bounds memory
            part = x[rows[begin: begin + 4_000]].astype(float)
            curve += (part * weight[rows[begin: begin + 4_000], None]).T @ part
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _curve(clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve: 0.5 where CALM of the clean documents decide lower, unless most toxic ones do, too."""
    middle = float(np.median(toxic))
    cut = min(float(np.quantile(clean, CALM)), (float(np.median(clean)) + middle) / 2)
    slope = 3.0 / max(middle - cut, 0.1)
    return slope, -slope * cut - 1e-6


def _changed(word: str, rng: np.random.Generator) -> list[str]:
    """The word with one character or two inserted inside it."""
    if len(word) < 4:
        return []
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    one = lambda w, k: w[:k] + letters[rng.integers(len(letters))] + w[k:]
    out = [one(word, k) for k in range(1, len(word))]
    return out + [one(one(word, k), int(rng.integers(1, len(word) + 1))) for k in range(1, len(word))]


def fit(texts: list[str], labels: list[int], **options) -> Model:
    """The machine from labelled texts (1 toxic, 0 not)."""
    return fit_bags(bags_of(pa.array(texts, pa.large_string())), labels, **options)


def bags_of(texts: pa.Array) -> list[list[str]]:
    """Each text's distinct words, in both readings."""
    distinct, counts, codes = words_of(texts)
    names = distinct.to_pylist()
    second = dict(zip(*map(list, plain_readings(distinct)), strict=True))
    ends = np.cumsum(counts)
    bags = [np.unique(codes[e - c: e]).tolist() for c, e in zip(counts, ends, strict=True)]
    return [sorted({names[k] for k in bag} | {second[k] for k in bag if k in second}) for bag in bags]


def fit_bags(
    words: list[list[str]], labels: list[int], *, landmarks: int = 250, negatives: int = 12_000, rounds: int = 2, seed: int = 5,
) -> Model:
    """The machine from labelled bags of words (1 toxic, 0 not)."""
    y = np.array(labels)
    if len(y) == 0 or y.min() == y.max():
        return FLAT
    encoded = pa.array([w for bag in words for w in bag], pa.large_string()).dictionary_encode()
    distinct, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
    if not len(distinct):
        return FLAT
    ends = np.cumsum([len(bag) for bag in words])
    bags = [codes[e - len(bag): e] for bag, e in zip(words, ends, strict=True)]
    df = np.zeros((2, len(distinct)))
    for bag, label in zip(bags, y, strict=True):
        df[label, bag] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()

    # log odds of subsequences over the documents' words, a chunk of words at a time
    seen = np.zeros((2, 1 << TABLE_BITS))
    chunks = range(0, len(distinct), 4_000)
    for begin in chunks:
        characters, _, word = _pieces(distinct.slice(begin, 4_000))
        for place, real, _ in _subsequences(characters):
            for label in (0, 1):
                times = np.broadcast_to(df[label, word + begin][:, None], place.shape)[real]
                seen[label] += np.bincount(place[real], weights=times, minlength=1 << TABLE_BITS)
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    telling = np.full(len(distinct), -np.inf)
    for begin in chunks:
        characters, lengths, word = _pieces(distinct.slice(begin, 4_000))
        total = sum(weight * (odds[place] * real).sum(axis=1) for place, real, weight in _subsequences(characters))
        np.maximum.at(telling, word + begin, total / (_norm(lengths) * np.sqrt(np.maximum(lengths, 1))))
    telling += np.log((df[1] + 0.5) / (n1 + 1)) - np.log((df[0] + 0.5) / (n0 + 1))

    # words that lean to toxic documents beyond chance (a bound on the binomial tail, over all words)
    n = np.maximum(df.sum(axis=0), 1)
    share = n1 / (n0 + n1)
    rate = np.clip(df[1] / n, 1e-9, 1 - 1e-9)
    surprise = n * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    leaning = (rate > 0.8) & (surprise > np.log(len(distinct)) + 3)
    clean = np.flatnonzero((df[0] > 0) & ~leaning)
    toxic_bags = [bag for bag, label in zip(bags, y, strict=True) if label == 1 and len(bag)]
    if not toxic_bags:
        return FLAT
    rng = np.random.default_rng(seed)
    decision = telling.copy()
    decision[clean] -= 1e-3
    name = lambda numbers: distinct.take(pa.array(numbers)).to_pylist()
    for number in range(rounds):
        told = [bag[leaning[bag]] for bag in toxic_bags]
        # a document without such a word shows its highest one, if the machine believes it or others show it as well
        tops = [bag[np.argmax(decision[bag])] for bag in toxic_bags]
        for k, top in enumerate(tops):
            if not len(told[k]) and (decision[top] > 0 if number else df[1, top] > 1):
                told[k] = np.array([top])
        if not sum(map(len, told)):
            told = [np.array([top]) for top in tops]
        witnesses, times = np.unique(np.concatenate(told), return_counts=True)
        order = np.argsort(-times, kind="stable")
        marks = name(witnesses[order[: landmarks * 3 // 5]])
        shown_by = len(marks)
        of = Landmarks.of(marks, shown_by)
        near = np.setdiff1d(clean, witnesses)
        bounds = of.bounds(distinct.take(pa.array(near)))
        near = near[np.argsort(-bounds, kind="stable")][: int((bounds >= NEAR).sum())]
        if len(near) > negatives:  # the half that is most alike, and a sample of the others
            rest = rng.choice(near[negatives // 2:], negatives - negatives // 2, replace=False)
            near = np.concatenate((near[: negatives // 2], rest))
        if len(near):
            likeness = of.kernel(distinct.take(pa.array(near))).max(axis=1)
            marks += name(near[np.argsort(-likeness, kind="stable")[: landmarks - shown_by]])
            of = Landmarks.of(marks, shown_by)
        positive = name(witnesses)
        changed = [v for w, many, leans in zip(positive, times, leaning[witnesses], strict=True) if many > 2 or leans for v in _changed(w, rng)]
        examples = pa.array(positive + changed + name(near), pa.large_string())
        values, vectors = np.linalg.eigh(of.kernel(pa.array(marks, pa.large_string())).astype(float))
        good = values > 1e-4 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        x = np.concatenate((of.kernel(examples) @ whiten.astype(np.float32), np.ones((len(examples), 1), np.float32)), axis=1)
        often = np.sqrt(df[0, near]) if len(near) else np.ones(1)  # clean words of many documents count more
        nothing = np.zeros((1, x.shape[1]), np.float32)  # a word like no landmark is clean
        nothing[0, -1] = 1
        x = np.concatenate((x, nothing))
        target = np.concatenate((np.ones(len(positive) + len(changed)), -np.ones(len(near) + 1)))
        shown = np.sqrt(times)  # a word of many documents does not drown the others
        weight = np.concatenate((
            shown / shown.sum(), np.full(len(changed), CHANGED / max(1, len(changed))), CLEAN * (often / often.sum())[: len(near)], [CLEAN]
        )) * 1_000
        w = _squared_hinge(x, target, weight, ridge=RIDGE)
        model = Model(of, (whiten @ w[:-1]).astype(np.float32), float(w[-1]), 1.0, 0.0)
        decision = model.decide(distinct).astype(float)
    tops = np.array([decision[bag].max() if len(bag) else LOWEST for bag in bags])
    slope, offset = _curve(tops[y == 0], tops[y == 1])
    return Model(of, model.weights, model.bias, slope, offset)


def train(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 800,
) -> Model:
    """A machine from at most `sample` labelled documents of each kind (1 and 0), those of the smallest hash of their id.

    Rows without a label or an id are not used; a document with several labels counts once, as their largest.
    """
    marked = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("labelled"))
        .agg(F.max(label).alias("mark"))
    )
    hashed = marked.select("labelled", "mark", F.xxhash64("labelled").alias("o"))
    picked = hashed.where("mark = 1").orderBy("o").limit(sample).union(hashed.where("mark = 0").orderBy("o").limit(sample))
    rows = (
        docs.select(F.col(doc_id).alias("labelled"), F.col(text).alias("body"))
        .join(F.broadcast(picked), "labelled")  # at most 2 * sample rows of three numbers
        .groupBy("labelled").agg(F.first("mark").alias("mark"), F.min(F.coalesce("body", F.lit(""))).alias("body"))
    )

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 250):
                part = batch.slice(begin, 250)
                own = pa.array(bags_of(part.column(2)), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), own], names=["labelled", "mark", "words"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        model = fit_bags([words for _, _, words in found], [mark for _, mark, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task, over the bags of at most 2 * sample documents; the driver only sees the machine, of bounded size
    sampled = rows.mapInArrow(frugal(bags), "labelled bigint, mark int, words array<string>").repartition(1)
    learnt = sampled.mapInArrow(frugal(learn), "model binary").first()
    return pickle.loads(learnt["model"]) if learnt else FLAT


# ---------------------------------------------------------------------------------------------
# Scoring


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with a column `toxicity`, 0 to 1, from the text alone.

    A null or empty text, or one without words, has the score of a text of no evidence; repeated rows score alike; a
    table without rows gives none; other columns pass through (a column `toxicity` of the input is replaced). Whole texts
    are read: memory is bounded by the largest Arrow batch.
    """
    names = [c for c in docs.columns if c != "toxicity"]
    kept = docs.select(*[f"`{c}`" for c in names])
    at = names.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField("toxicity", T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** TABLE_BITS floats and the landmarks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1_000):
                part = batch.slice(begin, 1_000)
                distinct, counts, codes = words_of(part.column(at))
                top = np.full(part.num_rows, LOWEST)
                if len(codes):
                    own = machine.decide(distinct)[codes]
                    full = np.flatnonzero(counts > 0)
                    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
                    top[full] = np.maximum.reduceat(own, starts[full])
                scores = machine.score(top)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*names, "toxicity"])

    return kept.mapInArrow(frugal(work), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
