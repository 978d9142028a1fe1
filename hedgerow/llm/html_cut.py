"""HTML extraction by minimum-cut labelling.

A page is cut into blocks of text. A classifier gives each block a cost of being called content and one of being called
boilerplate; they are its capacities to the two terminals. Neighbouring blocks, and blocks of one parent element, are tied
by smoothness edges. The maximum flow from the one terminal to the other separates content from boilerplate.

The classifier is a logistic regression on the block's form (length, link share, punctuation, depth, place) that is
trained here on a bounded sample of pages, whose blocks are labelled by telling elements and class names; the same
telling names are a fixed cost of their own. Pages are worked whole within their row, in Arrow batches: no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
# Elements left out up to their end tag; without one, the tag alone goes, but a script's or a style's rest is none of the text.
_LEFT_OUT = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE)
             for tag in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title")}
_TO_THE_END = frozenset(("script", "style"))
# What a head may hold; anything else ends it.
_IN_HEAD = frozenset("html head title base link meta style script noscript template bgsound basefont".split())
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
# An element that opens closes an open one of these, up to the nearest container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select div article section main body aside nav form".split())

# Elements and names that tell.
_BOILER_TAGS = frozenset("nav footer aside form button select menu dialog fieldset".split())
_BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert comment comments respond reply replies disqus discussion sidebar aside menu nav navigation navbar breadcrumb breadcrumbs "
    "footer header masthead topbar share sharing social related recommended newsletter subscribe subscription signup login popup modal "
    "overlay widget toc pagination pager search form toolbar tags skip complementary contentinfo".split()
)
_CONTENT_TAGS = frozenset(("article", "main"))
_CONTENT_NAMES = frozenset("article content post entry story main maincontent body text".split())


@dataclass
class Block:
    """A run of text that no block element interrupts."""

    text: str
    parent: int
    depth: int
    linked: int
    boiler: float
    content: int
    heading: bool


@dataclass
class _Open:
    tag: str
    number: int
    boiler: float  # of whole names and elements
    hinted: float  # of names that only hold a telling word, and of forms: an article below is not of them
    content: int
    hidden: bool
    link: bool
    heading: bool


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0


#: Weight of a name such as `has-sidebar` or `aspnetForm`, and of a form, which may hold a whole page.
HINT, FORM = 0.25, 0.5
#: A block under so much is an example of boilerplate.
SURE = 0.5


def _telling(tag: str, attributes: str, above: Sequence[_Open]) -> tuple[float, float, int]:
    """How much the element tells of boilerplate, hints at it, and whether it tells of content.

    A header inside an article heads the article. A name all of whose words tell is whole; one with other words hints.
    """
    names: set[str] = set()
    whole: set[str] = set()
    if "=" in attributes:
        for value in _NAMES.findall(attributes):
            for name in value.strip("\"'").split():
                words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()))
                names |= words
                if words <= _BOILER_NAMES:
                    whole |= words
    inside = any(o.tag in _CONTENT_TAGS for o in above)
    told = names & _BOILER_NAMES
    if told == {"header"} and (inside or names & _CONTENT_NAMES):
        told = set()  # such as `entry-header`
    element = tag in _BOILER_TAGS - {"form"} or (tag == "header" and not inside)
    if tag in ("body", "html") or (tag in _CONTENT_TAGS and "comment" not in names):
        return 0.0, 0.0, int(tag in _CONTENT_TAGS)
    boiler = float(element or bool(told & whole))
    hint = 0.0 if boiler else FORM if tag == "form" else HINT * bool(told)
    return boiler, hint, int(tag in _CONTENT_TAGS or (bool(names & _CONTENT_NAMES) and not boiler and not hint))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, without scripts, styles, comments, markup and hidden elements.

    References are decoded, white space becomes one space, and blocks without text are left out.
    """
    out = _Page()
    stack: list[_Open] = []
    number = 0
    at = 0
    in_head = False
    unclosed: set[str] = set()  # elements without a further end tag

    def flush() -> None:
        if out.pieces:
            text = " ".join(html.unescape("".join(out.pieces)).split())
            if text:
                parent = next((o for o in reversed(stack) if o.tag in _SCOPE), None)
                top = stack[-1] if stack else None
                out.blocks.append(Block(
                    text, parent.number if parent else -1, len(stack), out.linked,
                    top.boiler + top.hinted if top else 0, top.content if top else 0, bool(top and top.heading),
                ))
        out.pieces, out.linked = [], 0

    def say(text: str) -> None:
        nonlocal in_head
        if in_head and text.strip():
            in_head = False
        if text and not in_head and not (stack and stack[-1].hidden):
            out.pieces.append(text)
            if stack and stack[-1].link:
                out.linked += len(text)

    while m := _TOKEN.search(page, at):
        say(page[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "head":
            in_head = not m[1]
            continue
        if in_head and (tag not in _IN_HEAD) and not m[1]:
            in_head = False
        if tag in _LEFT_OUT and not m[1] and (tag != "title" or in_head) and not (tag == "svg" and m[3].endswith("/")):
            end = None if tag in unclosed else _LEFT_OUT[tag].search(page, at)
            if end or tag in _TO_THE_END:
                at = end.end() if end else len(page)
                say(" ")
                continue
            unclosed.add(tag)
        if m[1]:
            if tag in _BLOCKS:
                flush()
            if any(o.tag == tag for o in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in _BLOCKS:
            flush()
            while stack and stack[-1].tag not in _BLOCKS:  # inline elements do not reach into the next block
                stack.pop()
            if stack and stack[-1].tag == "p":
                stack.pop()
            ends = _ENDS.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE:
                    break
        elif tag in ("br", "wbr"):
            say(" " if tag == "br" else "")
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCKS:
            continue
        number += 1
        boiler, hinted, content = _telling(tag, m[3], stack)
        above = stack[-1] if stack else None
        if above:
            starts = tag in _CONTENT_TAGS and not boiler and not hinted  # what is above does not tell of an article or main
            boiler += 0 if starts and tag == "main" else above.boiler
            hinted += 0 if starts else above.hinted
            content += 0 if boiler > above.boiler else above.content
        stack.append(_Open(
            tag, number, boiler, hinted, content,
            bool(above and above.hidden) or bool(_HIDDEN.search(m[3])), bool(above and above.link) or tag == "a",
            bool(above and above.heading) or tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
        ))
    say(page[at:])
    flush()
    return out.blocks


def form_features(blocks: Sequence[Block]) -> np.ndarray:
    """Numbers of a block's form alone, without telling names."""
    n = len(blocks)
    rows = np.zeros((n, 8))
    for i, b in enumerate(blocks):
        size = len(b.text)
        words = b.text.count(" ") + 1
        rows[i] = (
            1.0, math.log1p(size), min(1.0, b.linked / size), math.log1p(words),
            min(1.0, sum(b.text.count(c) for c in ".,;:!?") / words), float(b.heading),
            min(b.depth, 12) / 12, (i + 0.5) / n,
        )
    return rows


#: Weights used where no page of the sample has blocks of both kinds.
DEFAULT_WEIGHTS = (-2.0, 0.6, -3.0, 0.2, 1.0, 0.3, 0.0, 0.0)


def fit(features: np.ndarray, labels: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; blocks of both kinds count alike."""
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (weight * (p - labels)) + ridge * w
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(pages: DataFrame, html_column: str = "html", sample: int = 300) -> tuple[float, ...]:
    """Weights of the classifier, from at most `sample` pages (those of the smallest hash of their text).

    A block under a telling element or name is an example of boilerplate, one under a content element of content;
    others are not used.
    """
    hashed = pages.where(F.col(html_column).isNotNull()).select(F.col(html_column).alias("h"), F.xxhash64(html_column).alias("o"))
    smallest = hashed.select("o").orderBy("o").limit(sample).agg(F.max("o")).first()[0]  # numbers alone meet on the driver
    if smallest is None:
        return DEFAULT_WEIGHTS
    picked = hashed.where(F.col("o") <= smallest).groupBy("o").agg(F.min("h").alias("h")).orderBy("o").select("h").collect()
    rows, labels = [], []
    for (page,) in picked:
        blocks = blocks_of(page)
        if blocks:
            known = [i for i, b in enumerate(blocks) if b.boiler >= SURE or b.content]
            rows.append(form_features(blocks)[known])
            labels += [float(blocks[i].boiler < SURE) for i in known]
    if not labels or min(labels) == max(labels):
        return DEFAULT_WEIGHTS
    return tuple(fit(np.concatenate(rows), np.array(labels)))


def max_flow_side(source: np.ndarray, sink: np.ndarray, edges: Sequence[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes lie on the source's side of a minimum cut (the smallest such side).

    `source` and `sink` are the capacities to the terminals, `edges` undirected (i, j, capacity). Levels and blocking
    flows (Dinic's method) over the residual graph, without recursion.
    """
    n = len(source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def add(i: int, j: int, forth: float, back: float) -> None:
        head[i].append(len(to))
        to.append(j)
        left.append(forth)
        head[j].append(len(to))
        to.append(i)
        left.append(back)

    for i in range(n):
        through = min(source[i], sink[i])  # flow that passes this node alone
        if source[i] > through:
            add(s, i, float(source[i] - through), 0.0)
        if sink[i] > through:
            add(i, t, float(sink[i] - through), 0.0)
    for i, j, c in edges:
        add(i, j, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for i in queue:
            for e in head[i]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([level[i] >= 0 for i in range(n)], dtype=bool)
        nexts = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                pushed = min(left[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    left[e] -= pushed
                    left[e ^ 1] += pushed
                    if left[e] <= tiny and not cut:
                        cut = k + 1
                i = to[path[cut - 1] ^ 1]
                del path[cut - 1:]
                continue
            while nexts[i] < len(head[i]):
                e = head[i][nexts[i]]
                if left[e] > tiny and level[to[e]] == level[i] + 1:
                    break
                nexts[i] += 1
            else:
                if i == s:
                    break
                e = path.pop()
                i = to[e ^ 1]
                nexts[i] += 1
                continue
            path.append(e)
            i = to[e]


#: Cost of a telling name, less than the classifier's most, so that it and the ties can outweigh a name; strength of the ties of neighbours, and of neighbours within one parent.
TELLING, ADJACENT, SIBLING = 2.5, 0.4, 0.8


def label(blocks: Sequence[Block], weights: Sequence[float]) -> np.ndarray:
    """True for blocks of content."""
    if not blocks:
        return np.zeros(0, bool)
    z = np.clip(form_features(blocks) @ np.array(weights), -3, 3)
    told_boiler = np.array([min(b.boiler, 3) for b in blocks]) * TELLING
    told_content = np.array([min(b.content, 1) for b in blocks]) * (TELLING / 2)
    content = np.log1p(np.exp(z)) + told_content
    boiler = np.log1p(np.exp(-z)) + told_boiler
    edges, last_of = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.parent in last_of:
            edges.append((last_of[b.parent], i, SIBLING))
        last_of[b.parent] = i
    return max_flow_side(content, boiler, edges)


def main_text(page: str | None, weights: Sequence[float] = DEFAULT_WEIGHTS) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks, weights), strict=True) if keep)


def extract(pages: DataFrame, html_column: str = "html", weights: Sequence[float] | None = None, sample: int = 300) -> DataFrame:
    """The rows with a column `main_text`: the text of the content blocks, in page order, joined by empty lines.

    A null or empty page, or one without content, gives an empty text; repeated rows are worked each; a table without
    rows gives none; other columns pass through, whatever their names (a column `main_text` is replaced). Nothing of a
    content block is dropped or cut; memory is bounded by the longest page.
    """
    chosen = tuple(weights) if weights is not None else train(pages, html_column, sample)
    names = [c for c in pages.columns if c != "main_text"]
    kept = pages.select(*[f"`{c}`" for c in names])
    at = names.index(html_column)
    schema = T.StructType([*kept.schema.fields, T.StructField("main_text", T.StringType(), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, chosen) for page in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "main_text"])

    return kept.mapInArrow(work, schema)
