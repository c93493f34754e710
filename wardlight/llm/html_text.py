"""HTML extraction by minimum-cut labelling.

A page is read into text blocks, each with its open elements. A logistic classifier over tag, name, link, sentence
and position features, learned from labelled pages, gives a block's log-odds of being content: positive odds are the
block's capacity to the source, negative ones to the sink. Smoothness edges join neighbours in page order, with a weight
that falls with their distance in the element tree and where one has marks the other lacks, and each block with the one before it under the same parent. The
minimum cut separates content from boilerplate.

Blocks whose capacity outweighs all their edges keep their label in every minimum cut; they are settled first, their
edges pass into their neighbours' capacities, and what is left falls into small parts that are solved by augmenting
paths. Weights of edges and the clip of the odds are chosen on labelled pages the classifier has not seen.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, deque
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardlight.llm.html_samples import labelled_pages

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|$)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")

# Element and name lists.
SKIPPED = frozenset(["script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title", "audio", "video"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
INLINE = frozenset([
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "del",
])
CLOSES_P = frozenset([
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "main", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dt", "dd", "tr", "td", "th",
])
BOILERPLATE_TAGS = frozenset(["nav", "footer", "aside", "form", "header", "button", "menu", "dialog", "fieldset"])
CONTENT_TAGS = frozenset(["article", "main"])
BOILERPLATE_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"])
BOILERPLATE_NAMES = frozenset([
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "copyright", "disclaimer", "discussion", "disqus", "footer", "foot", "form", "gdpr", "header", "login", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related",
    "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags",
    "toolbar", "topbar", "widget", "widgets",
])
CONTENT_NAMES = frozenset(["article", "content", "entry", "main", "post", "story", "body", "text"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Labelled pages to learn the odds from, and to choose the edge weights and the clip on.
LEARN_PAGES, CHOOSE_PAGES = 700, 300


class Element:
    __slots__ = ("tag", "parent", "depth", "article", "in_content", "in_boilerplate", "named_content", "named_boilerplate", "hidden")

    def __init__(self, tag: str, attrs: str, parent: "Element | None"):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)} if attrs else {}
        names = {x.lower() for k in ("class", "id") if k in found for x in NAME_PART.findall(found[k])}
        role = found.get("role", "").lower()
        content = tag in CONTENT_TAGS or role in ("main", "article")
        self.article = content or bool(parent and parent.article)
        own_header = tag == "header" and bool(parent and parent.article)  # the head of an article, not of the page
        boilerplate = (tag in BOILERPLATE_TAGS and not own_header) or role in BOILERPLATE_ROLES
        bad = tag not in ("html", "body") and bool(names & BOILERPLATE_NAMES) and not (own_header and names <= {"header"} | CONTENT_NAMES)
        self.in_content = content or bool(parent and parent.in_content)
        self.in_boilerplate = boilerplate or bool(parent and parent.in_boilerplate)
        self.named_content = bool(names & CONTENT_NAMES) and not bad or bool(parent and parent.named_content)
        self.named_boilerplate = bad or bool(parent and parent.named_boilerplate)
        self.hidden = bool(parent and parent.hidden) or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()

    def marks(self) -> tuple[bool, ...]:
        return self.in_content, self.in_boilerplate, self.named_boilerplate, self.hidden


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def read_blocks(html: str) -> list[Block]:
    """Non-empty text blocks in page order, white space made single, character references decoded."""
    at = Element("#page", "", None)
    blocks: list[Block] = []
    parts: list[str] = []
    linked = links = 0
    end = 0
    opened: Counter[str] = Counter()  # of the open elements, so an end tag without a start is passed over at once

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, at, min(linked, len(text))))
            parts.clear()
        linked = 0

    while end < len(html):
        m = TOKEN.match(html, end)
        if not m:
            break
        end = m.end()
        text, tag = m[5], m[2]
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if m[0][-1] != ">":
            break  # a tag cut off by the end of the page
        if tag in SKIPPED:
            if not closing and not m[4]:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, end)
                end = stop.end() if stop else len(html)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                while at.tag != tag:
                    opened[at.tag] -= 1
                    at = at.parent
                opened[tag] -= 1
                at = at.parent
            continue
        links = 0
        if tag in CLOSES_P and at.tag == "p":
            opened["p"] -= 1
            at = at.parent
        if tag == at.tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            opened[tag] -= 1
            at = at.parent
        if not m[4]:
            at = Element(tag, m[3], at)
            opened[tag] += 1
    flush()
    return blocks


FEATURES = [
    "bias", "words", "long", "linked", "prose", "commas", "heading", "paragraph", "item", "cell", "content tag", "boilerplate tag", "content name",
    "boilerplate name", "hidden", "content tag only", "outside the content tag", "first tenth", "last tenth", "linked around", "prose around", "letterless",
]


def features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; "around" looks at the blocks on both sides."""
    x = np.zeros((len(blocks), len(FEATURES)))
    marked = any(b.element.in_content for b in blocks)
    for i, b in enumerate(blocks):
        e, words = b.element, b.text.count(" ") + 1
        x[i, :19] = (
            1, np.log1p(min(words, 60)) - 2, words >= 25, b.linked / len(b.text), words >= 8 and 2 * b.linked < len(b.text) and b.text[-1] in ".!?:…»”\"'", min(b.text.count(","), 5) / 5,
            e.tag in HEADINGS, e.tag in ("p", "blockquote", "pre"), e.tag in ("li", "dt", "dd"), e.tag in ("td", "th"), e.in_content, e.in_boilerplate,
            e.named_content, e.named_boilerplate, e.hidden, e.in_content and not (e.in_boilerplate or e.named_boilerplate), marked and not e.in_content, 10 * i < len(blocks), 10 * i >= 9 * len(blocks),
        )
        x[i, 21] = not any(map(str.isalpha, b.text))
    for column, source in ((19, 3), (20, 4)):
        v = np.concatenate([[0.0], x[:, source], [0.0]])
        x[:, column] = (v[:-2] + v[2:]) / 2
    return x


def edges_of(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j, kind) and their closeness: neighbours in page order (kind 0), and a block with the last one under its parent (kind 1)."""
    pairs, near, last = [], [], {}
    for j, b in enumerate(blocks):
        e = b.element
        if j:
            a = blocks[j - 1].element
            pairs.append((j - 1, j, 0))
            near.append((1.0 if a.marks() == e.marks() else 0.25) / (1 + _steps(a, e)))
        before = last.get(id(e.parent), -1)
        if before >= 0 and before != j - 1:
            pairs.append((before, j, 1))
            near.append(1.0 if blocks[before].element.marks() == e.marks() else 0.25)
        last[id(e.parent)] = j
    return np.array(pairs, np.int64).reshape(-1, 3), np.array(near)


def _steps(a: Element, b: Element) -> int:
    """Steps up and down the tree from the parent of a to that of b."""
    n, a, b = 0, a.parent, b.parent
    while a is not b:
        if b is None or (a is not None and a.depth >= b.depth):
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut (of several, the one nearest to the source)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, forth: int, back: int) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(forth)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i in range(n):
        both = min(source[i], sink[i])
        if source[i] > both:
            add(s, i, source[i] - both, 0)
        if sink[i] > both:
            add(i, t, sink[i] - both, 0)
    for u, v, w in edges:
        add(u, v, w, w)
    while True:
        came = {s: -1}
        queue = deque([s])
        while queue and t not in came:
            u = queue.popleft()
            for e in out[u]:
                if room[e] and to[e] not in came:
                    came[to[e]] = e
                    queue.append(to[e])
        if t not in came:
            return [i in came for i in range(n)]
        path, v = [], t
        while v != s:
            path.append(came[v])
            v = to[came[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def cut_labels(odds: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for content under a minimum cut: odds are capacities to the source (> 0) or the sink (< 0)."""
    n = len(odds)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w and i != j:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    cap, room = list(odds), [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # a capacity that all edges together can't outweigh settles a block
        i = queue.popleft()
        if label[i] is None and (cap[i] > room[i] or -cap[i] >= room[i]):
            label[i] = cap[i] > room[i]
            for j, w in near[i].items():
                if label[j] is None:
                    cap[j] += w if label[i] else -w
                    room[j] -= w
                    queue.append(j)
    for start in range(n):
        if label[start] is None:
            part, at = [start], {start: 0}
            for i in part:
                for j in near[i]:
                    if label[j] is None and j not in at:
                        at[j] = len(part)
                        part.append(j)
            inner = [(at[i], at[j], w) for i in part for j, w in near[i].items() if j in at and i < j]
            for i, side in zip(part, min_cut([max(0, cap[i]) for i in part], [max(0, -cap[i]) for i in part], inner)):
                label[i] = side
    return [bool(x) for x in label]


@dataclass(frozen=True)
class Costs:
    """Weights of FEATURES, the clip of the odds, and the weights of the two kinds of edges."""

    weights: tuple[float, ...]
    clip: float
    order: float
    sibling: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ np.array(self.weights), -self.clip, self.clip)

    def labels(self, blocks: list[Block]) -> list[bool]:
        pairs, near = edges_of(blocks)
        return self.cut(features(blocks), pairs, near)

    def cut(self, x: np.ndarray, pairs: np.ndarray, near: np.ndarray) -> list[bool]:
        w = np.rint(1000 * near * np.where(pairs[:, 2] == 0, self.order, self.sibling)).astype(int)
        return cut_labels(np.rint(1000 * self.odds(x)).astype(int).tolist(), list(zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), w.tolist())))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@functools.lru_cache(maxsize=1)
def learn_costs() -> Costs:
    """Odds from LEARN_PAGES labelled pages; clip and edge weights that label most blocks of CHOOSE_PAGES others rightly."""

    def read(pages):
        for html, content in pages:
            if blocks := read_blocks(html):
                yield features(blocks), np.array([b.text in content for b in blocks], float), *edges_of(blocks)

    learn = list(read(labelled_pages(LEARN_PAGES, 1)))
    weights = tuple(logistic(np.concatenate([p[0] for p in learn]), np.concatenate([p[1] for p in learn])).tolist())
    choose, best = list(read(labelled_pages(CHOOSE_PAGES, 2))), (-1, None)
    for clip in (3.0, 5.0, 8.0):
        for order in (0.0, 0.5, 1.0, 2.0, 3.0):
            for sibling in (0.0, 0.5, 1.0, 2.0):
                costs = Costs(weights, clip, order, sibling)
                right = sum(int((np.array(costs.cut(x, pairs, near)) == (y == 1)).sum()) for x, y, pairs, near in choose)
                best = max(best, (right, costs), key=lambda b: b[0])
    return best[1]


def main_text(html: str | None, costs: Costs) -> str:
    """Content blocks joined by newlines; empty for a null or empty page or one without content."""
    blocks = read_blocks(html) if html else []
    return "\n".join(b.text for b, keep in zip(blocks, costs.labels(blocks)) if keep) if blocks else ""


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages plus the main text of each whole page; null and empty pages, and pages without content, have an empty one.

    A column named out_col is replaced, others pass through; repeated rows get equal texts, and of several minimum cuts the
    one nearest to the source counts. A page is one row of a task, however long; work grows with its blocks. An empty table
    gives an empty result.
    """
    pages = pages.drop(out_col) if out_col != html_col else pages.withColumnRenamed(html_col, "__html")
    html_at = pages.columns.index(html_col if out_col != html_col else "__html")
    names, shared = [*pages.columns, out_col], pages.sparkSession.sparkContext.broadcast(learn_costs())  # a few numbers

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py(), shared.value) for h in b.column(html_at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    out = pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(out_col, StringType())]))
    return out.drop("__html") if out_col == html_col else out


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
