"""Operator 7, HTML extraction: a tree-structured graphical model over the DOM.

Every element and text of a page is a node with a hidden mark, content or not. A node
potential (a logistic model of tag, position, text and link density) and a potential
for each parent-child edge tie the marks together. Sum-product messages go up from the
leaves and down from the root; they give each node's marginal exactly, as the graph is
a tree. Texts whose marginal is at least one half are the page's content.

The potentials are trained on a bounded sample of labelled pages. A page is labelled if
it has an ``article`` or ``main`` element: nodes in it are content, others are not. The
model never sees these tags (they count as ``div``), so pages without them are read alike.

Defined results
  null or empty html: no nodes, empty text; text without tags: one text node, judged by the model;
  broken markup: open elements end with their parent, stray end tags are dropped;
  null page_id: kept as null; repeated rows: extracted once each;
  long and deep pages, and tags that never end: read whole, in one pass;
  no labelled page to train on: all text outside head, script and style is content;
  an empty table: no rows; other columns: ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._sample import smallest
from loomspan.llm._text import batches, narrow

#: Labelled pages that are fitted at most (the classifier's sample bound).
FIT_PAGES = 400
SEED = 5
LABELS = ("article", "main")
TAGS = ("#text", "a", "b", "blockquote", "body", "br", "button", "code", "div", "dl", "em", "figure", "footer", "form", "h1", "h2", "h3", "h4", "head", "header", "html", "i", "img", "li", "nav", "ol", "p", "pre", "section", "span", "strong", "table", "td", "title", "tr", "ul", "aside", "other")
_CODE = {t: k for k, t in enumerate(TAGS)}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RAW = {"script", "style", "noscript", "template"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_BLOCK = {"p", "div", "ul", "ol", "li", "table", "section", "article", "main", "header", "footer", "nav", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dl"}
_SCOPE = {"div", "section", "article", "main", "body", "table", "ul", "ol", "nav", "header", "footer", "aside", "form", "blockquote", "dl", "html"}
_NAME = re.compile("[a-zA-Z][a-zA-Z0-9:-]*")
_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?i)(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)")
_CHROME = re.compile(r"(?i)\b(ads?|advert\w*|nav\w*|menu|foot\w*|side\w*|banner|cookie\w*|share|social|comment\w*|promo)\b")


def tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, lower-case name, attributes, whether it closes) of every tag; comments and declarations have no name.

    A tag ends at the first ``>`` outside quotes; a ``<`` without one is text. Where a
    tag ends is known for every mark (``>`` or quote) from one pass backwards over them,
    so that the page is read once however many of its tags are broken. The caller may
    send the place to go on from, as after a script.
    """
    marks = [m.start() for m in _MARK.finditer(page)]
    ends = [-1] * (len(marks) + 1)
    following = {'"': -1, "'": -1}
    for k in range(len(marks) - 1, -1, -1):
        c = page[marks[k]]
        if c == ">":
            ends[k] = marks[k]
        else:
            ends[k] = ends[following[c] + 1] if following[c] >= 0 else -1
            following[c] = k
    last = page.rfind(">")
    at = page.find("<")
    while at >= 0:
        go = at + 1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            go = len(page) if end < 0 else end + 3
            yield at, go, "", "", False
        elif page.startswith(("<!", "<?"), at):
            if last > at:
                go = page.find(">", at) + 1
                yield at, go, "", "", False
        else:
            close = page.startswith("/", at + 1)
            name = _NAME.match(page, at + 1 + close)
            end = ends[bisect_left(marks, name.end())] if name else -1
            if end >= 0:
                go = end + 1
                go = (yield at, go, name.group().lower(), page[name.end() : end], close) or go
        at = page.find("<", go)


class Tree:
    """A page's nodes in document order: parent, depth, tag, own text, whether chrome is named, whether labelled."""

    __slots__ = ("parent", "depth", "tag", "text", "chrome", "inside", "block", "link")

    def __init__(self, page: str):
        self.parent, self.depth, self.tag, self.text, self.chrome, self.inside, self.block, self.link = [], [], [], [], [], [], [], []
        self._add(-1, "html", "", False)
        stack: list[tuple[int, str]] = [(0, "html")]
        # how many elements of a name are open, in all and since each open element that bounds what an implied end reaches
        opened: dict[str, int] = {}
        scopes: list[dict[str, int]] = [{}]

        def shut(names: set[str]) -> None:
            while True:
                name = stack.pop()[1]
                opened[name] -= 1
                if name in _SCOPE:
                    scopes.pop()
                else:
                    scopes[-1][name] -= 1
                if name in names:
                    return

        at = 0
        scan = tags(page)
        found = next(scan, None)
        while found:
            first, end, name, attributes, close = found
            between, at, skip = page[at:first], end, None
            if between and not between.isspace():
                self._add(stack[-1][0], "#text", between, False)
            if close:
                if opened.get(name):
                    shut({name})
            elif name in _RAW:
                raw_end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = skip = raw_end.end() if raw_end else len(page)
            elif name and name != "html":
                ended = _CLOSES.get(name) or ({"p"} if name in _BLOCK else ())
                if any(scopes[-1].get(x) for x in ended):
                    shut(ended)
                chrome = any(_CHROME.search(m[1]) for m in _ATTRIBUTE.finditer(attributes))
                node = self._add(stack[-1][0], name, "", chrome)
                if name not in _VOID and not attributes.endswith("/"):
                    stack.append((node, name))
                    opened[name] = opened.get(name, 0) + 1
                    if name in _SCOPE:
                        scopes.append({})
                    else:
                        scopes[-1][name] = scopes[-1].get(name, 0) + 1
            try:
                found = scan.send(skip) if skip else next(scan, None)
            except StopIteration:
                found = None
        between = page[at:]
        if between and not between.isspace():
            self._add(stack[-1][0], "#text", between, False)

    def _add(self, parent: int, name: str, text: str, chrome: bool) -> int:
        k = len(self.parent)
        up = parent >= 0
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if up else 0)
        self.inside.append(name in LABELS or (up and self.inside[parent]))
        self.link.append(name == "a" or (up and self.link[parent]))
        self.tag.append(_CODE["div"] if name in LABELS else _CODE.get(name, len(TAGS) - 1))
        self.text.append(text)
        self.chrome.append(chrome)
        self.block.append(k if name in _BLOCK or not up else self.block[parent])
        return k


class Forest:
    """The nodes of many pages in flat arrays, with the order in which messages go."""

    def __init__(self, trees: list[Tree]):
        size = np.array([len(t.parent) for t in trees], np.int64)
        self.edge = np.concatenate([[0], np.cumsum(size)])
        flat = lambda name, kind: np.fromiter((x for t in trees for x in getattr(t, name)), kind, int(self.edge[-1]))
        self.depth, self.tag, self.chrome, self.inside, self.link = flat("depth", np.int64), flat("tag", np.int64), flat("chrome", bool), flat("inside", bool), flat("link", bool)
        parent = flat("parent", np.int64)
        self.parent = np.where(parent >= 0, parent + np.repeat(self.edge[:-1], size), -1)
        self.length = np.fromiter((len(x.strip()) for t in trees for x in t.text), np.float64, len(parent))
        order = np.argsort(self.depth, kind="stable")
        cut = np.searchsorted(self.depth[order], np.arange(int(self.depth.max()) + 2)) if len(order) else np.zeros(1, np.int64)
        self.levels = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def features(self) -> np.ndarray:
        text, linked, nodes = self.length.copy(), self.length * self.link, np.ones(len(self.length))
        named = self.chrome.copy()
        for level in self.levels[:0:-1]:
            for x in (text, linked, nodes):
                np.add.at(x, self.parent[level], x[level])
        for level in self.levels[1:]:
            named[level] |= named[self.parent[level]]
        up = np.maximum(self.parent, 0)
        hot = np.zeros((len(text), 2 * len(TAGS)), np.float32)
        lane = np.arange(len(text))
        hot[lane, self.tag] = 1
        hot[lane, len(TAGS) + self.tag[up]] = 1
        density = linked / np.maximum(text, 1)
        more = np.stack([np.ones(len(text)), np.log1p(text) / 5, density, np.log1p(text[up]) / 8, density[up], named, np.log1p(nodes) / 5, np.minimum(self.depth, 20) / 10], 1)
        return np.concatenate([hot, more.astype(np.float32)], 1)

    def marginals(self, unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """P(content) per node; unary[v, x] and edge[x_parent, x_child] are log potentials. Exact sum-product."""
        inward = unary.astype(np.float64).copy()  # a node's potential and its children's messages
        message = np.zeros_like(inward)
        for level in self.levels[:0:-1]:
            joint = inward[level][:, None, :] + edge[None]
            message[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(inward, self.parent[level], message[level])
        belief = inward.copy()
        for level in self.levels[1:]:
            rest = belief[self.parent[level]] - message[level]  # the parent without what this child told it
            joint = rest[:, :, None] + edge[None]
            belief[level] = inward[level] + np.logaddexp(joint[:, 0, :], joint[:, 1, :])
            belief[level] -= belief[level].max(1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


class Model:
    """Node weights and edge potentials, trained piecewise."""

    def __init__(self, pages: list[str]):
        trees = [t for t in map(Tree, pages) if any(t.inside)]
        self.trained = bool(trees)
        if not trees:
            return
        forest = Forest(trees)
        x, y = forest.features().astype(np.float64), forest.inside.astype(np.float64)
        w = np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            step = np.linalg.solve(hessian, x.T @ (y - p) - w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        child = np.flatnonzero(forest.parent >= 0)
        pair = np.bincount(2 * forest.inside[forest.parent[child]] + forest.inside[child], minlength=4).reshape(2, 2) + 1.0
        pair /= pair.sum()
        self.edge = np.log(pair / (pair.sum(1, keepdims=True) * pair.sum(0, keepdims=True)))

    def content(self, trees: list[Tree]) -> list[np.ndarray]:
        """P(content) of each node of each page."""
        forest = Forest(trees)
        if not self.trained:
            heads = forest.tag == _CODE["head"]
            for level in forest.levels[1:]:
                heads[level] |= heads[forest.parent[level]]
            p = 1.0 - heads
        else:
            z = forest.features() @ self.weights
            p = forest.marginals(np.stack([np.zeros(len(z)), z], 1), self.edge)
        return [p[a:b] for a, b in zip(forest.edge[:-1], forest.edge[1:])]


def render(tree: Tree, keep: np.ndarray) -> tuple[str, int]:
    """(text of the kept text nodes: one line per block, white space collapsed; how many there are)."""
    lines, block, n = [], None, 0
    for k, text in enumerate(tree.text):
        if tree.tag[k] == 0 and keep[k]:
            clean = " ".join(entities.unescape(text).split())
            n += 1
            if not clean:
                continue
            if block == tree.block[k] and lines:
                lines[-1] += " " + clean
            else:
                lines.append(clean)
            block = tree.block[k]
    return "\n".join(lines), n


def fit_pages(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Model:
    """A model of at most ``fit_pages`` labelled pages, the first by a hash of the id."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    labelled = rows.where("html is not null").where(" or ".join(f"lower(html) like '%<{t}%'" for t in LABELS))
    return Model([r.html for r in smallest(labelled, fit_pages, "page_id", SEED, F.md5("html"))])


def extract_content(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, n_nodes, n_content, text) of every row; after the bounded fit a map without a shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit_pages(pages))

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                html = part.column(1).to_pylist()
                trees = [Tree(x or "") for x in html]
                done = [render(t, p >= 0.5) for t, p in zip(trees, shared.value.content(trees))]
                nodes = [len(t.parent) if x else 0 for t, x in zip(trees, html)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), pa.array([n for _, n in done], pa.int64()), pa.array([x for x, _ in done], pa.string())], names=["page_id", "n_nodes", "n_content", "text"])

    return narrow(pages, key="page_id", text="html").mapInArrow(read, "page_id bigint, n_nodes bigint, n_content bigint, text string")
