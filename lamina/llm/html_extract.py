"""HTML extraction with a tree-structured graphical model.

Every node of a page's tree, elements and texts, is content or not. A node's
own potential is linear in what is seen of it; a child's potential with its
parent is a two-by-two table by the kind of the child. Sum-product messages
upward and downward give each node's marginal exactly, and training climbs the
labelled pages' likelihood with the same messages.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, small_batches

#: Labelled pages that the model is fitted on, about at most.
MAX_LABELLED = 400
STEPS = 60
#: Pages that are parsed and inferred together.
CHUNK = 256

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
_HIDDEN = frozenset("script style noscript template iframe head".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPE = frozenset("article aside body div footer header html main nav section table td th ul ol blockquote form".split())
_TAGS = ["#text", "p", "div", "a", "li", "ul", "nav", "footer", "header", "article", "main", "section", "aside", "h1", "h2", "h3", "b", "span", "td", "table", "title", "head", "body", "html", "form", "blockquote", "pre"]
_TAG = {t: i for i, t in enumerate(_TAGS)}
_CLUES = [re.compile(r"\b(?:ad|ads|advert|banner|sponsor|promo)", re.I), re.compile(r"nav|menu|side|foot|head|comment|share|social|cookie|related|widget", re.I), re.compile(r"article|content|main|post|entry|body|text|story", re.I)]
_NUMBERS = 8
N_FEATURES = 2 * (len(_TAGS) + 1) + len(_CLUES) + _NUMBERS + 1
_KINDS = 4  # texts, inline, blocks, parts of the page
_PARTS = frozenset("nav footer header article main section aside body head html div ul table form".split())


class Page:
    """A page's nodes in document order: parent, tag, attributes, a text's own text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs, self.text = [-1], ["html"], [""], [""]
        stack = [0]
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            begin = m.start() if m else len(source)
            if begin > at:
                self._words(stack[-1], source[at:begin])
            if not m:
                break
            at = m.end()
            name = (m.group(2) or "").lower()
            if not name:
                continue
            if m.group(1):
                self._close(stack, name)
                continue
            if name in ("html", "body") and name in [self.tag[k] for k in stack]:
                self.attrs[next(k for k in stack if self.tag[k] == name)] += m.group(3)
                continue
            self._open(stack, name)
            self._add(stack[-1], name, m.group(3), "")
            node = len(self.tag) - 1
            if name in _VOID or m.group(3).endswith("/") and name not in _BLOCK:
                continue
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(source, at)
                inner = source[at : end.start() if end else len(source)]
                at = end.end() if end else len(source)
                if name not in _HIDDEN and inner:
                    self._words(node, inner)
                continue
            stack.append(node)

    def _add(self, parent: int, tag: str, attrs: str, text: str) -> None:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)

    def _words(self, parent: int, raw: str) -> None:
        if raw and not raw.isspace():
            self._add(parent, "#text", "", html.unescape(raw))

    def _open(self, stack: list[int], name: str) -> None:
        """Closes what this start tag ends: a paragraph before a block, the item before an item."""
        ends = _CLOSES.get(name, set()) | ({"p"} if name in _BLOCK else set())
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in ends:
                del stack[k:]
                return
            if tag in _SCOPE:
                return

    def _close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                del stack[k:]
                return
            if name not in _SCOPE and self.tag[stack[k]] in _SCOPE:
                return


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    x = np.zeros((n, N_FEATURES), np.float32)
    parent = page.parent
    chars, linked, stops, depth = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    in_link = [False] * n
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
        in_link[k] = page.tag[k] == "a" or in_link[parent[k]]
        if page.tag[k] == "#text":
            t = page.text[k]
            chars[k] = len(t.strip())
            linked[k] = chars[k] if in_link[k] else 0
            stops[k] = t.count(".") + t.count(",")
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        stops[p] += stops[k]
    other = len(_TAGS)
    tags = np.array([_TAG.get(t, other) for t in page.tag])
    x[np.arange(n), tags] = 1
    x[np.arange(1, n), other + 1 + tags[np.array(parent[1:], int)]] = 1
    at = 2 * (other + 1)
    for k in range(n):
        if page.attrs[k]:
            for c, clue in enumerate(_CLUES):
                x[k, at + c] = bool(clue.search(page.attrs[k]))
    at += len(_CLUES)
    size = np.maximum(chars, 1)
    x[:, at] = np.log1p(chars) / 4
    x[:, at + 1] = linked / size
    x[:, at + 2] = np.minimum(stops / size * 20, 3)
    x[:, at + 3] = np.minimum(depth, 20) / 10
    x[:, at + 4] = np.arange(n) / n
    x[:, at + 5] = chars == 0
    x[:, at + 6] = chars < 25
    x[:, at + 7] = chars > 120
    x[:, at + 8] = 1
    return x


def kinds(page: Page) -> np.ndarray:
    return np.array([0 if t == "#text" else 3 if t in _PARTS else 2 if t in _BLOCK else 1 for t in page.tag])


class Forest:
    """Some pages' trees as arrays, with the nodes of each depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.x = np.concatenate([features(p) for p in pages])
        self.kind = np.concatenate([kinds(p) for p in pages])
        self.parent = np.concatenate([np.array(p.parent) + a for p, a in zip(pages, self.at)])
        self.parent[self.at[:-1]] = -1
        level = self.at[:-1]
        self.levels = [level]
        child = np.argsort(self.parent, kind="stable")
        starts = np.searchsorted(self.parent[child], np.arange(len(self.parent) + 1))
        while len(level):
            n = starts[level + 1] - starts[level]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[level], n)
            level = child[k]
            if len(level):
                self.levels.append(level)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(trees: Forest, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's probability of being content, and each child's joint probabilities with its parent (parent, child)."""
    n = len(trees.parent)
    up = np.zeros((n, 2))
    up[:, 1] = trees.x @ w
    message = np.zeros((n, 2))  # to the parent, by the parent's state
    for level in reversed(trees.levels[1:]):
        message[level] = _log_sum(pair[trees.kind[level]] + up[level][:, None, :], 2)
        np.add.at(up, trees.parent[level], message[level])
    down = np.zeros((n, 2))
    both = np.zeros((n, 2, 2))
    for level in trees.levels[1:]:
        p = trees.parent[level]
        rest = up[p] + down[p] - message[level]
        joint = pair[trees.kind[level]] + rest[:, :, None]
        down[level] = _log_sum(joint, 1)
        joint = joint + up[level][:, None, :]
        flat = joint.reshape(-1, 4)
        both[level] = np.exp(flat - _log_sum(flat, 1)[:, None]).reshape(-1, 2, 2)
    belief = up + down
    return np.exp(belief[:, 1] - _log_sum(belief, 1)), both


def fit(pages: list[Page], labels: list[np.ndarray], steps: int = STEPS, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials with the highest likelihood of the labelled trees, by gradient steps."""
    w, pair = np.zeros(N_FEATURES), np.zeros((_KINDS, 2, 2))
    if not pages:
        w[-1] = -1.0
        return w, pair
    trees, y = Forest(pages), np.concatenate(labels).astype(float)
    child = trees.parent >= 0
    told = np.zeros((len(y), 2, 2))
    a, b = y[trees.parent[child]].astype(int), y[child].astype(int)
    told[np.flatnonzero(child), a, b] = 1
    count = np.array([max((trees.kind[child] == k).sum(), 1) for k in range(_KINDS)])
    mw, vw, mp, vp = (np.zeros_like(z) for z in (w, w, pair, pair))
    for t in range(1, steps + 1):
        p, both = marginals(trees, w, pair)
        gw = trees.x.T @ (y - p) / len(y) - l2 * w
        gp = np.zeros_like(pair)
        np.add.at(gp, trees.kind[child], (told - both)[child])
        gp = gp / count[:, None, None] - l2 * pair
        for z, g, m, v in ((w, gw, mw, vw), (pair, gp, mp, vp)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            z += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, pair


_WORDS = re.compile(r"\w+")


def labels_from(page: Page, text: str) -> np.ndarray:
    """Which nodes hold a document's text: its texts, the longest first, each claim a free occurrence of theirs; an element is content if half of its words are."""
    doc = " " + " ".join(_WORDS.findall(text.lower())) + " "
    free = np.ones(len(doc), bool)
    n = len(page.tag)
    words = [_WORDS.findall(t.lower()) if t else [] for t in page.text]
    total, mine = np.zeros(n), np.zeros(n)
    order = sorted((k for k in range(n) if words[k]), key=lambda k: (-len(" ".join(words[k])), -k))
    for k in order:
        total[k] = len(words[k])
        key = " " + " ".join(words[k]) + " "
        at = doc.find(key)
        while at >= 0:
            if free[at + 1 : at + len(key) - 1].all():
                free[at + 1 : at + len(key) - 1] = False
                mine[k] = total[k]
                break
            at = doc.find(key, at + 1)
    for k in range(n - 1, 0, -1):
        total[page.parent[k]] += total[k]
        mine[page.parent[k]] += mine[k]
    return (total > 0) & (2 * mine >= total)


def content(page: Page, p: np.ndarray, least: float = 0.5) -> tuple[str, int]:
    """The texts that are content, a line for each block; and how many blocks."""
    lines: list[list[str]] = []
    last = None
    for k in range(1, len(page.tag)):
        if page.tag[k] == "br":
            last = None
        if page.tag[k] != "#text" or p[k] < least:
            continue
        block = page.parent[k]
        while block and page.tag[block] not in _BLOCK:
            block = page.parent[block]
        if block != last:
            lines.append([])
            last = block
        lines[-1].append(page.text[k])
    shown = [" ".join("".join(x).split()) for x in lines]
    shown = [x for x in shown if x]
    return "\n".join(shown), len(shown)


def taught(pages: DataFrame, docs: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """fit on pages whose URL names a document: that document's text is their content."""
    path = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    named = F.regexp_extract(path, r"/(\d{1,18})(?:[/.?#]|$)", 1)
    some = pages.where("html is not null").select("page_id", "html", F.when(named != "", named.cast("long")).alias("doc")).where("doc is not null")
    some = hashed_share(some, "page_id", max_labelled).toPandas()
    if not len(some):
        return fit([], [])
    texts = docs.where("text is not null").where(F.col("doc_id").isin([int(x) for x in some["doc"].unique()])).groupBy("doc_id").agg(F.min("text").alias("text")).toPandas()
    text = dict(zip(texts["doc_id"], texts["text"]))
    rows = sorted((r.page_id, r.html, text[r.doc]) for r in some.itertuples() if r.doc in text)
    trees = [Page(h) for _, h, _ in rows]
    return fit(trees, [labels_from(t, d) for t, (_, _, d) in zip(trees, rows)])


def extracted(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, text, n_blocks, certainty) of every page: its content, a line for each block.

    certainty is the mean probability of the decisions on the page's texts. A
    null, empty or textless page has an empty text, no blocks and certainty
    1; broken markup is read as browsers do; repeated rows are each reported.
    Pages are read whole, however long; a probability of exactly one half is
    content. page_ids are of any type, other columns are ignored, whatever
    their names.
    """
    w, pair = taught(pages, docs)
    kind = pages.schema["page_id"].dataType.simpleString()

    def over(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                trees = [Page(h.as_py() or "") for h in some.column(1)]
                forest = Forest(trees)
                p, _ = marginals(forest, w, pair)
                texts, blocks, sure = [], [], []
                for tree, a, b in zip(trees, forest.at[:-1], forest.at[1:]):
                    q = p[a:b]
                    text, n = content(tree, q)
                    own = q[[t == "#text" for t in tree.tag]]
                    texts.append(text)
                    blocks.append(n)
                    sure.append(float(np.maximum(own, 1 - own).mean()) if len(own) else 1.0)
                yield pa.record_batch([some.column(0), pa.array(texts, pa.string()), pa.array(blocks, pa.int64()), pa.array(sure, pa.float64())], ["page_id", "text", "n_blocks", "certainty"])

    return small_batches(pages).select("page_id", "html").mapInArrow(over, f"page_id {kind}, text string, n_blocks bigint, certainty double")
