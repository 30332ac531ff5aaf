"""Operator 9: the main text of web pages by a tree-structured graphical model over their elements.

Block elements of a page are the nodes of a tree. A node's potential for being content comes from its tag, the words
in its class, id and role, those of the elements around it, and its own text; a potential of parent and child connects nodes. Sum-product message
passing, once upward and once downward, gives each node's marginal exactly. The parameters are those of a conditional
random field, trained by gradient ascent on labelled pages (html_pages). Text of nodes with a marginal over one half is
what is extracted, in page order. Trees of many pages are passed level by level at once in numpy.

Nulls and ties: a null or empty html gives an empty text. A marginal of exactly one half is not content. Broken markup is
read as far as it goes: what isn't closed ends with its parent, what wasn't opened isn't closed. Rows with one page_id
are each extracted. Other columns are kept as they are, but for text and n_chars, which are replaced.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sightstream.llm.common import bounded, tune
from sightstream.llm.html_pages import NAMES, pages

#: Elements that are part of the line they stand in.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source map area".split())

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements whose content isn't text of the page.
HIDDEN = frozenset("script style template noscript svg math iframe object canvas audio video title textarea select button datalist option".split())

#: Elements that an element of the same group ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Where the search for such an element ends.
SCOPE = frozenset("ul ol dl table div article section main body html aside nav header footer form blockquote".split())

TAGS = "html body head nav header footer aside article main section div p h1 h2 h3 h4 ul ol li table tr td th tbody form fieldset blockquote pre figure figcaption details dl dd dt address center other".split()
_TAG = {t: i for i, t in enumerate(TAGS)}
KINDS = list(NAMES)
_KIND: dict[str, set[int]] = {}
for _i, _k in enumerate(KINDS):
    for _name in NAMES[_k]:
        for _part in [_name, *_name.split("-")]:
            if _part not in ("main", "page", "site", "list", "head", "more", "bottom", "text") or _part == _name:
                _KIND.setdefault(_part, set()).add(_i)
#: Values of the attribute role, with the kind of part they name.
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "alert": "notice", "dialog": "notice", "main": "content", "article": "content", "menu": "nav"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>?", re.S)
ATTRIBUTE = re.compile(r"(?:\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))", re.I)
PARTS = re.compile(r"[^a-z0-9-]+")
MARK = "data-article"

#: Length of a node's own text in characters, and its share in links: borders of the groups.
LENGTHS = (1, 25, 80, 200)
OWN = 1 + len(TAGS) + len(KINDS) + len(LENGTHS) + 4

#: Features that the elements inside a node have from it: parts of a page by tag and by name.
PASSED_ON = [*(1 + TAGS.index(t) for t in ("head", "nav", "header", "footer", "aside", "article", "main", "form", "fieldset")), *range(1 + len(TAGS), 1 + len(TAGS) + len(KINDS))]
FEATURES = OWN + len(PASSED_ON)


class Tree(NamedTuple):
    parent: list[int]
    depth: list[int]
    tag: list[int]
    kinds: list[tuple[int, ...]]
    marked: list[bool]
    segments: list[tuple[int, str]]  # (node, text of one block)
    linked: list[int]  # characters in links, of each node


@lru_cache(50_000)
def attributes(tag: str, raw: str) -> tuple[int, ...]:
    found: set[int] = set()
    for m in ATTRIBUTE.finditer(raw):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value in ROLES:
                found.add(KINDS.index(ROLES[value]))
            continue
        for word in PARTS.split(value):
            for part in (word, *word.split("-")):
                found |= _KIND.get(part, set())
    return tuple(sorted(found))


def parse(page: str) -> Tree:
    parent, depth, tags, kinds, marked, linked, segments = [-1], [0], [_TAG["other"]], [()], [False], [0], []
    stack: list[tuple[str, int]] = [("", 0)]
    opened: defaultdict[str, list[int]] = defaultdict(lambda: [-1])  # where each tag is in the stack, so that nothing is searched for, however deep it is
    buffer: list[str] = []
    link = False

    def flush() -> None:
        nonlocal link
        if buffer:
            raw = "".join(buffer)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                segments.append((stack[-1][1], text))
            buffer.clear()
        link = False

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag].pop()
        return tag

    def text(raw: str) -> None:
        if raw:
            buffer.append(raw)
            if link:
                linked[stack[-1][1]] += len(raw)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and MARK in m[0]:
                marked[stack[-1][1]] = True
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = False
            elif tag not in INLINE and tag not in VOID and opened[tag][-1] > 0:
                flush()
                while close() != tag:
                    pass
            continue
        if tag in INLINE:
            if tag == "a":
                link = True
            continue
        if tag in VOID:
            if tag == "br" or tag == "hr":
                buffer.append(" ")
            continue
        if tag in HIDDEN:
            if not m[3].endswith("/"):
                closing = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
                at = closing.end() if closing else end
            if tag not in ("script", "style", "template", "noscript"):
                buffer.append(" ")
            continue
        flush()
        if stack[-1][0] == "p":
            close()
        if tag in ENDS and (last := max(opened[t][-1] for t in ENDS[tag])) > max(opened[t][-1] for t in SCOPE - ENDS[tag]):
            while len(stack) > last:
                close()
        node, up = len(parent), stack[-1][1]
        parent.append(up)
        depth.append(depth[up] + 1)
        tags.append(_TAG.get(tag, _TAG["h4"] if tag in ("h5", "h6") else _TAG["other"]))
        kinds.append(attributes(tag, m[3]) if m[3] else ())
        marked.append(MARK in m[3])
        linked.append(0)
        if not m[3].endswith("/"):
            stack.append((tag, node))
            opened[tag].append(len(stack) - 1)
    flush()
    return Tree(parent, depth, tags, kinds, marked, segments, linked)


class Forest(NamedTuple):
    """Trees of several pages, one after another."""

    parent: np.ndarray
    depth: np.ndarray
    features: np.ndarray
    first: list[int]


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from the roots on."""
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
    return [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def forest(trees: list[Tree]) -> Forest:
    first = np.cumsum([0, *(len(t.parent) for t in trees)])
    n = int(first[-1])
    parent, own, links = np.empty(n, np.int64), np.zeros(n), np.zeros(n)
    depth, tag = np.concatenate([t.depth for t in trees]), np.concatenate([t.tag for t in trees])
    x = np.zeros((n, FEATURES), np.float32)
    sentence, alone = np.zeros(n, bool), np.zeros(n, bool)
    for t, base in zip(trees, first, strict=False):
        p = np.array(t.parent)
        parent[base : base + len(p)] = np.where(p < 0, -1, p + base)
        links[base : base + len(p)] = t.linked
        for node, s in t.segments:
            own[base + node] += len(s)
            sentence[base + node] |= s[-1] in ".!?"
        if t.segments and len(having := {node for node, _ in t.segments}) == 1:
            alone[base + having.pop()] = True  # all text of the page is this node's
        for i, k in enumerate(t.kinds):
            if k:
                x[base + i, [1 + len(TAGS) + j for j in k]] = 1
    x[:, 0] = 1
    x[np.arange(n), 1 + tag] = 1
    at = 1 + len(TAGS) + len(KINDS)
    for i, least in enumerate(LENGTHS):
        x[:, at + i] = own >= least
    x[:, at + len(LENGTHS)] = links > 0.5 * np.maximum(own, 1)
    x[:, at + len(LENGTHS) + 1] = sentence
    x[:, at + len(LENGTHS) + 2] = (own > 0) & (tag == _TAG["div"])
    x[:, at + len(LENGTHS) + 3] = alone
    for level in levels_of(depth)[1:]:
        up = parent[level]
        x[level, OWN:] = np.maximum(x[up][:, PASSED_ON], x[up, OWN:])
    return Forest(parent, depth, x, first.tolist())


class Model(NamedTuple):
    weights: np.ndarray  # of the features, for content against not
    pair: np.ndarray  # [parent][child]


def pass_messages(f: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 marginals of the nodes, n x 2 x 2 marginals of parent and child, zero for roots)."""
    theta = np.zeros((len(f.parent), 2))
    theta[:, 1] = f.features @ model.weights
    levels = levels_of(f.depth)
    below, up = theta.copy(), np.zeros_like(theta)
    for level in levels[:0:-1]:  # from the leaves
        up[level] = np.logaddexp(below[level, None, 0] + model.pair[:, 0], below[level, None, 1] + model.pair[:, 1])
        np.add.at(below, f.parent[level], up[level])
    belief, both = below.copy(), np.zeros((len(theta), 2, 2))
    for level in levels[1:]:  # from the roots
        rest = belief[f.parent[level]] - up[level]
        joint = rest[:, :, None] + model.pair + below[level, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        both[level] = joint
        down = np.logaddexp(rest[:, None, 0] + model.pair[0], rest[:, None, 1] + model.pair[1])
        belief[level] = below[level] + down
    belief = np.exp(belief - belief.max(1, keepdims=True))
    both = np.exp(both)
    both[f.parent < 0] = 0
    return belief / belief.sum(1, keepdims=True), both / np.maximum(both.sum((1, 2), keepdims=True), 1e-300)


def train(labelled: list[str], steps: int = 250, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Gradient ascent (Adam) on the conditional likelihood: observed less expected features, of nodes and of pairs."""
    trees = [parse(p) for p in labelled]
    f = forest(trees)
    y = np.concatenate([t.marked for t in trees]).astype(np.int64)
    has = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[f.parent[has]], y[has]), 1)
    n = len(trees)
    p = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        node, pair = pass_messages(f, Model(p[:FEATURES], p[FEATURES:].reshape(2, 2)))
        g = np.concatenate([f.features.T @ (y - node[:, 1]), (seen - pair.sum(0)).reshape(-1)]) / n - decay * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(p[:FEATURES], p[FEATURES:].reshape(2, 2))


@lru_cache(1)
def default_model() -> Model:
    """Trained from the generated pages, once a process."""
    return train(pages())


def extract(htmls: list[str | None], model: Model) -> list[str]:
    trees = [parse(h or "") for h in htmls]
    if not trees:
        return []
    f = forest(trees)
    content = pass_messages(f, model)[0][:, 1] > 0.5
    return [" ".join(s for node, s in t.segments if content[base + node]) for t, base in zip(trees, f.first, strict=False)]


def main_text(table: DataFrame, model: Model | None = None) -> DataFrame:
    """The columns of table, text and n_chars. model: None trains one from generated labelled pages."""
    model = model or default_model()
    table = tune(table).drop("text", "n_chars")
    at = table.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, at):
            out = extract(b.column(at).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*b.schema.names, "text", "n_chars"])

    return table.mapInArrow(run, StructType([*table.schema, StructField("text", StringType()), StructField("n_chars", LongType())]))


def op9(table: DataFrame) -> DataFrame:
    return main_text(table.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
