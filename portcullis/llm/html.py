"""Main text of web pages by a tree-structured graphical model.

The block elements of a page and the runs of text between their tags are the nodes of a tree, each with a hidden
state: it holds the article, is of it, or is of something else. A node's state depends on its parent's (one 3 x 3
potential for elements, one for runs of text), and its observed features on its state. All potentials are smoothed relative frequencies over labelled pages. Messages go
from the leaves up and from the root down (sum-product), which gives each node's exact marginal; runs of text whose
marginal says article are the page's main text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled_pages

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content is never shown as text of a page.
HIDDEN = frozenset("script style head title noscript template svg math iframe object noembed noframes textarea select option datalist audio video canvas".split())
BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend button label blockquote pre figure figcaption address "
    "details summary center hgroup menu dialog".split()
)
_CLOSES_P = BLOCKS - {"html", "body", "button", "label", "caption", "td", "th", "tr", "thead", "tbody", "tfoot", "legend", "dt", "dd", "li"} | {"hr"}
#: What may stand in a head; any other start tag, and text, closes an open one.
_IN_HEAD = frozenset("head title meta link base basefont bgsound style script noscript noframes template object".split())
#: What a start tag closes, and where the search for it ends.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_GROUPS = {w: g for g, names in labelled_pages.NAMES.items() for n in names for w in n.lower().split("-") if g != "wrap" and w not in ("page", "list", "site", "main" if g == "nav" else "", "body" if g == "comment" else "", "top", "bottom", "us", "also", "more", "read", "follow", "text", "slot", "col")}
_GROUPS |= {"navigation": "nav", "contentinfo": "footer", "complementary": "side", "banner": "ad", "commentary": "comment", "advertising": "ad", "cookies": "notice", "menus": "nav", "navi": "nav", "comments": "comment", "main": "main"}


class Page:
    """The tree of one page: parallel lists by node, parents before children."""

    def __init__(self, source: str, labels: bool = False) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.group: list[str] = []
        self.label: list[int] = []
        self.text: list[str] = []  # of runs; empty for elements
        self.linked: list[int] = []  # characters of a run inside links
        self._build(source, labels)

    def _node(self, parent: int, tag: str, group: str, label: int, text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.group.append(group)
        self.label.append(label)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1

    def _build(self, source: str, labels: bool) -> None:
        root = self._node(-1, "#root", "", 0)
        stack: list[tuple[str, int]] = [("#root", root)]  # open elements, each with its block
        run: list[str] = []
        linked, links, hidden, heads, at = 0, 0, 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    block = stack[-1][1]
                    self._node(block, "#text", "", self.label[block], text, linked)
                run.clear()
                linked = 0

        def pop() -> None:
            nonlocal links, hidden, heads
            tag, _ = stack[-1]
            if tag in BLOCKS:
                flush()
            links -= tag == "a"
            hidden -= tag in HIDDEN
            heads -= tag == "head"
            stack.pop()

        def data(text: str) -> None:
            nonlocal linked
            if heads and stack[-1][0] == "head" and not text.isspace():
                pop()
            if text and not hidden:
                text = entities.unescape(text) if "&" in text else text
                run.append(text)
                if links:
                    linked += len(text)

        end = len(source)
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                data(source[at:])
                break
            m = _TAG.match(source, lt)
            if m is None:
                data(source[at : lt + 1])
                at = lt + 1
                continue
            if lt > at:
                data(source[at:lt])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                depth = len(stack) - 1
                while depth and stack[depth][0] != tag:
                    depth -= 1
                while depth and len(stack) > depth:
                    pop()
                continue
            if heads and tag not in _IN_HEAD:
                depth = next(i for i, (name, _) in enumerate(stack) if name == "head")
                if tag == "body" or not any(name in ("noscript", "template", "object") for name, _ in stack[depth:]):
                    while len(stack) > depth:
                        pop()
            if tag == "br" or tag == "hr":
                run.append(" ")
            if tag in _CLOSES_P:
                depth = len(stack) - 1
                while depth and stack[depth][0] not in ("p", "td", "th", "li", "div", "article", "section", "main", "body", "button"):
                    depth -= 1
                if depth and stack[depth][0] == "p":
                    while len(stack) > depth:
                        pop()
            elif tag in _IMPLIED:
                closed, stop = _IMPLIED[tag]
                depth = len(stack) - 1
                while depth and stack[depth][0] not in stop and stack[depth][0] not in closed:
                    depth -= 1
                if depth and stack[depth][0] in closed:
                    while len(stack) > depth:
                        pop()
            rest = m[3] if m[2] else m[6]
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
                continue
            block = stack[-1][1]
            if tag in BLOCKS:
                flush()
                group, label = "", self.label[block]
                if "=" in rest:
                    found = [(n.lower(), a or b or c) for n, a, b, c in _ATTRIBUTE.findall(rest)]
                    words = [w.lower() for n, v in found if n in ("class", "id", "role") for w in _WORDS.findall(v)]
                    groups = [_GROUPS[w] for w in words if w in _GROUPS]
                    group = next((g for g in groups if g != "main"), groups[0] if groups else "other" if words else "")
                    if labels:
                        label = next((int(v) for n, v in found if n == "data-main"), label)
                block = self._node(block, tag, group, label)
            links += tag == "a"
            hidden += tag in HIDDEN
            heads += tag == "head"
            stack.append((tag, block))
        flush()

    def features(self) -> list[tuple[str, ...]]:
        """Observed features of each node; those of an element sum over its text."""
        n = len(self.parent)
        chars, linked = [len(t) for t in self.text], list(self.linked)
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        out: list[tuple[str, ...]] = []
        inside = [False] * n  # of an article or main element, as far as there is one
        for i in range(n):
            inside[i] = self.tag[i] in ("article", "main") and self.group[i] in ("", "main", "other") or i > 0 and inside[self.parent[i]]
        some = any(inside)
        for i in range(n):
            share = linked[i] / chars[i] if chars[i] else -1
            dense = "none" if share < 0 else "free" if share == 0 else "some" if share < 0.3 else "half" if share < 0.7 else "full"
            if self.text[i]:
                text = self.text[i]
                size = "1" if chars[i] < 20 else "2" if chars[i] < 80 else "3" if chars[i] < 250 else "4"
                out.append(("t:" + dense + size, "e:" + ("stop" if text[-1] in ".!?…:;\"'”»)" else "open"), "c:" + ("mark" if "©" in text else "")))
            else:
                own = ("g:" + self.tag[i] + "*", "n:" + self.group[i], "d:" + dense) if self.group[i] else ("g:" + self.tag[i], "d:" + dense)
                if not (i and inside[self.parent[i]]):  # below it, the parent's state says this
                    own += ("a:" + ("in" if inside[i] else "out" if some else "none"),)
                out.append(own)
        return out


OUTER, ARTICLE, OTHER = range(3)
_STATES = (OUTER, ARTICLE, OTHER)


class Model:
    """Potentials as frequencies over labelled pages; a node holds the article, is of it, or is of something else."""

    def __init__(self, sources: list[str], smooth: float = 0.05) -> None:
        edges: dict[bool, list[list[float]]] = {k: [[0.2] * 3 for _ in _STATES] for k in (False, True)}
        seen: dict[str, list[float]] = {}
        totals: dict[str, list[float]] = {}
        values: dict[str, set[str]] = {}
        for source in sources:
            page = Page(source, labels=True)
            states = self.states(page)
            for i, observed in enumerate(page.features()):
                z = states[i]
                if i:
                    edges[bool(page.text[i])][states[page.parent[i]]][z] += 1
                for f in observed:
                    seen.setdefault(f, [0.0] * 3)[z] += 1
                    totals.setdefault(f[0], [0.0] * 3)[z] += 1
                    values.setdefault(f[0], set()).add(f)
        self.edge = {k: [[v / sum(row) for v in row] for row in rows] for k, rows in edges.items()}
        self.log = {f: [math.log((n[z] + smooth) / (totals[f[0]][z] + smooth * (len(values[f[0]]) + 1))) for z in _STATES] for f, n in seen.items()}
        self.known: dict[tuple[str, ...], tuple[float, ...]] = {}

    @staticmethod
    def states(page: Page) -> list[int]:
        """The labelled states: elements outside the article that hold some of it are outer ones."""
        holds = [x == 1 for x in page.label]
        for i in range(len(holds) - 1, 0, -1):
            holds[page.parent[i]] |= holds[i]
        return [ARTICLE if x == 1 else OUTER if h else OTHER for x, h in zip(page.label, holds, strict=True)]

    def likelihood(self, observed: tuple[str, ...]) -> tuple[float, ...]:
        """Scaled probabilities of a node's features in each state; unknown features say nothing."""
        if (out := self.known.get(observed)) is None:
            logs = [sum(self.log[f][z] for f in observed if f in self.log) for z in _STATES]
            out = tuple(math.exp(max(-60.0, x - max(logs))) for x in logs)
            if len(self.known) < 100_000:
                self.known[observed] = out
        return out

    def marginals(self, page: Page) -> list[float]:
        """Probability of each node that it is of the article, by messages up and down the tree."""
        n, parent = len(page.parent), page.parent
        up = [list(self.likelihood(f)) for f in page.features()]
        sent: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
        edges = [self.edge[bool(t)] for t in page.text]
        for i in range(n - 1, 0, -1):
            a, b, c = up[i]
            e0, e1, e2 = edges[i]
            m0, m1, m2 = e0[0] * a + e0[1] * b + e0[2] * c, e1[0] * a + e1[1] * b + e1[2] * c, e2[0] * a + e2[1] * b + e2[2] * c
            s = m0 + m1 + m2
            sent[i] = (m0 / s, m1 / s, m2 / s)
            u = up[parent[i]]
            x, y, z = u[0] * m0, u[1] * m1, u[2] * m2
            s = x + y + z
            u[0], u[1], u[2] = max(x / s, 1e-200), max(y / s, 1e-200), max(z / s, 1e-200)
        full: list[tuple[float, float, float]] = [(1.0, 0.0, 0.0)] * n  # the root holds whatever there is
        for i in range(1, n):
            f, m, u = full[parent[i]], sent[i], up[i]
            # the parent's belief without what came from here
            a, b, c = f[0] / m[0], f[1] / m[1], f[2] / m[2]
            e0, e1, e2 = edges[i]
            x = (a * e0[0] + b * e1[0] + c * e2[0]) * u[0]
            y = (a * e0[1] + b * e1[1] + c * e2[1]) * u[1]
            z = (a * e0[2] + b * e1[2] + c * e2[2]) * u[2]
            s = x + y + z
            full[i] = (x / s, y / s, z / s)
        return [f[1] for f in full]

    def blocks(self, source: str) -> list[str]:
        """The article's runs of text in page order."""
        page = Page(source)
        return [t for t, p in zip(page.text, self.marginals(page), strict=True) if t and p > 0.5]


@cache
def trained() -> Model:
    """The model of the generated labelled pages."""
    return Model(labelled_pages.pages())


def main_text(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """pages with blocks (the article's runs of text, in order) and text (the same, joined by one space).

    A null or empty page, and one without an article, has no blocks and the empty text. Columns of these two names
    are replaced, all others kept.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or trained())
    others = [c for c in pages.columns if c not in ("blocks", "text")]
    place = others.index(html) if html in others else len(others)  # a page's source may itself be named text
    # the row travels as one value, so its columns may have any names
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in others], *[F.col(f"`{html}`").alias("html")][: place == len(others)]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.column("row").slice(lo, 256)
                found = [held.value.blocks(x or "") for x in own.field(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([own, pa.array(found, pa.list_(pa.string())), pa.array([" ".join(x) for x in found], pa.string())], names=["row", "blocks", "text"])

    got = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, blocks array<string>, text string")
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in others], "blocks", "text")
