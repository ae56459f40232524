"""Main text of web pages: a tree-structured graphical model over the DOM, trained from labelled pages.

Every block element and every run of text in it is a node that is content or not. A node has a potential of its
features, an edge one of the labels of parent and child. Sum-product messages, first from the leaves up and then from
the root down, give each run its marginal; runs at 0.5 or more make the text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import small_batches, whole_text

# The model is fitted on at most this many pages, and nodes of them; every page is read.
TRAIN_PAGES = 512
TRAIN_NODES = 100_000
PRIOR_STRENGTH = 4.0
THRESHOLD = 0.5

# Fixed values of the language: elements without end, without text of the page, and that stand in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head svg math iframe object canvas title select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th"),
}
LIST_PARENTS = frozenset("ul ol dl table menu body".split())
KINDS = {
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"),
    **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"),
    **dict.fromkeys(("li", "dt", "dd"), "item"),
    **dict.fromkeys(("p", "blockquote", "pre"), "paragraph"),
    **dict.fromkeys(("figure", "figcaption", "table", "tbody", "thead", "tr", "td", "th"), "figure"),
    **dict.fromkeys(("div", "section", "span", "center"), "container"),
    **dict.fromkeys(("html", "body", "#root"), "root"),
    **dict.fromkeys(("form", "fieldset", "button", "textarea", "label"), "form"),
    **dict.fromkeys(("nav", "aside", "footer", "header", "article", "main", "address", "dialog"), ""),
}
LAYOUT = frozenset("table tbody thead tr td th".split())
# Whole words in class, id and role that tell what an element is for: "sign" is no part of "design" here.
NAMES = {
    "name_content": "article articles main content contents post entry story body text prose blog",
    "name_menu": "nav navbar navigation topnav menu menus submenu breadcrumb breadcrumbs pagination pager toolbar tabs skip",
    "name_header": "header masthead banner logo topbar",
    "name_footer": "footer foot copyright legal colophon",
    "name_side": "sidebar side aside widget widgets rail related recommended recommendations popular trending promo teaser teasers",
    "name_notice": "notice notices cookie cookies cookiebar consent gdpr alert popup modal overlay subscribe newsletter paywall",
    "name_advert": "ad ads advert adverts advertisement advertising sponsor sponsored outbrain taboola adsense",
    "name_form": "form search login signup signin register contact",
    "name_comment": "comment comments commentlist reply replies discussion disqus respond responses feedback",
    "name_share": "share sharing social tags byline meta author print rating",
}
NAMED = {word: name for name, words in NAMES.items() for word in words.split()}
# Names that a labelled article still leaves out.
OTHER_NAMES = frozenset(("name_menu", "name_comment", "name_advert", "name_notice", "name_side"))
# The word of consent notices, the same in most languages of the web. Short runs only: an article may be about it.
CONSENT = re.compile(r"\b(?:cookies?|gdpr)\b", re.I)

# Centre of the weights before any page is seen: features that the labelled pages don't show keep these.
PRIOR = {
    "bias": -0.2,
    "article": 3.0, "main": 2.0, "nav": -5.0, "aside": -4.0, "footer": -5.0, "header": -1.5, "form": -4.0,
    "dialog": -4.0, "address": -1.0, "heading": 0.5, "paragraph": 0.5, "list": -0.2, "item": -0.2, "figure": 0.0,
    "container": 0.0, "root": -1.0,
    "name_content": 1.5, "name_menu": -3.5, "name_header": -2.0, "name_footer": -4.0, "name_side": -3.0,
    "name_notice": -4.0, "name_advert": -4.0, "name_form": -3.0, "name_comment": -4.5, "name_share": -2.0,
    "run": 0.0, "linked": -2.0, "short": -0.3, "long": 0.7, "sentences": 0.4, "rights": -2.0, "consent": -3.0,
    "bulk": 3.0,
}
FEATURES = tuple(PRIOR)
PLACE = {name: i for i, name in enumerate(FEATURES)}
# Pseudo-counts of (parent, child) labels: elements below the root, below containers that could hold anything, below
# those that say they are the main part, below all other elements; and runs of text in any element but the root.
EDGE_PRIOR = {
    "root": ((10, 10), (1, 10)), "container": ((40, 6), (4, 40)), "main": ((60, 1), (10, 40)), "other": ((60, 1), (2, 60)),
    "run": ((200, 1), (1, 200)),
}
EDGES = tuple(EDGE_PRIOR)


@dataclass
class Node:
    tag: str
    parent: int
    names: frozenset[str] = frozenset()
    main: int | None = None
    text: list[str] = field(default_factory=list)
    letters: int = 0
    linked: int = 0
    layout: bool = False  # part of a table that holds blocks, as pages laid out by tables do
    bulk: bool = False  # holds over half of the page's text outside links
    holds: str = "root"  # kind of the edges to its children

    @property
    def run(self) -> bool:
        return self.tag == "#text"

    @property
    def kind(self) -> str:
        return "container" if self.layout else KINDS.get(self.tag, "container")


def name_groups(attrs: list) -> frozenset[str]:
    """Groups of the whole words in class, id and role; camelCase is two words."""
    words = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
    if not words:
        return frozenset()
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", words).lower()
    return frozenset(NAMED[w] for w in re.findall(r"[a-z]+", words) if w in NAMED)


class Dom(HTMLParser):
    """Block elements and runs of text of a page, parents before children, in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1)]
        self.open: list[tuple[str, int]] = [("#root", 0)]  # every open element with the block it belongs to
        self.hidden = 0
        self.links = 0
        self.run: Node | None = None
        self.feed(html)
        self.close()
        self._look_over()

    def _look_over(self) -> None:
        """Marks layout tables, and nodes that hold most of the text."""
        plain = [n.letters - n.linked for n in self.nodes]
        for i in range(len(self.nodes) - 1, 0, -1):
            node = self.nodes[i]
            parent = self.nodes[node.parent]
            plain[node.parent] += plain[i]
            if (node.layout and node.tag != "table") or (
                parent.tag in ("td", "th") and node.kind in ("paragraph", "heading", "list", "container") and not node.run
            ):
                parent.layout = parent.tag in LAYOUT
        for i, node in enumerate(self.nodes):
            up = self.nodes[node.parent] if node.parent >= 0 else node
            node.layout |= node.tag in LAYOUT and up.tag in LAYOUT and up.layout
            node.bulk = i > 0 and 2 * plain[i] > plain[0]
            node.holds = self._holds(node, up.holds)

    @staticmethod
    def _holds(node: Node, above: str) -> str:
        """What the edges to the children of a node are like. A container without a name is like what it stands in."""
        if node.tag in ("article", "main") or (node.kind == "container" and node.names == {"name_content"}):
            return "main"
        if node.kind not in ("root", "container") or node.names:
            return "other"
        return above if node.kind == "container" and above in ("main", "other") else node.kind

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag in ("br", "hr", "img") and self.run:
                self.run.text.append(" ")
            return
        if tag in HIDDEN:
            if tag == "head" or not self.hidden:
                self.run = None
            self.hidden += 1
            self.open.append((tag, self.open[-1][1]))
            return
        if tag == "body":  # an unclosed head ends here
            while self.hidden:
                self._pop()
        if tag in INLINE:
            self.links += tag == "a"
            self.open.append((tag, self.open[-1][1]))
            return
        self.run = None
        self._close_open_paragraph()
        self._close_siblings(tag)
        main = next((int(v == "1") for k, v in attrs if k == "data-main"), None)
        self.nodes.append(Node(tag, self.open[-1][1], name_groups(attrs), main))
        self.open.append((tag, len(self.nodes) - 1))

    def _pop(self) -> None:
        tag, _ = self.open.pop()
        self.hidden -= tag in HIDDEN
        self.links -= tag == "a"
        if tag not in INLINE:
            self.run = None

    def _close_open_paragraph(self) -> None:
        """A block inside a paragraph or heading ends it, with what is open in it."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth][0]
            if tag == "p" or (tag in KINDS and KINDS[tag] == "heading"):
                while len(self.open) > depth:
                    self._pop()
                return
            if tag not in INLINE:
                return

    def _close_siblings(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            above = self.open[depth][0]
            if above in CLOSES.get(tag, ()):
                while len(self.open) > depth:
                    self._pop()
                return
            if above in LIST_PARENTS:
                return

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                while len(self.open) > depth:
                    self._pop()
                return
            if tag in INLINE and self.open[depth][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.run is None:
            if not data.strip():
                return
            self.run = Node("#text", self.open[-1][1])
            self.nodes.append(self.run)
        self.run.text.append(data)
        size = len(data.strip())
        self.run.letters += size
        self.run.linked += size if self.links else 0


def features(node: Node) -> list[int]:
    """Places of the features that a node has."""
    out = [PLACE["bias"]]
    if node.run:
        text = "".join(node.text)
        out.append(PLACE["run"])
        if node.linked * 2 > node.letters:
            out.append(PLACE["linked"])
        out += [PLACE["short"]] if node.letters < 25 else [PLACE["long"]] if node.letters > 120 else []
        if re.search(r"[.!?…]\s+\S", text):
            out.append(PLACE["sentences"])
        if text.lstrip().startswith("©"):
            out.append(PLACE["rights"])
        if node.letters < 300 and CONSENT.search(text):
            out.append(PLACE["consent"])
        return out
    out.append(PLACE[node.kind or node.tag])
    out += [PLACE[name] for name in sorted(node.names)]
    if node.bulk:
        out.append(PLACE["bulk"])
    return out


def edge(parent: Node, child: Node) -> int:
    """Kind of an edge."""
    return EDGES.index("run" if child.run and parent.holds != "root" else parent.holds)


@dataclass
class PageModel:
    weights: list[float]
    edges: list[list[list[float]]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of being content for every node."""
        own = []
        for node in nodes:
            logit = max(-30.0, min(30.0, sum(self.weights[i] for i in features(node))))
            p = 1 / (1 + math.exp(-logit))
            own.append((1 - p, p))
        n = len(nodes)
        inside = [list(x) for x in own]  # own potential times the messages of the children
        upward = [(0.5, 0.5)] * n
        for i in range(n - 1, 0, -1):
            parent = nodes[i].parent
            table = self.edges[edge(nodes[parent], nodes[i])]
            a, b = inside[i]
            up0, up1 = table[0][0] * a + table[0][1] * b, table[1][0] * a + table[1][1] * b
            total = up0 + up1
            upward[i] = (up0 / total, up1 / total)
            p0, p1 = inside[parent][0] * upward[i][0], inside[parent][1] * upward[i][1]
            inside[parent] = [p0 / (p0 + p1), p1 / (p0 + p1)]
        beliefs = [(0.5, 0.5)] * n
        beliefs[0] = tuple(inside[0])
        for i in range(1, n):
            parent = nodes[i].parent
            table = self.edges[edge(nodes[parent], nodes[i])]
            # What the parent believes without this child's message.
            q0 = beliefs[parent][0] / max(upward[i][0], 1e-300)
            q1 = beliefs[parent][1] / max(upward[i][1], 1e-300)
            b0 = inside[i][0] * (q0 * table[0][0] + q1 * table[1][0])
            b1 = inside[i][1] * (q0 * table[0][1] + q1 * table[1][1])
            beliefs[i] = (b0 / (b0 + b1), b1 / (b0 + b1))
        return [b for _, b in beliefs]


def labelled(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that marks its article: what lies in it and in none of the parts that say they are something
    else. None for pages without such a mark."""
    if not any(n.tag == "article" for n in nodes):
        return None
    out = []
    for node in nodes:
        up = out[node.parent] if node.parent >= 0 else 0
        if node.tag == "article":
            up = 1
        if node.tag in ("nav", "aside", "footer", "form", "dialog") or node.names & OTHER_NAMES:
            up = 0
        out.append(up)
    return out


# Frames of rearranged training pages: the same texts under other markup. ``data-main`` tells where the main text
# begins (1) and where other parts do (0); it is read as a label only.
WRAPPERS = (
    ("<article data-main=1>", "</article>"),
    ("<main data-main=1>", "</main>"),
    ('<div class="post-content" data-main=1>', "</div>"),
    ('<div id="content" data-main=1>', "</div>"),
    ('<section class="entry" data-main=1>', "</section>"),
    ('<div class="{0}" data-main=1>', "</div>"),
    ('<section id="{0}" class="{1}" data-main=1>', "</section>"),
    ("<div data-main=1>", "</div>"),
    ("<table><tr><td data-main=1>", "</td></tr></table>"),
)
OTHER_PARTS = (
    '<header class="site-header" data-main=0><a href="/">{0}</a><p>{1}</p></header>',
    "<header data-main=0><h2>{0}</h2></header>",
    '<nav data-main=0><ul><li><a href="/a">{0}</a></li><li><a href="/b">{1}</a></li></ul></nav>',
    '<div class="menu" data-main=0><a href="/a">{0}</a> <a href="/b">{1}</a></div>',
    '<div class="cookie-notice" data-main=0><p>{0}</p><button>{1}</button></div>',
    '<div class="banner notice" data-main=0>{0}</div>',
    '<div class="advert" data-main=0><p>{0}</p></div>',
    '<div class="ad" data-main=0>{0}</div>',
    "<form data-main=0><label>{0}</label><input><p>{1}</p></form>",
    "<aside data-main=0><h3>{0}</h3><p>{1}</p></aside>",
    '<div class="sidebar" data-main=0><h3>{0}</h3><p>{1}</p><ul><li><a href="/c">{0}</a></li></ul></div>',
    '<section class="comments" data-main=0><h3>{0}</h3><div class="comment"><p>{1}</p></div><p>{0}</p></section>',
    '<div id="comments" data-main=0><ol><li><p>{0}</p></li><li>{1}</li></ol></div>',
    '<div class="related" data-main=0><h4>{0}</h4><p>{1}</p></div>',
    '<div class="share" data-main=0><a href="/s">{0}</a></div>',
    "<footer data-main=0><p>&copy; {0}</p><p>{1}</p></footer>",
    '<div class="footer" data-main=0>&copy; {0}</div>',
)
BLOCKS = (
    "<p>{0}</p>", "<p>{0}</p>", "<p>{0}</p>", "<ul><li>{0}</li></ul>", "<blockquote>{0}</blockquote>", "<div>{0}</div>", "<h2>{0}</h2>",
    "<table><tr><th>{0}</th><td>{0}</td></tr></table>", "<figure><figcaption>{0}</figcaption></figure>",
)


def rearranged(nodes: list[Node], marks: list[int]) -> str:
    """A page of the same texts in another frame: main blocks in a wrapper, other parts, which take texts of either
    kind, before, in and behind it. The choice follows from the texts."""
    main = ["".join(n.text).strip() for n, m in zip(nodes, marks, strict=True) if n.run and m]
    texts = main + ["".join(n.text).strip() for n, m in zip(nodes, marks, strict=True) if n.run and not m]
    rng = np.random.default_rng(zlib.crc32(texts[0].encode()) if texts else 0)

    def part() -> str:
        chosen = rng.integers(0, len(texts), size=2)
        return OTHER_PARTS[rng.integers(len(OTHER_PARTS))].format(*(escape(texts[i]) for i in chosen))

    begin, end = WRAPPERS[rng.integers(len(WRAPPERS))]
    # Names that tell nothing, or little: words of the page, and those that articles have beside other elements.
    words = [w for t in texts for w in t.split()[:20]] + " ".join(NAMES[f"name_{x}"] for x in ("content", "header", "share")).split()
    begin = begin.format(*(escape("-".join(words[i] for i in rng.integers(0, len(words), size=2))) for _ in range(2)))
    shown = main[: rng.integers(1, len(main) + 1)] if main and rng.random() < 0.5 else main
    shown = [t[: rng.integers(4, 40)] if rng.random() < 0.2 else t for t in shown]  # articles have short blocks too
    body = [BLOCKS[rng.integers(len(BLOCKS))].format(escape(t)) for t in shown]
    if main and rng.random() < 0.3:
        body[0] = f"<header data-main=1><h1>{escape(main[0])}</h1></header>"
    for _ in range(rng.integers(0, 5)):
        body.insert(rng.integers(0, len(body) + 1), part())
    before, behind = "".join(part() for _ in range(rng.integers(1, 4))), "".join(part() for _ in range(rng.integers(1, 4)))
    page = f"{before}{begin}{''.join(body)}{end}{behind}"
    for _ in range(rng.integers(0, 3)):
        page = f"<div>{page}</div>"
    return f"<body>{page}</body>"


def marked(nodes: list[Node]) -> list[int]:
    """Labels of a rearranged page."""
    out: list[int] = []
    for node in nodes:
        out.append(node.main if node.main is not None else out[node.parent] if node.parent >= 0 else 0)
    return out


def prior_edges() -> np.ndarray:
    """Log potential of each (kind, parent, child) before any page is seen: share of the child's label below the
    parent's, against its share below any."""
    counts = np.array([EDGE_PRIOR[name] for name in EDGES], dtype=float)
    shares = counts / counts.sum(axis=2, keepdims=True)
    return np.log(shares / (counts.sum(axis=1, keepdims=True) / counts.sum(axis=(1, 2), keepdims=True)))


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def forest_marginals(own: np.ndarray, edges: np.ndarray, kind: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> tuple:
    """Marginals of all nodes (n, 2) and of all edges (n, 2, 2) by sum-product, level by level over all trees."""
    inside, upward = np.stack([np.zeros_like(own), own], axis=1), np.zeros((len(own), 2))
    for level in reversed(levels[1:]):
        upward[level] = log_sum(edges[kind[level]] + inside[level][:, None, :], axis=2)
        np.add.at(inside, parent[level], upward[level])
    full, pairs = inside.copy(), np.zeros((len(own), 2, 2))
    for level in levels[1:]:
        without = full[parent[level]] - upward[level]
        joint = without[:, :, None] + edges[kind[level]]
        full[level] = inside[level] + log_sum(joint, axis=1)
        joint = joint + inside[level][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
    nodes = np.exp(full - full.max(axis=1, keepdims=True))
    return nodes / nodes.sum(axis=1, keepdims=True), pairs


def fit(nodes: pd.DataFrame, rounds: int = 250) -> PageModel:
    """Weights and edge potentials near their prior centres under which the labels of the training trees are likeliest.

    Nodes are the columns ``features`` (places), ``label``, ``edge`` and ``parent`` (row number, -1 for roots), parents
    first. The slope is the difference between what the labels show and what the marginals expect.
    """
    weights, edges = np.array(list(PRIOR.values())), prior_edges()
    if len(nodes):
        centre, edge_centre, n = weights.copy(), edges.copy(), len(nodes)
        matrix = np.zeros((n, len(FEATURES)))
        for i, places in enumerate(nodes["features"]):
            matrix[i, list(places)] = 1
        labels, parent, kind = (nodes[c].to_numpy(dtype=np.int64) for c in ("label", "parent", "edge"))
        depth = np.zeros(n, dtype=np.int64)
        for i in range(n):
            depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
        levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        child = np.flatnonzero(parent >= 0)
        shown = np.zeros_like(edges)
        np.add.at(shown, (kind[child], labels[parent[child]], labels[child]), 1.0)
        means, squares = [np.zeros_like(weights), np.zeros_like(edges)], [np.zeros_like(weights), np.zeros_like(edges)]
        for step in range(1, rounds + 1):
            marginals, pairs = forest_marginals(matrix @ weights, edges, kind, parent, levels)
            expected = np.zeros_like(edges)
            np.add.at(expected, kind[child], pairs[child])
            slopes = (
                (matrix.T @ (labels - marginals[:, 1]) - PRIOR_STRENGTH * (weights - centre)) / n,
                (shown - expected - PRIOR_STRENGTH * (edges - edge_centre)) / n,
            )
            for k, (value, slope) in enumerate(zip((weights, edges), slopes, strict=True)):
                means[k] = 0.9 * means[k] + 0.1 * slope
                squares[k] = 0.99 * squares[k] + 0.01 * slope**2
                pace = 0.1 / math.sqrt(1 + step / 25)
                value += pace * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-6)
    return PageModel(weights.tolist(), np.exp(edges).tolist())


def training_rows(nodes: list[Node], marks: list[int], tree: int = 0) -> list[dict]:
    return [
        {
            "tree": tree,
            "at": i,
            "features": features(node),
            "label": marks[i],
            "edge": edge(nodes[node.parent], node) if i else -1,
            "parent": node.parent,
        }
        for i, node in enumerate(nodes)
    ]


def training_nodes(pages: DataFrame, page_id: str, html: str, most: int) -> pd.DataFrame:
    """Nodes of at most ``most`` different pages that mark their article, those whose ids hash least, each as it is and
    rearranged. Pages whose trees go beyond TRAIN_NODES nodes in all are left out whole."""
    marking = pages.select(F.col(page_id).alias("id"), F.col(html).alias("html")).filter("id IS NOT NULL")
    marking = marking.filter(F.col("html").rlike("(?i)<article")).withColumn("digest", F.xxhash64("html"))
    chosen = marking.select("id", "digest").distinct().orderBy(F.xxhash64("id"), "id", "digest").limit(most)

    @F.pandas_udf("array<struct<tree:int,at:int,features:array<int>,label:int,edge:int,parent:int>>")
    def read(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            nodes = Dom(text).nodes
            marks = labelled(nodes)
            if marks is None:
                out.append([])
                continue
            other = Dom(rearranged(nodes, marks)).nodes
            out.append(training_rows(nodes, marks) + training_rows(other, marked(other), 1))
        return pd.Series(out, dtype=object)

    trees = marking.join(F.broadcast(chosen), ["id", "digest"]).dropDuplicates(["id", "digest"])
    trees = trees.select("id", "digest", read("html").alias("nodes"))
    so_far = F.sum(F.size("nodes")).over(Window.orderBy("id", "digest"))  # over ``most`` rows
    rows = trees.withColumn("so_far", so_far).filter(F.col("so_far") <= TRAIN_NODES)
    rows = rows.select("id", "digest", F.inline("nodes")).orderBy("id", "digest", "tree", "at")
    return with_row_parents(rows.toPandas())


def with_row_parents(nodes: pd.DataFrame) -> pd.DataFrame:
    """Parents as row numbers: every tree begins at a row whose place is 0."""
    start = np.maximum.accumulate(np.where(nodes["at"] == 0, np.arange(len(nodes)), 0))
    return nodes.assign(parent=np.where(nodes["parent"] >= 0, nodes["parent"] + start, -1))


def main_text(html: str, model: PageModel) -> str:
    nodes = Dom(html).nodes
    if len(nodes) == 1:
        return ""
    marginals = model.marginals(nodes)
    blocks = (" ".join("".join(n.text).split()) for n, p in zip(nodes, marginals, strict=True) if n.run and p >= THRESHOLD)
    return " ".join(b for b in blocks if b)


def extracted(pages: DataFrame, model: PageModel, html: str = "html") -> Column:
    """Main text of a page, empty if it has none."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model)  # as many numbers as there are features

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        for texts in batches:
            yield pd.Series([main_text(t, known) for t in texts], dtype=object)

    return extract(whole_text(html))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per page.

    The model is fitted on a bounded number of pages that mark their article; without any, the prior stands. Null,
    empty and blank pages, and pages without content, have an empty text. Broken or endless markup is read as far as it
    goes. Repeated rows are read alike, other columns are not read, an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    model = fit(training_nodes(pages, page_id, html, TRAIN_PAGES))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), extracted(pages, model, html).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
