"""Main text of HTML pages by a tree-structured graphical model over their DOM."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.llm.common import drawn, packed, pieces

#: Labelled pages the model is trained on, at most, and layouts that each is also shown in.
SAMPLE, LAYOUTS = 160, 3
#: Letters of the longest page that training draws; with the sample, this bounds what the driver gets.
LONGEST = 1 << 20
#: Elements nested deeper than this become siblings, as in browsers.
DEEPEST = 512

#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template svg math iframe object noscript button select textarea option canvas audio video".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    "html body article main section div nav header footer aside form fieldset ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption table thead tbody tfoot tr td th caption address details summary center hr".split()
)
#: What an opening tag closes, and how far up.
CLOSES = {
    **dict.fromkeys(BLOCK - frozenset("html body li dt dd tr td th thead tbody tfoot caption".split()), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
    "th": ("td", "th", "p"), "option": ("option",), "body": ("head",), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
SCOPE = frozenset("html body table ul ol dl td th article section main aside nav form div blockquote".split())

#: Groups of tags and of words in class, id and role that tell alike.
TAG_GROUPS = [
    ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("article",), ("main",), ("section",), ("div", "center"), ("nav",),
    ("header",), ("footer", "address"), ("aside",), ("form", "fieldset"), ("ul", "ol", "dl"), ("li", "dt", "dd"),
    ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("blockquote", "pre", "figure", "figcaption"),
    ("html", "body"),
]
WORD_GROUPS = [
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip"),
    ("header", "masthead", "banner", "topbar", "branding", "logo", "toolbar"),
    ("footer", "foot", "copyright", "legal", "colophon", "contentinfo", "credits"),
    ("sidebar", "side", "aside", "related", "recommended", "widget", "popular", "trending", "complementary", "rail", "more"),
    ("notice", "cookie", "cookies", "consent", "gdpr", "alert", "modal", "popup", "overlay", "dialog", "privacy", "disclaimer"),
    ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "dfp", "outbrain", "taboola"),
    ("form", "search", "login", "signup", "signin", "register", "subscribe", "newsletter", "contact"),
    ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "feedback", "review", "reviews"),
    ("share", "sharing", "social", "follow", "tags", "meta", "byline"),
    ("article", "content", "main", "post", "entry", "story", "body", "text", "copy", "prose"),
]
_TAG_OF = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_WORD_OF = {w: len(TAG_GROUPS) + 1 + i for i, g in enumerate(WORD_GROUPS) for w in g}
_OTHER = len(TAG_GROUPS)
_HIDDEN = len(TAG_GROUPS) + 1 + len(WORD_GROUPS)
_TEXT = _HIDDEN + 1
_ABOVE = _TEXT + 1  # a text run also sees the features of the element it is in
_NUMBERS = _ABOVE + _TEXT
WIDTH = _NUMBERS + 9

#: A quote opens a value only after "=". One that nothing closes is read as a letter of a bare value; no quote of its kind
#: follows it, so a page is searched in vain once for each kind, and the time stays linear at any length of a value.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"""
    r"""((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?i)\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_INVISIBLE = re.compile(r"""(?i)(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""")
_LABEL = re.compile(r'data-label="([01])"')
_LETTERS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Tree:
    """Block elements and the text runs between their borders, parents before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    static: list[tuple[int, ...]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    texts: dict[int, str] = field(default_factory=dict)
    linked: dict[int, int] = field(default_factory=dict)

    def add(self, parent: int, static: tuple[int, ...], label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.static.append(static)
        self.label.append(label)
        return len(self.parent) - 1


_seen: dict[tuple[str, str], tuple[int, ...]] = {}


def _static(tag: str, attributes: str) -> tuple[int, ...]:
    """Features of an element from its tag and the words of its class, id and role."""
    key = (tag, attributes)
    if key in _seen:
        return _seen[key]
    found = {_TAG_OF.get(tag, _OTHER)}
    for value in _NAMED.findall(attributes):
        words = _LETTERS.findall(_CAMEL.sub(" ", value).lower())
        found.update(_WORD_OF[w] for w in words if w in _WORD_OF)
    if _INVISIBLE.search(attributes):
        found.add(_HIDDEN)
    static = tuple(sorted(found))
    if len(attributes) <= 1000:
        if len(_seen) > 100_000:
            _seen.clear()
        _seen[key] = static
    return static


def parse(page: str) -> Tree:
    """The tree of a page. Markup that is never shown gives nothing; broken markup is read as browsers do, roughly."""
    tree = Tree()
    root = tree.add(-1, (_TAG_OF["html"],), 0)
    stack: list[tuple[str, int, int]] = [("", root, 0)]  # tag, block node, label
    places: dict[str, list[int]] = {}  # where in the stack each tag stands
    scopes = [0]  # and those that end the search for what an opening tag closes
    unseen = links = at = 0
    run: list[str] = []
    in_links = 0

    def flush() -> None:
        nonlocal in_links
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            _, node, label = stack[-1]
            leaf = tree.add(node, (_TEXT, *(_ABOVE + f for f in tree.static[node])), label)
            tree.texts[leaf], tree.linked[leaf] = text, min(in_links, len(text))
        in_links = 0

    def leave(depth: int) -> None:
        nonlocal unseen, links
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
            stack.pop()
            places[tag].pop()
            if scopes[-1] == len(stack):
                scopes.pop()
            unseen -= tag in UNSEEN
            links -= tag == "a"

    def end_head() -> None:
        if stack[-1][0] == "head":
            leave(len(stack) - 1)

    def say(text: str) -> None:
        nonlocal in_links
        if unseen and text.strip():
            end_head()
        if text and not unseen:
            run.append(text)
            in_links += len(text) if links else 0

    while found := _TOKEN.search(page, at):
        say(page[at : found.start()])
        at = found.end()
        closing, name, attributes = found.groups()
        if name is None:
            continue
        tag = name.lower()
        if closing:
            if places.get(tag):
                leave(places[tag][-1])
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag == "br":
            say(" ")
        if tag in VOID:
            if tag == "hr" and not unseen:
                flush()
            continue
        ends = CLOSES.get(tag, ())
        while (i := max((places[e][-1] for e in ends if places.get(e)), default=0)) and i >= scopes[-1]:
            leave(i)
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}\b[^>]*>?").search(page, at)
            stop = end.start() if end else len(page)
            if tag == "xmp":
                say(page[at:stop])
            at = end.end() if end else len(page)
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        _, node, label = stack[-1]
        given = _LABEL.search(attributes)
        label = int(given.group(1)) if given else label
        if tag in BLOCK:
            if not unseen:
                flush()
                above = node if tree.depth[node] < DEEPEST else tree.parent[node]
                node = tree.add(above, _static(tag, attributes), label)
        unseen += tag in UNSEEN
        links += tag == "a"
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append((tag, node, label))
    rest = page[at:]
    say(rest if not re.match(r"</?[a-zA-Z]|<[!?]", rest) else "")
    leave(1)
    flush()
    return tree


@dataclass
class Forest:
    """Trees one after the other as arrays, with their features."""

    parent: np.ndarray
    levels: list[np.ndarray]  # nodes by depth
    features: np.ndarray
    leaf: np.ndarray
    label: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, trees: list[Tree]) -> Forest:
        starts = np.concatenate(([0], np.cumsum([len(t.parent) for t in trees]))).astype(np.int64)
        of = np.repeat(np.arange(len(trees)), np.diff(starts))
        parent = np.concatenate([np.array(t.parent, np.int64) for t in trees]) + starts[of]
        depth = np.concatenate([np.array(t.depth, np.int64) for t in trees])
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1)))
        parent[levels[0]] = -1
        x = np.zeros((len(parent), WIDTH), np.float32)
        static = [s for t in trees for s in t.static]
        x[np.repeat(np.arange(len(static)), [len(s) for s in static]), [c for s in static for c in s]] = 1
        leaf = np.zeros(len(parent), bool)
        size, linked, ends = np.zeros(len(parent)), np.zeros(len(parent)), np.zeros(len(parent))
        for t, start in zip(trees, starts, strict=False):
            for i, text in t.texts.items():
                leaf[start + i], size[start + i], linked[start + i] = True, len(text), t.linked[i]
                ends[start + i] = text.rstrip("\"'»”)")[-1:] in tuple(".!?…:;。")
        label = np.concatenate([np.array(t.label, np.int8) for t in trees]) * leaf
        below, links, count = size.copy(), linked.copy(), leaf.astype(float)
        for nodes in levels[:0:-1]:  # an element holds article text if anything in it does
            for total in (below, links, count):
                np.add.at(total, parent[nodes], total[nodes])
            np.maximum.at(label, parent[nodes], label[nodes])
        whole = np.maximum(below[starts[:-1]], 1)[of]
        x[:, _NUMBERS] = 1
        x[:, _NUMBERS + 1] = np.log1p(below) / 5
        x[:, _NUMBERS + 2] = links / np.maximum(below, 1)
        x[:, _NUMBERS + 3] = below / whole
        x[:, _NUMBERS + 4] = np.log1p(below / np.maximum(count, 1)) / 5
        x[:, _NUMBERS + 5] = leaf * np.log1p(size) / 5
        x[:, _NUMBERS + 6] = leaf * ends
        x[:, _NUMBERS + 7] = leaf * linked / np.maximum(size, 1)
        x[:, _NUMBERS + 8] = leaf * (size > 80)
        return cls(parent, levels, x, leaf, label, starts)


@dataclass
class Model:
    """Log potentials: a node's features speak for content, and parent and child states go together."""

    weights: np.ndarray
    edge: np.ndarray  # parent state, child state

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the nodes (n, 2) and of the edge to each node's parent (n, 2, 2), by sum-product.

        Messages go from the leaves up, level by level, then from the roots down; on a tree that is exact.
        """
        belief = np.zeros((len(forest.parent), 2))
        belief[:, 1] = forest.features @ self.weights
        up = np.zeros_like(belief)
        for nodes in forest.levels[:0:-1]:
            up[nodes] = np.logaddexp.reduce(self.edge[None] + belief[nodes][:, None, :], axis=2)
            np.add.at(belief, forest.parent[nodes], up[nodes])
        pairs = np.zeros((len(belief), 2, 2))
        for nodes in forest.levels[1:]:
            above = belief[forest.parent[nodes]] - up[nodes]
            joint = above[:, :, None] + self.edge[None] + belief[nodes][:, None, :]
            belief[nodes] = np.logaddexp.reduce(joint, axis=1)
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pairs[nodes] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True), pairs


def fit(trees: list[Tree], steps: int = 160, ridge: float = 1e-4) -> Model:
    """The potentials of highest likelihood for labelled trees: observed minus expected counts, followed by Adam."""
    model = Model(np.zeros(WIDTH), np.zeros((2, 2)))
    if not trees:
        return model
    forest = Forest.of(trees)
    y, child = forest.label, np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[child]], y[child]), 1)
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, steps + 1):
        nodes, pairs = model.marginals(forest)
        slope = np.append(forest.features.T @ (nodes[:, 1] - y), (pairs.sum(axis=0) - seen).ravel()) / len(y)
        slope += ridge * np.append(model.weights, model.edge.ravel())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * (1 - step / (steps + 1))
        model.weights, model.edge = model.weights - move[:WIDTH], model.edge - move[WIDTH:].reshape(2, 2)
    return model


def extract(pages: Sequence[str | None], model: Model) -> list[str]:
    """The text runs more likely content than not, joined in page order."""
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    forest = Forest.of(trees)
    content = model.marginals(forest)[0][:, 1] > 0.5
    return [
        "\n\n".join(text for i, text in t.texts.items() if content[start + i])
        for t, start in zip(trees, forest.starts, strict=False)
    ]


# Labelled pages: those that mark their article, and the same blocks in other layouts; if none does, layouts alone.

_ARTICLE = re.compile(r"(?i)<article(?=[\s>])")
#: Features of what is no part of an article, wherever it stands.
_FOREIGN = frozenset(_TAG_OF[t] for t in ("nav", "footer", "aside", "form")) | frozenset(
    _WORD_OF[w] for w in ("nav", "footer", "sidebar", "notice", "ad", "form", "comment"))

#: Wrappers of the article, and of what stands around it.
WRAPS = [
    '<main><div{}>', "<section{}>", '<div class="post-content"{}>', '<div id="content"{}>', '<div class="entry"{}>', "<main{}>",
    '<div class="story-body"{}>', "<div{}>", "<article{}>",
]
AROUND = {
    "top": ['<header><div class="logo">{0}</div><p>{1}</p></header>', '<div id="header"><a href="/">{0}</a><p>{1}</p></div>',
            '<div class="topbar">{0}</div>', "<header><h1>{0}</h1><p>{1}</p></header>"],
    "menu": ['<nav><ul>{links}</ul></nav>', '<div class="menu"><ul>{links}</ul></div>', '<ul id="navigation">{links}</ul>',
             '<div class="breadcrumbs">{links}</div>'],
    "notice": ['<div class="cookie-notice"><p>{1}</p><button>{0}</button></div>', '<div id="consent" role="dialog">{1}</div>',
               '<section class="alert"><p>{1}</p><p>{2}</p></section>'],
    "side": ['<aside><h3>{0}</h3><p>{1}</p><ul>{links}</ul></aside>', '<div class="sidebar"><h2>{0}</h2><p>{2}</p></div>',
             '<div id="related"><h3>{0}</h3><ul>{links}</ul></div>', '<div class="widget"><p>{1}</p><p>{2}</p></div>'],
    "advert": ['<div class="ad">{1}</div>', '<div class="sponsored"><p>{2}</p></div>', '<aside class="promo"><p>{1}</p></aside>',
               '<div id="advertisement"><a href="/x">{1}</a></div>'],
    "form": ['<form action="/s"><p>{1}</p><label>{0}</label><input name="q"><button>{0}</button></form>',
             '<div class="newsletter"><p>{1}</p><form><label>{0}</label><input></form></div>'],
    "comments": ['<section class="comments"><h3>{0}</h3><div class="comment"><p>{1}</p></div><div class="comment"><p>{2}</p></div></section>',
                 '<div id="comments"><ul><li><p>{1}</p></li><li><p>{2}</p></li></ul></div>',
                 '<div class="reader-replies"><article class="reply"><p>{1}</p></article><article class="reply"><p>{2}</p></article></div>',
                 '<section id="discussion"><article><p>{1}</p></article><article><p>{2}</p></article></section>',
                 '<section class="comments"><article><h4>{0}</h4><p>{1}</p></article><article><h4>{0}</h4><p>{2}</p></article></section>'],
    "cards": ['<section class="related"><article><h3><a href="/a">{0}</a></h3><p>{1}</p></article><article><h3>{0}</h3><p>{2}</p></article></section>',
              '<div class="more-stories"><article><a href="/b">{1}</a></article><article><a href="/c">{2}</a></article></div>'],
    "end": ['<footer>&copy; {0} {1}</footer>', '<div class="footer"><p>{1}</p><ul>{links}</ul></div>', '<div id="legal">{2}</div>',
            "<footer><p>{1}</p><p>{2}</p></footer>"],
}

#: Blocks of an article and other texts, for a table whose drawn pages have no text.
STAND_INS = (
    ["A walk along the river", "The path begins behind the old mill and follows the water for an hour, mostly in the shade of tall trees.",
     "Where the valley widens there is a bench, and from there you see both churches, the bridge and the hills beyond.",
     "Go back the same way, or take the bus that stops at the bridge every hour until the evening."],
    ["Home", "Sign in", "All rights reserved.", "We use cookies to make this site work.", "Read more about the places nearby."],
)


def mark_article(tree: Tree) -> bool:
    """Label the text runs of a page's article; false if the page marks none.

    That is the outermost article element that holds most text, outside of comments, asides and the like,
    if it holds as much as all others together: several alike are a list of cards. What is foreign to an
    article, and articles within it, are none of its text.
    """
    article, n = _TAG_OF["article"], len(tree.parent)
    inner, foreign, size = [-1] * n, [False] * n, [0] * n  # outermost article a node is in, whether it is foreign or in a nested one
    nested = [False] * n
    for i in range(n):
        above = tree.parent[i]
        if above >= 0:
            inner[i], foreign[i], nested[i] = inner[above], foreign[above], nested[above]
        if i in tree.texts:
            if inner[i] >= 0 and not foreign[i] and not nested[i]:
                size[inner[i]] += len(tree.texts[i]) - tree.linked[i]
            continue
        foreign[i] = foreign[i] or not _FOREIGN.isdisjoint(tree.static[i])
        if article in tree.static[i]:
            if inner[i] >= 0:
                nested[i] = True
            elif not foreign[i]:
                inner[i] = i
    best = max(range(n), key=lambda i: size[i])
    if not size[best] or 2 * size[best] < sum(size):
        return False
    for i in tree.texts:
        tree.label[i] = int(inner[i] == best and not foreign[i] and not nested[i])
    return True


def layout(blocks: list[str], others: list[str], rng: random.Random) -> str:
    """The blocks of an article in a layout drawn at random, with other texts around it."""
    def around(kind: str) -> str:
        words = [html.escape(w) for w in rng.choice(others).split()] or ["x"]
        links = "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(words[: rng.randint(2, 8)]))
        given = [" ".join(words[:3]), html.escape(rng.choice(others)), html.escape(rng.choice(others))]
        return rng.choice(AROUND[kind]).format(*given, links=links).replace(">", ' data-label="0">', 1)

    some = lambda *kinds: "".join(around(k) for k in kinds if rng.random() < 0.6)
    wrap = rng.choice(WRAPS)
    body = [f"<h1>{html.escape(blocks[0])}</h1>"]
    body += [f"<{t}>{html.escape(b)}</{t}>" for b in blocks[1:] for t in [rng.choice(["p"] * 12 + ["h2", "blockquote", "div"])]]
    if rng.random() < 0.3:
        body.insert(rng.randint(1, len(body)), around("advert"))
    if rng.random() < 0.3:
        body.append(around("comments"))
    inner = wrap.format(' data-label="1"') + "".join(body) + "".join(f"</{t}>" for t in re.findall(r"<(\w+)", wrap)[::-1])
    return (
        "<html><body>" + some("notice", "top", "menu", "advert") + rng.choice(["", "<div>", '<div class="page">'])
        + some("side", "form") + inner + some("comments", "cards", "side", "advert", "form") + some("end", "notice") + "</body></html>"
    )


def training_trees(pages: Sequence[str], layouts: int = LAYOUTS, seed: int = 7) -> list[Tree]:
    """Labelled trees of pages that mark their article, as they are and in other layouts."""
    trees, parts = [], []
    for page in pages:
        tree = parse(page)
        if mark_article(tree):
            trees.append(tree)
            parts.append(([t for i, t in tree.texts.items() if tree.label[i]], [t for i, t in tree.texts.items() if not tree.label[i]]))
    return trees + _laid_out(parts, layouts, seed)


def _laid_out(parts: list[tuple[list[str], list[str]]], layouts: int, seed: int) -> list[Tree]:
    """Trees of the blocks of articles, each in several layouts with its other texts and blocks of more articles around."""
    trees, rng = [], random.Random(seed)
    for blocks, others in parts:
        foreign = [b for more in rng.sample(parts, min(3, len(parts))) for b in more[0][1:4]] + others
        trees += [parse(layout(blocks, foreign or blocks, rng)) for _ in range(layouts)]
    return trees


def _densest(tree: Tree) -> tuple[list[str], list[str]]:
    """The unlinked runs in the smallest element with more than one run that holds over half of a page's unlinked text, and all other runs."""
    plain = {i for i in tree.texts if 2 * tree.linked[i] <= len(tree.texts[i])} or set(tree.texts)
    size, runs = [0] * len(tree.parent), [0] * len(tree.parent)
    for i in range(len(tree.parent) - 1, -1, -1):
        if i in plain:
            size[i], runs[i] = len(tree.texts[i]), 1
        if i:
            size[tree.parent[i]] += size[i]
            runs[tree.parent[i]] += runs[i]
    top = max((i for i in range(len(size)) if 2 * size[i] > size[0] and runs[i] > 1), default=0, key=lambda i: tree.depth[i])
    inside = [False] * len(size)
    for i, parent in enumerate(tree.parent):
        inside[i] = i == top or parent >= 0 and inside[parent]
    return [t for i, t in tree.texts.items() if inside[i] and i in plain], [t for i, t in tree.texts.items() if not (inside[i] and i in plain)]


def unmarked_trees(pages: Sequence[str], layouts: int = LAYOUTS + 1, seed: int = 7) -> list[Tree]:
    """Labelled trees from pages that mark no article: the texts of the element that holds most, in generated layouts.

    The pages themselves are not among them, since nobody knows their labels. Without any text, ``STAND_INS`` are laid out.
    """
    parts = []
    for page in pages:
        blocks, others = _densest(parse(page))
        if blocks:
            parts.append((blocks if len(blocks) > 1 else [" ".join(blocks[0].split()[:8]), *blocks], others))
    return _laid_out(parts or [STAND_INS], layouts, seed)


def train(pages: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model from at most ``sample`` pages of up to ``longest`` letters that mark their article, drawn by a hash.

    If there are none, the text runs of any pages of that length are learned from in generated layouts, and if there
    are no such pages either, ``STAND_INS``. Repeated pages may be drawn repeatedly.
    """
    short = pages.filter(F.length("html").between(1, longest)).select("page_id", "html")
    marked = drawn(short.filter(F.col("html").rlike(_ARTICLE.pattern)), sample, "page_id", "html")
    trees = training_trees([r.html for r in marked.collect()])
    if not trees:
        trees = unmarked_trees([r.html for r in drawn(short, sample, "page_id", "html").collect()])
    return fit(trees)


def main_text(pages: DataFrame, model: Model, carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One row per page: the ``carry`` columns in ``page``, and text, in one pass without a shuffle.

    A null or empty html, and one without any text that the model takes for content, gives an empty text. Pages of any
    length are read whole, an empty table gives no rows, and repeated rows equal texts; a node as likely content as not is none.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(packed(carry).alias("page"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html", 1 << 20):
            found = pa.array(extract(part.column("html").to_pylist(), sent.value), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page"), found], ["page", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["page"], T.StructField("text", T.StringType())]))
