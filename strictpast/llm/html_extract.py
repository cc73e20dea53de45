"""Main-text extraction: boosted trees score DOM nodes, a tree programme decodes them without contradictions.

A page is parsed into elements. Each element that holds text gets features: subtree text and link density, tokens of its
class, id and role and of its ancestors', depth, place and size among its siblings, share of its parent's and the page's
text. Gradient-boosted trees, trained on the driver on generated pages with known main text, give each element log-odds.
Decoding then picks for every element whether its whole subtree is kept, dropped or mixed, with the best total, so no
kept element lies under a dropped one and a lone doubtful paragraph follows its surroundings.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one line feed, and
nothing else is lost. A line break counts as white space. Script, style, head, hidden elements, form controls and
comments in the markup are never text. Null or empty html gives the empty text; broken or cut markup is read as far as
it goes. Repeated rows are extracted each, null ids are kept, an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.llm.common import Held

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"'<]++|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "textarea", "title", "xmp", "noscript", "iframe", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style head title noscript template iframe svg math select textarea button object canvas audio video datalist xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr caption ul".split()
)
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_KINDS = [
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "blockquote", "pre"}, {"ul", "ol", "li", "dl", "dt", "dd", "menu"}, {"table", "tr", "td", "th", "tbody"}, {"div", "section", "span"},
    {"article", "main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "label", "fieldset", "legend"}, {"figure", "figcaption", "caption"},
]
_LEXICON = [
    {"article", "content", "post", "entry", "story", "main", "body", "text", "articlebody"},
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip"},
    {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adbox"},
    {"sidebar", "aside", "side", "widget", "related", "share", "social", "tags", "recommended", "popular", "complementary", "trending", "rail"},
    {"footer", "foot", "copyright", "legal", "contentinfo", "colophon"},
    {"header", "masthead", "topbar", "logo", "branding", "top", "site"},
    {"cookie", "cookies", "notice", "consent", "alert", "popup", "modal", "newsletter", "subscribe", "subscription", "gdpr", "paywall", "dialog", "message", "disclaimer"},
    {"comment", "comments", "reply", "replies", "discussion", "respond", "disqus", "reader", "readers"},
    {"form", "login", "search", "signup", "signin", "register", "contact", "poll", "survey"},
]


class Node:
    __slots__ = ("tag", "words", "parent", "children", "items", "hidden", "depth")

    def __init__(self, tag: str, words: list[str], parent: "Node | None", hidden: bool):
        self.tag, self.words, self.parent, self.hidden = tag, words, parent, hidden
        self.children: list[Node] = []
        #: text (str) and child elements (Node) in page order
        self.items: list = []
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> Node:
    """A tree of the page's elements. Elements that hold no visible text of the page are hidden."""
    root = Node("html", [], None, False)
    here, at, end = root, 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if not found:
            break
        if found.start() > at:
            here.items.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                # An inline end tag does not close the blocks inside it.
                if tag in _BLOCK or not _blocks_between(here, up):
                    here = up.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK:
            up = here
            while up is not root and up.tag not in _BLOCK:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in _CLOSES:
            own, stop = _CLOSES[tag]
            up, last = here, None
            while up is not root and up.tag not in stop:
                if up.tag in own:
                    last = up
                up = up.parent
            if last:
                here = last.parent
        words, hidden = [], tag in _SKIP
        if found[3]:
            for name, value in _ATTRIBUTE.findall(found[3]):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role", "itemprop"):
                    words += [w for w in _SPLIT.split(value) if w]
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
        node = Node(tag, words, here, hidden)
        here.items.append(node)
        here.children.append(node)
        if tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = close.start() if close else end
            after = page.find(">", at)
            at = end if after < 0 else after + 1
        elif tag not in _VOID and not found[3].rstrip().endswith("/"):
            here = node
    if at < end:
        here.items.append(page[at:])
    return root


def _blocks_between(low: Node, high: Node) -> bool:
    while low is not high:
        if low.tag in _BLOCK:
            return True
        low = low.parent
    return False


@dataclass
class Page:
    """The elements with text, in page order (parents first), and their features."""

    nodes: list[Node]
    up: list[int]
    own: list[int]
    x: np.ndarray


WIDTH = 3 + len(_KINDS) + 2 * len(_LEXICON) + 2 + 14


def features(root: Node) -> Page:
    nodes: list[Node] = []
    up: list[int] = []
    seen: dict[int, int] = {}
    own, links, marks, blocks, controls, starts = [], [], [], [], [], []
    total = 0
    # (element, index of its parent, inside a link)
    stack: list = [(root, -1, False)]
    while stack:
        node, parent, linked = stack.pop()
        i = len(nodes)
        nodes.append(node)
        up.append(parent)
        linked = linked or node.tag == "a"
        text = " ".join(" ".join(x.split()) for x in node.items if x.__class__ is str)
        n = len(text.strip())
        own.append(n)
        links.append(n if linked else 0)
        marks.append(sum(map(text.count, ".,!?;:")))
        blocks.append(1 if node.tag in _BLOCK else 0)
        controls.append(1 if node.tag in ("input", "select", "textarea", "button", "option") else 0)
        starts.append(total)
        total += n
        if not node.hidden:
            stack += [(c, i, linked) for c in reversed(node.children)]
            if any(c.hidden for c in node.children):
                kept = []
                while stack and stack[-1][1] == i:
                    kept.append(stack.pop())
                for k in reversed(kept):
                    if not k[0].hidden:
                        stack.append(k)
                    elif k[0].tag in ("select", "textarea", "button"):
                        controls[i] += 1
    count = len(nodes)
    size, link, mark, block, control = (np.array(v, float) for v in (own, links, marks, blocks, controls))
    tags, paragraphs, heads = np.ones(count), np.array([n.tag == "p" for n in nodes], float), np.array([n.tag == "h1" for n in nodes], float)
    for i in range(count - 1, 0, -1):
        p = up[i]
        for v in (size, link, mark, block, control, tags, paragraphs, heads):
            v[p] += v[i]
    kids: dict[int, list[int]] = {}
    for i in range(1, count):
        kids.setdefault(up[i], []).append(i)
    x = np.zeros((count, WIDTH))
    k, m = len(_KINDS), len(_LEXICON)
    for i, node in enumerate(nodes):
        row, p = x[i], up[i]
        row[0], row[1], row[2] = min(node.depth, 20), np.log1p(size[i]), link[i] / max(1, size[i])
        for j, kind in enumerate(_KINDS):
            if node.tag in kind:
                row[3 + j] = 1
        if node.words:
            for j, words in enumerate(_LEXICON):
                row[3 + k + j] = sum(w in words for w in node.words)
        if p >= 0:
            row[3 + k + m : 3 + k + 2 * m] = np.maximum(x[p, 3 + k : 3 + k + m], x[p, 3 + k + m : 3 + k + 2 * m])
            at = 3 + k + 2 * m
            row[at] = max(x[p, at], x[p, 3 + 5])
            row[at + 1] = max(x[p, at + 1], x[p, 3 + 6], x[p, 3 + 7] * (1 - x[p, at]), x[p, 3 + 8], x[p, 3 + 9])
    at = 3 + k + 2 * m + 2
    page = max(1.0, size[0])
    x[:, at] = size / tags
    x[:, at + 1] = np.log1p(paragraphs)
    x[:, at + 2] = size / page
    x[:, at + 3] = [size[i] / max(1, size[p]) if p >= 0 else 1 for i, p in enumerate(up)]
    for group in kids.values():
        names = [nodes[i].tag for i in group]
        mean = np.log1p(size[group].mean())
        for place, i in enumerate(group):
            x[i, at + 4 : at + 8] = np.log1p(len(group)), names.count(nodes[i].tag) / len(group), mean, place / max(1, len(group) - 1)
    x[:, at + 8] = np.array(starts) / page
    x[:, at + 9] = mark / np.maximum(1, size) * 100
    x[:, at + 10] = np.log1p(size / np.maximum(1, block))
    x[:, at + 11] = np.log1p(np.array(own))
    x[:, at + 12] = np.minimum(heads, 3)
    x[:, at + 13] = np.minimum(control, 20)
    return Page(nodes, up, own, x)


class Trees:
    """Gradient-boosted regression trees for the logistic loss with soft labels, on binned features."""

    def __init__(self, rounds: int = 90, depth: int = 5, rate: float = 0.2, bins: int = 24, least: float = 8.0, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        n, d = b.shape
        flat = b + np.arange(d) * self.bins
        score = np.zeros(n)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
            size = 1 << self.depth
            column, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(2 * size)
            where = np.ones(n, np.int64)
            for node in range(1, size):
                rows = np.flatnonzero(where == node)
                if not len(rows):
                    continue
                gs = np.bincount(flat[rows].ravel(), np.repeat(g[rows], d), d * self.bins).reshape(d, -1)
                hs = np.bincount(flat[rows].ravel(), np.repeat(h[rows], d), d * self.bins).reshape(d, -1)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least / 8) | (ht - hl < self.least / 8)] = 0
                best = int(gain.argmax())
                if gain.flat[best] <= 1e-3:
                    continue
                column[node], cut[node] = divmod(best, self.bins)
                where[rows] = 2 * node + (b[rows, column[node]] > cut[node])
            for leaf in np.unique(where):
                rows = where == leaf
                value[leaf] = -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
            self.trees.append((column, cut, value))
            score += value[where]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows, out = np.arange(len(b)), np.zeros(len(b))
        for column, cut, value in self.trees:
            where = np.ones(len(b), np.int64)
            for _ in range(self.depth):
                inner = where < len(column)
                c = np.where(inner, column[np.minimum(where, len(column) - 1)], -1)
                go = c >= 0
                step = 2 * where + (b[rows, np.maximum(c, 0)] > cut[np.minimum(where, len(column) - 1)])
                where = np.where(go, step, where)
            out += value[where]
        return out


def decode(page: Page, score: np.ndarray, split: float = 1.5) -> list[bool]:
    """Whether each element's own text is kept: the best total of agreeing scores, less ``split`` for each mixed element."""
    n = len(page.nodes)
    s = np.clip(score, -4, 4) * (page.x[:, 1] > 0)
    every = s.copy()  # the gain of keeping the whole subtree
    best_kids = np.zeros(n)
    choice = [0] * n
    for i in range(n - 1, -1, -1):
        mixed = best_kids[i] + (abs(s[i]) if page.own[i] else 0) - split
        best = max(every[i], -every[i], mixed)
        choice[i] = 2 if best == mixed and best > abs(every[i]) else 1 if every[i] > 0 else -1
        if i:
            every[page.up[i]] += every[i]
            best_kids[page.up[i]] += best
    kept = [False] * n
    state = [0] * n
    for i in range(n):
        state[i] = state[page.up[i]] if i and state[page.up[i]] != 2 else choice[i]
        kept[i] = s[i] > 0 if state[i] == 2 else state[i] == 1
    return kept


def blocks(page: Page, kept: list[bool]) -> list[str]:
    """The kept text, block by block in page order."""
    flag = {id(n): k for n, k in zip(page.nodes, kept, strict=True)}
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [page.nodes[0]]
    keep = flag[id(page.nodes[0])]
    while stack:
        item = stack.pop()
        if item.__class__ is str:
            if keep:
                run.append(item)
        elif item.__class__ is tuple:  # an element ends
            if item[0].tag in _BLOCK:
                close()
            keep = item[1]
        elif item.tag == "br":
            run.append(" ")
        elif id(item) in flag:
            if item.tag in _BLOCK:
                close()
            stack.append((item, keep))
            keep = flag[id(item)]
            stack += reversed(item.items)
    close()
    return out


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    read = [features(parse(x)) if x else None for x in pages]
    x = [p.x for p in read if p]
    scores = trees.score(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for p in read:
        if p is None:
            out.append("")
            continue
        out.append("\n".join(blocks(p, decode(p, scores[at : at + len(p.nodes)]))))
        at += len(p.nodes)
    return out


class Teacher:
    """Generated pages whose main text is known: many layouts, tags and attribute words, none from the input."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int, dots: bool = True) -> str:
        r = self.r
        out = ["".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(1, 9))) for _ in range(n)]
        if dots:
            out = [w + r.choice(["", "", "", "", "", ",", "."]) for w in out]
            out[-1] += "."
        return " ".join(out).capitalize()

    def attributes(self, names: list[str], chance: float = 0.8) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        name = r.choice(names) + r.choice(["", "", "-box", "-wrap", "-" + str(r.randint(1, 9)), "__inner"])
        return f' {r.choice(["class", "class", "id", "role"])}="{name}"'

    def paragraph(self) -> str:
        r = self.r
        n = r.choice([r.randint(1, 6), r.randint(5, 40), r.randint(30, 160)])
        text = self.words(n)
        if r.random() < 0.2:
            text = text.replace(" ", f' <a href="/x">{self.words(2, False)}</a> ', 1)
        if r.random() < 0.2:
            text = r.choice(["<b>", "<i>", "<em>"]) + text + r.choice(["<br>", "</b>", ""])
        kind = r.random()
        if kind < 0.08:
            return "<ul>" + "".join(f"<li>{self.words(r.randint(2, 14))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.13:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.18:
            return f"<h{r.randint(2, 4)}>{self.words(r.randint(1, 8), False)}</h{r.randint(2, 4)}><p>{text}</p>"
        if kind < 0.21:
            return "<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return f"<p>{text}" + r.choice(["</p>", "</p>", "</p>", ""])

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/y">{self.words(self.r.randint(1, 3), False)}</a></li>' for _ in range(n)) + "</ul>"

    def wrapped(self, tag: str, text: str) -> str:
        return text if tag == "p" or self.r.random() < 0.5 else self.r.choice(["<p>{}</p>", "<h3>" + self.words(2) + "</h3><p>{}</p>", "<span>{}</span>", "<div><p>{}</p></div>"]).format(text)

    def clutter(self) -> str:
        r = self.r
        kind = r.randrange(9)
        text = lambda a, b: self.words(r.randint(a, b))
        if kind == 0:
            return r.choice([f"<nav{self.attributes(['menu', 'nav'], 0.4)}>{{}}</nav>", f"<div{self.attributes(['menu', 'navbar', 'breadcrumb', 'pagination'], 1)}>{{}}</div>"]).format(self.links(r.randint(1, 9)))
        if kind == 1:
            return f"<{(t := r.choice(['div', 'div', 'section', 'aside', 'p']))}{self.attributes(['ad', 'ads', 'advert', 'sponsored', 'promo', 'banner'], 1)}>{self.wrapped(t, text(2, 30))}</{t}>"
        if kind == 2:
            t = r.choice(["aside", "div", "section"])
            body = r.choice([self.links(r.randint(2, 6)), f"<h3>{text(1, 3)}</h3><p>{text(5, 40)}</p>", f"<p>{text(5, 60)}</p>"])
            return f"<{t}{self.attributes(['sidebar', 'related', 'widget', 'share', 'social'], 0.5 if t == 'aside' else 1)}>{body}</{t}>"
        if kind == 3:
            t = r.choice(["footer", "footer", "div"])
            return f"<{t}{self.attributes(['footer', 'copyright', 'legal'], 0.3 if t == 'footer' else 1)}>" + r.choice([f"&copy; {text(2, 20)}", f"<p>{text(3, 40)}</p>" + self.links(3)]) + f"</{t}>"
        if kind == 4:
            t = r.choice(["header", "header", "div"])
            return f"<{t}{self.attributes(['header', 'masthead', 'topbar', 'site-header'], 0.3 if t == 'header' else 1)}>" + r.choice([f"<h1>{text(1, 4)}</h1>", f"<p>{text(2, 10)}</p>", f"<a href='/'>{text(1, 2)}</a>", f"<a href='/'>{text(1, 2)}</a><h2>{text(1, 3)}</h2>", f"<h2>{text(1, 3)}</h2><p>{text(2, 8)}</p>"]) + r.choice(["", self.links(4)]) + f"</{t}>"
        if kind == 5:
            return f"<{(t := r.choice(['div', 'div', 'section', 'p']))}{self.attributes(['cookie', 'notice', 'consent', 'alert', 'newsletter', 'subscribe', 'popup'], 1)}>{self.wrapped(t, text(4, 40))}{r.choice(['', '<button>ok</button>'])}</{t}>"
        if kind == 6:
            each = "".join(r.choice(["<div{}>{}</div>", "<li{}>{}</li>", "<p{}>{}</p>", "<article{}>{}</article>"]).format(self.attributes(["comment", "reply"], 0.6), f"<b>{text(1, 2)}</b> " * (r.random() < 0.5) + text(3, 60)) for _ in range(r.randint(1, 7)))
            return f"<{(t := r.choice(['div', 'section', 'ol', 'ul']))}{self.attributes(['comments', 'discussion', 'replies', 'comment-list', 'reader-comments'], 1)}>{r.choice(['', '<h2>' + text(1, 2) + '</h2>'])}{each}</{t}>"
        if kind == 7:
            return f"<form{self.attributes(['login', 'search', 'signup', 'contact'], 0.5)}>" + r.choice(["", "", f"<p>{text(2, 15)}</p>", f"<h3>{text(1, 3)}</h3>"]) + "".join(f"<label>{text(1, 3)}</label><input name=a>" for _ in range(r.randint(1, 4))) + "<button>go</button></form>"
        return f"<div{self.attributes(['tags', 'share', 'social', 'related', 'popular'], 1)}>" + " ".join(f'<a href="/z">{self.words(r.randint(1, 4), False)}</a>' for _ in range(r.randint(1, 8))) + "</div>"

    def page(self) -> str:
        """Main text is between the marks U+0001 and U+0002, which stay out of features and labels."""
        r = self.r
        body = "".join(self.paragraph() for _ in range(r.choice([1, 2, 3, r.randint(2, 14), r.randint(5, 30)])))
        title = f"<h1>{self.words(r.randint(1, 10), False)}</h1>"
        head = r.choice([title, title, f"<header>{title}</header>", ""])
        inner = "\x01" + head + body
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            at = inner.find("<p", r.randrange(len(inner)))
            if at > 0:
                inner = inner[:at] + "\x02" + self.clutter() + "\x01" + inner[at:]
        inner += "\x02"
        t = r.choice(["article", "article", "main", "div", "div", "section", ""])
        if t:
            inner = f"<{t}{self.attributes(['article', 'content', 'post', 'entry', 'story', 'main', 'text'], 0.3 if t in ('article', 'main') else 0.8)}>{inner}</{t}>"
        if r.random() < 0.3:
            inner = f"<{(t := r.choice(['main', 'div']))}{self.attributes(['main', 'content', 'container', 'page', 'wrapper'], 0.7)}>{inner}" + "".join(self.clutter() for _ in range(r.choice([0, 0, 1, 2]))) + f"</{t}>"
        before, after = ("".join(self.clutter() for _ in range(r.choice([0, 1, 2, 3, 5]))) for _ in range(2))
        whole = before + inner + after
        if r.random() < 0.25:
            whole = f"<div{self.attributes(['page', 'wrapper', 'container', 'site'], 0.8)}>{whole}</div>"
        return f"<html><head><title>{self.words(3)}</title></head><body>{whole}</body></html>"

    def lesson(self) -> tuple[Page, np.ndarray, np.ndarray]:
        """A page's features, each element's share of main text and its weight."""
        root = parse(self.page())
        share = {}
        main = False
        stack: list = [root]
        while stack:
            node = stack.pop()
            if node.__class__ is tuple:
                node, k, text = node
                part, main = _marked(text, main)
                share.setdefault(id(node), [0, 0])
                share[id(node)][0] += part
                share[id(node)][1] += len(text.replace("\x01", "").replace("\x02", "").strip())
            elif not node.hidden:
                stack += [(node, 0, x) if x.__class__ is str else x for x in reversed(node.items)]
        _strip(root)
        page = features(root)
        good, size = (np.array([share.get(id(n), [0, 0])[j] for n in page.nodes], float) for j in (0, 1))
        for i in range(len(page.nodes) - 1, 0, -1):
            good[page.up[i]] += good[i]
            size[page.up[i]] += size[i]
        return page, good / np.maximum(1, size), (size > 0) * 1.0


def _marked(text: str, main: bool) -> tuple[int, bool]:
    """Characters of main text in ``text``, given whether it begins in it, and whether it ends in it."""
    n = 0
    for part in re.split("([\x01\x02])", text):
        if part in ("\x01", "\x02"):
            main = part == "\x01"
        elif main:
            n += len(part.strip())
    return n, main


def _strip(node: Node) -> None:
    todo = [node]
    while todo:
        node = todo.pop()
        node.items = [x.replace("\x01", "").replace("\x02", "") if x.__class__ is str else x for x in node.items]
        todo += node.children


def learned(pages: int = 1000, seed: int = 8) -> Trees:
    """The trees of ``pages`` generated lessons."""
    teacher = Teacher(seed)
    lessons = [teacher.lesson() for _ in range(pages)]
    x, y, w = (np.concatenate(v) for v in zip(*((p.x, s, z) for p, s, z in lessons), strict=True))
    return Trees().fit(x[w > 0], y[w > 0], w[w > 0])


def extract_pages(pages: DataFrame, trees: Trees, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the columns ``keep``, text, n_chars."""
    held = Held(pages.sparkSession, trees)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = extract(part.column(len(keep)).to_pylist(), held.value)
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    rows = pages.select(*keep, F.col(html_col).cast("string").alias("html"))
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[: len(keep)])
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op8_html(spark, sf_dir):
    from strictpast.llm.common import table

    return extract_pages(table(spark, sf_dir, "pages"), learned())
