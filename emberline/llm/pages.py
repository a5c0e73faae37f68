"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of block elements whose leaves are runs of text. Each node has a hidden label: it holds main
content or not. A linear model of the node's features (tag, words of class, id and role, lengths, share of links) and
tables of parent-child pairs give the potentials; sum-product messages, once from the leaves up and once from the root
down, give exact marginals. Runs of text with a marginal of at least one half are the page's text. Potentials are
trained on labelled pages: pairs of html and, for each run of text, whether it is content.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches

# -- fixed values: elements of the HTML standard ---------------------------------------------------------------------
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math canvas head title select option textarea audio video".split())
RAW = "script|style|noscript|iframe|textarea|title|template"
#: What an opening tag closes, if it is open within the given scope.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table td th body article section div main aside nav header footer form blockquote".split())
LIMITS = SCOPES - {"td", "th"}  # of what an opening tag closes
# --------------------------------------------------------------------------------------------------------------------
#: Attributes: a quote without a partner in the rest of the page is a character like others. No part is tried twice.
REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|\"(?![^\"]*+\")|'(?![^']*+'))*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b{REST}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({REST})(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PARTS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "words", "parent", "kids", "text", "links", "own", "chars", "linked", "depth")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None):
        self.tag, self.words, self.parent, self.kids, self.text = tag, words, parent, [], None
        self.links = self.own = self.chars = self.linked = 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.kids.append(self)


def _words(attributes: str) -> tuple[str, ...]:
    out = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "style":
            out += ["hidden"] * ("display:none" in value.replace(" ", ""))
        elif name in ("hidden", "aria-hidden"):
            out += ["hidden"] * (value != "false")
        else:
            out += PARTS.findall(value)
    return tuple(out)


class Open:
    """The path of open elements. What is open is known by name, so that no search goes up the path in vain."""

    def __init__(self, root: Node):
        self.node = root
        self.all: Counter = Counter()
        self.inner: list[Counter] = [Counter()]  # since each scope on the path, the scope's own name first

    def push(self, node: Node) -> None:
        self.node = node
        self.all[node.tag] += 1
        if node.tag in LIMITS:
            self.inner.append(Counter())
        self.inner[-1][node.tag] += 1

    def pop(self) -> str:
        tag = self.node.tag
        self.all[tag] -= 1
        self.inner[-1][tag] -= 1
        if tag in LIMITS:
            self.inner.pop()
        self.node = self.node.parent
        return tag

    def close(self, tag: str) -> None:
        """Up to the parent of the nearest element of that name, if there is one."""
        if self.all[tag]:
            while self.pop() != tag:
                pass

    def close_before(self, tags: tuple[str, ...]) -> None:
        """Within the scope, the nearest element of one of the names and those right above it that have one too."""
        if any(self.inner[-1][t] for t in tags):
            while self.node.tag not in tags:
                self.pop()
            while self.node.tag in tags:
                self.pop()


def parse(page: str) -> Node:
    """The tree of block elements; each run of text is a leaf ``#t`` with its text and the characters of it in links."""
    root = Node("#root", (), None)
    path = Open(root)
    run: list[str] = []
    linked = at = links = 0  # links: open ones

    def flush() -> None:
        nonlocal linked
        text = " ".join(_html.unescape("".join(run)).split())
        if text:
            leaf = Node("#t", (), path.node)
            leaf.text, leaf.chars, leaf.linked = text, len(text), min(linked, len(text))
        run.clear()
        linked = 0

    def say(s: str) -> None:
        nonlocal linked
        run.append(s)
        if links:
            linked += len(s)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue  # comments, declarations, raw text
        tag, closing = name.lower(), bool(m[2])
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        flush()
        if closing:
            path.close(tag)
            if tag in SCOPES:
                links = 0
            continue
        if tag in VOID:
            continue
        if path.node.tag == "p":
            path.pop()
        if tag in CLOSES:
            path.close_before(CLOSES[tag])
        made = Node(tag, _words(m[4]), path.node)
        if not m[4].rstrip().endswith("/"):
            path.push(made)
    if at < len(page):
        say(page[at:])
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """Parents before their children, in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += reversed(x.kids)
    return out


def measure(nodes: list[Node]) -> None:
    for x in reversed(nodes):
        if x.parent:
            x.parent.chars += x.chars
            x.parent.linked += x.linked


def features(x: Node) -> list[str]:
    out = ["t:" + x.tag, f"n:{min(9, x.chars.bit_length())}", f"l:{(4 * x.linked) // max(1, x.chars)}"]
    out += ["c:" + w for w in x.words]
    if x.tag in HIDDEN or "hidden" in x.words:
        out.append("hidden")
    if x.text is not None:
        up = x.parent
        out += [f"p:{up.tag}", f"s:{up.tag}:{min(6, x.chars.bit_length())}", "mark:" + ("end" if x.text[-1] in ".!?…:;\"”'" else "none")]
        out += ["pc:" + w for w in up.words]
        if "©" in x.text:
            out.append("copyright")
    else:
        out += [f"k:{min(4, len(x.kids))}", f"d:{min(5, x.depth)}"]
    return out


class Model:
    """Weights of features, and log potentials of (parent's label, child's label) by the child's kind."""

    def __init__(self, weights: dict[str, float], pairs: dict[str, np.ndarray]):
        self.weights, self.pairs = weights, pairs

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of content of each node, by messages up and down the tree."""
        n = len(nodes)
        number = {id(x): i for i, x in enumerate(nodes)}
        up = [number[id(x.parent)] if x.parent else -1 for x in nodes]
        get, exp, log = self.weights.get, math.exp, math.log
        local = []
        for x in nodes:
            z = max(-20.0, min(20.0, sum(get(f, 0.0) for f in features(x))))
            local.append([0.0, z])
        pair = [self.pairs.get(x.tag, self.pairs["*"]) for x in nodes]
        sent: list[tuple[float, float] | None] = [None] * n

        def soft(a: float, b: float) -> float:
            return (a if a > b else b) + log(1 + exp(-abs(a - b)))

        for i in range(n - 1, 0, -1):
            a, b = local[i]
            (p00, p01), (p10, p11) = pair[i]
            sent[i] = m0, m1 = soft(p00 + a, p01 + b), soft(p10 + a, p11 + b)
            parent = local[up[i]]
            parent[0] += m0
            parent[1] += m1
        out = [0.0] * n
        for i in range(n):
            a, b = local[i]
            if i:
                parent = local[up[i]]
                m0, m1 = sent[i]
                q0, q1 = parent[0] - m0, parent[1] - m1
                (p00, p01), (p10, p11) = pair[i]
                a, b = a + soft(q0 + p00, q1 + p10), b + soft(q0 + p01, q1 + p11)
                top = soft(a, b)
                a, b = a - top, b - top
                local[i] = [a, b]
            out[i] = 1 / (1 + exp(max(-700.0, min(700.0, a - b))))
        return out


def train(labelled: Iterable[tuple[str, list[bool]]], rounds: int = 25, rate: float = 0.5, ridge: float = 0.02) -> Model:
    """Labelled pages: html and, for each run of text in page order, whether it is content.

    An element is content if most of the characters of its text are, or half of the page's content is in it. Pair
    potentials are logs of the counted shares of labels given the parent's. Weights are fitted so that a node's features
    and the share of its kind give the odds of its label; the features' part is the log likelihood ratio of what is
    seen of the node alone. So the messages of any number of children add up without a drift.
    """
    trees, count = [], defaultdict(lambda: np.ones((2, 2)))
    for page, truth in labelled:
        nodes = nodes_of(parse(page))
        measure(nodes)
        runs = iter(truth)
        good = {id(x): x.chars * next(runs) for x in nodes if x.text is not None}
        for x in reversed(nodes):
            if x.parent:
                good[id(x.parent)] = good.get(id(x.parent), 0) + good.get(id(x), 0)
        whole = max(1, good.get(id(nodes[0]), 0))
        label = {id(x): int(good.get(id(x), 0) * 2 > x.chars or good.get(id(x), 0) * 2 >= whole) if x.chars else 0 for x in nodes}
        for x in nodes[1:]:
            for kind in (x.tag, "*"):
                count[kind][label[id(x.parent)], label[id(x)]] += 1
        trees.append((nodes, label))
    base = count["*"] / count["*"].sum(axis=1, keepdims=True)
    pairs = {}
    for kind, c in count.items():
        c = c + 4 * base
        p = c / c.sum(axis=1, keepdims=True)
        pairs[kind] = np.log(p).tolist()
    names: dict[str, int] = {}
    rows, fixed, y = [], [], []
    share = defaultdict(lambda: np.ones(2))
    for nodes, label in trees:
        for x in nodes:
            share[x.tag][label[id(x)]] += 1
    for nodes, label in trees:
        for x in nodes:
            rows.append([names.setdefault(f, len(names)) for f in features(x)])
            fixed.append(math.log(share[x.tag][1] / share[x.tag][0]))
            y.append(label[id(x)])
    flat = np.array([i for r in rows for i in r])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    fixed, y, w = np.array(fixed), np.array(y, float), np.zeros(len(names))
    seen = np.bincount(flat, minlength=len(names))
    for _ in range(rounds * 8):
        z = fixed + np.bincount(of, w[flat], minlength=len(rows))
        error = y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        w += rate * (np.bincount(flat, error[of], minlength=len(names)) - ridge * w) / (0.25 * seen + 1) / 3
    return Model({f: float(w[i]) for f, i in names.items()}, pairs)


# -- labelled pages: a grammar of layouts ----------------------------------------------------------------------------

SYLLABLES = "an en er in on at or es re th nd ou ha st le la de que ción lich ung tion ment aux".split()
#: Names that pages give to what isn't content: menus, headers, footers, sidebars, notices, adverts, forms, comments.
BOILERPLATE = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination toc links tabs skip",
    "header": "header masthead banner topbar logo branding site top",
    "footer": "footer foot copyright legal bottom colophon site",
    "aside": "sidebar side aside widget related rail recommended popular trending tags archive",
    "notice": "cookie cookies consent gdpr notice banner popup modal overlay alert message warning subscribe newsletter privacy",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner teaser",
    "form": "form search login signup subscribe newsletter contact feedback",
    "comments": "comments comment replies reply discussion disqus responses respond thread user",
    "share": "share social sharing follow buttons meta byline author",
}
CONTENT = "content article post entry main story body text page prose maincontent single"


class Grammar:
    """Random pages with the truth of each run of text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def say(self, lo: int, hi: int, stop: bool = True) -> str:
        r = self.r
        words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        return " ".join(words).capitalize() + ("." if stop else "")

    def attributes(self, kind: str) -> str:
        r = self.r
        names = (CONTENT if kind == "content" else BOILERPLATE[kind]).split()
        if r.random() < 0.25:
            return ""
        name = r.choice(names)
        if r.random() < 0.4:
            name += r.choice("-_ ") + r.choice([*names, "box", "wrap", "inner", "list", "area", "container"])
        return f' {r.choice(("class", "class", "id"))}="{name}"' + (' role="complementary"' if kind == "aside" and r.random() < 0.2 else "")

    def boilerplate(self, kind: str) -> tuple[str, list[bool]]:
        r = self.r
        tags = {"nav": "nav div ul", "header": "header div", "footer": "footer div", "aside": "aside div section", "notice": "div section aside p", "ad": "div aside section", "form": "form div", "comments": "section div ol", "share": "div ul p"}[kind].split()
        tag = r.choice(tags)
        attr = self.attributes(kind)
        if not attr and tag in ("div", "section", "p", "ul", "ol"):
            attr = f' class="{r.choice(BOILERPLATE[kind].split())}"'
        parts: list[str] = []
        n = r.randint(1, 6)
        if tag in ("ul", "ol") or kind in ("nav", "share") and r.random() < 0.7:
            items = [f'<li><a href="/{i}">{self.say(1, 3, False)}</a></li>' for i in range(n)]
            parts = items if tag in ("ul", "ol") else ["<ul>", *items, "</ul>"]
        elif kind == "form":
            parts = [f"<label>{self.say(1, 3, False)}</label><input type=text><button>{self.say(1, 2, False)}</button>"]
            n = 1
        elif kind == "comments":
            parts = [r.choice((f"<p>{self.say(4, 40)}</p>", f'<div class="comment"><p>{self.say(4, 40)}</p></div>', f'<article class="comment"><p>{self.say(4, 40)}</p></article>')) for _ in range(n)]
        elif kind == "nav":
            parts = [" | ".join(f'<a href="/{i}">{self.say(1, 3, False)}</a>' for i in range(n))]
            n = 1
        elif kind == "aside":
            parts = [f"<h3>{self.say(1, 4, False)}</h3>", *(r.choice((f"<p>{self.say(3, 30)}</p>", f'<p><a href="/x">{self.say(2, 8, False)}</a></p>')) for _ in range(n))]
            n += 1
        elif kind == "footer":
            parts = [r.choice(("&copy; ", "© 2024 ", "")) + self.say(2, 20)]
            n = 1
        else:
            inside = self.say(2, 25)
            parts = [r.choice((inside, f"<p>{inside}</p>", f"<h1>{inside}</h1>" if kind == "header" else inside, f'<a href="/x">{inside}</a>'))]
            n = 1
        page = f"<{tag}{attr}>{''.join(parts)}</{tag}>"
        return page, [False] * sum(x.text is not None for x in nodes_of(parse(page)))

    def block(self) -> tuple[str, int]:
        r = self.r
        kind = r.random()
        if kind < 0.75:
            text = self.say(1, 60)
            if r.random() < 0.25:
                text += f' <a href="/y">{self.say(1, 4, False)}</a> ' + self.say(2, 12)
            if r.random() < 0.2:
                text = f"<b>{text}</b>" if r.random() < 0.5 else f"<b>{text}<br>"
            return f"<p>{text}" + "</p>" * (r.random() < 0.9), 1
        if kind < 0.83:
            level = r.choice((2, 3, 4))
            return f"<h{level}>{self.say(1, 8, False)}</h{level}>", 1
        if kind < 0.9:
            n = r.randint(1, 5)
            return "<ul>" + "".join(f"<li>{self.say(1, 20)}</li>" for _ in range(n)) + "</ul>", n
        if kind < 0.94:
            return f"<blockquote><p>{self.say(3, 30)}</p></blockquote>", 1
        if kind < 0.97:
            return f"<pre>{self.say(3, 20, False)}</pre>", 1
        n = r.randint(1, 4)
        return "<table>" + "".join(f"<tr><td>{self.say(1, 4, False)}</td></tr>" for _ in range(n)) + "</table>", n

    def content(self) -> tuple[str, list[bool]]:
        r = self.r
        tag = r.choice(("article", "article", "main", "div", "section"))
        attr = self.attributes("content") or (' class="content"' if tag in ("div", "section") else "")
        parts, truth = [], []
        if r.random() < 0.75:
            parts.append(f"<h1>{self.say(2, 10, False)}</h1>")
            truth.append(True)
        for _ in range(r.choice((1, 1, 2, 4, 8, 16))):
            page, n = self.block()
            parts.append(page)
            truth += [True] * n
            if r.random() < 0.06:
                page, false = self.boilerplate(r.choice(("ad", "aside", "share", "notice", "form")))
                parts.append(page)
                truth += false
        page = f"<{tag}{attr}>{''.join(parts)}</{tag}>"
        if r.random() < 0.25:
            page = f"<div{self.attributes('content')}>{page}</div>"
        return page, truth

    def page(self) -> tuple[str, list[bool]]:
        r = self.r
        if r.random() < 0.08:
            return self.content()  # a fragment
        before = [k for k, p in (("notice", 0.35), ("header", 0.5), ("nav", 0.7), ("ad", 0.4), ("form", 0.15), ("aside", 0.15)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("ad", 0.25), ("comments", 0.4), ("aside", 0.35), ("form", 0.2), ("nav", 0.15), ("notice", 0.15), ("footer", 0.75)) if r.random() < p]
        r.shuffle(before)
        done = [self.boilerplate(k) for k in before] + [self.content()] + [self.boilerplate(k) for k in after]
        body = "".join(p for p, _ in done)
        if r.random() < 0.3:
            body = f'<div class="{r.choice(("wrapper", "container", "page", "layout"))}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.say(1, 6)}</title></head><body>{body}</body></html>", [t for _, truth in done for t in truth]


def labelled_pages(n: int = 500, seed: int = 4) -> list[tuple[str, list[bool]]]:
    g = Grammar(seed)
    return [g.page() for _ in range(n)]


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


# -- the operator ----------------------------------------------------------------------------------------------------


def extract(page: str, model: Model) -> str:
    nodes = nodes_of(parse(page))
    measure(nodes)
    keep = model.marginals(nodes)
    return "\n".join(x.text for x, p in zip(nodes, keep) if x.text is not None and p >= 0.5)


def _extracted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(t, model) if t else "" for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points).

    Null and empty html, and pages without content, have an empty text. Broken and cut-off markup is read as far as it
    goes. Pages may have any length and depth: the time is in proportion to the page, and a worker holds one page's
    tree at a time. A run of text at a marginal of one half is kept. Repeated rows stay repeated, null ids stay, and
    other columns are ignored. An empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(partial(_extracted, model=model or default_model()), "page_id long, url string, text string, n_chars long")
