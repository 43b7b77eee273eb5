"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is a binary variable: content or not. Its own features (tag, words of class and id, link density, amount of
text) give a potential, and parent and child share a pairwise potential that depends on the kind of the child. Messages
are passed upward from the leaves and downward from the root (sum-product), which is exact on a tree and yields each
element's content marginal. Both kinds of potentials are trained together, by gradient ascent on the likelihood of
labelled pages; those are made here, from varied layouts of which each element's role is known.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_fields

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe xmp svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mfrac mi mn mo mrow ms mspace msqrt mstyle msub msup mtext".split())
#: Elements that don't end a block.
WITHIN = INLINE | {"img", "wbr"}
#: An opening tag that ends an open element of one of these names, if no element of the second list stands between.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ())}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|[^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

#: Element kinds, by name; others are "other".
KINDS = {name: kind for kind, names in {
    "article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "head": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li dt dd", "a": "a", "nav": "nav",
    "foot": "footer address", "top": "header", "aside": "aside", "form": "form button input select label fieldset option textarea", "table": "table tbody thead tr td th caption", "quote": "blockquote pre figure figcaption details summary",
    "root": "html body", "meta": "head title", "inline": " ".join(INLINE - {"a", "label"}),
}.items() for name in names.split()}
#: Words of class, id and role that speak of an element's use.
WORDS = {
    "ad": "ad ads adv advert advertisement advertising adsense banner promo promotion sponsor sponsored",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar toolbar tabs",
    "foot": "foot footer copyright legal colophon contentinfo imprint",
    "top": "header masthead logo brand hero",
    "side": "side sidebar aside widget rail complementary",
    "share": "share sharing social related recommended popular trending more tags",
    "comment": "comment comments reply replies respond discussion disqus feedback",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog warning message",
    "form": "form login signup subscribe subscription newsletter search contact",
    "good": "article content entry post story main text prose copy",
}
_WORD = {w: kind for kind, ws in WORDS.items() for w in ws.split()}
FEATURES = {f: k for k, f in enumerate(["bias", *(f"tag:{k}" for k in [*dict.fromkeys(KINDS.values()), "other"]), *(f"word:{k}" for k in WORDS), "links:most", "links:some", "text:none", "text:short", "text:some", "text:long", "own:none", "own:short", "own:long", "stops:none", "top", "strong:bad", "strong:good"])}
#: Kinds of child for the pairwise potential: plain inline, plain block, one that its tag or words mark.
EDGES = ("inline", "block", "marked")
_BAD_TAGS, _BAD_WORDS = {"nav", "foot", "aside", "form", "top"}, set(WORDS) - {"good"}


class Page:
    """Elements in page order: tag, attribute words, parent; and the events: (element, text), or (element, None) for an edge of a block."""

    def __init__(self, text: str) -> None:
        self.tags, self.words, self.parents = ["html"], [frozenset()], [-1]
        self.events: list[tuple[int, str | None]] = []
        self.stack = [0]
        at = 0
        while m := TOKEN.search(text, at):
            self.text(text[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag, closing = m[2].lower(), m[1]
            if closing:
                self.close(tag)
            elif not m[3].endswith(">"):
                break  # the page ends within a tag
            else:
                self.open(tag, m[3])
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(text, at)
                    at = end.start() if end else len(text)
        else:
            self.text(text[at:])

    def text(self, raw: str) -> None:
        if raw:
            self.events.append((self.stack[-1], html.unescape(raw) if "&" in raw else raw))

    def edge(self, tag: str) -> None:
        if tag not in WITHIN:
            self.events.append((self.stack[-1], None))

    def cut(self, names: tuple[str, ...], walls: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[k]]
            if tag in names:
                del self.stack[k:]
                return
            if tag in walls or tag not in INLINE and not walls:
                return

    def open(self, tag: str, rest: str) -> None:
        if tag == "html":
            return
        if tag in ENDS:
            self.cut(*ENDS[tag])
        if tag not in INLINE and tag not in VOID or tag == "hr":
            self.cut(("p",), ())
        self.edge(tag)
        if tag in VOID:
            return
        attributes = " ".join(v for m in ATTRIBUTE.finditer(rest) for v in m.groups()[1:] if v) if "=" in rest else ""
        words = frozenset(_WORD[w] for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", attributes).lower()) if w in _WORD)
        self.tags.append(tag)
        self.words.append(words)
        self.parents.append(self.stack[-1])
        if not (rest.endswith("/>") and tag in RAW):
            self.stack.append(len(self.tags) - 1)

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            own = self.tags[self.stack[k]]
            if own == tag:
                del self.stack[k:]
                break
            if tag in INLINE and own not in INLINE:
                break
        self.edge(tag)

    def features(self) -> tuple[list[list[int]], list[int]]:
        """For each element the numbers of its features, and the kind of its edge to the parent."""
        n = len(self.tags)
        own, links, stops = [0] * n, [0] * n, [0] * n
        for k, text in self.events:
            if text:
                own[k] += (size := len(text.strip()))
                stops[k] += text.count(".") + text.count(",") if size else 0
        total = own[:]
        for k in range(n - 1, 0, -1):
            p = self.parents[k]
            total[p] += total[k]
            links[p] += total[k] if self.tags[k] == "a" else links[k]
            stops[p] += stops[k]
        out, edges = [], []
        for k in range(n):
            kind, words = KINDS.get(self.tags[k], "other"), self.words[k]
            share = links[k] / total[k] if total[k] else 0
            bad, good = kind in _BAD_TAGS or bool(words & _BAD_WORDS), kind in ("article", "main") or "good" in words
            f = ["bias", f"tag:{kind}", *(f"word:{w}" for w in words), "text:none" if not total[k] else "text:short" if total[k] < 30 else "text:some" if total[k] < 200 else "text:long", "own:none" if not own[k] else "own:short" if own[k] < 60 else "own:long"]
            f += ["links:most"] * (share > 0.6) + ["links:some"] * (0.2 < share <= 0.6) + ["stops:none"] * (not stops[k]) + ["top"] * (self.parents[k] == 0) + ["strong:bad"] * bad + ["strong:good"] * (good and not bad)
            out.append([FEATURES[x] for x in f])
            edges.append(2 if bad or good else 0 if self.tags[k] in INLINE else 1)
        return out, edges


def _soft(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def marginals(parents: list[int], own: list[float], edges: list[int], pair: list[tuple[float, float, float, float]]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product on the tree. own: log odds of content; pair: for each kind of edge log potentials of (parent, child) = 00, 01, 10, 11. Returns log odds of content with all messages, those without the parent's, and the messages upward."""
    n = len(parents)
    below, up, full = own[:], [0.0] * n, [0.0] * n
    for k in range(n - 1, 0, -1):
        a, b, c, d = pair[edges[k]]
        s = below[k]
        up[k] = c + _soft(d + s - c) - a - _soft(b + s - a)
        below[parents[k]] += up[k]
    full[0] = below[0]
    for k in range(1, n):
        a, b, c, d = pair[edges[k]]
        above = full[parents[k]] - up[k]
        full[k] = below[k] + b + _soft(d + above - b) - a - _soft(c + above - a)
    return full, below, up


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


class TreeModel:
    def __init__(self, weights: np.ndarray, pair: np.ndarray) -> None:
        self.weights, self.pair = weights.tolist(), [tuple(r) for r in pair.tolist()]

    def content(self, page: Page) -> list[bool]:
        """Whether each element is content: more likely than not by its marginal. If no text is, the page has no part that looks like an article: all text counts then that isn't marked as something else, nor mostly links."""
        features, edges = page.features()
        w = self.weights
        out = [x > 0 for x in marginals(page.parents, [sum([w[i] for i in f]) for f in features], edges, self.pair)[0]]
        if not any(text and out[k] and page.tags[k] not in RAW and text.strip() for k, text in page.events):
            out = []
            for k, p in enumerate(page.parents):
                other = FEATURES["strong:bad"] in features[k] or FEATURES["links:most"] in features[k] or page.tags[k] in ("head", "title")
                out.append((not k or out[p]) and (not k or not other))
        return out

    def extract(self, text: str | None) -> str:
        if not text:
            return ""
        page = Page(text)
        keep = self.content(page)
        parts = []
        for k, piece in page.events:
            if piece is None:
                parts.append(" ")
            elif keep[k] and page.tags[k] not in RAW:
                parts.append(piece)
            else:
                parts.append(" ")
        return " ".join("".join(parts).split())


@lru_cache(maxsize=4)
def trained(pages: int = 240, rounds: int = 40, seed: int = 11) -> TreeModel:
    """Gradient ascent on the log likelihood of labelled pages; the gradient needs the marginals of elements and of edges."""
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        page = LabelledPage(labelled_page(rng))
        data.append((page.parents, *page.features(), page.labels))
    w, pair = np.zeros(len(FEATURES)), np.zeros((len(EDGES), 4))
    seen_w, seen_pair = np.full(len(w), 1e-6), np.full(pair.shape, 1e-6)
    batch = 24
    for step in range(rounds * pages // batch):
        slope_w, slope_pair = -0.02 * w, -0.02 * pair
        rows = [tuple(r) for r in pair.tolist()]
        for parents, features, edges, label in (data[(step * batch + i) % pages] for i in range(batch)):
            full, below, up = marginals(parents, [float(w[f].sum()) for f in features], edges, rows)
            for k, f in enumerate(features):
                slope_w[f] += label[k] - _sigmoid(full[k])
                if k:
                    a, b, c, d = rows[edges[k]]
                    above = full[parents[k]] - up[k]
                    logs = np.array([a, b + below[k], c + above, d + above + below[k]])
                    p = np.exp(logs - logs.max())
                    slope_pair[edges[k]] -= p / p.sum()
                    slope_pair[edges[k], 2 * label[parents[k]] + label[k]] += 1
        seen_w += slope_w**2
        seen_pair += slope_pair**2
        w += 0.25 * slope_w / np.sqrt(seen_w)
        pair += 0.25 * slope_pair / np.sqrt(seen_pair)
    return TreeModel(w, pair)


class LabelledPage(Page):
    """A made page; labels: 1 for elements of the main text."""

    def __init__(self, text: str) -> None:
        self.labels = [0]
        super().__init__(text)

    def open(self, tag: str, rest: str) -> None:
        super().open(tag, rest)
        self.labels += [int(" data-y" in rest)] * (len(self.tags) - len(self.labels))


def _prose(rng: random.Random, low: int, high: int, plain: bool = False) -> str:
    parts = "ta re sol mi en qua ber ist on de la vor ke nu pli sam dor".split()
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) + ("" if plain or rng.random() < 0.85 else rng.choice(".,")) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize() + ("" if plain or rng.random() < 0.1 else ".")


def _links(rng: random.Random, n: int) -> str:
    item = lambda: f'<a href="/{rng.random()}">{_prose(rng, 1, 3, True)}</a>'
    return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if rng.random() < 0.8 else " | ".join(item() for _ in range(n))


def _junk(rng: random.Random, kind: str) -> str:
    """A part of a page that isn't main text."""
    name = rng.choice([w for w in WORDS[kind].split()])
    mark = rng.choice([f'class="{name}"', f'id="{name}"', f'class="box {name}-{rng.randint(1, 9)}"'])
    text = f"<p>{_prose(rng, 2, 40)}</p>" if rng.random() < 0.6 else _prose(rng, 2, 25)
    if kind == "menu":
        tag = rng.choice(["nav", "nav", "div", "ul"])
        return f"<{tag}{rng.choice(['', ' ' + mark]) if tag == 'nav' else ' ' + mark}>{_links(rng, rng.randint(3, 9))}</{tag}>"
    if kind == "foot":
        tag = rng.choice(["footer", "footer", "div"])
        return f"<{tag}{'' if tag == 'footer' and rng.random() < 0.7 else ' ' + mark}>{rng.choice(['&copy; ', ''])}{text}{_links(rng, 3) if rng.random() < 0.3 else ''}</{tag}>"
    if kind == "top":
        tag = rng.choice(["header", "div"])
        return f"<{tag}{'' if tag == 'header' and rng.random() < 0.6 else ' ' + mark}><h1>{_prose(rng, 1, 4, True)}</h1>{_junk(rng, 'menu') if rng.random() < 0.5 else ''}{text if rng.random() < 0.4 else ''}</{tag}>"
    if kind == "side":
        tag = rng.choice(["aside", "aside", "div"])
        return f"<{tag}{'' if tag == 'aside' and rng.random() < 0.6 else ' ' + mark}><h3>{_prose(rng, 1, 3, True)}</h3>{rng.choice([_links(rng, 5), text])}</{tag}>"
    if kind == "form":
        return f"<form{rng.choice(['', ' ' + mark])}>{rng.choice(['<p>%s</p>', '<label>%s</label>', '%s']) % _prose(rng, 1, 12)}<input name=q><button>{_prose(rng, 1, 2, True)}</button></form>"
    if kind == "comment":
        one = lambda: rng.choice(['<div class="comment"><b>%s</b><p>%s</p></div>', "<li><p>%s</p><p>%s</p></li>", "<p>%s</p><p>%s</p>"]) % (_prose(rng, 1, 2, True), _prose(rng, 3, 60))
        return f"<{(t := rng.choice(['section', 'div', 'ol']))} {mark}>{rng.choice(['', '<h3>%s</h3>' % _prose(rng, 1, 3, True)])}{''.join(one() for _ in range(rng.randint(1, 5)))}</{t}>"
    return f"<{(t := rng.choice(['div', 'div', 'section', 'aside', 'p']))} {mark}>{text if t != 'p' else _prose(rng, 2, 20)}</{t}>"


def _block(rng: random.Random) -> str:
    """A block of main text; its elements carry data-y."""
    y, r = " data-y", rng.random()
    inline = lambda: rng.choice([f"<b{y}>{_prose(rng, 1, 4)}</b>", f"<em{y}>{_prose(rng, 1, 2)}</em>", f'<a{y} href="/x">{_prose(rng, 1, 4)}</a>', f"<span{y}>{_prose(rng, 1, 9)}</span>"])
    if r < 0.55:
        return f"<p{y}>{_prose(rng, *rng.choice([(1, 4), (5, 30), (30, 120)]))}{' ' + inline() + ' ' + _prose(rng, 1, 30) if rng.random() < 0.3 else ''}{'</p>' if rng.random() < 0.9 else ''}"
    if r < 0.65:
        return f"<p{y}><b{y}>{_prose(rng, 1, 25)}<br>"
    if r < 0.75:
        return f"<h{(n := rng.randint(2, 4))}{y}>{_prose(rng, 1, 8, True)}</h{n}>"
    if r < 0.82:
        return f"<ul{y}>" + "".join(f"<li{y}>{inline() if rng.random() < 0.3 else _prose(rng, 1, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
    if r < 0.86:
        return f"<blockquote{y}><p{y}>{_prose(rng, 5, 50)}</p></blockquote>"
    if r < 0.89:
        return f"<table{y}>" + "".join(f"<tr{y}><td{y}>{_prose(rng, 1, 5)}</td><td{y}>{_prose(rng, 1, 5)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>"
    if r < 0.91:
        return f"<pre{y}>{_prose(rng, 3, 40)}</pre>"
    if r < 0.94:  # linked passages and lists belong to the text that they stand in
        return f'<p{y}>{rng.choice([_prose(rng, 1, 3) + " ", ""])}<a{y} href="/x">{_prose(rng, 3, 20)}</a></p>'
    if r < 0.985:
        return f"<ul{y}>" + "".join(f'<li{y}><a{y} href="/x">{_prose(rng, 1, 6, rng.random() < 0.7)}</a></li>' for _ in range(rng.randint(2, 6))) + "</ul>"
    return f"<div{y}>{_prose(rng, 5, 80)}</div>"


def labelled_page(rng: random.Random) -> str:
    """A page in a made layout: main text among menus, headers, footers, sidebars, notices, adverts, forms and comments."""
    y, out = " data-y", []
    some = lambda kind, share: [_junk(rng, kind)] if rng.random() < share else []
    good = rng.choice(WORDS["good"].split())
    wrap = rng.choice([("article", ""), ("article", ""), ("article", f' class="{good}"'), ("main", ""), ("div", f' class="{good}"'), ("div", f' id="{good}"'), ("section", f' class="{good}-body"'), ("div", "")])
    inner = [rng.choice([f"<h1{y}>{_prose(rng, 2, 12, True)}</h1>", f"<header{y}><h1{y}>{_prose(rng, 2, 12, True)}</h1></header>", ""])]
    for _ in range(rng.choice([1, 2, 4, 8, 14])):
        inner += [_block(rng)] + some("ad", 0.07) + some("share", 0.03) + some("form", 0.02)
    tail = some("share", 0.2) + some("comment", 0.45)
    within = rng.random() < 0.4
    body = f"<{wrap[0]}{y}{wrap[1]}>{''.join(inner)}{''.join(tail) if within else ''}</{wrap[0]}>{'' if within else ''.join(tail)}"
    around = some("side", 0.3) + [body] + some("side", 0.3) + some("form", 0.15)
    if rng.random() < 0.3:
        around = [f"<{(t := rng.choice(['div', 'main']))}>", *around, f"</{t}>"]
    out += some("notice", 0.25) + some("top", 0.5) + some("menu", 0.8) + some("ad", 0.5) + around + some("share", 0.15) + some("ad", 0.2) + some("notice", 0.1) + some("foot", 0.9)
    return f"<!DOCTYPE html><html><head><title>{_prose(rng, 1, 5)}</title><script>x()</script></head><body>{''.join(out)}</body></html>"


def main_texts(pages: DataFrame, column: str = "html", model: TreeModel | None = None) -> DataFrame:
    """pages with `text`, the main text of each page.

    Null, empty and markup-only pages give an empty text; text without any markup is all main text; a passage marked as a notice or warning is one, also within an article; very long pages are
    handled whole; a page that ends within a tag loses that tag only. Pages are
    handled one by one, whole, so repeated rows get equal texts; a column `text` is replaced, other columns stay.
    """
    model = model or trained()
    pages = pages.drop("text")
    at = pages.columns.index(column)

    def extract(batches):
        for b in batches:
            out = [model.extract(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "text"])

    return pages.mapInArrow(extract, with_fields(pages, "text string"))


def pages_digest(pages: DataFrame) -> DataFrame:
    return main_texts(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
