"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is a binary variable (content or not) with a potential from its features and one with its parent's variable. Sum-product
messages go up and down the tree once and give each element's marginal, in training the gradient of the conditional likelihood too.
"""

from __future__ import annotations

import functools
import math
import random
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .htmltree import INLINE, UNSEEN, Tree

SECTIONS = frozenset("article main nav header footer aside form section dialog menu figure table ul ol blockquote".split())
_WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class ExtractParams:
    """pages: labelled training pages; threshold: marginal from which an element is content."""

    pages: int = 160
    epochs: int = 12
    rate: float = 0.25
    decay: float = 1e-3
    seed: int = 5
    threshold: float = 0.5


def _edge_type(tag: str) -> int:
    return 0 if tag in INLINE else 1 if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dd", "dt", "pre", "figcaption", "blockquote") else 2


class Dom:
    """A parsed page with each element's features."""

    def __init__(self, html: str):
        t = self.tree = Tree(html)
        n = len(t.tags)
        own, links, stops = [0] * n, [0] * n, [0] * n
        hidden = [False] * n
        for i in range(n):
            p = t.parents[i]
            hidden[i] = t.tags[i] in UNSEEN or (p >= 0 and hidden[p])
        self.hidden = hidden
        linked = [t.tags[i] == "a" for i in range(n)]
        for i in range(n):
            p = t.parents[i]
            linked[i] = linked[i] or (p >= 0 and linked[p])
        for e, text in t.runs:
            if e >= 0 and not hidden[e]:
                size = len(text.strip())
                own[e] += size
                if linked[e]:
                    links[e] += size
                stops[e] += text.count(". ") + text.rstrip().endswith((".", "!", "?"))
        total, in_links, ends = own[:], links[:], stops[:]
        for i in range(n - 1, -1, -1):
            p = t.parents[i]
            if p >= 0:
                total[p] += total[i]
                in_links[p] += in_links[i]
                ends[p] += ends[i]
        within: list[frozenset] = []
        self.features: list[list[str]] = []
        for i in range(n):
            p, tag = t.parents[i], t.tags[i]
            names = set()
            for k, v in t.attrs[i]:
                if k in ("class", "id", "role", "itemprop", "aria-label") and v:
                    names.update("n:" + w for w in _WORD.findall(v.lower()))
                elif k in ("hidden",) or (k == "style" and v and "display:none" in v.replace(" ", "")):
                    names.add("n:hidden")
            around = within[p] if p >= 0 else frozenset()
            more = {"u" + x for x in names} | ({"in:" + tag} if tag in SECTIONS else set())
            if not more <= around:  # else the parent's set serves
                around = around | more
            within.append(around)
            size = total[i]
            f = ["bias", "t:" + tag, *names, *around, f"len:{min(9, size.bit_length())}", f"link:{4 * in_links[i] // size if size else 5}", f"end:{min(3, ends[i])}"]
            if p >= 0:
                f.append(f"pt:{t.tags[p]}>{tag}")
            self.features.append(f)
        self.kinds = [_edge_type(x) for x in t.tags]
        self.parents = t.parents


class TreeModel:
    def __init__(self):
        self.weights: dict[str, float] = {}
        self.edges = [[[0.5, 0.0], [0.0, 0.5]] for _ in range(3)]

    def marginals(self, dom: Dom) -> tuple[list[float], list[tuple[float, ...]]]:
        """P(content) of each element, and P(parent, own) of each edge as (00, 01, 10, 11)."""
        parents, kinds, w = dom.parents, dom.kinds, self.weights
        n = len(parents)
        up0 = [0.0] * n
        up1 = [sum(w.get(x, 0.0) for x in f) for f in dom.features]
        to0, to1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if parents[i] >= 0:
                e = self.edges[kinds[i]]
                a, b = e[0][0] + up0[i], e[0][1] + up1[i]
                to0[i] = max(a, b) + math.log1p(math.exp(-abs(a - b)))
                a, b = e[1][0] + up0[i], e[1][1] + up1[i]
                to1[i] = max(a, b) + math.log1p(math.exp(-abs(a - b)))
                up0[parents[i]] += to0[i]
                up1[parents[i]] += to1[i]
        full0, full1, pairs = up0[:], up1[:], [()] * n
        for i in range(n):
            p = parents[i]
            if p >= 0:
                e = self.edges[kinds[i]]
                c0, c1 = full0[p] - to0[i], full1[p] - to1[i]  # the parent without this child
                s = (c0 + e[0][0] + up0[i], c0 + e[0][1] + up1[i], c1 + e[1][0] + up0[i], c1 + e[1][1] + up1[i])
                top = max(s)
                x = [math.exp(v - top) for v in s]
                z = sum(x)
                pairs[i] = tuple(v / z for v in x)
                own = pairs[i][1] + pairs[i][3]
                full0[i], full1[i] = math.log(max(1 - own, 1e-300)), math.log(max(own, 1e-300))
        return [1 / (1 + math.exp(max(-700, min(700, a - b)))) for a, b in zip(full0, full1, strict=True)], pairs

    def fit(self, pages: list[tuple[str, list[int]]], p: ExtractParams) -> TreeModel:
        """Gradient ascent on the likelihood of the labels (one for each element in start-tag order)."""
        doms = [(Dom(html), y) for html, y in pages]
        rng = random.Random(p.seed)
        for epoch in range(p.epochs):
            rng.shuffle(doms)
            rate = p.rate / (1 + epoch / 4)
            for dom, y in doms:
                own, pairs = self.marginals(dom)
                for i, f in enumerate(dom.features):
                    g = (y[i] - own[i]) * rate
                    if abs(g) > 1e-4:
                        for x in f:
                            self.weights[x] = self.weights.get(x, 0.0) * (1 - rate * p.decay) + g / 4
                    q = dom.parents[i]
                    if q >= 0:
                        e, k = self.edges[dom.kinds[i]], 2 * y[q] + y[i]
                        for j in range(4):
                            e[j // 2][j % 2] += rate / 10 * ((j == k) - pairs[i][j])
        return self

    def text(self, html: str | None, threshold: float = 0.5) -> str:
        """The content blocks of a page, white space as one space, joined by line breaks."""
        if not html:
            return ""
        dom = Dom(html)
        t = dom.tree
        own, _ = self.marginals(dom)
        block = [0] * len(t.tags)
        for i, tag in enumerate(t.tags):
            p = t.parents[i]
            block[i] = (block[p] if p >= 0 else -1) if tag in INLINE else i
        out: list[str] = []
        last, parts, seen = None, [], 0

        def close():
            line = " ".join("".join(parts).split())
            if line and (last is None or last < 0 or own[last] >= threshold):
                out.append(line)
            parts.clear()

        # a block also ends where another block starts between two of its runs
        starts = [i for i, tag in enumerate(t.tags) if tag not in INLINE]
        plain = not starts
        for e, s in t.runs:
            if e >= 0 and dom.hidden[e]:
                continue
            b = block[e] if e >= 0 else -1
            if not s.strip():
                if b == last:
                    parts.append(" ")
                continue
            if b != last:
                close()
                last = b
            parts.append(s)
        if not plain or parts:
            close()
        return "\n".join(out)


_SYLLABLES = "an ber cor da el fin gar ho ist jo ka lum mer no or pra qui ras sol ten ul ver wis xa yo zen".split()


def training_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """n made-up pages of many layouts, each with a label for every element in start-tag order."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + rng.choice(".....!?")
    prose = lambda: " ".join(sentence() for _ in range(rng.randint(1, 7)))

    def page():
        html: list[str] = []
        labels: list[int] = []

        def el(tag, y, inside="", name="", close=True):
            attr = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
            html.append(f"<{tag}{attr}>")
            labels.append(y)
            inside() if callable(inside) else html.append(inside)
            if close:
                html.append(f"</{tag}>")

        def link(y, text):
            html.append(f'<a href="/{word()}">')
            labels.append(y)
            html.append(text + "</a>")

        def menu(tag="ul"):
            el(tag, 0, lambda: [el("li", 0, lambda: link(0, words(1, 3))) for _ in range(rng.randint(3, 8))])

        def nav():
            el(*rng.choice([("nav", 0), ("div", 0)]), menu, name=rng.choice(["", "nav", "menu", "navbar", "top-menu", "navigation", "breadcrumb"]) or ("menu" if rng.random() < 0.7 else ""))

        def ad():
            el(rng.choice(["div", "div", "aside", "p", "section"]), 0, rng.choice([prose, sentence])(), name=rng.choice(["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-box", "advertisement"]))

        def notice():
            el("div", 0, lambda: (el("p", 0, prose()), labels.append(0), html.append("<button>" + word() + "</button>")), name=rng.choice(["cookie", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "banner"]))

        def form():
            el("form", 0, lambda: (el("label", 0, words(2, 5)), labels.append(0), html.append('<input type="text">'), el("p", 0, sentence()), labels.append(0), html.append("<button>ok</button>")), name=rng.choice(["", "search", "newsletter", "login", "subscribe", "signup"]))

        def side():
            el(rng.choice(["aside", "div"]), 0, lambda: (el("h3", 0, words(1, 3)), menu() if rng.random() < 0.6 else el("p", 0, prose())), name=rng.choice(["sidebar", "side", "widget", "related", "rail", "sidebar-right", "recommended"]))

        def comments():
            def one():
                el(rng.choice(["div", "li", "article"]), 0, lambda: (el(rng.choice(["p", "div"]), 0, prose()), el("span", 0, words(1, 2), name="author")), name=rng.choice(["comment", "comment-body", "reply", "comments-item"]))

            el(rng.choice(["section", "div", "ul", "ol"]), 0, lambda: (el("h3", 0, words(1, 2)), [one() for _ in range(rng.randint(1, 4))]), name=rng.choice(["comments", "comment-list", "discussion", "reader-comments", "responses", "disqus"]))

        def header():
            el(rng.choice(["header", "div"]), 0, lambda: (el(rng.choice(["div", "span", "h2", "p"]), 0, words(1, 4), name=rng.choice(["logo", "site-title", "brand", "tagline"])), nav() if rng.random() < 0.5 else None), name=rng.choice(["header", "site-header", "top", "masthead"]))

        def footer():
            el(rng.choice(["footer", "footer", "div"]), 0, lambda: (html.append("&copy; " + words(1, 3) + " &middot; " + sentence()), el("p", 0, prose()) if rng.random() < 0.5 else None, menu() if rng.random() < 0.4 else None), name=rng.choice(["footer", "site-footer", "copyright", "bottom"]))

        def inline():
            if rng.random() < 0.3:
                el(rng.choice(["b", "em", "strong", "i", "code", "span"]), 1, words(1, 4))
            elif rng.random() < 0.3:
                link(1, words(1, 3))
            html.append(" " + prose())

        def para():
            kind = rng.random()
            if kind < 0.6:
                el("p", 1, lambda: (html.append(prose()), inline() if rng.random() < 0.4 else None), close=rng.random() < 0.9)
            elif kind < 0.7:
                html.append("<p><b>")
                labels.extend([1, 1])
                html.append(prose() + "<br>")
                labels.append(1)
            elif kind < 0.78:
                el(rng.choice(["h2", "h3", "h4"]), 1, words(1, 6))
            elif kind < 0.85:
                el(rng.choice(["ul", "ol"]), 1, lambda: [el("li", 1, rng.choice([sentence, prose])()) for _ in range(rng.randint(2, 5))])
            elif kind < 0.9:
                el("blockquote", 1, lambda: el("p", 1, prose()))
            elif kind < 0.93:
                el("table", 1, lambda: [el("tr", 1, lambda: [el("td", 1, words(1, 4)) for _ in range(3)]) for _ in range(3)])
            elif kind < 0.95:
                el("pre", 1, words(3, 9))
            else:
                el("div", 1, lambda: el("p", 1, prose()))

        def body():
            if rng.random() < 0.8:
                el("h1", 1, words(2, 9))
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                para()
                if rng.random() < 0.07:
                    ad()
                if rng.random() < 0.04:
                    el("div", 0, lambda: [link(0, word()) for _ in range(3)], name=rng.choice(["share", "social", "share-buttons", "tags"]))
            if rng.random() < 0.15:
                comments()
            if rng.random() < 0.1:
                form()

        def content():
            tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
            name = rng.choice(["", "post", "entry", "story"]) if tag in ("article", "main") else rng.choice(["content", "post", "entry-content", "article-body", "main", "story", "article", "text"])
            if rng.random() < 0.25:
                el(rng.choice(["div", "main"]), 1, lambda: el(tag, 1, body, name=name), name=rng.choice(["container", "wrapper", "page", "main", "content"]))
            else:
                el(tag, 1, body, name=name)

        html.append("<!DOCTYPE html><html><head><meta charset='utf-8'><title>" + words(2, 8) + "</title><style>p{}</style><script>var a=1;</script></head><body>")
        labels.extend([1, 0, 0, 0, 0, 0, 1])
        before = [f for f, q in ((header, 0.5), (nav, 0.8), (notice, 0.3), (ad, 0.5), (form, 0.25), (side, 0.2)) if rng.random() < q]
        rng.shuffle(before)
        after = [f for f, q in ((comments, 0.4), (side, 0.4), (ad, 0.3), (form, 0.25), (notice, 0.2)) if rng.random() < q]
        rng.shuffle(after)
        for f in (*before, content, *after):
            f()
            if rng.random() < 0.1:
                html.append("<!-- x -->")
        if rng.random() < 0.9:
            footer()
        html.append("</body></html>" if rng.random() < 0.9 else "")
        return "".join(html), labels

    return [page() for _ in range(n)]


@functools.lru_cache(maxsize=2)
def trained(params: ExtractParams) -> TreeModel:
    return TreeModel().fit(training_pages(params.pages, params.seed), params)


def extract_pages(pages: DataFrame, params: ExtractParams = ExtractParams(), model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html, ...).

    Null and empty html give the empty text; a page without markup is all content. Each row is done on its own from its whole html, so
    repeated rows and null ids are kept as they are; other columns aren't read. The model is small and fixed in size.
    """
    model = model or trained(params)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                text = [model.text(h, params.threshold) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
