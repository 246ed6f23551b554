"""A small tolerant HTML tree: elements in start-tag order with their parents, and text runs with their element."""

from __future__ import annotations

from html.parser import HTMLParser

# Fixed values of HTML: elements without content, elements whose text is never shown, inline elements, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe object canvas title head select option textarea datalist audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr map svg g text tspan path circle rect line "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics annotation".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}


class Tree(HTMLParser):
    """tags, attrs, parents of all elements; runs: (element, text) in page order, element -1 outside all."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[list] = []
        self.parents: list[int] = []
        self.runs: list[tuple[int, str]] = []
        self.open: list[int] = []
        self.feed(html)
        try:
            self.close()
        except AssertionError:  # an unfinished declaration at the end
            pass

    def _close_to(self, names, limits) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.tags[self.open[k]]
            if tag in names:
                del self.open[k:]
                return
            if tag in limits:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_to({"p"}, {"table", "td", "th", "button", "object", "div", "article", "section", "li"})
        if tag in CLOSES:
            self._close_to(CLOSES[tag], LIMITS[tag])
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parents.append(self.open[-1] if self.open else -1)
        if tag == "br":
            self.runs.append((self.parents[-1], " "))
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[k]] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.runs.append((self.open[-1] if self.open else -1, data))
