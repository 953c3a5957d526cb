"""Main text of HTML pages, by a tree-structured graphical model over the DOM.

Method: the block elements of a page are the nodes of a tree of hidden labels
(main text or not). A node's potential comes from its tag, its class, id and
role words, its own text's length and link share; a parent-child potential
ties each node's label to its parent's. Sum-product messages pass upward and
then downward through the tree and leave every node's marginal probability of
being main text; the text blocks of nodes at ``KEEP_AT`` or more are the page's
text. All potentials are counted on labelled pages (``html_labelled``, a fixed
small set) before the job starts; tasks get them as a few hundred numbers.

Scripts, styles, the head, comments in the markup and form controls never give
text. Pages are parsed tolerantly: void elements, implied ends of paragraphs,
list items and cells, stray end tags, missing ends. A head without an end tag
ends at the first tag or text that can't stand in it, a button, select or option
without one at the next flow element. Fallback content of objects, canvases and
media, and formulas, are text like other.

Defined cases: null or empty html: empty text; html without any markup is a
body; ids of any type, null and repeated ones included, pass through row by
row; an empty table gives an empty result; very deep markup is no recursion.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_AT = 0.5
#: Weight of a flow element's own evidence. Neighbouring paragraphs are alike, so that each counts for less than a
#: node of its own would; chosen by leaving out labelled pages in turn.
FLOW_WEIGHT = 0.3

# HTML's void elements, elements whose content is no text, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg title".split())
HIDDEN = frozenset("head select option button".split()) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " audio canvas object param source track video"
    " math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt"
    " mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split()
)
#: Start tags that leave an open head open; any other, and text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
#: Start tags that an open form control may hold without an end of its own.
_IN_CONTROL = frozenset("option optgroup datalist select button".split())
#: Start tags that end an open element of the second set, up to the nearest of the third.
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_ITEM_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

# Words of class, id and role attributes, by what they tell.
_WORDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs",
    "ad": "ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored",
    "comment": "comment comments commentlist reply replies respond disqus discussion",
    "foot": "footer foot copyright colophon contentinfo",
    "head": "header masthead topbar logo",
    "side": "sidebar side aside widget widgets related recommended popular complementary",
    "notice": "cookie cookies notice notices consent alert modal popup overlay newsletter subscribe subscription gdpr",
    "social": "share sharing social buttons tweet follow",
    "form": "form login search signup register",
    "main": "content article post entry story main body text page hentry",
}
WORDS = {w: kind for kind, words in _WORDS.items() for w in words.split()}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Words of a name: runs of letters, cut where a capital follows a small letter (userComments) or begins a word (HTMLBody).
_NAME = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: The next start or end (group 1) of a control: one that is followed by a start before an end has none of its own.
_CONTROL = {t: re.compile(f"<(/)?{t}(?=[\\s/>])", re.I) for t in ("button", "select")}


#: Elements that hold main text by their name, and those that are apart from the text around them by theirs.
_ARTICLE = frozenset(("article", "main"))
_APART = frozenset("nav aside footer form dialog".split())


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    y: str | None = None
    inside: bool = False
    blocks: list[int] = field(default_factory=list)
    chars: int = 0
    link_chars: int = 0


class Page:
    """The block elements of a page, parents first, and its text blocks in page order."""

    def __init__(self, html: str):
        self.nodes = [Node("html", -1)]
        self.blocks: list[tuple[int, str]] = []
        self._stack = [("html", 0)]  # open elements and the node each belongs to
        self._parts: list[str] = []
        self._links = 0
        self._hidden = 0
        self._head = False
        self._loose: list[int] = []  # places in the stack of form controls that may have no end tag
        self._parse(html)

    def _parse(self, html: str) -> None:
        at = 0
        for m in _MARKUP.finditer(html):
            if m.start() < at:  # inside a script or the like
                continue
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[1]:
                self._end(m[1].lower())
            elif m[2] or m[4]:
                tag, attributes = (m[2] or m[4]).lower(), m[3] if m[2] else m[5]
                closed = attributes.rstrip().endswith("/")
                if self._head and tag not in IN_HEAD:
                    self._close({"head"}, set())
                if tag in RAW and not closed:
                    end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                    continue
                if tag in ("button", "select"):
                    following = _CONTROL[tag].search(html, at)
                    self._start(tag, attributes, closed, not (following and following[1]))
                else:
                    self._start(tag, attributes, closed, tag == "option")
        if at < len(html):
            self._text(html[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if self._head and raw.strip():
            self._close({"head"}, set())
        if self._hidden:
            return
        self._parts.append(raw)
        if self._links:
            self.nodes[self._stack[-1][1]].link_chars += len(raw.strip())

    def _flush(self) -> None:
        """End the running block: references decoded, white space as single spaces."""
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            self._parts = []
            if text:
                node = self._stack[-1][1]
                self.nodes[node].blocks.append(len(self.blocks))
                self.nodes[node].chars += len(text)
                self.blocks.append((node, text))

    def _start(self, tag: str, attributes: str, closed: bool, loose: bool) -> None:
        if tag == "br" or tag == "wbr":
            self._parts.append(" " if tag == "br" else "")
            return
        if tag not in INLINE:
            self._flush()
            if self._loose and tag not in _IN_CONTROL and (tag not in VOID or tag == "hr"):
                self._pop(self._loose[0])
        if tag == "button":
            self._close({"button"}, {"table", "td", "th"})
        if tag in _PARAGRAPH_ENDS:
            self._close({"p"}, {"table", "td", "th", "li", "div", "section", "article", "blockquote", "body", "html"})
        if tag in _ITEM_ENDS:
            self._close(*_ITEM_ENDS[tag])
        if tag in ("html", "body") and any(t == tag for t, _ in self._stack[1:]):
            return
        if tag in VOID or closed and tag in INLINE:
            return
        node = self._stack[-1][1]
        if tag not in INLINE and tag != "html":
            values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
            words = {WORDS[w] for k in ("class", "id", "role") for w in map(str.lower, _NAME.findall(values.get(k, ""))) if w in WORDS}
            parent = self.nodes[node]
            # Inside the article: below an article element or a box named as main text, with no named box of another kind between.
            # A word of main text beside another kind (page-header, post-footer) only says whose box it is.
            words = words if words <= {"main"} else words - {"main"}
            inside = words <= {"main", "head"} and tag not in _APART and (parent.inside or parent.tag in _ARTICLE or "main" in parent.words)
            self.nodes.append(Node(tag, node, tuple(sorted(words)), values.get("y"), inside))
            node = len(self.nodes) - 1
        if loose:
            self._loose.append(len(self._stack))
        self._stack.append((tag, node))
        self._head |= tag == "head"
        self._links += tag == "a"
        self._hidden += tag in HIDDEN

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Close the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                self._flush()
                self._pop(i)
                return
            if self._stack[i][0] in stop:
                return

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if self._head and tag in ("body", "html", "br"):
            self._close({"head"}, set())
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                self._pop(i)
                return
            if tag in INLINE and self._stack[i][0] not in INLINE:
                return

    def _pop(self, i: int) -> None:
        for t, _ in self._stack[i:]:
            self._links -= t == "a"
            self._hidden -= t in HIDDEN
            self._head &= t != "head"
        del self._stack[i:]
        while self._loose and self._loose[-1] >= i:
            self._loose.pop()


def _features(n: Node) -> list[str]:
    tag = "h" if re.fullmatch("h[1-6]", n.tag) else n.tag
    # An article's own header holds its heading; a page's header is none of the text. Links in an article are references.
    place = " inside" if n.inside else ""
    found = [f"tag {tag}{place if tag == 'header' else ''}"] + [f"word {w}{place if w == 'head' else ''}" for w in n.words]
    if n.chars:
        size = "tiny" if n.chars < 25 else "short" if n.chars < 80 else "long"
        link = n.link_chars / n.chars
        found += [f"size {size}", f"link {'no' if link < 0.2 else 'some' if link < 0.6 else 'all'}{place}"]
    return found


#: Elements that divide text; unlike boxes, they mostly share their parent's label.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th hr figcaption caption".split())


def _tie(parent: Node, child: Node) -> str:
    """Kind of a parent-child potential: a page's outermost boxes say little about those inside, inner elements much."""
    return ("outer " if parent.tag in ("html", "body") else "inner ") + ("flow" if child.tag in _FLOW and not child.words else "box")


class Model:
    """Log-odds of the features and parent-child potentials, counted on labelled pages with one added to each count."""

    def __init__(self, pages: list[str]):
        features: tuple[Counter, Counter] = (Counter(), Counter())
        total = [0, 0]
        pairs: Counter = Counter()
        for html in pages:
            page = Page(html)
            labels: list[int] = []
            for n in page.nodes:
                y = int(n.y) if n.y is not None else labels[n.parent] if n.parent >= 0 else 0
                labels.append(y)
                total[y] += 1
                features[y].update(_features(n))
                if n.parent >= 0:
                    pairs[_tie(page.nodes[n.parent], n), labels[n.parent], y] += 1
        # Length and link share are counted among the nodes that have text of their own.
        texts = [sum(n for f, n in c.items() if f.startswith("size ")) for c in features]

        def share(f: str, y: int) -> float:
            return (features[y][f] + 0.5) / ((texts if f.startswith(("size ", "link ")) else total)[y] + 1)

        self.odds = {f: log(share(f, 1) / share(f, 0)) for f in features[0] | features[1]}
        self.main_if = {
            (kind, p): (pairs[kind, p, 1] + 1) / (pairs[kind, p, 0] + pairs[kind, p, 1] + 2)
            for kind in ("outer flow", "outer box", "inner flow", "inner box")
            for p in (0, 1)
        }
        self.root = log((sum(1 for h in pages if 'body y="1"' in h) + 1) / (len(pages) + 1))

    def marginals(self, page: Page) -> list[float]:
        """P(main text) of every node: messages from the leaves up, then from the root down (parents stand first)."""
        nodes = page.nodes
        belief = [sum(self.odds.get(f, 0.0) for f in _features(n)) * (FLOW_WEIGHT if n.tag in _FLOW and not n.words else 1.0) for n in nodes]
        belief[0] += self.root
        up = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            n = nodes[i]
            kind = _tie(nodes[n.parent], n)
            a, b = self.main_if[kind, 1], self.main_if[kind, 0]
            e = exp(min(50.0, max(-50.0, belief[i])))
            up[i] = log((a * e + 1 - a) / (b * e + 1 - b))
            belief[n.parent] += up[i]
        for i in range(1, len(nodes)):
            n = nodes[i]
            kind = _tie(nodes[n.parent], n)
            a, b = self.main_if[kind, 1], self.main_if[kind, 0]
            q = _sigmoid(belief[n.parent] - up[i])  # the parent's belief without this child's message
            main = q * a + (1 - q) * b
            belief[i] += log(main / (1 - main))
        return [_sigmoid(x) for x in belief]

    def text(self, html: str | None, keep_at: float = KEEP_AT) -> str:
        page = Page(html or "")
        p = self.marginals(page)
        return "\n".join(t for node, t in page.blocks if p[node] >= keep_at)


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-min(50.0, max(-50.0, x))))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", labelled: list[str] | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """``pages`` with the main text in a column ``text``, in place of ``html_col``; other columns pass through."""
    if labelled is None:
        from cohortlens.llm.html_labelled import PAGES as labelled
    model = Model(labelled)
    keep = [f for f in pages.schema.fields if f.name not in (html_col, "text")]

    def run(batches):
        for b in batches:
            texts = [model.text(h, keep_at) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [f"c{i}" for i in range(len(keep) + 1)])

    inner = pages.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(keep)], F.col(html_col).cast("string").alias(f"c{len(keep)}"))
    out = inner.mapInArrow(run, inner.schema)
    return out.toDF(*[f.name for f in keep], "text")
