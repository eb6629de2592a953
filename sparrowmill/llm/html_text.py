"""Main text of web pages: the maximum-scoring contiguous region.

A page is read once into words, tags and the elements around them.  Words score positive and tags negative.  A linear scan (Kadane's)
finds the contiguous region of the largest sum, which starts and ends at words; of regions of equal sums the first is taken.  All
weights are counted on labelled pages of many layouts (``html_layouts``):

* a word's weight depends on whether it is in a link and on where it is to the page's ``article`` and ``main`` elements, if there are any;
* a tag's weight depends on its name and place, and on whether it opens or closes: log odds of standing between two content words;
* an element scores by its cues (name, role, whole class names and ids, hidden or not), the share of its words that are in links and its
  length.  One that scores negative, with cues that do, counts as one tag of the scan, with a weight of its own, and is left out of the
  text wherever it stands: menus, adverts and the like within an article, say.  Class names that the labelled pages don't have are no cue.

The weights' scale is that which does best on the labelled pages.  Elements whose contents a browser doesn't show as text (``HIDDEN``)
are passed over.

Character references are decoded, white space inside of a block becomes one space, blocks are trimmed and joined by ``\\n``.  A null
or empty page, or one without words, has an empty text.  Very long pages are read whole.  Repeated rows are read alike, an empty
table gives no rows, and other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import functools
import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from sparrowmill.llm.html_layouts import LAYOUTS, labelled_pages

#: Elements by their use in HTML.
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
HIDDEN = (*RAW, "noscript", "template", "svg", "canvas", "object", "video", "audio", "head", "button", "select", "datalist")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head",
)
#: Open elements that an opening tag ends, and the elements within which they are looked for.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WITHIN = frozenset(("ul", "ol", "menu", "dl", "table", "select", "body", "article", "main", "section", "form"))

_RAW, _HIDDEN, _VOID, _BLOCK = frozenset(RAW), frozenset(HIDDEN), frozenset(VOID), frozenset(BLOCK)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?<![\w-])(?:class|id|(role))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_WS = re.compile(r"\s+")
#: Elements whose name says what part of a page they are; names of others are no cue.
PARTS = ("article", "aside", "dialog", "footer", "form", "header", "main", "menu", "nav")
#: Elements that can't be left out, as they hold the page.
_WHOLE = ("html", "body")


class _Element:
    __slots__ = ("name", "cues", "up", "link", "words", "linked", "out")

    def __init__(self, name: str, cues: tuple, up: _Element | None) -> None:
        self.name, self.cues, self.up = name, cues, up
        self.link = name == "a" or (up is not None and up.link)
        self.words = self.linked = 0
        self.out: bool | None = None


def _cues(name: str, attrs: str, authored: bool) -> tuple:
    """What may tell that an element is content or not; parts of names don't count, only whole ones."""
    own = ("<" + name + " in an article" * (authored and name in ("header", "footer")),) if name in PARTS else ()
    if not attrs:
        return own
    found = [*own]
    for m in _ATTR.finditer(attrs):
        names = (m[2] or m[3] or m[4] or "").lower().split()
        found += [("role " if m[1] else "") + x for x in names]
    if _UNSEEN.search(attrs):
        found.append("hidden")
    return tuple(dict.fromkeys(found))


class Page:
    """A page as blocks: parts[k] are (text, element) of block k, tags[k] the names of the tags before it and the elements they stand in."""

    def __init__(self, page: str) -> None:
        self.root = _Element("", (), None)
        self.parts: list[list[tuple[str, _Element]]] = [[]]
        self.tags: list[list[tuple[str, _Element]]] = [[]]
        self.elements: list[_Element] = []
        self.stack = [self.root]
        self.open: Counter = Counter()
        self._read(page)
        for e in reversed(self.elements):  # children come after their parents
            if e.up is not None:
                e.up.words += e.words
                e.up.linked += e.linked

    def _pop(self) -> None:
        self.open[self.stack.pop().name] -= 1

    def _text(self, text: str) -> None:
        e = self.stack[-1]
        if not text.isspace():
            n = len(text.split())
            e.words += n
            e.linked += n * e.link
        self.parts[-1].append((text, e))

    def _tag(self, name: str, e: _Element | None = None, closing: str = "") -> None:
        """``e``: the element that the tag opens or closes, if it is kept track of."""
        if name in _BLOCK and self.parts[-1]:
            self.parts.append([])
            self.tags.append([])
        elif name == "br":
            self.parts[-1].append((" ", self.stack[-1]))
        if self.parts[-1] and name not in _BLOCK:
            return  # tags within a block's words don't part them
        self.tags[-1].append((closing + name, e or self.stack[-1]))

    def _implied(self, name: str) -> None:
        """End the elements that an opening tag ends."""
        if name in _BLOCK and self.open["p"]:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].name in _BLOCK:
                    if self.stack[k].name == "p":
                        while len(self.stack) > k:
                            self._pop()
                    break
        ends = ENDS.get(name, ())
        if any(self.open[x] for x in ends):
            last = 0
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].name in ends:
                    last = k
                    if name != "tr" or self.stack[k].name == "tr":
                        break
                elif self.stack[k].name in WITHIN:
                    break
            while last and len(self.stack) > last:
                self._pop()

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                self._text(page[at:])
                return
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            name, attrs = name.lower(), (m[3] or m[6] or "")
            if m[1] or m[4]:
                e = None
                if self.open[name] and not (self.stack[-1].name != name and self._inner(name)):
                    while self.stack[-1].name != name:
                        self._pop()
                    e = self.stack[-1]
                    self._pop()
                self._tag(name, e, "/")
            elif name in _HIDDEN and not (attrs.endswith("/") and name not in RAW):
                if name in _BLOCK:
                    self._tag(name)
                at = self._past(page, at, name)
            elif name in _VOID:
                self._tag(name)
            else:
                if name == "a" and self.stack[-1].name == "a":
                    self._pop()
                self._implied(name)
                authored = self.open["article"] + self.open["main"] > 0
                e = _Element(name, _cues(name, attrs, authored), self.stack[-1])
                self._tag(name, e)
                self.elements.append(e)
                if not attrs.endswith("/") or name in _BLOCK or name == "a":
                    self.stack.append(e)
                    self.open[name] += 1

    def _inner(self, name: str) -> bool:
        """Whether a closing tag of an inline element would have to reach over a block: then it is ignored."""
        if name in _BLOCK:
            return False
        for e in reversed(self.stack):
            if e.name == name:
                return False
            if e.name in _BLOCK:
                return True
        return True

    def _past(self, page: str, at: int, name: str) -> int:
        """Where an element that isn't shown ends, whose opening tag ends at ``at``."""
        if name in _RAW:
            m = _RAW_END[name].search(page, at)
            return m.end() if m else len(page)
        depth = 1
        while m := _TOKEN.search(page, at):
            tag, closing = (m[2] or m[5] or "").lower(), bool(m[1] or m[4])
            if tag in _RAW and not closing:
                at = self._past(page, m.end(), tag)
                continue
            if tag == name:
                depth += -1 if closing else 1
                if depth == 0:
                    return m.end()
            elif name == "head" and tag == "body" or closing and tag in _BLOCK and self.open[tag] and name in ("button", "select", "datalist"):
                return m.start()
            at = m.end()
        return len(page)

    def authors(self) -> tuple[set, set]:
        """The page's article elements and its main elements that aren't left out and have words."""
        seen = [e for e in self.elements if e.name in ("article", "main") and e.words and not e.out]
        return {id(e) for e in seen if e.name == "article"}, {id(e) for e in seen if e.name == "main"}


#: Where a word can be: in an article, in main of a page without or with articles, outside of both, or on a page without either.
PLACES = ("article", "main", "beside", "outside", "plain")


def _shape(e: _Element) -> tuple[str, ...]:
    """Cues of an element's words: the share of those in links, their number, and the number for an element of this name."""
    share = 4 * e.linked // max(1, e.words)
    length = f"words {min(e.words, 1000).bit_length() // 2}"
    return f"links {min(share, 3)}", length, *(f"{c} {length}" for c in e.cues[:1] if c[0] == "<")


def _leave_out(page: Page, odds: dict[str, float]) -> None:
    """Set ``out`` of every element: whether it, or one around it, is left out."""
    page.root.out = False
    for e in page.elements:
        e.out = e.up.out
        if not e.out and e.name not in _WHOLE:
            score = sum(odds.get(c, 0.0) for c in e.cues)
            e.out = score < 0 and score + sum(odds.get(c, 0.0) for c in _shape(e)) < 0


def _places(page: Page) -> dict[int, str]:
    """The place of the words that stand directly in each element."""
    articles, mains = page.authors()
    none = "outside" if articles or mains else "plain"
    found = {id(page.root): none}
    for e in page.elements:
        up = found[id(e.up)]
        found[id(e)] = "article" if id(e) in articles or up == "article" else ("beside" if articles else "main") if id(e) in mains else up
    return found


class Weights:
    """Weights of words by place and link, of tags and elements that are left out (``skip``) by place, and log odds of cues."""

    def __init__(self, word: dict, tag: dict, skip: dict, cues: dict, scale: float = 1.0) -> None:
        self.word, self.tag, self.skip, self.cues, self.scale = word, tag, skip, cues, scale
        self.other = tag["", "plain"]

    def scores(self, page: Page) -> list[tuple[float, float]]:
        """For each block the score of the tags before it and that of its words."""
        _leave_out(page, self.cues)
        places = _places(page)
        out, skipped = [], None
        for tags, parts in zip(page.tags, page.parts):
            before = 0.0
            for name, e in tags:
                if not e.out:
                    before += self.tag.get((name, places[id(e)]), self.other)
            words = 0.0
            for text, e in parts:
                if e.out:
                    top = e
                    while top.up.out:
                        top = top.up
                    if top is not skipped:  # an element that is left out counts once
                        skipped = top
                        before += self.skip[places[id(top.up)]]
                elif n := len(text.split()):
                    words += n * self.word[places[id(e)], e.link]
            out.append((before * self.scale, words))
        return out


def best_region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last block (exclusive) of the first region of the largest sum, by one scan; (0, 0) if no words score positive."""
    best = run = 0.0
    first = last = start = 0
    for k, (before, words) in enumerate(scores):
        run += before
        if run <= 0:
            run, start = 0.0, k
        run += words
        if run > best:
            best, first, last = run, start, k + 1
    return first, last


#: Words that a place's counts start with, in the proportion of all places.
PRIOR = 20
_MARK = re.compile(r"\[\[|\]\]|[^\s\[\]]+")


def _split(page: Page) -> list[tuple[int, _Element, int, int]]:
    """(block, element, content words, other words) of each part of a labelled page; takes the marks out of the parts."""
    found, inside = [], False
    for k, parts in enumerate(page.parts):
        for j, (text, e) in enumerate(parts):
            n = [0, 0]
            for w in _MARK.findall(text):
                if w in ("[[", "]]"):
                    inside = w == "[["
                else:
                    n[0 if inside else 1] += 1
            parts[j] = (text.replace("[[", "").replace("]]", ""), e)
            found.append((k, e, n[0], n[1]))
    return found


def fit(marked: list[str]) -> Weights:
    """Weights from labelled pages: log odds, with the scale of tags that puts most words in the right place."""
    pages = [Page(m) for m in marked]
    parts = [_split(p) for p in pages]
    seen: dict[str, list[float]] = {}
    for page, found in zip(pages, parts):
        inside: Counter = Counter()
        for _, e, yes, no in found:
            while e is not None and yes + no:
                inside[id(e)] += yes
                e = e.up
        once = {(c, 10 * inside[id(e)] > e.words) for e in page.elements if e.words and e.name not in _WHOLE for c in (*e.cues, *_shape(e))}
        for c, yes in once:  # a page counts once, however many elements of a kind it has
            seen.setdefault(c, [0.5, 0.5])[0 if yes else 1] += 1
    cues = {c: math.log(a / b) for c, (a, b) in seen.items() if a + b >= 5}
    for k in ("links ", "words "):  # against their own mean, as every element has them
        own = [c for c in seen if c.startswith(k)]
        base = math.log(sum(seen[c][0] for c in own) / sum(seen[c][1] for c in own))
        cues.update({c: cues[c] - base for c in own if c in cues})
    word = {(p, link): [0.0, 0.0] for p in PLACES for link in (False, True)}
    tag: dict[tuple[str, str], list[float]] = {}
    skip = {p: [0.5, 0.5] for p in PLACES}
    for page, found in zip(pages, parts):
        _leave_out(page, cues)
        places = _places(page)
        of_block: Counter = Counter()
        for k, e, yes, no in found:
            if not e.out:
                word[places[id(e)], e.link][0] += yes
                word[places[id(e)], e.link][1] += no
                of_block[k] += yes
        last = max((k for k, v in of_block.items() if v), default=-1)
        begun = False
        for k, (tags, own) in enumerate(zip(page.tags, page.parts)):
            between = begun and k <= last
            for name, e in tags:
                if not e.out:
                    tag.setdefault((name, places[id(e)]), [0.5, 0.5])[0 if between else 1] += 1
            for at in {places[id(e.up)] for _, e in own if e.out and not e.up.out}:
                skip[at][0 if between else 1] += 1
            begun = begun or of_block[k] > 0
    odds = {k: math.log(a / b) for k, (a, b) in tag.items() if a + b > 5}
    top = max(odds.values())
    # words score positive (but not those outside of the author's elements), tags negative; places that are seldom seen are like all
    all_words = {link: [sum(word[p, link][j] for p in PLACES) for j in (0, 1)] for link in (False, True)}
    prior = {link: [PRIOR * n / max(1.0, sum(ns)) + 0.5 for n in ns] for link, ns in all_words.items()}
    words = {k: math.log((a + prior[k[1]][0]) / (b + prior[k[1]][1])) for k, (a, b) in word.items()}
    words = {k: v if k[0] in ("outside", "beside") else max(0.02 if k[1] else 0.1, v) for k, v in words.items()}
    tags = {k: min(-0.05, v - top - 0.1) for k, v in odds.items()}
    tags["", "plain"] = min(tags.values()) / 2
    skips = {p: min(-0.05, math.log(a / b) - top) for p, (a, b) in skip.items()}
    best = None
    for scale in (0.125, 0.25, 0.5, 1.0, 2.0, 4.0):
        w, wrong = Weights(words, tags, skips, cues, scale), 0
        for page, found in zip(pages, parts):
            first, last = best_region(w.scores(page))
            wrong += sum(yes if e.out or not first <= k < last else no for k, e, yes, no in found)
        if best is None or wrong < best[0]:
            best = wrong, w
    return best[1]


@functools.cache
def weights(pages: int = 300, seed: int = 7, layouts: tuple = LAYOUTS) -> Weights:
    """Fitted once a process, in the driver; tasks get the weights with their code."""
    return fit(labelled_pages(pages, seed, layouts))


def extract(page: str | None, w: Weights | None = None) -> str:
    """Main text of a page."""
    if not page:
        return ""
    read = Page(page)
    first, last = best_region((w or weights()).scores(read))
    out = []
    for parts in read.parts[first:last]:
        if t := _WS.sub(" ", _html.unescape("".join(text for text, e in parts if not e.out))).strip():
            out.append(t)
    return "\n".join(out)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""
    id_type = pages.schema[id_col].dataType.simpleString()
    w = weights()

    def run(batches):
        for b in batches:
            texts = [extract(x.as_py(), w) for x in b.column(2)]
            chars = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), chars], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {id_type}, {url_col} string, text string, n_chars long")
