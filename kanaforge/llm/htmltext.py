"""HTML extraction by tree scoring: the main text of a web page.

A page is read once from front to back into a tree of its elements and the blocks of text in them. Each block has points for its length and its
commas, less the share of it that is link text, and passes them to its ancestors, the nearer the more. The container with most points,
discounted by its own link density, is kept with those of its siblings that look like it; an enclosing `article` or `main` of it is the
container. Before that, elements go that are no article by their tag, role, name or state (menus, headers, footers, sidebars, notices,
adverts, forms, comments); after it, lists and boxes that are mostly links.

The text of a block is decoded and its white space made single; blocks are joined by newlines in page order. Line breaks inside a block are white space.

Reading is linear in the page's length: no recursion, no pattern that scans twice, whatever the page holds (unclosed
tags, quotes and comments, a million nested boxes). Only one page of a batch is in memory as a tree.

Defined cases: null and empty pages, and pages without text, give an empty text; text without any tag is one block; a tag that is never closed
ends with its parent; where names of classes would leave nothing, they are not heeded; repeated pages give the same text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanaforge.llm.common import str_values

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol"
    " p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and those that belong into the head.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never an article's text.
NEVER = RAW | frozenset("aside audio button canvas datalist dialog footer head input map math menu meter nav object progress search select svg template video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Parts of class names and ids of what surrounds an article; the soft ones do not count beside a part that names an article.
HARD = frozenset(
    "ad ads adsense advert advertisement advertisements advertising adverts aside breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr menu menus modal nav navbar navigation"
    " newsletter pager pagination popup promo recommended related replies respond share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe teaser".split()
)
SOFT = frozenset("alert alerts banner disclaimer discussion header hidden login masthead message notice notices notification overlay promotion rail reply search toolbar topbar widget widgets".split())
ARTICLE = frozenset("article blog body content copy entry main page post prose story text".split())
#: Class names that begin or end so tell of a page's layout.
BEGINS, ENDS = frozenset("has is no with without".split()), frozenset("container layout page site wrap wrapper".split())
#: Where a closing tag or an implied end stops.
FENCES = ("td", "th", "caption", "table")
CLOSED_BY = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}
CLOSED_BY |= {"tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)), "thead": (("tbody", "thead"), ("table",)), "option": (("option",), ())}
TABLE = frozenset("caption table tbody td tfoot th thead tr".split())

#: A container's points before any text: by its tag, and by a class name that names an article.
START = defaultdict(float, {"article": 10, "main": 10, "div": 5, "section": 5, "blockquote": 3, "td": 3, "pre": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "form": -3, "th": -5})
NAMED = 25
#: Elements that pass their text's points to their parent, as paragraphs do; text elsewhere counts for the element itself.
PARAGRAPHS = frozenset("dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary".split())
#: Ancestors that get points, and what they get of them.
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)
#: A paragraph of this many characters has its full first point; points of length grow to this many hundreds.
SHORT, HUNDREDS = 25, 3
#: A sibling is kept from this share of the best container's score and from this score on.
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
#: Boxes and lists with a larger share of link text are menus.
MENU_SHARE = 0.5
BOXES = frozenset("dir div dl fieldset figure menu ol section table ul".split())

_TAG = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r"""=\s*+(["'])|>""")
_ATTR = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMA = re.compile("[,،，、]")
_SENTENCE = re.compile(r"[.!?。！？]['\"”’»)]*+(?:\s|$)")
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)


def _surrounds(name: str) -> bool:
    """Does one class name or id tell of something that is no article?"""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in BEGINS or words[-1] in ENDS:
        return False
    return any(w in HARD for w in words) or (any(w in SOFT for w in words) and not any(w in ARTICLE for w in words))


class Tree:
    """The elements of a page in page order, and its blocks of text: (element, text, characters of it in links)."""

    def __init__(self, html: str, by_name: bool):
        self.parent, self.tag, self.gone, self.named, self.links = [-1], ["html"], [False], [0.0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.by_name = by_name
        self._stack, self._open, self._barrier = [0], defaultdict(list), [0]
        self._open["html"].append(0)
        self._text: list[str] = []
        self._linked = self._in_link = 0
        self._read(html)
        self._flush()

    # -- text ------------------------------------------------------------------------------------------------

    def _add(self, text: str) -> None:
        if not text or self.gone[self._stack[-1]]:
            return
        if "&" in text:
            text = unescape(text)
        self._text.append(text)
        if self._in_link:
            self._linked += sum(map(len, text.split()))

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[self._barrier[-1]], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    # -- elements --------------------------------------------------------------------------------------------

    def _last(self, *tags: str) -> int:
        return max((self._open[t][-1] for t in tags if self._open[t]), default=-1)

    def _pop_to(self, at: int) -> None:
        """Close the elements from that place of the stack on."""
        while len(self._stack) > max(at, 1):
            place = len(self._stack) - 1
            tag = self.tag[self._stack[-1]]
            if place == self._barrier[-1]:
                self._flush()
                self._barrier.pop()
            self._stack.pop()
            self._open[tag].pop()
            self._in_link -= tag == "a"

    def _start(self, tag: str, attrs: str, closed: bool) -> None:
        if tag in ("html", "body") and self._open["body"]:
            return
        if self._open["head"] and tag not in HEAD and tag != "head":
            self._pop_to(self._open["head"][-1])
        block = tag in BLOCKS
        if block:
            if self._open["p"] and self._last("p") > self._last(*FENCES):
                self._pop_to(self._last("p"))
            if tag in HEADINGS and self.tag[self._stack[-1]] in HEADINGS:
                self._pop_to(len(self._stack) - 1)
        if tag in CLOSED_BY:
            ends, fences = CLOSED_BY[tag]
            at = min((self._open[t][-1] for t in ends if self._open[t] and self._open[t][-1] > self._last(*fences)), default=0)
            if at:
                self._pop_to(at)
        if tag == "a" and self._open["a"] and self._open["a"][-1] > self._barrier[-1]:
            self._pop_to(self._open["a"][-1])
        if block:
            self._flush()
        elif tag == "br":
            self._add(" ")
        self.links[self._stack[-1]] += tag == "a"
        if tag in VOID:
            return
        above = self._stack[-1]
        gone, named = self.gone[above], 0.0
        if not gone:
            gone, named = self._judge(tag, attrs, above)
        self.parent.append(above)
        self.tag.append(tag)
        self.gone.append(gone)
        self.named.append(named)
        self.links.append(0)
        self._open[tag].append(len(self._stack))
        if block:
            self._barrier.append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        self._in_link += tag == "a"
        if closed and not block and tag != "a":  # <svg/>
            self._pop_to(len(self._stack) - 1)

    def _judge(self, tag: str, attrs: str, above: int) -> tuple[bool, float]:
        """(Is it no article?, points of its name)"""
        if tag in NEVER:
            return True, 0.0
        found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs.strip(" /\t\n") else {}
        inside = bool(self._open["article"] or self._open["main"])
        if tag == "header":
            return not inside, 0.0
        if self.parent and self.tag[above] == "header" and tag not in HEADINGS and tag not in ("hgroup", "div"):
            return True, 0.0  # of an article's header the headings stay
        if not found:
            return False, 0.0
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
            return True, 0.0
        if tag in ("html", "body"):
            return False, 0.0
        if found.get("role", "").lower() in ROLES:
            return True, 0.0
        names = (found.get("class", "") + " " + found.get("id", "")).split()
        if self.by_name and tag != "main" and any(map(_surrounds, names)):
            return True, 0.0
        return False, NAMED if any(w.lower() in ARTICLE for n in names for w in _WORD.findall(n)) else 0.0

    def _end(self, tag: str) -> None:
        places = self._open[tag]
        if tag in BLOCKS:
            self._flush()
            if places and (tag in TABLE or places[-1] > self._last(*FENCES)):
                self._pop_to(places[-1])
        elif places and (places[-1] > self._barrier[-1] or tag in NEVER):
            self._pop_to(places[-1])

    # -- reading ---------------------------------------------------------------------------------------------

    def _read(self, html: str) -> None:
        at, size, dead = 0, len(html), set()
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self._add(html[at:])
                return
            self._add(html[at:lt])
            mark = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = end + 3 if end >= 0 else size
                continue
            if mark in ("!", "?") or (mark == "/" and not html[lt + 2 : lt + 3].isalpha()):
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else size
                continue
            closing = mark == "/"
            name = _TAG.match(html, lt + 1 + closing) if mark else None
            if name is None:
                self._add("<")
                at = lt + 1
                continue
            end = self._tag_end(html, name.end(), dead)
            if end < 0:  # a tag that never ends is not shown
                return
            tag = name.group().lower()
            at = end + 1
            if closing:
                self._end(tag)
                continue
            attrs = html[name.end() : end]
            if tag in RAW:
                if ("raw", tag) in dead:
                    continue
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                if close is None:
                    dead.add(("raw", tag))
                    if tag != "noscript":  # the rest of the page is its content
                        return
                    continue
                gt = html.find(">", close.end())
                at = gt + 1 if gt >= 0 else size
                continue
            self._start(tag, attrs, attrs.endswith("/"))

    @staticmethod
    def _tag_end(html: str, at: int, dead: set) -> int:
        """Place of the `>` that ends a tag; quoted values may hold one. dead: quotes that have no partner any more."""
        while True:
            found = _STOP.search(html, at)
            if found is None:
                return -1
            quote = found.group(1)
            if quote is None:
                return found.start()
            end = html.find(quote, found.end()) if quote not in dead else -1
            if end < 0:
                dead.add(quote)
                at = found.end()
            else:
                at = end + 1


def points(text: str, linked: int) -> float:
    """Of a block: length and commas, less its share of link text."""
    size = len(text)
    return (min(size / SHORT, 1.0) + len(_COMMA.findall(text)) + min(size / 100, HUNDREDS)) * (1 - linked / size)


def _kept(tree: Tree) -> list[str]:
    """The texts of the best container and its siblings, in page order."""
    n = len(tree.tag)
    size, linked, links = [0] * n, [0] * n, list(tree.links)
    for at, text, link in tree.blocks:
        size[at] += len(text)
        linked[at] += link
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        size[up], linked[up], links[up] = size[up] + size[i], linked[up] + linked[i], links[up] + links[i]
    # A form goes, unless it is the page.
    gone = list(tree.gone)
    for i in range(1, n):
        gone[i] = gone[i] or gone[tree.parent[i]] or (tree.tag[i] == "form" and 2 * size[i] <= size[0])
    blocks = [b for b in tree.blocks if not gone[b[0]]]
    if not blocks:
        return []

    score: dict[int, float] = {}
    for at, text, link in blocks:
        up = tree.parent[at] if tree.tag[at] in PARAGRAPHS and at else at
        worth = points(text, link)
        for share in SHARES:
            if up < 0:
                break
            score[up] = score.get(up, START[tree.tag[up]] + tree.named[up]) + worth * share
            up = tree.parent[up]
    dense = lambda i: linked[i] / size[i] if size[i] else 0.0
    final = {i: s * (1 - dense(i)) for i, s in score.items()}
    best = max(final, key=lambda i: (final[i], -i))
    up = best
    while up > 0 and tree.tag[up] not in ("article", "main"):
        up = tree.parent[up]
    top = up if up > 0 else best

    keep = [False] * n
    keep[top] = True
    least = max(SIBLING_LEAST, SIBLING_SHARE * final[best])
    around, loose = tree.parent[top], set()
    if around >= 0:
        paragraphs = {}
        for b, (at, text, link) in enumerate(blocks):
            if at == around or (tree.parent[at] == around and tree.tag[at] == "p"):
                paragraphs[b] = at
                share = link / len(text)
                if (len(text) > 80 and share < 0.25) or (len(text) <= 80 and not link and _SENTENCE.search(text)):
                    loose.add(b)
            elif tree.parent[at] == around and tree.tag[at] in HEADINGS and at < top and not link:
                loose.add(b)
        for i, s in final.items():
            if tree.parent[i] == around and s >= least and dense(i) < MENU_SHARE:
                keep[i] = True
    menu = [False] * n
    for i in range(1, n):
        up = tree.parent[i]
        keep[i] = keep[i] or keep[up]
        menu[i] = menu[up] or (i != top and keep[up] and tree.tag[i] in BOXES and links[i] > 1 and dense(i) > MENU_SHARE)
    return [text for b, (at, text, _) in enumerate(blocks) if (keep[at] or b in loose) and not menu[at]]


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    found = _kept(Tree(html, True)) or _kept(Tree(html, False))
    return "\n".join(found)


def main_text(html: Column | str) -> Column:
    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(h) for h in str_values(batch)], pa.string())

    return texts(F.col(html) if isinstance(html, str) else html)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars, its code points, in place of the page's source."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    found = pages.select(*["`" + c.replace("`", "``") + "`" for c in kept], main_text(html).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
