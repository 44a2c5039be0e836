"""Main text of HTML pages by tag-path ratios.

A page is read as a run of text nodes, each under its path of open tags from the root. Text
length and punctuation are summed up per path, divided by the path's nodes, and fused into
one ratio: article paths have long texts with many marks per node, menus and links neither.
The ratios are smoothed along the page, so that a heading or a short line between paragraphs
goes with them, averaged per path again, and paths under a share of the best are dropped.

What the page declares has its say in two ways. Elements that are no article text by their tag
(menus, headers, footers, forms, scripts, ...) don't compete; buttons and labels within an article's sentence
are words of it. Elements whose class, id or role names such a thing weigh little (``NAMED_WEIGHT``), and don't
profit from their neighbours. Neither holds for an element around the article: one with all article elements of
the page (readers' comments aside), or, where it has none, with over half of its text. Names are told by
whole tokens, so ``has-sidebar`` and ``no-comments`` name nothing, and other attributes say nothing.
Where the page has an article element, all of that element's text stays, however short, but for links, which
have to reach the share like all that stands outside, and for elements of which a whole token says no more than
one of ``WITHIN`` and where it is (adverts, menus, readers' comments, cookie notices, share buttons, what is not displayed): a section called
related-work, search or legal is the article's own.

White space in a block becomes one space, a ``br`` is white space; blocks are joined by a newline in
page order. A null or empty html has an empty text. Pages are independent: repeated rows give
repeated results, an empty table gives an empty one. Unclosed and stray tags are repaired as far
as the path needs it; a tag that the page ends in is dropped, as browsers do. A page of any
length takes time in proportion to it. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the best path's smoothed ratio that a path needs.
SHARE = 0.2
#: Weights of a node's neighbours, at distances 0, 1, 2.
KERNEL = (0.4, 0.2, 0.1)
#: What a path outside the article element weighs, where the page has one.
OUTSIDE = 0.25
#: What is in an element named as something else than the article weighs.
NAMED_WEIGHT = 0.02
#: What a link's text weighs.
LINK_WEIGHT = 0.3
MARKS = re.compile(r"[.,;:!?。，、！？…\"'»«”“-]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed xmp".split())
OTHER = RAW | frozenset("svg math object audio video canvas head nav header footer aside form button select option dialog menu label fieldset".split())
#: Those that an article's sentence can hold outside of forms.
IN_SENTENCES = frozenset(("button", "label"))
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset(("article", "main"))
#: Elements that end an open p.
ENDS_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "caption"}
#: Elements that end open ones of the first set, unless one of the second set has been opened since.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
P_SCOPE = ("table", "td", "th", "caption", "button", "object", "template")
#: An end tag doesn't close what is outside these, but for the tags of the second set.
WALLS = ("article", "main", "body", "td", "table")
PASS_WALLS = frozenset("html body main article table section div".split())

#: Words that say what an element is for, as a whole token of class, id or role, or as its first or last part.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer contentinfo complementary notice cookie cookies consent gdpr alert popup modal overlay "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription "
    "signup login search form widget pagination pager toolbar copyright legal disclaimer hidden".split()
)
#: Those of them that say so as any part.
ANYWHERE = frozenset("advert advertisement sponsored breadcrumb breadcrumbs cookie cookies gdpr comment comments commentlist disqus newsletter".split())
#: Those that also hold within the article, alone or together with ``SLOTS`` and ``PLACES``.
WITHIN = frozenset(
    "ad ads advert adverts advertisement advertisements sponsored promo breadcrumb breadcrumbs sidebar navbar navigation nav menu footer cookie cookies gdpr "
    "comment comments commentlist disqus replies respond share sharing social newsletter subscribe signup login popup modal pagination hidden".split()
)
SLOTS = frozenset("area banner bar block box button buttons consent container form icons item links list notice section signup slot thread unit widget wrapper".split())
PLACES = frozenset("article blog bottom content entry global inner left main mobile page post primary right secondary site sub top".split())
#: What is around articles of readers or of other pages, not of this one.
NOT_AROUND = frozenset("comment comments commentlist disqus reply replies respond related recommended".split())
#: First parts that turn a name around, and those whose header is the article's own.
NEGATED = frozenset("no has with without not non hide".split())
OWN = frozenset("post entry article page content story".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
UNSEEN = re.compile(r"(?:^|;)\s*+display\s*+:\s*+none\b", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def named(token: str, within: bool = False) -> set[str]:
    """The words of a token of class, id or role that say that the element isn't the article; ``within``: it is in one."""
    parts = [x.rstrip("0123456789") for x in re.split(r"[-_]+", token.lower()) if x]
    if not parts or parts[0] in NEGATED or (parts[0] in OWN and parts[-1] == "header"):
        return set()
    if within:
        return WITHIN & set(parts) if all(x in WITHIN or x in SLOTS or x in PLACES or len(x) == 1 for x in parts) else set()
    return (ANYWHERE & set(parts)) | (NAMES & {parts[0], parts[-1]})


def _names(attributes: str, within: bool) -> set[str]:
    """What the class, id, role and visibility of an element say; other attributes and their values say nothing."""
    found: set[str] = set()
    if not attributes or attributes.isspace():
        return found
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "role"):
            for token in value.split():
                found |= named(token, within)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
            found.add("hidden")
    return found


class Zone:
    """An element that the page declares as something else, and what is in it."""

    __slots__ = ("parent", "tag", "others", "mains", "chars", "shut")

    def __init__(self, parent: Zone | None, tag: str, others: bool):
        """tag: its name, where that alone declares it; others: whether articles in it are not the page's own."""
        self.parent, self.tag, self.others = parent, tag, others or (parent is not None and parent.others)
        self.mains = self.chars = 0
        self.shut = 1.0


class Page:
    """nodes: (block, path, within an article element, zone, text) of each text node, in page order; path: a number, see ``paths``."""

    def __init__(self, html: str):
        self.nodes: list[tuple[int, int, bool, Zone | None, str]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.linked: list[bool] = [False]
        self.zones: list[Zone] = []
        self.mains = 0
        self.block = 0
        #: Of each open element its name, path, whether it is within an article element, and zone.
        self.stack: list[tuple[str, int, bool, Zone | None]] = [("", 0, False, None)]
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self._read(html)

    def _last(self, names: tuple[str, ...]) -> int:
        """The place on the stack of the innermost open element of those names."""
        return max((self.open[n][-1] for n in names if self.open[n]), default=-1)

    def _close(self, down_to: int) -> None:
        for name, *_ in self.stack[down_to:]:
            self.open[name].pop()
        del self.stack[down_to:]

    def _text(self, text: str) -> None:
        _, path, main, zone = self.stack[-1]
        self.nodes.append((self.block, path, main, zone, text))

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.block += 1
        if name in ENDS_P and (at := self._last(("p",))) > self._last(P_SCOPE):
            self._close(at)
        if name in ENDS:
            same, within = ENDS[name]
            if (at := self._last(same)) > self._last(within):
                self._close(at)
        if name == "br":
            self._text(" ")
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            return
        _, path, main, zone = self.stack[-1]
        words = _names(attributes, main) if name not in ("html", "body") else set()
        by_tag = name in OTHER and not (name == "header" and self.open["article"]) and not (name in IN_SENTENCES and main and self.open["p"] and not self.open["form"])
        if by_tag or words:
            zone = Zone(zone, name if by_tag else "", bool(words & NOT_AROUND))
            self.zones.append(zone)
        if name in MAIN:
            main = True
            if zone is None or not zone.others:
                self.mains += 1
                if zone is not None:
                    zone.mains += 1
        step = self.paths.setdefault((path, name), len(self.linked))
        if step == len(self.linked):
            self.linked.append(name == "a" or self.linked[path])
        self.open[name].append(len(self.stack))
        self.stack.append((name, step, main, zone))

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self.block += 1
        at = self._last((name,))
        if at > 0 and (name in PASS_WALLS or at >= self._last(WALLS)):
            self._close(at)

    def _read(self, html: str) -> None:
        at = scan = 0
        while (lt := html.find("<", scan)) >= 0:
            after = html[lt + 1 : lt + 2]
            if after in ("!", "?"):
                closing = "-->" if html.startswith("<!--", lt) else "]]>" if html.startswith("<![CDATA[", lt) else ">"
                end = html.find(closing, lt + 2)
                end = len(html) if end < 0 else end + len(closing)
                m = None
            elif after == "/" or after.isascii() and after.isalpha():
                m = TAG.match(html, lt)
                if not m and after == "/" and not html[lt + 2 : lt + 3].isalpha():
                    scan = lt + 1
                    continue
                end = m.end() if m else len(html)
            else:
                scan = lt + 1
                continue
            if lt > at:
                self._text(html[at:lt])
            at = scan = end
            if m:
                name = m[2].lower()
                if m[1]:
                    self._end(name)
                    continue
                self._start(name, m[3])
                if name in RAW and (stop := RAW_END[name].search(html, end)):
                    at = scan = stop.start()
                elif name in RAW:
                    return
        if at < len(html):
            self._text(html[at:])

    def weigh_zones(self) -> None:
        """What each zone weighs; one around the article weighs as much as the page."""
        total = 0
        for _, _, _, zone, text in self.nodes:
            n = len(text) - text.count(" ")
            total += n
            if zone is not None:
                zone.chars += n
        for zone in reversed(self.zones):  # an inner one comes after those around it
            if zone.parent is not None:
                zone.parent.chars += zone.chars
                zone.parent.mains += zone.mains
        for zone in self.zones:
            most = self.mains == 0 and zone.tag in ("", "form") and 2 * zone.chars > total
            wraps = not zone.others and (most or zone.mains == self.mains > 0)
            before = zone.parent.shut if zone.parent is not None else 1.0
            zone.shut = min(before, 1.0 if wraps else 0.0 if zone.tag else NAMED_WEIGHT)


def path_ratios(nodes: list[tuple[int, bool, Zone | None, str]], linked: list[bool]) -> dict[int, float]:
    """The fused and smoothed ratio of each path; nodes: path, within an article element, zone, text."""
    sums: dict[int, list[float]] = {}
    for path, _, _, text in nodes:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += len(text)
        s[1] += len(MARKS.findall(text))
        s[2] += 1
    article = any(main and (zone is None or zone.shut == 1.0) for _, main, zone, _ in nodes)
    raw = {p: log1p(chars / n) * (1 + log1p(marks / n)) * (LINK_WEIGHT if linked[p] else 1) for p, (chars, marks, n) in sums.items()}
    weights = [(1.0 if zone is None else zone.shut) * (1 if main or not article else OUTSIDE) for _, main, zone, _ in nodes]
    line = [raw[p] * w for (p, *_), w in zip(nodes, weights, strict=True)]
    smooth: dict[int, list[float]] = {}
    for i, (path, *_) in enumerate(nodes):
        value, weight = 0.0, 0.0
        for j in range(max(0, i - len(KERNEL) + 1), min(len(nodes), i + len(KERNEL))):
            if weights[j] == weights[i]:  # what weighs less doesn't profit from what weighs more
                value += KERNEL[abs(i - j)] * line[j]
                weight += KERNEL[abs(i - j)]
        s = smooth.setdefault(path, [0.0, 0])
        s[0] += value / weight
        s[1] += 1
    return {p: v / n for p, (v, n) in smooth.items()}


def main_text(html: str | None, share: float = SHARE) -> str:
    page = Page(html or "")
    page.weigh_zones()
    nodes = [(block, path, main, zone, unescape(text)) for block, path, main, zone, text in page.nodes if zone is None or zone.shut]
    # What stands under one path inside and outside of a zone or an article is two paths.
    key = lambda path, main, zone: path * 4 + 2 * main + (zone is None or zone.shut == 1.0)
    seen = [(key(path, main, zone), main, zone, text) for _, path, main, zone, text in nodes if text and not text.isspace()]
    if not seen:
        return ""
    ratios = path_ratios(seen, [x for x in page.linked for _ in range(4)])
    least = share * max(ratios.values())
    out: list[list[str]] = []
    last = None
    for block, path, main, zone, text in nodes:
        if text and not text.isspace():
            own = main and (zone is None or zone.shut == 1.0) and not page.linked[path]
            if not own and ratios[key(path, main, zone)] < least:
                continue
        if block != last:
            out.append([])
            last = block
        out[-1].append(text)
    return "\n".join(filter(None, (" ".join("".join(parts).split()) for parts in out)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
