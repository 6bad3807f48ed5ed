"""Main text of web pages by two passes of block rules.

First pass: a page is cut into blocks, each with its zone (inside an article, inside boilerplate by element, role or
class, or neither), stop-word density, length and link density, which decide most blocks. Second pass: short blocks and
those near the limits take the label of their nearest decided neighbours.

A page is read in time linear in its length, however broken: a tag ends at the first ">" outside quotes, or at the first
one of all if quotes do not close; quotes from which no end was found are not followed again.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.common import arrow_map

# The most frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that for it as was with be by on not he his this are at from but have an they which or had we you a "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "de la le et les des en un du une que est pour qui dans par pas sur au ne se ce il sont plus avec son "
    "el los las una del que por con para su al lo como más o pero sus le ha me si sin sobre este ya cuando".split()
)
RAW = frozenset("script style noscript template textarea title svg select option button annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i iframe img ins kbd label mark math menclose merror mfrac mi mn mo mover "
    "mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object picture q rp rt ruby s samp semantics "
    "small source span strike strong sub sup time track tt u var video wbr".split()
)
BOILER_TAGS = frozenset("nav footer aside form head menu dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|menu|nav|navbar|navigation|breadcrumbs?|sidebar|widgets?|"
    r"footer|comments?|commentlist|respond|disqus|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|popup|modal|login|search|pagination|pager|toolbar|masthead|skip)(?:$|[\s_-])"
)
HEADERS = re.compile(r"(?:^|[\s_-])(?:header|topbar|top-bar)(?:$|[\s_-])")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")

SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.30
LINKS_MOST, LINKS_ARTICLE = 0.2, 0.5


@dataclass
class Block:
    text: str
    zone: str
    heading: bool
    linked: int
    label: str = field(default="")

    @property
    def links(self) -> float:
        return self.linked / len(self.text)

    @property
    def stops(self) -> float:
        words = self.text.lower().split()
        return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def _zone(tag: str, attributes: str, zone: str) -> str:
    """The zone within an element of a zone."""
    if zone == "boiler" or tag in BOILER_TAGS or (tag == "header" and zone != "article"):
        return "boiler"
    if attributes:
        at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        name = f"{at.get('class', '')} {at.get('id', '')}".lower()
        if (
            at.get("role", "").lower() in BOILER_ROLES
            or BOILER_NAMES.search(name)
            or (zone != "article" and HEADERS.search(name))
            or "display:none" in at.get("style", "").replace(" ", "").lower()
            or at.get("aria-hidden", "").lower() == "true"
        ):
            return "boiler"
        if at.get("role", "").lower() in ("main", "article") or at.get("itemprop", "").lower() == "articlebody":
            return "article"
    return "article" if tag in ("article", "main") else zone


class _Ends:
    """Where the tags of a page end."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()  # quotes that open where no end follows

    def of(self, at: int) -> int:
        """The place after the ">" that ends a tag whose name ends at a place; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        tried, here = [], at
        while here <= self.last[">"]:
            m = MARK.search(self.page, here)
            if m[0] == ">":
                return m.end()
            opens = m.start()
            if opens in self.dead:
                break
            tried.append(opens)
            if self.last[m[0]] == opens:
                break
            here = self.page.find(m[0], opens + 1) + 1
        self.dead.update(tried)
        return self.page.find(">", at) + 1


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order. Unclosed comments and scripts run to the end of the page."""
    found: list[Block] = []
    piece: list[str] = []
    stack: list[tuple[str, str]] = []
    open_tags: Counter[str] = Counter()
    zone, anchors, linked, heading = "none", 0, 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(piece).split())
        if text:
            found.append(Block(text, zone, heading, min(linked, len(text))))
        piece.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw)
        piece.append(text)
        if anchors:
            linked += len(" ".join(text.split()))

    at, n, lower, ends = 0, len(page), None, _Ends(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = NAME.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = ends.of(m.end())
        if at < 0:  # no tag ends from here on
            add(page[lt:])
            break
        closes, tag, attributes = bool(m[1]), m[2].lower(), page[m.end() : at - 1]
        if tag in RAW:
            if not closes and not attributes.endswith("/"):
                lower = lower if lower is not None else page.lower()
                end = lower.find(f"</{tag}", at) if len(lower) == n else page.find(f"</{m[2]}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = n if close < 0 else close + 1
            piece.append("" if tag.startswith("annotation") else " ")
            continue
        if tag == "a":
            anchors = max(0, anchors - 1) if closes else 1
        if tag in INLINE:
            if tag == "br":
                piece.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if not closes:
            if tag == "body" or (tag == "p" and stack and stack[-1][0] == "p"):
                while stack and (stack[-1][0] in ("p", "head") if tag == "body" else stack[-1][0] == "p"):
                    open_tags[stack[-1][0]] -= 1
                    zone = stack.pop()[1]
            if not attributes.endswith("/"):
                stack.append((tag, zone))
                open_tags[tag] += 1
                zone = _zone(tag, attributes, zone)
                heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            anchors = 0
        else:
            heading = False
            if open_tags[tag]:
                while True:
                    was, zone = stack.pop()
                    open_tags[was] -= 1
                    if was == tag:
                        break
            anchors = 0
    flush()
    return found


def _first_pass(b: Block, article: bool) -> str:
    if b.zone == "boiler" or (article and b.zone != "article"):
        return "bad"
    if article:
        if b.links > LINKS_ARTICLE:
            return "bad"
        return "good" if len(b.text) >= SHORT and b.stops >= STOPS_LOW else "short"
    if b.links > LINKS_MOST or "\xa9" in b.text:
        return "bad"
    if len(b.text) < SHORT:
        return "short"
    if b.stops >= STOPS_HIGH:
        return "good" if len(b.text) >= LONG else "near"
    return "near" if b.stops >= STOPS_LOW else "bad"


def classify(found: list[Block]) -> list[Block]:
    """Labels good or bad. In an article a short block is good unless its nearest decided neighbours there are not."""
    article = any(b.zone == "article" and b.links <= LINKS_ARTICLE for b in found)
    for b in found:
        b.label = _first_pass(b, article)
    n = len(found)
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            side[i] = last
            if found[i].label in ("good", "bad") and (not article or found[i].zone == "article"):
                last = (i, found[i].label)
    for i, b in enumerate(found):
        if b.label in ("good", "bad"):
            continue
        near = [x for x in ((after[i],) if b.heading and not article else (before[i], after[i])) if x]
        labels = {x[1] for x in near}
        if not labels:
            b.label += "!good" if article or b.label == "near" else "!bad"
        elif len(labels) == 1:
            b.label += "!" + labels.pop()
        elif b.label == "near" or article:
            b.label += "!good"
        else:
            b.label += "!" + min(near, key=lambda x: (abs(x[0] - i), x[1] != "bad"))[1]
    for b in found:
        b.label = b.label.rpartition("!")[2]
    return found


def main_text(page: str | None) -> str:
    """The good blocks in page order, one to a line."""
    return "\n".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html, ...).

    A null or empty page, or one without main text, has an empty text and n_chars 0. Nulls in page_id and url stay;
    repeated rows each get a row; other columns are not read; an empty table gives an empty one. Very long and broken
    pages take time in proportion to their length.
    """
    kinds = dict(pages.dtypes)

    def rows(ids, urls, bodies):
        texts = [main_text(b) for b in bodies]
        return [ids, urls, texts, [len(t) for t in texts]]

    return arrow_map(pages.select("page_id", "url", "html"), rows, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
