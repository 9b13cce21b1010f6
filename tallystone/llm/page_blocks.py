"""Leaf blocks of HTML pages with their ancestor and text features.

One pass of a regular expression over the tags keeps a stack of open elements.
Text between two block boundaries is a block; inline tags and line breaks do not
end it. Every open element carries the features of its ancestors, so a block
only adds its own, and the stack is never cut, however deep a page is nested.
Formulas and what an embedded object holds in its place are inline text. Broken markup is read as browsers do in the common cases:
a new block element ends an open paragraph, a list item ends the one before,
an end tag ends everything opened since its start tag and is ignored without one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

#: A comment, declaration or instruction, or the name of a tag; what the tag holds is read by ``tag_end``.
OPENING = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
COMMENT_END = re.compile(r"--!?>")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Fixed values of HTML: elements whose content is not text of the page, elements without content, inline elements.
RAW = frozenset("script style noscript template iframe svg title textarea select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml"
INLINE = frozenset(f"{MATH} audio canvas object video a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var ruby rt rp label br wbr img".split())
ENDS_PARAGRAPH_NOT = INLINE | {"input", "button", "source", "param", "meta", "link"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("object ul ol dl table body html article section div main".split())
ANCESTORS = frozenset("nav header footer aside form article main section ul ol table figure blockquote dialog fieldset button pre details menu address".split())
#: Words of class, id and role values by what they tell.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar tabs toc",
    "top": "masthead topbar header banner logo branding",
    "foot": "footer copyright colophon legal imprint bottom",
    "side": "sidebar side aside widget rail complementary secondary",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner newsletter subscribe subscription signup paywall dialog toast message",
    "talk": "comment comments commentlist reply replies respond disqus discussion thread reader feedback",
    "share": "share sharing social related recommended recommendations more tags tag tagged meta byline pagination pager follow popular trending",
    "form": "form search login signin register input contact",
    "main": "content article post entry story main body text prose page single hentry blog",
    "hide": "hidden hide invisible offscreen sr",
}
HINT_OF: dict[str, list[str]] = {}
for _kind, _words in HINTS.items():
    for _word in _words.split():
        HINT_OF.setdefault(_word, []).append("hint:" + _kind)
OWN_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 td th blockquote pre div section article body span a dt dd figcaption button summary legend caption address main header footer nav aside form".split())
SAID = {
    "cookie": re.compile(r"\b(cookies?|consent|gdpr)\b", re.I),
    "rights": re.compile(r"©|\bcopyright\b|all rights reserved|\bprivacy\b|\bterms\b", re.I),
    "join": re.compile(r"\b(subscribe|newsletter|sign ?up|log ?in|sign ?in|register)\b", re.I),
    "sell": re.compile(r"\b(advertisement|sponsored|promoted|buy now|shop now|offer)\b", re.I),
    "talk": re.compile(r"\b(comments?|reply|replied|wrote|says)\b:?", re.I),
    "share": re.compile(r"\b(share|tweet|follow us|related|read more|tags)\b", re.I),
}
SAID_ANY = re.compile("|".join(f"(?P<{k}>{v.pattern})" for k, v in SAID.items()), re.I)


class Scanner:
    """The tags of a page, one after the other, in time that grows with the page.

    A quoted value may hold ``>``. A quote that is never closed does not open a
    value, and where quotes leave a tag without an end it ends at its first ``>``,
    as all later tags do. Where each kind of mark comes next is remembered, and that
    there is none, so no part of a page is searched twice for the same mark.
    """

    def __init__(self, page: str):
        self.page, self.ahead, self.quotes = page, {}, True

    def next(self, mark: str, at: int) -> int:
        """The place of the next such mark; -1 if there is none."""
        found = self.ahead.get(mark, -2)
        if found == -1 or found >= at:
            return found
        found = self.ahead[mark] = self.page.find(mark, at)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if it never ends."""
        begin = at
        while self.quotes:
            m = MARK.search(self.page, at)
            if m is None:
                self.quotes = False
                break
            if m[0] == ">":
                return m.start()
            close = self.next(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        return self.next(">", begin)


class Open:
    """An open element: its tag and the features that its blocks inherit."""

    __slots__ = ("features", "link", "tag")

    def __init__(self, tag: str, features: frozenset[str], link: bool):
        self.tag, self.features, self.link = tag, features, link


KNOWN: dict[tuple, Open] = {}


def opened(parent: Open, tag: str, attributes: str) -> Open:
    key = (parent.features, parent.link, tag, attributes if tag != "a" else "")
    found = KNOWN.get(key)
    if found is None:
        features = set(parent.features)
        if tag in ANCESTORS:
            features.add("in:" + tag)
            if tag in ("header", "footer", "aside", "section") and "in:article" in features:
                features.add(f"in:article/{tag}")
        if attributes and tag != "a":
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    features.add("hint:hide")
                elif name in ("class", "id", "role"):
                    for word in TOKEN.findall(value):
                        features.update(HINT_OF.get(word.lower(), ()))
        found = Open(tag, frozenset(features), parent.link or tag == "a")
        if len(KNOWN) > 20_000:
            KNOWN.clear()
        if len(attributes) < 200:
            KNOWN[key] = found
    return found


ROOT = Open("body", frozenset(), False)


class Block:
    __slots__ = ("features", "links", "tag", "text")

    def __init__(self, text: str, tag: str, features: frozenset[str], links: int):
        self.text, self.tag, self.features, self.links = text, tag, features, links


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order."""
    out: list[Block] = []
    if not page:
        return out
    stack, parts, links = [ROOT], [], 0
    # for every place of the stack its innermost element that is not inline; the places of each tag
    around, places = [ROOT], {}
    holder: Open | None = None
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, links, holder
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = holder or stack[-1]
                out.append(Block(text, own.tag, own.features, links))
            parts, links, holder = [], 0, None

    def enter(own: Open) -> None:
        places.setdefault(own.tag, []).append(len(stack))
        around.append(around[-1] if own.tag in INLINE else own)
        stack.append(own)

    def last(tags: tuple[str, ...] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: tuple[str, ...], scopes: frozenset[str]) -> None:
        at = last(tags)
        if at and at >= last(scopes):
            while len(stack) > at:
                places[stack.pop().tag].pop()
                around.pop()

    def add(text: str) -> None:
        nonlocal links, holder
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if holder is None and not text.isspace():
            holder = around[-1]
        if stack[-1].link:
            links += len(text)

    scanner, search = Scanner(page), OPENING.search
    while at < end:
        m = search(page, at)
        name = m and m[2]
        stop = scanner.tag_end(m.end()) if name else 0
        if m is None or stop < 0:
            # no tag any more, or one that the page's end cuts off
            add(page[at : m.start()] if m else page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        if name is None:
            if m[0] == "<!--":
                closing = COMMENT_END.search(page, m.end())
                at = closing.end() if closing else end
            else:
                closing = scanner.next(">", m.end())
                at = closing + 1 if closing >= 0 else end
            continue
        at = stop + 1
        tag, ending, attributes = name.lower(), m[1], page[m.end() : stop]
        if ending:
            if tag not in INLINE:
                flush()
            close((tag,), frozenset())
        elif tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
        elif tag in RAW:
            if tag not in INLINE and not attributes.rstrip().endswith("/"):
                closing = re.compile(f"</{tag}\\b", re.I).search(page, at)
                stop = scanner.next(">", closing.end()) if closing else -1
                at = stop + 1 if stop >= 0 else end
        else:
            if tag not in INLINE:
                flush()
            if tag not in ENDS_PARAGRAPH_NOT:
                close(("p",), SCOPES)
            if tag in SIBLINGS:
                close(SIBLINGS[tag], SCOPES)
            if not attributes.rstrip().endswith("/"):
                enter(opened(stack[-1], tag, attributes))
    flush()
    return out


def own_features(b: Block, place: int, total: int) -> list[str]:
    """Features of a block beside those of its ancestors."""
    text = b.text
    n = text.count(" ") + 1
    out = ["tag:" + (b.tag if b.tag in OWN_TAGS else "other"), "words:" + ("1" if n == 1 else "2-3" if n < 4 else "4-7" if n < 8 else "8-15" if n < 16 else "16-40" if n < 41 else "41+")]
    share = b.links / len(text)
    out.append("links:" + ("0" if not share else "few" if share < 0.3 else "some" if share < 0.7 else "most"))
    if text[-1] in ".!?…:”\"":
        out.append("ends")
    if ", " in text:
        out.append("comma")
    if place == 0:
        out.append("first")
    if place == total - 1:
        out.append("last")
    if n < 60:
        if m := SAID_ANY.search(text):
            out.append("said:" + m.lastgroup)
        if text[-1] in "›»|>":
            out.append("arrow")
    return out


def emission(weights: dict[str, float]) -> Callable[[list[Block]], list[float]]:
    """For each block of a page the sum of its features' weights."""
    inherited: dict[frozenset[str], float] = {}

    def score(found: list[Block]) -> list[float]:
        out = []
        for i, b in enumerate(found):
            base = inherited.get(b.features)
            if base is None:
                if len(inherited) > 20_000:
                    inherited.clear()
                base = inherited[b.features] = sum(weights.get(f, 0.0) for f in b.features)
            out.append(base + sum(weights.get(f, 0.0) for f in own_features(b, i, len(found))))
        return out

    return score
