"""Labelled training pages: a generator of invented sites with known main text.

Pages are drawn from independent choices of layout, element names, class names,
order and clutter, so that no single cue tells the article. Every piece is
written with its label, and the labels of a page's blocks follow from markers
that the reader of blocks finds at the pieces' words.
"""

from __future__ import annotations

import html
import random

#: Syllables of the invented words.
SYLLABLES = "al an ar bel can dor el en er est fal gen har il in kor la len mar men nor ol on or pa per que ra ren sa sen ter tion un ver vi".split()
SHORT = ["Home", "About", "Contact", "News", "Sport", "Help", "Login", "Search", "Archive", "Shop", "Start", "Kontakt", "Inicio", "Accueil"]
NOTICES = ["We use cookies to improve your visit.", "This site uses cookies. Accept all cookies to go on.", "Subscribe to our newsletter for weekly news.", "Sign up and never miss a story.", "You have read 3 of 5 free pages this month."]
FEET = ["© 2024 {w}. All rights reserved.", "Copyright {w} and partners", "Privacy · Terms · Imprint", "{w} is a service of {v}."]
ADS = ["Advertisement", "Sponsored: {w} {v}, buy now", "Special offer on {w}.", "{w} {v} {w}. {v} {w} {v} {w}."]
TALK = ["{w} says: {s}", "{s}", "I do not agree. {s}", "Reply", "3 comments", "Thanks, {w}! {s}"]

CUES = ["Cookies were baked.", "Readers may subscribe.", "The offer was sponsored.", "He wrote comments.", "Privacy and terms matter.", "They share related tags."]


class Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.choice([1, 1, 2, 2, 3])))

    def words(self, n: int) -> str:
        out = [self.word() for _ in range(n)]
        for i in range(n - 1):
            if self.rng.random() < 0.07:
                out[i] += ","
        return " ".join(out)

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.rng.randint(1, 22)).capitalize() + self.rng.choice([".", ".", ".", "!", "?"]) for _ in range(n))

    def fill(self, pattern: str) -> str:
        return pattern.format(w=self.word().capitalize(), v=self.word(), s=self.sentences(self.rng.randint(1, 3)))

    def block(self, tag: str, text: str, label: int, attributes: str = "") -> str:
        self.labels.append(label)
        text = html.escape(text)
        if label and tag == "p" and self.rng.random() < 0.2:
            at = text.find(" ", len(text) // 3)
            text = f"<b>{text[:at]}</b>{text[at:]}" if at > 0 and "&" not in text else text
        if label and tag == "p" and self.rng.random() < 0.12:
            text += f' <a href="/x">{self.word()}</a>'
        end = "" if tag in ("p", "li") and self.rng.random() < 0.25 else f"</{tag}>"
        return f"<{tag}{attributes}>{text}{end}\n"

    def links(self, n: int, label: int = 0) -> str:
        out = []
        for _ in range(n):
            self.labels.append(label)
            name = self.rng.choice([*SHORT, self.word(), self.word().capitalize(), self.words(2)])
            out.append(f'<li><a href="/{self.word()}">{name}</a></li>')
        return "<ul>" + "".join(out) + "</ul>"

    def row(self, n: int, between: str, label: int = 0) -> str:
        """Links side by side, one block."""
        self.labels.append(label)
        return between.join(f'<a href="/{self.word()}">{self.rng.choice([*SHORT, self.word()])}</a>' for _ in range(n)) + "\n"

    def named(self, tag: str, hints: str, inner: str, bare: float = 0.35) -> str:
        """The element, or a div that only its class or id tells."""
        pick, how = self.rng.choice(hints.split()), self.rng.random()
        if how < bare and tag != "div":
            return f"<{tag}>{inner}</{tag}>"
        tag = tag if how < 0.6 else "div"
        return f'<{tag} {self.rng.choice(["class", "class", "id"])}="{self.rng.choice([pick, "site-" + pick, pick + " box", pick + "_1"])}">{inner}</{tag}>'


def clutter(w: Writer, kind: str) -> str:
    rng = w.rng
    if kind == "nav" and rng.random() < 0.25:
        return w.named("nav", "nav menu navbar breadcrumb navigation", w.row(rng.randint(2, 7), rng.choice([" ", " | ", "<br>", " · "])), 0.5)
    if kind == "nav":
        return w.named("nav", "nav menu navbar breadcrumb navigation", w.links(rng.randint(2, 8)), 0.5)
    if kind == "header":
        return w.named("header", "header masthead topbar", w.block(rng.choice(["h1", "div", "p", "span"]), w.words(rng.randint(1, 4)).title(), 0) + (w.links(3) if rng.random() < 0.4 else ""))
    if kind == "footer":
        n = rng.randint(1, 3)
        return w.named("footer", "footer copyright colophon legal", "".join(w.block(rng.choice(["p", "div"]), w.fill(rng.choice([*FEET, "{s}"])), 0) for _ in range(n)) + (w.links(4) if rng.random() < 0.3 else ""), 0.5)
    if kind == "aside" and rng.random() < 0.25:
        inner = "".join(f"<article>{w.block(rng.choice(['h3', 'h4']), w.words(rng.randint(1, 4)), 0)}{w.block('p', w.sentences(1), 0)}</article>" for _ in range(rng.randint(1, 3)))
        return w.named("aside", "sidebar widget rail related", inner, 0.6)
    if kind == "aside":
        return w.named("aside", "sidebar widget rail side", w.block("h3", w.words(2), 0) + w.links(rng.randint(2, 5)) + (w.block("p", w.sentences(rng.randint(1, 2)), 0) if rng.random() < 0.5 else ""))
    if kind == "ad":
        n = rng.randint(1, 2)
        return w.named("div", "ad ads advert sponsored promo", "".join(w.block(rng.choice(["p", "span", "div"]), w.fill(rng.choice([*ADS, "{s}"])), 0) for _ in range(1)) + ("" if n == 1 else w.block("p", w.sentences(1), 0)))
    if kind == "notice":
        return w.named("div", "cookie consent notice newsletter popup modal alert", w.block("p", rng.choice(NOTICES) if rng.random() < 0.6 else w.sentences(1), 0) + (w.block("button", rng.choice(["Accept", "OK", "Close", "Subscribe"]), 0) if rng.random() < 0.6 else ""))
    if kind == "form":
        return w.named("form", "search login form contact", w.block(rng.choice(["p", "div"]), w.words(rng.randint(1, 3)) + ":", 0) + '<input name="q">' + w.block("button", rng.choice(["Send", "Search", w.word()]), 0), 0.7)
    if kind == "share":
        return w.named("div", "share social related tags pagination recommended", w.links(rng.randint(2, 4)) + (w.block("p", w.words(4), 0) if rng.random() < 0.4 else ""))
    out = w.block("h3", rng.choice(["Comments", "3 comments", "Discussion", w.word()]), 0)
    if rng.random() < 0.25:
        out += "<ol>" + "".join(f"<li>{w.block('p', w.fill(rng.choice([*TALK, '{s}'])), 0)}</li>" for _ in range(rng.randint(1, 4))) + "</ol>"
        return w.named(rng.choice(["section", "div"]), "comments commentlist respond discussion replies", out, 0.0)
    for _ in range(rng.randint(1, 4)):
        out += w.named("div", "comment reply comment-body", w.block("p", w.fill(rng.choice([*TALK, "{s}"])), 0))
    return w.named("section", "comments commentlist respond discussion replies", out, 0.1)


def pieces(w: Writer) -> list[str]:
    """The article's own parts in order, clutter between them included."""
    rng = w.rng
    out = []
    for i in range(rng.randint(1, 9)):
        how = rng.random()
        if how < 0.68 or not i:
            cue = " " + rng.choice(CUES) if rng.random() < 0.08 else ""
            out.append(w.block(rng.choice(["p", "p", "p", "p", "div"]), w.sentences(rng.randint(1, 6)) + cue, 1))
        elif how < 0.76:
            out.append(w.block(rng.choice(["h2", "h2", "h3"]), w.words(rng.randint(1, 6)).capitalize(), 1))
        elif how < 0.83:
            tag = rng.choice(["ul", "ul", "ol"])
            out.append(f"<{tag}>" + "".join(w.block("li", w.words(rng.randint(1, 12)), 1) for _ in range(rng.randint(2, 4))) + f"</{tag}>")
        elif how < 0.855:
            out.append("<dl>" + "".join(w.block("dt", w.words(rng.randint(1, 3)), 1) + w.block("dd", w.sentences(1), 1) for _ in range(rng.randint(1, 3))) + "</dl>")
        elif how < 0.88:
            out.append(f"<blockquote>{w.block('p', w.sentences(1), 1)}</blockquote>")
        elif how < 0.905:
            head = "".join(w.block("th", w.words(1), 1) for _ in range(2)) if rng.random() < 0.5 else ""
            out.append(f"<table><tr>{head}<tr>" + "".join(w.block("td", w.words(rng.randint(1, 4)), 1) for _ in range(4)) + "</tr></table>")
        elif how < 0.92:
            out.append(w.block("pre", w.words(rng.randint(2, 12)), 1) if rng.random() < 0.5 else f"<figure><img src=x>{w.block('figcaption', w.words(rng.randint(2, 9)).capitalize(), 1)}</figure>")
        elif how < 0.95:
            out.append(clutter(w, "ad"))
        elif how < 0.97:
            out.append(clutter(w, rng.choice(["share", "aside", "notice"])))
        else:
            out.append(w.block("p", w.words(rng.randint(1, 3)).capitalize() + ".", 1))
    return out


def article(w: Writer) -> str:
    rng = w.rng
    out = ""
    if rng.random() < 0.85:
        title = w.block(rng.choice(["h1", "h1", "h1", "h2"]), w.words(rng.randint(1, 10)).capitalize(), 1)
        out += f"<header>{title}</header>" if rng.random() < 0.1 else title
    if rng.random() < 0.2:
        for _ in range(rng.randint(1, 3)):
            head = w.block("h2", w.words(rng.randint(1, 6)).capitalize(), 1) if rng.random() < 0.7 else ""
            out += f"<section>{head}{''.join(pieces(w))}</section>"
    else:
        out += "".join(pieces(w))
    if rng.random() < 0.15:
        out += clutter(w, "talk")
    return w.named(rng.choice(["article", "article", "main", "div"]), "content article post entry story post-content", out, 0.6)


def laid_out(w: Writer) -> str:
    """A page whose parts are the cells of a table, without names that tell them."""
    rng = w.rng
    top = f"<tr><td colspan=2>{w.block('h2', w.words(rng.randint(1, 3)).title(), 0)}</td></tr>" if rng.random() < 0.5 else ""
    side = f"<td width=150>{w.row(rng.randint(2, 8), '<br>')}</td>"
    title = w.block("h1", w.words(rng.randint(1, 8)).capitalize(), 1)
    main = f"<td>{title}{''.join(w.block('p', w.sentences(rng.randint(1, 5)), 1) for _ in range(rng.randint(1, 7)))}</td>"
    foot = f"<tr><td colspan=2><small>{w.block('span', w.fill(rng.choice(FEET)), 0).strip()}</small></td></tr>" if rng.random() < 0.7 else ""
    return f"<table>{top}<tr>{side}{main}</tr>{foot}</table>"


def page(seed: int) -> tuple[str, list[int]]:
    """A page and the labels of its blocks in page order (1: main text)."""
    w = Writer(seed)
    rng = w.rng
    if rng.random() < 0.05:
        return f"<html><head><title>{w.words(3)}</title></head><body>{laid_out(w)}</body></html>", w.labels
    before = rng.sample(["nav", "header", "ad", "notice", "aside", "form"], rng.randint(0, 4))
    after = rng.sample(["aside", "ad", "share", "talk", "form", "notice", "footer"], rng.randint(0, 4))
    if rng.random() < 0.6 and "footer" not in after:
        after.append("footer")
    body = "".join(clutter(w, k) for k in before)
    main = article(w) if rng.random() < 0.97 else ""
    if main and rng.random() < 0.2:
        main = f"<main>{main}</main>"
    body += main + "".join(clutter(w, k) for k in after)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(["page", "wrapper", "container", "site"])}">{body}</div>'
    head = f"<title>{w.words(3)}</title><style>p{{margin:0}}</style><script>var x = '</p>';</script>"
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>", w.labels
