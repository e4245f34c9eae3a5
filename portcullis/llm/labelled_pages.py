"""Labelled training pages for the main-text model, made by a seeded generator.

Each page is drawn from a grammar of common layouts. An element with ``data-main="1"`` or ``"0"`` says whether the text
below it, down to the next such element, belongs to the article. Words are random syllables, so nothing but structure,
names of classes and the shape of texts can be learned.
"""

from __future__ import annotations

import random
import re

_SYLLABLES = "ka lo mi ren tas vo der ing on est al um per qui so na ble tor he wi ra".split()
#: Class and id names that pages use for each part.
_NAMES = {
    "main": "content article post entry-content post-body story main-content article-body entry text page-content body-text",
    "wrap": "container wrapper page site layout row col-md-8 inner grid section",
    "nav": "nav menu navbar main-menu breadcrumb breadcrumbs site-nav topnav pagination pager tabs",
    "header": "header site-header masthead top-bar page-header branding logo",
    "footer": "footer site-footer page-footer copyright bottom colophon legal",
    "side": "sidebar side widget related aside recommended popular-posts more-stories trending tags also-read",
    "ad": "ad ads advert advertisement banner sponsored promo ad-slot adsbygoogle sponsor",
    "notice": "cookie cookie-banner cookie-notice notice gdpr consent popup modal alert subscribe newsletter paywall",
    "share": "share social sharing social-links follow-us share-buttons",
    "comment": "comments comment-list comment reply replies disqus responses comment-body discussion",
    "form": "search search-form login signup contact-form subscribe-form newsletter-form",
}
NAMES = {k: v.split() for k, v in _NAMES.items()}


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.r.choice(["."] * 8 + ["!", "?"])

    def prose(self, lo: int = 1, hi: int = 6) -> str:
        out = [self.sentence() for _ in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.25:
            i = self.r.randrange(len(out))
            out[i] = f'<a href="/{self.word()}">{out[i]}</a>' if self.r.random() < 0.3 else f"{out[i]} <a href='/x'>{self.word()}</a>"
        if self.r.random() < 0.2:
            out[0] = f"<b>{out[0]}</b>"
        return " ".join(out)

    def name(self, part: str, chance: float = 1.0) -> str:
        if self.r.random() > chance:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(NAMES[part])}"'

    def links(self, lo: int, hi: int) -> str:
        each = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(lo, hi))]
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>"
        return (" | " if kind < 0.8 else " ").join(each)

    def out(self, part: str, tag: str, inner: str, chance: float = 0.8) -> str:
        return f'<{tag}{self.name(part, chance)} data-main="0">{inner}</{tag}>'

    def nav(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "ul"])
        return self.out("nav", tag, self.links(3, 9), 0.5 if tag == "nav" else 1)

    def header(self) -> str:
        tag = self.r.choice(["header", "header", "div"])
        return self.out("header", tag, f"<{(t := self.r.choice(['h1', 'div', 'p', 'span']))}>{self.words(1, 4)}</{t}>" + (self.nav() if self.r.random() < 0.5 else ""), 0.5 if tag == "header" else 1)

    def footer(self) -> str:
        tag = self.r.choice(["footer", "footer", "div"])
        inner = self.r.choice([lambda: f"&copy; 2024 {self.words(1, 3)} &middot; {self.sentence()}", lambda: f"<p>{self.words(3, 12)}</p>{self.links(2, 8)}", lambda: f"<p>&copy; {self.prose(1, 2)}</p>"])()
        return self.out("footer", tag, inner, 0.4 if tag == "footer" else 1)

    def side(self) -> str:
        tag = self.r.choice(["aside", "aside", "div", "section"])
        inner = f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 3)}</h{n}>" + self.r.choice([lambda: self.links(3, 8), lambda: f"<p>{self.prose(1, 3)}</p>", lambda: "".join(f"<div><a href='/x'>{self.words(3, 9)}</a></div>" for _ in range(3))])()
        return self.out("side", tag, inner, 0.5 if tag == "aside" else 1)

    def ad(self) -> str:
        return self.out("ad", self.r.choice(["div", "div", "aside", "p", "section"]), self.r.choice([self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", f"<a href='/x'>{self.words(2, 8)}</a>"]), 1)

    def notice(self) -> str:
        return self.out("notice", self.r.choice(["div", "div", "section", "p"]), self.r.choice([f"<p>{self.prose(1, 3)}</p><button>{self.word()}</button>", self.prose(1, 3)]), 1)

    def share(self) -> str:
        return self.out("share", "div", self.links(2, 5), 1)

    def form(self) -> str:
        return self.out("form", "form", f"<label>{self.words(1, 4)}</label><input type='text'><p>{self.prose(1, 2)}</p><button>{self.word()}</button>", 0.6)

    def comments(self) -> str:
        one = lambda: f'<{(t := self.r.choice(["div", "li", "article"]))} class="{self.r.choice(NAMES["comment"])}"><{(h := self.r.choice(["h4", "span", "b", "div"]))}>{self.words(1, 2)}</{h}><p>{self.prose(1, 3)}</p></{t}>'
        return self.out("comment", self.r.choice(["section", "div", "ol"]), f"<h3>{self.words(1, 3)}</h3>" * (self.r.random() < 0.6) + "".join(one() for _ in range(self.r.randint(1, 6))), 1)

    def block(self) -> str:
        k = self.r.random()
        if k < 0.78:
            return f"<p>{self.prose()}</p>" if self.r.random() < 0.9 else f"<p>{self.prose()}"
        if k < 0.86:
            return f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 8)}</h{n}>"
        if k < 0.9:
            return "<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if k < 0.93:
            return f"<blockquote><p>{self.prose()}</p></blockquote>"
        if k < 0.95:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if k < 0.97:
            return f"<figure><img src='x'><figcaption>{self.sentence()}</figcaption></figure>"
        return f"<div>{self.prose()}</div>"

    def article(self) -> str:
        body = [self.block() for _ in range(self.r.choice([1, 2, 4, 8, 16, 30]))]
        for part in (self.ad, self.share, self.side, self.notice, self.form):
            if self.r.random() < 0.16:
                body.insert(self.r.randint(1, len(body)), part())
        title = f"<h1>{self.words(1, 10)}</h1>"
        if self.r.random() < 0.75:
            body.insert(0, title)
        if self.r.random() < 0.1:
            body.append(self.comments())
        if self.r.random() < 0.08:  # without an element of its own
            return "".join(x if "data-main" in x else re.sub(r"^<(\w+)", r'<\1 data-main="1"', x) for x in body)
        inner = "".join(body)
        if inner.startswith("<h1>") and self.r.random() < 0.2:
            inner = inner.replace("<h1>", "<header><h1>", 1).replace("</h1>", "</h1></header>", 1)
        k = self.r.random()
        if k < 0.45:
            return f'<article{self.name("main", 0.4)} data-main="1">{inner}</article>'
        if k < 0.65:
            return f'<main{self.name("main", 0.4)} data-main="1">{inner}</main>'
        if k < 0.8:
            return f'<main><article data-main="1">{inner}</article></main>'
        return f'<{(t := self.r.choice(["div", "div", "section"]))}{self.name("main")} data-main="1">{inner}</{t}>'

    def page(self) -> str:
        parts = [self.article()]
        for chance, part, before in ((0.5, self.header, True), (0.7, self.nav, True), (0.35, self.notice, True), (0.4, self.ad, True), (0.5, self.side, None), (0.4, self.comments, False), (0.25, self.share, False), (0.25, self.form, None), (0.3, self.ad, False), (0.8, self.footer, False)):
            if self.r.random() < chance:
                first = self.r.random() < 0.5 if before is None else before
                parts = [part(), *parts] if first else [*parts, part()]
        body = "".join(parts)
        for _ in range(self.r.choice([0, 0, 1, 2])):
            body = f"<div{self.name('wrap')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body data-main='0'>{body}</body></html>"


def pages(n: int = 2000, seed: int = 7) -> list[str]:
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]
