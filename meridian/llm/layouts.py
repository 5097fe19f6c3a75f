"""Page layouts generated from rules, with the main text marked by data-main="1"."""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "ka lo mi ne ru ta si ve po du ber lin gor fen aus ein de les tion ment".split()


class Layout:
    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, low: int, high: int) -> str:
        r = self.r
        ws = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(ws).capitalize() + r.choice([".", ".", ".", "", "?", " &amp; co."])

    def some(self, chance: float, make, *args) -> str:
        return make(*args) if self.r.random() < chance else ""

    def attrs(self, *names: str, chance: float = 0.75) -> str:
        if not names or self.r.random() > chance:
            return ""
        name = self.r.choice(names)
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} box-{self.r.randint(1, 9)}"', f' class="wrap {name}"'])

    def box(self, tags: list[str], names: list[str], inside: str, chance: float = 0.8) -> str:
        tag = self.r.choice(tags)
        # a neutral tag says what it is by its attributes, or not at all
        return f"<{tag}{self.attrs(*names, chance=chance if tag in ('div', 'section', 'ul') else 0.5)}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        item = lambda: f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>'
        n = self.r.randint(low, high)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return " | ".join(item() for _ in range(n))

    def nav(self) -> str:
        return self.box(["nav", "nav", "div"], ["nav", "menu", "main-menu", "navbar", "breadcrumb", "top-nav"], self.links(3, 12))

    def header(self) -> str:
        inside = self.some(0.8, lambda: f"<a href='/'>{self.words(1, 3)}</a>") + self.some(0.4, lambda: f"<p>{self.words(2, 8)}</p>") + self.some(0.5, self.nav) + self.some(0.3, self.form)
        return self.box(["header", "header", "div"], ["header", "masthead", "site-header", "banner", "top"], inside or self.words(2, 5))

    def footer(self) -> str:
        inside = f"&copy; {self.words(1, 4)} &middot; {self.words(2, 15)}" + self.some(0.5, self.links, 2, 8) + self.some(0.3, lambda: f"<p>{self.words(5, 30)}</p>")
        return self.box(["footer", "footer", "footer", "div"], ["footer", "site-footer", "bottom", "legal", "copyright"], inside)

    def advert(self) -> str:
        text = self.words(2, 25)
        inside = self.r.choice([text, f"<p>{text}</p>", f"<a href='/x'>{text}</a>", f"<p>{text}</p><a href='/b'>{self.words(1, 3)}</a>"])
        return self.box(["div", "div", "div", "aside", "section"], ["ad", "ads", "advert", "sponsor", "promo", "ad-slot", "advertisement"], inside, 0.97)

    def notice(self) -> str:
        inside = self.r.choice(["{}", "<p>{}</p>", "<p>{}</p><button>OK</button>"]).format(self.words(6, 40))
        return self.box(["div", "div", "section", "aside"], ["cookie-notice", "notice", "alert", "consent", "cookie", "popup"], inside, 0.97)

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name='q'>" for _ in range(self.r.randint(1, 4)))
        return f"<form{self.attrs('search', 'newsletter', 'subscribe', 'login', 'contact')}>{self.some(0.6, lambda: f'<p>{self.words(3, 20)}</p>')}{fields}<button>{self.words(1, 2)}</button></form>"

    def sidebar(self) -> str:
        part = lambda: f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([self.links(3, 8), f"<p>{self.words(5, 40)}</p>"])
        inside = "".join(part() for _ in range(self.r.randint(1, 4))) + self.some(0.3, self.advert)
        return self.box(["aside", "aside", "div"], ["sidebar", "side", "widget", "rail", "secondary", "related"], inside, 0.95)

    def comments(self) -> str:
        one = lambda: self.box(["div", "li", "article"], ["comment", "reply", "comment-body"], f"{self.some(0.6, lambda: f'<span>{self.words(1, 2)}</span>')}<p>{self.words(3, 80)}</p>{self.some(0.3, lambda: f'<p>{self.words(3, 30)}</p>')}", 0.95)
        inside = self.some(0.7, lambda: f"<h3>{self.words(1, 3)}</h3>") + "".join(one() for _ in range(self.r.randint(1, 8))) + self.some(0.4, self.form)
        return self.box(["section", "div", "div"], ["comments", "comment-list", "discussion", "disqus", "replies comments"], inside, 0.97)

    def share(self) -> str:
        return self.box(["div", "ul"], ["share", "social", "tags", "share-links"], self.links(2, 5), 0.95)

    def block(self) -> str:
        """A block of main text."""
        r, m = self.r, ' data-main="1"'
        x = r.random()
        if x < 0.6:
            text = self.words(*r.choice([(1, 6), (5, 40), (30, 120), (80, 250)]))
            if r.random() < 0.25:
                text = f"<b>{text}" + r.choice(["</b>", "<br>", "</b><br>"])
            if r.random() < 0.2:
                text += f' <a href="/y">{self.words(1, 4)}</a> {self.words(3, 20)}'
            return f"<p{m}>{text}" + r.choice(["</p>", "</p>", "</p>", ""])
        if x < 0.7:
            return f"<{(t := r.choice(['h2', 'h3', 'h4']))}{m}>{self.words(1, 8)}</{t}>"
        if x < 0.78:
            return f"<{(t := r.choice(['ul', 'ol']))}{m}>" + "".join(f"<li{m}>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 7))) + f"</{t}>"
        if x < 0.84:
            return f"<blockquote{m}><p{m}>{self.words(5, 60)}</p></blockquote>"
        if x < 0.88:
            cells = "".join(f"<tr{m}>" + "".join(f"<td{m}>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5)))
            return f"<table{m}>{cells}</table>"
        if x < 0.92:
            return f"<pre{m}>{self.words(3, 40)}</pre>"
        if x < 0.96:
            return f"<figure{m}><img src='i.png'><figcaption{m}>{self.words(2, 15)}</figcaption></figure>"
        return f"<div{m}>{self.words(10, 100)}</div>"

    def article(self) -> str:
        r, m = self.r, ' data-main="1"'
        n = r.choice([1, 2, 4, 8, 16, 30])
        head = f"<h1{m}>{self.words(1, 12)}</h1>"
        if r.random() < 0.2:
            head = f"<header{m}>{head}</header>"
        parts = [self.block() if r.random() > 0.05 else r.choice([self.advert, self.share, self.form])() for _ in range(n)]
        inside = self.some_text(head, 0.85) + "".join(parts)
        if "data-main" not in inside:
            inside += f"<p{m}>{self.words(10, 60)}</p>"
        inside += self.some(0.15, self.share) + self.some(0.1, self.comments)
        if r.random() < 0.25:
            inside = f'<div class="{r.choice(["body", "text", "entry-content", "inner"])}">{inside}</div>'
        return self.box(["article", "article", "main", "div", "section"], ["content", "article", "post", "entry", "main", "story", "page-content"], inside, 0.85)

    def some_text(self, text: str, chance: float) -> str:
        return text if self.r.random() < chance else ""

    def page(self) -> str:
        r = self.r
        middle = self.article()
        if r.random() < 0.25:
            middle = f"<main>{middle}</main>"
        around = [self.some(0.4, self.sidebar), middle, self.some(0.3, self.sidebar)]
        if r.random() < 0.4:
            around = [self.box(["div"], ["container", "wrapper", "page", "columns", "content"], "".join(around))]
        before = [self.some(0.5, self.header), self.some(0.7, self.nav), self.some(0.5, self.advert), self.some(0.3, self.notice)]
        r.shuffle(before)
        after = self.some(0.3, self.comments) + self.some(0.15, self.advert) + self.some(0.15, self.notice) + self.some(0.85, self.footer)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(before)}{''.join(around)}{after}</body></html>"


def generate(n: int, seed: int) -> Iterator[str]:
    rng = random.Random(seed)
    for _ in range(n):
        yield Layout(rng).page()
