"""Made-up pages whose main text is known: what the extraction model is fitted on.

Layouts, element names, attribute words and texts are drawn at random; blocks are marked while they are made.
"""

from __future__ import annotations

import random

KEEP, DROP = "keep", "drop"
#: How often each optional part appears.
PARTS = {
    "notice": 0.3, "header": 0.55, "nav": 0.8, "advert": 0.6, "aside": 0.45, "comments": 0.4, "form": 0.35, "footer": 0.85, "related": 0.35, "share": 0.3, "inner_advert": 0.3,
    "byline": 0.2, "crumbs": 0.2,
}
#: Elements that say what is to be dropped without attributes.
TELLING = ("nav", "header", "footer", "aside", "form")


class Maker:
    """Makes one page from a seed; marks are data-m attributes, which features never see."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = self.r.choice(["abcdefghijklmnopqrstuvwxyz", "aeiouéèntrlsp", "abehilmnorstuäöü", "тонаеирсвлкм"])
        self.lexicon = [self.word() for _ in range(200)]
        self.plain = self.r.random() < 0.35  # few attributes, as on simple pages

    def word(self) -> str:
        return "".join(self.r.choice(self.letters) for _ in range(self.r.randint(2, 10)))

    def sentence(self, low: int = 3, high: int = 22) -> str:
        words = [self.r.choice(self.lexicon) + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def text(self, low: int = 1, high: int = 9) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        kind = self.r.random()
        if kind < 0.04:  # tables of words, shouting and noise occur in articles
            out = out.replace(" ", " | ")
        elif kind < 0.07:
            out = out.upper()
        elif kind < 0.1:
            out = out.replace(" ", self.r.choice(["*** ", "&amp;&amp; ", "### "]))
        elif kind < 0.3:
            words = out.split(" ")
            i = self.r.randrange(len(words))
            words[i] = self.r.choice([f"<b>{words[i]}</b>", f'<a href="/x">{words[i]}</a>', f"<em>{words[i]}</em>", f"<span>{words[i]}</span>"])
            out = " ".join(words)
        return out

    def attrs(self, *names: str) -> str:
        if not names or self.r.random() < (0.5 if self.plain else 0.08):
            return ""
        name = self.r.choice(names)
        extra = self.r.choice(["", "", f" {self.word()}", f" col-{self.r.randint(1, 12)}", " clearfix"])
        return f' {self.r.choice(["class", "class", "class", "id"])}="{self.r.choice([name, name, f"{self.word()}-{name}", f"{name}_{self.word()}"])}{extra}"'

    def el(self, tag: str, inside: str, attrs: str = "", mark: str = "") -> str:
        end = "" if tag in ("p", "li") and self.r.random() < 0.08 else f"</{tag}>"
        return f"<{tag}{attrs}{f' data-m={mark}' if mark else ''}>{inside}{end}{self.r.choice(['', '', chr(10)])}"

    def links(self, tag: str = "li") -> str:
        return "".join(self.el(tag, f'<a href="/{self.word()}">{self.sentence(1, 3)}</a>') for _ in range(self.r.randint(2, 9)))

    def listed(self) -> str:
        return self.el("ul", self.links()) if self.r.random() < 0.7 else "".join(f'<a href="/{self.word()}">{self.sentence(1, 3)}</a> ' for _ in range(self.r.randint(2, 7)))

    def drop(self, tags: list[str], inside: str, *names: str) -> str:
        tag = self.r.choice(tags)
        # without a telling element name the attribute has to tell
        attrs = self.attrs(*names)
        while not attrs and tag not in TELLING:
            attrs = self.attrs(*names)
        return self.el(tag, inside, attrs, DROP)

    def nav(self) -> str:
        return self.drop(["nav", "nav", "div"], self.listed(), "nav", "menu", "navbar", "main-nav", "navigation", "top-links")

    def crumbs(self) -> str:
        return self.drop(["div", "nav", "ol"], self.links(self.r.choice(["span", "li"])), "breadcrumb", "breadcrumbs", "crumbs")

    def header(self) -> str:
        inside = self.el(self.r.choice(["div", "p", "h2", "a"]), self.sentence(1, 6), self.attrs("logo", "brand", "tagline", "site-title"))
        return self.drop(["header", "header", "div"], inside + (self.nav() if self.r.random() < 0.4 else ""), "header", "masthead", "site-header", "topbar")

    def footer(self) -> str:
        inside = self.r.choice(["&copy; ", "", "Copyright 2024 "]) + self.sentence(2, 20) + (self.listed() if self.r.random() < 0.4 else "")
        inside = self.el("p", inside) if self.r.random() < 0.4 else inside
        return self.drop(["footer", "footer", "footer", "div"], inside, "footer", "site-footer", "copyright", "bottom", "legal")

    def advert(self) -> str:
        inside = self.r.choice([self.sentence(), self.el("p", self.text(1, 2)), f'<a href="/{self.word()}">{self.sentence()}</a>', self.sentence() + self.sentence()])
        return self.drop(["div", "div", "aside", "section", "p"], inside, "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot")

    def notice(self) -> str:
        inside = self.el("p", self.text(1, 3)) if self.r.random() < 0.6 else self.text(1, 3)
        if self.r.random() < 0.1:
            return self.el("noscript", inside, mark=DROP)
        return self.drop(["div", "div", "section", "aside"], inside + self.r.choice(["", "<button>OK</button>"]), "cookie-notice", "cookie", "consent", "notice", "newsletter", "alert", "gdpr", "popup", "subscribe", "paywall")

    def aside(self) -> str:
        inside = "".join(self.el("div", self.el("h3", self.sentence(1, 4)) + self.r.choice([self.listed(), self.el("p", self.text(1, 3))]), self.attrs("widget", "box")) for _ in range(self.r.randint(1, 3)))
        return self.drop(["aside", "aside", "div"], inside, "sidebar", "side", "rail", "widgets", "related", "trending")

    def related(self) -> str:
        items = "".join(self.el("li", f'<a href="/{self.word()}">{self.sentence(3, 12)}</a>' + (self.el("p", self.text(1, 2)) if self.r.random() < 0.3 else "")) for _ in range(self.r.randint(2, 6)))
        return self.drop(["section", "div", "aside"], self.el("h3", self.sentence(1, 3)) + self.el("ul", items), "related", "recommended", "more-stories", "popular", "also")

    def share(self) -> str:
        return self.drop(["div", "ul"], self.links(self.r.choice(["span", "li"])), "share", "social", "share-bar", "follow")

    def byline(self) -> str:
        return self.el(self.r.choice(["div", "p"]), self.sentence(2, 5), self.attrs("byline", "meta", "author", "date", "published"), KEEP)

    def form(self) -> str:
        inside = self.el("label", self.sentence(1, 4)) + '<input name="q">' + self.r.choice(["", self.el("p", self.text(1, 2)), "<button>Go</button>"])
        return self.el("form", inside, self.attrs("search", "login", "signup", "contact-form", "newsletter"), DROP)

    def comments(self) -> str:
        one = lambda: self.el(self.r.choice(["div", "li", "article"]), self.r.choice(["", self.el("span", self.sentence(1, 2), self.attrs("author"))]) + self.el("p", self.text(1, 4)), self.attrs("comment", "comment-body", "reply"))
        inside = self.el("h3", self.sentence(1, 3)) * (self.r.random() < 0.7) + "".join(one() for _ in range(self.r.randint(1, 6))) + (self.form() if self.r.random() < 0.4 else "")
        return self.drop(["section", "div", "div", "ol"], inside, "comments", "comment-list", "discussion", "responses", "disqus_thread", "reviews", "feedback")

    def some(self, part: str) -> str:
        name = "advert" if part == "inner_advert" else part
        return getattr(self, name)() if self.r.random() < PARTS[part] else ""

    def linked(self) -> str:
        """A paragraph that is a link for the most part."""
        link = f'<a href="/{self.word()}">{self.sentence(1, 9)}</a>'
        return self.el("p", self.r.choice([link, f"{self.sentence(1, 3)} {link}", f"{link} {self.sentence(1, 4)}", f"{link}, {link} &ndash; {self.sentence(1, 2)}"]))

    def links_told(self) -> str:
        """A list of links that belongs to the article."""
        items = [f'<a href="/{self.word()}">{self.sentence(1, 10)}</a>' + self.r.choice(["", "", " " + self.sentence(2, 14)]) for _ in range(self.r.randint(2, 14))]
        return self.el(self.r.choice(["ul", "ol"]), "".join(self.el("li", x) for x in items))

    def part(self) -> str:
        """A block of an article."""
        r, kind = self.r, self.r.random()
        if kind < 0.7:
            body = self.text()
            odd = r.choice([f"<p><{r.choice(['i', 'span', 'strong', 'u', 'font'])}>{body}", f"<p>{body}<br><br>{self.text(1, 2)}", f"<p>{body}</span></p>"])
            return odd if r.random() < 0.08 else self.el(r.choice(["p"] * 9 + ["div"]), body, self.unsaid() if r.random() < 0.1 else "")
        if kind < 0.76:
            return self.linked()
        if kind < 0.82:
            return self.el(r.choice(["h2", "h3"]), self.sentence(1, 8))
        if kind < 0.86:
            return self.el(r.choice(["ul", "ol"]), "".join(self.el("li", self.sentence()) for _ in range(r.randint(2, 6))))
        if kind < 0.89:
            return self.links_told()
        if kind < 0.93:
            return self.el("blockquote", "".join(self.el("p", self.text(1, 5)) for _ in range(r.choice([1, 1, 2, 8]))) if r.random() < 0.7 else self.text(1, 6))
        if kind < 0.96:
            return self.el("table", "".join(self.el("tr", "".join(self.el("td", self.sentence(1, 3)) for _ in range(3))) for _ in range(r.randint(1, 6))))
        if kind < 0.98:
            return self.el(r.choice(["pre", "dl"]), r.choice([self.text(1, 3), "".join(self.el("dt", self.sentence(1, 2)) + self.el("dd", self.sentence()) for _ in range(r.randint(1, 5)))]))
        inside = r.choice(["<img src=x>", "<noscript><img src=x></noscript>", f"<object data=x>{self.el('p', self.sentence())}</object>"])
        return self.el("figure", inside + self.el("figcaption", self.sentence()))

    def unsaid(self) -> str:
        """Attributes that tell nothing."""
        return self.r.choice(["", f' class="{self.word()}"', f' class="{self.r.choice("abcdefx")}{self.r.randint(0, 99)}"', f' id="{self.word()}-{self.r.randint(0, 99)}"', ' style="margin:0"'])

    def article(self) -> str:
        """An article: in an element or attributes that tell, in ones that don't, in a table's cell, or in none."""
        r = self.r
        heading = self.el("h1", self.sentence(2, 12), self.attrs("title", "headline")) if r.random() < 0.85 else ""
        if heading and r.random() < 0.15:
            heading = self.el("header", heading, self.attrs("entry-header", "article-header"), KEEP)
        parts = [heading] if heading else []
        kind = r.random()
        if kind < 0.06:  # a list of links is all there is
            parts.append(self.links_told())
        elif kind < 0.1:  # one kind of block again and again
            parts += [self.el(r.choice(["div", "p"]), self.text()) for _ in range(r.randint(1, 14))]
        else:
            parts += [self.part() for _ in range(0 if heading and r.random() < 0.04 else r.randint(1, 14))]
        if r.random() < 0.12:  # sections inside
            half = len(parts) // 2
            parts = [*parts[:half], self.el("section", "".join(parts[half:]))]
        for part in ("byline", "share", "inner_advert"):
            parts.insert(r.randint(min(1, len(parts)), len(parts)), self.some(part))
        tail = self.comments() if r.random() < 0.1 else ""
        mixed = tail or any(f"data-m={DROP}" in p for p in parts)
        inside = self.keep_each(parts) + tail if mixed else "".join(parts)
        if r.random() < 0.5:
            return self.told(inside, bool(mixed))
        if not mixed and r.random() < 0.12:  # text without elements
            return self.el("div", "<br><br>".join(self.text() for _ in range(r.randint(1, 9))), self.unsaid(), KEEP)
        how = r.random()
        if how < 0.35:
            return inside if mixed else self.keep_each(parts)
        if how < 0.8:
            inner = self.el("div", inside, self.unsaid(), "" if mixed else KEEP)
            return self.el("div", inner, self.unsaid()) if r.random() < 0.3 else inner
        cells = [self.el("td", inside, self.unsaid(), "" if mixed else KEEP)]
        if r.random() < 0.6:
            cells.insert(r.randint(0, 1), self.el("td", self.nav() if r.random() < 0.6 else self.aside()))
        return self.el("table", self.el("tr", "".join(cells)), self.unsaid())

    def told(self, inside: str, mixed: bool) -> str:
        """The article in an element or attributes that say so."""
        names = ("content", "article-body", "entry-content", "post", "story-text", "main", "prose")
        tag, names = self.r.choice([("article", ()), ("article", ()), ("article", ("post", "story")), ("main", ()), ("div", names), ("section", ("content", "article", "text"))])
        attrs = self.attrs(*names)
        while not attrs and tag in ("div", "section"):
            attrs = self.attrs(*names)
        return self.el(tag, inside, attrs, "" if mixed else KEEP)

    def keep_each(self, parts: list[str]) -> str:
        """Marks each kept block, where blocks to drop lie between them."""
        out = []
        for p in parts:
            if p.startswith("<") and f"data-m={DROP}" not in p and "data-m=" not in p.split(">", 1)[0]:
                head, rest = p.split(">", 1)
                p = f"{head} data-m={KEEP}>{rest}"
            out.append(p)
        return "".join(out)

    def page(self) -> str:
        r = self.r
        before = [self.some(p) for p in ("notice", "header", "nav", "crumbs", "advert")]
        after = [self.some(p) for p in ("share", "advert", "related", "comments", "form", "aside", "notice")]
        r.shuffle(after)
        if r.random() < 0.25:
            r.shuffle(before)
        middle = self.article()
        if r.random() < 0.08:  # an article and nothing else, or a piece of one
            return r.choice([middle, f"<html><body>{middle}</body></html>"])
        if r.random() < 0.03:
            return "".join(self.el("p", self.text(), mark=KEEP) for _ in range(r.randint(1, 3)))
        if r.random() < 0.03:  # text without any element
            return f"<body data-m={KEEP}>" + r.choice(["<br><br>", "\n\n", "<hr>"]).join(self.text() for _ in range(r.randint(1, 6)))
        if r.random() < 0.3:
            inner = [self.some("aside"), middle, *after[:2]]
            middle, after = self.el(r.choice(["div", "main"]), "".join(inner), self.attrs("wrapper", "container", "page", "layout")), after[2:]
        if r.random() < 0.2:
            middle = self.el("div", middle, self.attrs("container", "wrap"))
        body = "".join(before) + middle + "".join(after) + self.some("footer")
        end = "" if r.random() < 0.1 else "</body></html>"
        heads = [f"<title>{self.sentence(2, 9)}</title>", f"<style>.{self.word()}{{color:#{r.randint(100, 999)}}}</style>", f"<script>{self.word()}({r.randint(1, 99)})</script>", f'<meta name="{self.word()}" content="{self.sentence(2, 9)}">', f'<link rel="{self.word()}" href="/{self.word()}">']
        head = "".join(r.sample(heads, r.randint(1, len(heads))))
        return f'<!DOCTYPE html><html><head>{head}</head><body{self.attrs("page", "home")}>{body}{end}'


def page(seed: int) -> str:
    """A page with data-m marks on blocks to keep or to drop; what has none is inside a marked block, or mixed."""
    return Maker(seed).page()
