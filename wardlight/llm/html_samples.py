"""Labelled pages to learn block costs from: made by rule from a seed, with layouts of many kinds.

A page has an article and the things around it. Marks that tell them apart (semantic elements, telling class names)
are left out, misplaced or contradicted at random, prose stands in comments and notices, short lines stand in articles.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za".split()
NEUTRAL = ["box", "c1", "row", "inner", "col-8", "x7", "wrap", "module", "unit", "grid"]
WRAPPERS = ["content", "page-content", "main-wrap", "container", "site", "body"]
ARTICLE_NAMES = ["article-body", "post-content", "entry", "story", "post", "main-text", "articleBody"]
AROUND = {
    "menu": (["nav", "ul", "div", "header"], ["menu", "navbar", "main-nav", "topbar", "breadcrumbs"]),
    "header": (["header", "div"], ["site-header", "header", "banner"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "widget", "related", "recommended"]),
    "notice": (["div", "dialog", "section"], ["cookie-notice", "consent", "popup", "newsletter"]),
    "advert": (["div", "aside", "section"], ["ad", "advert", "sponsored", "promo"]),
    "form": (["form", "div"], ["search-form", "login", "signup", "subscribe"]),
    "comments": (["section", "div", "ol", "article"], ["comments", "comment", "discussion", "replies"]),
    "share": (["div", "ul"], ["share", "social", "tags", "toolbar"]),
}


class Writer:
    """One page; ``content`` holds the texts of its content blocks."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.content = rng, [], set()

    def words(self, low: int, high: int) -> str:
        word = lambda: "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))
        return " ".join(word() for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        text = self.words(low, high).capitalize()
        if self.rng.random() < 0.6:
            text = text.replace(" ", ", ", 1)
        if self.rng.random() < 0.05:
            text = text.upper() if self.rng.random() < 0.5 else text.replace(" ", " | ")
        return text + self.rng.choice([".", ".", ".", "!", "?", ":", ""])

    def block(self, tag: str, text: str, keep: bool, link: float = 0.0) -> None:
        if keep:
            self.content.add(text)
        if link and self.rng.random() < link:
            text = f'<a href="/{self.rng.randrange(999)}">{text}</a>'
        elif self.rng.random() < 0.15:
            first, _, rest = text.partition(" ")
            text = f"<b>{first}</b> {rest}" if rest else f"<i>{first}</i>"
        self.out.append(f"<{tag}>{text}" + (f"</{tag}>" if tag != "p" or self.rng.random() < 0.9 else ""))

    def open(self, tag: str, names: list[str], telling: float) -> None:
        name = self.rng.choice(names if self.rng.random() < telling else NEUTRAL)
        bare = telling <= 1 and self.rng.random() < 0.25
        self.out.append(f"<{tag}>" if bare else f'<{tag} class="{name}">')

    def around(self, kind: str, telling: float) -> None:
        tags, names = AROUND[kind]
        tag = self.rng.choice(tags) if self.rng.random() < telling else "div"
        telling = 2.0 if tag == "article" else max(telling, 0.95) if kind in ("comments", "notice") else telling  # prose is named
        if kind in ("advert", "notice", "share", "header") and self.rng.random() < 0.4:  # one bare line
            self.open("div", names, telling)
            self.out.append(self.rng.choice([self.prose(2, 12), f'<a href="/x">{self.words(2, 8)}</a>', " | ".join(f"<a href=x>{self.words(1, 2)}</a>" for _ in range(4))]) + "</div>")
            return
        if kind in ("menu", "sidebar") and self.rng.random() < 0.15:  # a layout table
            self.out.append("<table><tr>")
            for _ in range(self.rng.randint(1, 3)):
                self.out.append("<td>" + "<br>".join(f"<a href=x>{self.words(1, 3)}</a>" for _ in range(self.rng.randint(1, 6))) + "</td>")
            self.out.append("</tr></table>")
            return
        self.open(tag, names, telling)
        if kind in ("menu", "share"):
            self.out.append("<ul>" if tag != "ul" else "")
            for _ in range(self.rng.randint(3, 9)):
                self.block("li", self.words(1, 3), False, 0.95)
            self.out.append("</ul>" if tag != "ul" else "")
        elif kind == "header":
            self.block("div", self.words(1, 4), False, 0.5)
            self.block("p", self.words(3, 8), False)
        elif kind == "footer":
            self.block("p", "&copy; " + self.words(2, 5), False)
            for _ in range(self.rng.randint(1, 4)):
                self.block(self.rng.choice(["p", "div"]), self.prose(2, 10), False, 0.5)
        elif kind == "comments":
            self.block("h3", self.words(1, 3), False)
            for _ in range(self.rng.randint(2, 6)):
                self.block("div", self.words(1, 3), False, 0.4)
                self.block("p", self.prose(4, 45), False)
        elif kind == "form":
            for _ in range(self.rng.randint(1, 4)):
                self.block("label" if self.rng.random() < 0.5 else "div", self.words(1, 3), False)
            self.block("button", self.words(1, 2), False)
        elif kind == "sidebar":
            self.block("h3", self.words(1, 4), False)
            for _ in range(self.rng.randint(2, 6)):
                self.block(self.rng.choice(["li", "p", "div"]), self.prose(3, 16), False, 0.8)
        else:
            for _ in range(self.rng.randint(1, 2)):
                self.block(self.rng.choice(["p", "div"]), self.prose(4, 25), False, 0.3)
        self.out.append(f"</{tag}>")

    def article(self, telling: float) -> None:
        tag = self.rng.choice(["article", "main"]) if self.rng.random() < telling else self.rng.choice(["div", "section"])
        self.open(tag, ARTICLE_NAMES, telling)
        plain = "p" if self.rng.random() < 0.6 else self.rng.choice(["div", "div", "section"])
        self.block(self.rng.choice(["h1", "h2"]), self.words(1, 12).capitalize(), True)
        if self.rng.random() < 0.3:
            self.block("p", self.words(2, 5), True)
        for _ in range(self.rng.randint(2, 12)):
            kind = self.rng.random()
            if kind < 0.08:
                self.block(self.rng.choice(["h2", "h3"]), self.words(2, 7).capitalize(), True)
            elif kind < 0.16:
                self.block(plain, self.prose(1, 4), True)
            elif kind < 0.22:
                self.out.append("<ul>")
                for _ in range(self.rng.randint(2, 5)):
                    self.block("li", self.prose(2, 14), True, 0.1)
                self.out.append("</ul>")
            elif kind < 0.27:
                self.around(self.rng.choice(["advert", "share", "sidebar"]), 2.0)
            elif kind < 0.31:
                self.out.append("<blockquote>")
                self.block("p", self.prose(6, 30), True)
                self.out.append("</blockquote>")
            elif kind < 0.34:
                self.out.append("<table>")
                for _ in range(self.rng.randint(1, 4)):
                    self.out.append("<tr>")
                    for _ in range(3):
                        self.block("td", self.words(1, 4), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif kind < 0.36:
                self.out.append(self.rng.choice(['<div hidden>', '<div style="display: none">', '<div aria-hidden="true">']))
                self.block("p", self.prose(3, 30), False)
                self.out.append("</div>")
            else:
                self.block(plain, self.prose(10, 90), True, 0.02)
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            self.block(plain, self.prose(1, 3), True)
        if self.rng.random() < 0.2:
            self.around("comments", 2.0)
        self.out.append(f"</{tag}>")

    def page(self) -> str:
        telling = self.rng.choice([0.4, 0.7, 0.9, 1.0])
        some = lambda kinds, p: [k for k in kinds if self.rng.random() < p]
        self.out.append("<html><head><title>t</title></head><body>")
        wrapped = self.rng.random() < 0.4
        if wrapped:
            self.open("div", WRAPPERS, 0.8)
        telling = max(telling, 0.7)
        for kind in some(["notice", "header", "menu", "advert", "form", "sidebar"], 0.6):
            self.around(kind, telling)
        self.article(telling * self.rng.choice([0.5, 1.0]))
        for kind in some(["share", "comments", "sidebar", "advert", "form", "notice", "footer"], 0.55):
            self.around(kind, telling)
        if wrapped:
            self.out.append("</div>")
        self.out.append("</body></html>")
        return "".join(self.out)


def labelled_pages(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """(html, texts of its content blocks) of n pages."""
    out = []
    for i in range(n):
        w = Writer(random.Random(f"{seed}-{i}"))
        out.append((w.page(), w.content))
    return out
