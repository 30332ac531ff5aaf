"""Pages whose article is known, from which operator 9 learns. They are put together from the usual parts of web pages
in random order and with usual names; blocks of the article carry the attribute data-article. Some pages are text alone,
with lines and inline elements at most, where a comment with that word marks the element it stands in; some have no article."""

from __future__ import annotations

import random

#: Names that pages use for what a part is.
NAMES = {
    "nav": ["nav", "menu", "navbar", "main-nav", "breadcrumbs", "topbar", "pagination", "toolbar", "tabs"],
    "header": ["header", "masthead", "site-header", "banner", "logo", "page-head"],
    "footer": ["footer", "site-footer", "copyright", "legal", "colophon", "bottom"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "rail", "more-stories"],
    "notice": ["cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "overlay"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adbox", "banner-ad"],
    "comments": ["comments", "comment", "comment-list", "disqus", "replies", "respond", "discussion"],
    "share": ["share", "social", "tools", "byline-links", "tags"],
    "content": ["content", "article", "post", "entry", "story", "article-body", "entry-content", "main-content", "text", "post-body"],
}

_SYLLABLES = "ka lo mi ren tas vo pe du shi na or el ti ba con str ea ing er un de la os ach".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 3))) for _ in range(n))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.r.randint(2, 16)).capitalize() + self.r.choice([".", ".", ".", "!", "?"]) for _ in range(n))

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(self.r.randint(1, 3))}</a></li>' for i in range(n)) + "</ul>"

    def named(self, kind: str, tags: list[str], inner: str) -> str:
        tag = self.r.choice(tags)
        name = self.r.choice(NAMES[kind])
        attrs = "" if tag not in ("div", "section", "p", "ul") and self.r.random() < 0.5 else f' {self.r.choice(["class", "id"])}="{name}"'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def paragraph(self, mark: str) -> str:
        text = self.sentences(self.r.choice([1, 1, 2, 3, 5])) if self.r.random() < 0.85 else self.words(self.r.choice([2, 8, 40]))
        if self.r.random() < 0.2:
            text = f'{self.words(3)} <a href="/x">{self.words(2)}</a> {text}'
        if self.r.random() < 0.15:
            text = f"<b>{text}<br>"
            return f"<p{mark}>{text}"
        return f"<p{mark}>{text}</p>"

    def article(self) -> str:
        m = " data-article"
        parts = [f"<h1{m}>{self.words(self.r.randint(2, 12))}</h1>"] if self.r.random() < 0.8 else []
        for _ in range(self.r.choice([1, 2, 4, 8, 14])):
            kind = self.r.random()
            if kind < 0.08:
                parts.append(f"<h2{m}>{self.words(4)}</h2>")
            elif kind < 0.13:
                parts.append(f"<blockquote{m}>{self.sentences(2)}</blockquote>")
            elif kind < 0.19:
                parts.append(f"<ul{m}>" + "".join(f"<li{m}>{self.words(self.r.randint(2, 14))}</li>" for _ in range(4)) + "</ul>")
            elif kind < 0.22:
                parts.append(f"<table{m}><tr{m}><td{m}>{self.words(2)}</td><td{m}>{self.words(3)}</td></tr></table>")
            elif kind < 0.25:
                parts.append(f"<pre{m}>{self.words(6)}</pre>")
            elif kind < 0.30:
                parts.append(f"<div{m}>{self.sentences(2)}</div>")
            elif kind < 0.36:
                parts.append(self.boiler(self.r.choice(["ad", "share", "aside", "notice"])))
            else:
                parts.append(self.paragraph(m))
        body = "".join(parts)
        shape = self.r.random()
        if shape < 0.45:
            body = f"<article{m}>{body}</article>"
        elif shape < 0.9:
            body = f'<{(t := self.r.choice(["div", "div", "section", "main"]))}{m} {self.r.choice(["class", "id"])}="{self.r.choice(NAMES["content"])}">{body}</{t}>'
        if self.r.random() < 0.4:
            body = f"<main>{body}</main>" if self.r.random() < 0.5 else f'<div class="{self.r.choice(["wrap", "container", "page", "row", "col"])}">{body}</div>'
        return body

    def boiler(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.named("nav", ["nav", "nav", "div", "ul"], self.links(r.randint(3, 9)))
        if kind == "header":
            return self.named("header", ["header", "header", "div"], f"<div>{self.words(2)}</div><p>{self.words(r.randint(2, 9))}</p>")
        if kind == "footer":
            return self.named("footer", ["footer", "footer", "div"], r.choice([f"&copy; {self.words(3)} {self.sentences(1)}", f"<p>{self.sentences(1)}</p>" + self.links(4)]))
        if kind == "aside":
            return self.named("aside", ["aside", "aside", "div", "section"], f"<h3>{self.words(2)}</h3>" + r.choice([self.links(4), f"<p>{self.sentences(2)}</p>"]))
        if kind == "notice":
            return self.named("notice", ["div", "section", "p"], r.choice([self.sentences(2), f"<p>{self.sentences(2)}</p><button>{self.words(1)}</button>"]))
        if kind == "ad":
            return self.named("ad", ["div", "section", "aside"], r.choice([self.sentences(1), f"<p>{self.sentences(1)}</p>", f'<a href="/y">{self.words(5)}</a>']))
        if kind == "comments":
            one = lambda: f'<{(t := r.choice(["div", "li", "article"]))}{r.choice(["", " class=comment"])}><h4>{self.words(1)}</h4><p>{self.sentences(r.randint(1, 4))}</p></{t}>'
            return self.named("comments", ["div", "section"], f"<h3>{self.words(1)}</h3>" + "".join(one() for _ in range(r.randint(1, 4))))
        if kind == "share":
            return self.named("share", ["div"], self.links(3))
        return f'<form{r.choice(["", " class=search"])}><label>{self.words(2)}</label><p>{self.sentences(1)}</p><button>{self.words(1)}</button></form>'

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < 0.5]
        after = [k for k in ("share", "comments", "aside", "form", "ad", "nav", "footer") if r.random() < 0.5]
        r.shuffle(before)
        head = f'<head><meta charset="utf-8"><title>{self.words(4)}</title><style>p{{}}</style><script>var a="</p>";</script></head>'
        body = "".join(self.boiler(k) for k in before) + self.article() + "".join(self.boiler(k) for k in after)
        if r.random() < 0.1:
            body = r.choice([self.words(2), f'<a href="#main">{self.words(3)}</a>']) + body
        return f'<!DOCTYPE html><html lang="xx">{head}<body>{body}' + ("</body></html>" if r.random() < 0.9 else "")

    def bare(self) -> str:
        r = self.r
        line = lambda: r.choice([self.sentences(r.choice([1, 1, 3])), f"{self.words(2)} <b>{self.words(2)}</b>", self.words(r.choice([2, 5, 9, 30]))])
        text = "<!--data-article-->" + r.choice(["<br>", "\n", " "]).join(line() for _ in range(r.choice([1, 1, 2, 6])))
        return r.choice([text, text, f"<body>{text}</body>", f"<html><head><title>{self.words(3)}</title></head><body>{text}</body></html>"])

    def hollow(self) -> str:
        """A page without an article, all text of which may be one element's."""
        kind, tags = self.r.choice([("nav", ["nav", "div"]), ("header", ["header", "div"]), ("footer", ["footer", "div"]), ("aside", ["aside", "div"]), ("notice", ["div", "p"]), ("ad", ["div", "section"]), ("comments", ["div", "section"])])
        inner = self.r.choice([self.sentences(1), f'<a href="/z">{self.words(2)}</a>'])
        return f"<body>{self.named(kind, tags, inner)}{self.boiler(kind) if self.r.random() < 0.3 else ''}</body>"


#: One page in so many is text alone, and one has no article.
BARE = 12


def pages(n: int = 600, seed: int = 11) -> list[str]:
    makers = [Maker(seed * 100_003 + i) for i in range(n)]
    return [m.bare() if i % BARE == 0 else m.hollow() if i % BARE == BARE // 2 else m.page() for i, m in enumerate(makers)]
