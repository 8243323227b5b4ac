"""Training pages for the main-text extractor: random layouts whose article is known by construction.

Texts are drawn from a bounded sample of real pages' text runs, so lengths and languages follow the
table; structure, tags and names vary widely.  Two marker attributes, which features never look at,
say where an article part or a non-article part begins.
"""

from __future__ import annotations

import html
import random

MARK = "data-part"
CONTENT, OTHER = "article", "other"

_NAMES = {
    "nav": ["nav", "main-nav", "navbar", "menu", "site-menu", "topMenu", "breadcrumbs", "toc", "pagination", "navigation"],
    "header": ["header", "site-header", "masthead", "topbar", "page-header", "branding", "logo"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "legal", "bottom"],
    "aside": ["sidebar", "side", "rail", "widget", "widgets", "secondary", "right-column"],
    "notice": ["notice", "cookie-notice", "cookies", "consent", "gdpr", "alert", "popup", "modal", "announcement", "paywall"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "promotion", "sponsor", "banner"],
    "comments": ["comments", "comment-list", "disqus", "replies", "discussion", "reader-comments", "responses", "respond"],
    "related": ["related", "recommended", "share", "social", "newsletter", "subscribe", "popular", "more-stories", "tags"],
    "form": ["search", "login", "contact-form", "signup", "form"],
    "content": ["content", "main", "main-content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story",
                "story-body", "text", "page-content", "body-text", "prose"],
    "wrap": ["container", "wrapper", "page", "layout", "row", "col", "inner", "outer", "grid", "site", "wrap"],
}


class _Maker:
    def __init__(self, rng: random.Random, runs: list[str]):
        self.rng, self.runs = rng, runs
        self.words = [w for r in runs[:400] for w in r.split()] or ["word"]

    def text(self, low: int, high: int) -> str:
        rng = self.rng
        n = rng.randint(low, high)
        if n > 12 and rng.random() < 0.6:
            words = rng.choice(self.runs).split()[:n]
            while len(words) < n:
                words += rng.choice(self.runs).split()[:n - len(words)] or ["word"]
        else:
            at = rng.randrange(len(self.words))
            words = self.words[at:at + n] or ["word"]
        return html.escape(" ".join(words), quote=False)

    def attrs(self, kind: str, chance: float = 0.85) -> str:
        rng = self.rng
        if rng.random() > chance:
            return ""
        name = rng.choice(_NAMES[kind])
        extra = f" {rng.choice(['a', 'x1', 'block', 'box', 'clearfix', 'u-pad'])}" if rng.random() < 0.3 else ""
        return f' id="{name}"' if rng.random() < 0.3 else f' class="{name}{extra}"'

    def links(self, n: int) -> str:
        rng = self.rng
        items = [f'<a href="/{i}">{self.text(1, 3)}</a>' for i in range(n)]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice([" | ", " ", "<br>"]).join(items)

    def paragraphs(self, n: int, low: int, high: int, tag: str = "p") -> str:
        return "".join(f"<{tag}>{self.text(low, high)}</{tag}>" for _ in range(n))

    def other(self, kind: str) -> str:
        """A part that is no article."""
        rng = self.rng
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        tag = semantic[kind] if kind in semantic and rng.random() < 0.6 else rng.choice(["div", "div", "section", "p" if kind in ("ad", "notice") else "div"])
        named = self.attrs(kind, 0.5 if tag in semantic.values() else 1.0)
        if kind == "nav":
            body = self.links(rng.randint(2, 12))
        elif kind == "header":
            body = rng.choice([f"<h1>{self.text(1, 4)}</h1>", f"<a href='/'>{self.text(1, 3)}</a>", f"<p>{self.text(2, 8)}</p>", self.text(2, 12)])
            body += self.links(3) if rng.random() < 0.4 else ""
        elif kind == "footer":
            body = "&copy; " + self.text(2, 25) + (self.links(3) if rng.random() < 0.4 else "")
            body = f"<p>{body}</p>" if rng.random() < 0.4 else body
        elif kind == "aside":
            body = f"<h{rng.randint(2, 4)}>{self.text(1, 3)}</h3>" + rng.choice([self.links(5), self.paragraphs(rng.randint(1, 3), 5, 60), self.text(5, 60)])
        elif kind in ("notice", "ad"):
            body = self.text(2, 60) if tag == "p" or rng.random() < 0.6 else self.paragraphs(rng.randint(1, 2), 4, 50)
            body += "<button>" + self.text(1, 2) + "</button>" if tag != "p" and rng.random() < 0.3 else ""
            if rng.random() < 0.25 and tag != "p":
                body = f'<a href="/go">{body}</a>'
        elif kind == "comments":
            one = lambda: f"<{(t := rng.choice(['div', 'li', 'article']))}{self.attrs('comments', 0.6)}>" + rng.choice(["", f"<b>{self.text(1, 2)}</b>"]) + \
                self.paragraphs(rng.randint(1, 2), 3, 80) + f"</{t}>"
            body = (f"<h3>{self.text(1, 2)}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 5)))
        elif kind == "related":
            body = f"<h3>{self.text(1, 3)}</h3>" + rng.choice([self.links(5), self.paragraphs(2, 4, 20)])
        else:
            body = f"<label>{self.text(1, 3)}</label><input name=q><button>{self.text(1, 2)}</button>" + rng.choice(["", f"<p>{self.text(3, 20)}</p>"])
        return f'<{tag}{named} {MARK}="{OTHER}">{body}</{tag}>'

    def article(self) -> str:
        rng = self.rng
        out = [f"<h{rng.choice([1, 1, 1, 2])}>{self.text(2, 14)}</h1>"] if rng.random() < 0.85 else []
        brief = rng.random() < 0.25                          # some articles are a few short paragraphs
        for _ in range(rng.randint(1, 4 if brief else 14)):
            pick = rng.random()
            if pick < 0.62 or brief:
                body = self.text(1, 140) if rng.random() < 0.8 and not brief else self.text(1, 10)
                if rng.random() < 0.15:
                    body = f"<b>{body}<br>" if rng.random() < 0.5 else f'{body} <a href="/x">{self.text(1, 4)}</a> {self.text(1, 20)}'
                out.append(f"<p>{body}</p>" if not body.endswith("<br>") else f"<p>{body}")
            elif pick < 0.7:
                out.append(f"<h{rng.randint(2, 4)}>{self.text(1, 8)}</h2>")
            elif pick < 0.77:
                out.append("<ul>" + "".join(f"<li>{self.text(2, 30)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif pick < 0.82:
                out.append(f"<blockquote>{self.paragraphs(1, 5, 50)}</blockquote>")
            elif pick < 0.86:
                out.append("<table>" + "".join(f"<tr><td>{self.text(1, 4)}</td><td>{self.text(1, 6)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            elif pick < 0.9:
                out.append(f"<div>{self.text(3, 80)}</div>")
            elif pick < 0.93:
                out.append(f"<pre>{self.text(3, 40)}</pre>")
            elif pick < 0.97:
                out.append(f"<section>{self.paragraphs(rng.randint(1, 3), 5, 90)}</section>")
            else:
                out.append(f"<figure><img src=a.png><figcaption>{self.text(2, 15)}</figcaption></figure>")
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        kinds = ["nav", "header", "footer", "aside", "notice", "ad", "comments", "related", "form"]
        some = lambda k, high: "".join(self.other(rng.choice(k)) for _ in range(rng.randint(0, high)))
        body = self.article()
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        named = self.attrs("content", 1.0 if tag in ("div", "section") and rng.random() < 0.8 else 0.4)
        cell = tag == "td"
        if rng.random() < 0.35:                              # other parts inside the article's element
            inner = rng.choice(["div", "section", "div"])
            kept = f'<{inner}{self.attrs("content", 0.6)} {MARK}="{CONTENT}">{body}</{inner}>'
            main = f"<{tag}{named}>{some(['ad', 'notice', 'header', 'nav'], 1)}{kept}{some(['ad', 'comments', 'related', 'form', 'footer'], 2)}</{tag}>"
        else:
            main = f'<{tag}{named} {MARK}="{CONTENT}">{body}</{tag}>'
            if rng.random() < 0.25:                          # an advert between its paragraphs
                cut = main.rfind("<p>")
                if cut > 0:
                    main = main[:cut] + self.other(rng.choice(["ad", "notice", "related", "form"])) + main[cut:]
        if cell:
            main = f"<table><tr>{'<td>' + some(['nav', 'aside'], 1) + '</td>' if rng.random() < 0.5 else ''}{main}</tr></table>"
        for _ in range(rng.randint(0, 3)):
            main = f"<div{self.attrs('wrap', 0.8)}>{some(kinds, 1) if rng.random() < 0.3 else ''}{main}{some(kinds, 1) if rng.random() < 0.3 else ''}</div>"
        top = (self.other("header") if rng.random() < 0.5 else "") + (self.other("nav") if rng.random() < 0.8 else "")
        return f"<html><head><title>{self.text(1, 6)}</title></head><body>{top}{some(['ad', 'notice', 'nav', 'form'], 2)}{main}" \
               f"{some(['comments', 'aside', 'ad', 'related', 'notice'], 3)}{self.other('footer') if rng.random() < 0.85 else ''}</body></html>"


def training_pages(runs: list[str], count: int, seed: int = 11) -> list[str]:
    maker = _Maker(random.Random(seed), sorted(r for r in runs if r.strip()) or ["some words of text"])
    return [maker.page() for _ in range(count)]
