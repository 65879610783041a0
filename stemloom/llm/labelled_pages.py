"""Labelled pages, from which the weights of html extraction are learned and on which they are measured.

Pages are made by a rule: content of a few shapes is put into layouts of several families, between
furniture (menus, headers, adverts, notices, forms, teasers, comments, footers) in several kinds of
markup. Content lies between ``<!--[-->`` and ``<!--]-->``; furniture inside an article lies between two
such stretches. Families with odd numbers are for fitting and those with even ones are held out: no
layout and no wrapper's name of one half occurs in the other, while the names of furniture are common.
"""

from __future__ import annotations

import random
import re

_SYLLABLES = "ka lo mi ren ta vos el bri an do fe gul his jo"
OPEN, CLOSE = "<!--[-->", "<!--]-->"
FITTED, HELD_OUT = (1, 3, 5, 7, 9, 11), (2, 4, 6, 8, 10, 12)


class _Maker:
    def __init__(self, seed: int, family: int):
        self.r, self.family = random.Random(f"{seed}/{family}"), family
        self.syllables = _SYLLABLES.split()

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(self.syllables, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(5, 11).capitalize() + self.r.choice((", ", ": ", " ", " ")) + self.words(3, 9) + self.r.choice("...!?") for _ in range(n))

    def inline(self, text: str) -> str:
        parts = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            i = self.r.randrange(len(parts))
            parts[i] = self.r.choice(("<b>{}</b>", "<i>{}</i>", '<a href="/x">{}</a>', "<em>{}</em>", "<span>{}</span>", "<code>{}</code>", "{}<br>")).format(parts[i])
        return " ".join(parts)

    def links(self, n: int, form: str) -> str:
        item = lambda: f'<a href="/{self.words(1, 1)}">{self.words(1, 4).capitalize()}</a>'
        if form == "list":
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        if form == "rows":
            return "".join(f"<div>{item()}</div>" for _ in range(n))
        return self.r.choice((" | ", " ", " &middot; ")).join(item() for _ in range(n))

    def named(self, html: str) -> str:
        """Now and then a name that tells nothing, for the outermost element."""
        pool = ("text", "lead", "para", "title", "block", "inner", "row", "body", "first", "t1") if self.family % 2 else ("col", "copy", "chunk", "grid", "cell", "pane", "x9")
        return re.sub(r"^<(\w+)", rf'<\1 class="{self.r.choice(pool)}"', html) if self.r.random() < 0.25 else html

    # Furniture: its element or name, and what is in it.

    def wrap(self, name: str, inner: str, tags: str = "div div section") -> str:
        tag = self.r.choice(tags.split())
        how = self.r.choice(("class", "class", "id", "role")) if name in ("navigation", "banner", "complementary", "contentinfo", "alert", "search") else self.r.choice(("class", "class", "id"))
        shown = self.r.choice((name, f"{name}-{self.r.choice(('box', 'wrap', 'inner', 'left', 'top'))}", f"site_{name}", name.capitalize())) if how != "role" else name
        return f'<{tag} {how}="{shown}">{inner}</{tag}>'

    def menu(self) -> str:
        inner = self.links(self.r.randint(4, 9), self.r.choice(("list", "list", "rows", "line")))
        return self.r.choice((f"<nav>{inner}</nav>", self.wrap(self.r.choice("nav navbar navigation menu menubar topbar breadcrumb breadcrumbs toolbar".split()), inner), inner if self.r.random() < 0.5 else f"<div>{inner}</div>"))

    def head(self) -> str:
        inner = f'<a href="/">{self.words(1, 3).capitalize()}</a> <span>{self.words(2, 7)}</span>' + (self.menu() if self.r.random() < 0.6 else "")
        return self.r.choice((f"<header>{inner}</header>", self.wrap(self.r.choice(("header", "masthead", "banner", "topbar")), inner)))

    def foot(self) -> str:
        inner = self.r.choice(("&copy; ", "Copyright ", "")) + self.sentences(self.r.randint(1, 3)) + (self.links(self.r.randint(2, 8), self.r.choice(("list", "line"))) if self.r.random() < 0.7 else "")
        return self.r.choice((f"<footer>{inner}</footer>", f"<footer><p>{inner}</p></footer>", self.wrap(self.r.choice(("footer", "copyright", "contentinfo", "legal")), inner)))

    def advert(self) -> str:
        inner = self.r.choice((self.sentences(1), self.sentences(2), self.words(3, 9).capitalize() + ".")) if self.r.random() < 0.6 else f'<p>{self.words(3, 12)}</p><a href="/buy">{self.words(1, 3)}</a>'
        return self.wrap(self.r.choice("ad ads adv advert advertisement advertising sponsor sponsored promo promotion".split()), inner, "div div div aside section")

    def notice(self) -> str:
        inner = self.r.choice((f"<p>{self.sentences(self.r.randint(1, 3))}</p>", self.words(3, 9), self.sentences(1))) + self.r.choice(("", f"<button>{self.words(1, 2)}</button>"))
        return self.wrap(self.r.choice("cookie cookies consent gdpr notice popup modal overlay alert dialog".split()), inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input type=text><p>{self.words(3, 12)}</p><button>{self.words(1, 2)}</button>"
        return self.r.choice((f"<form>{inner}</form>", f'<form class="{self.r.choice(("search", "login", "signup", "newsletter"))}">{inner}</form>', self.wrap(self.r.choice("newsletter subscribe subscription signup login search".split()), inner)))

    def shares(self) -> str:
        return self.wrap(self.r.choice(("share", "sharing", "social")), self.links(self.r.randint(2, 5), "line"))

    def related(self) -> str:
        cards = "".join(f"<article><a href=/t>{self.words(3, 9)}</a><p>{self.sentences(1)}</p></article>" if self.r.random() < 0.5 else f"<div><a href=/t>{self.words(3, 9)}</a></div>" for _ in range(self.r.randint(1, 5)))
        return self.wrap(self.r.choice("related recommended recommendations teaser widget".split()), f"<h3>{self.words(1, 4)}</h3>" + cards)

    def side(self) -> str:
        inner = "".join(self.r.choice((self.related, self.advert, lambda: self.links(5, "list"), lambda: f"<h4>{self.words(1, 3)}</h4><p>{self.sentences(1)}</p>"))() for _ in range(self.r.randint(1, 4)))
        return self.r.choice((f"<aside>{inner}</aside>", self.wrap(self.r.choice(("sidebar", "aside", "widget", "complementary")), inner)))

    def comments(self) -> str:
        size = self.r.choice((3, 8, 30))
        each = lambda: f"<li><b>{self.words(1, 2)}</b><p>{self.sentences(self.r.randint(1, 5))}</p></li>"
        bare = lambda: f"<p>{self.sentences(self.r.randint(1, 6))}</p>"
        inner = f"<h3>{self.words(1, 3)}</h3>" + ("<ol>" + "".join(each() for _ in range(size)) + "</ol>" if self.r.random() < 0.5 else "".join(bare() for _ in range(size)))
        return self.wrap(self.r.choice("comments comments comment disqus replies respond reply".split()), inner, "div div section ol")

    def pager(self) -> str:
        return self.wrap(self.r.choice(("pagination", "pager")), self.links(3, "line"))

    # Content.

    def part(self) -> str:
        kind = self.r.random()
        if kind < 0.62:
            return f"<p>{self.inline(self.sentences(self.r.randint(1, 7)))}</p>"
        if kind < 0.72:
            return f"<h{(h := self.r.randint(2, 4))}>{self.words(1, 7).capitalize()}</h{h}>"
        if kind < 0.78:
            return f"<p>{self.words(1, 3).capitalize()}.</p>"
        if kind < 0.86:
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.inline(self.sentences(1) if self.r.random() < 0.7 else self.words(2, 6))}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        return self.r.choice((f"<blockquote><p>{self.sentences(2)}</p></blockquote>", f"<pre>{self.words(4, 20)}</pre>", f"<div>{self.sentences(self.r.randint(2, 5))}</div>", f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(2, 9)}</td></tr></table>", f"<dl><dt>{self.words(1, 2)}</dt><dd>{self.sentences(1)}</dd></dl>", f"<figure><img src=/i><figcaption>{self.words(4, 12)}</figcaption></figure>"))

    def content(self, titled: float = 0.7) -> str:
        parts = [f"<h1>{self.words(2, 8).capitalize()}</h1>"] if self.r.random() < titled else []
        if self.r.random() < 0.1:  # next to nothing
            return OPEN + "".join(parts) + f"<p>{self.words(3, 8)}.</p>" + CLOSE
        parts += [f"<p>{self.sentences(3)}</p>"] + [self.named(self.part()) for _ in range(self.r.choice((0, 1, 3, 6, 12, 25)))]
        out, open_ = OPEN, True
        for p in parts:
            out += p
            if self.r.random() < 0.06:
                out += CLOSE + self.r.choice((self.advert, self.shares, self.related, self.form, self.notice))() + OPEN
        return out + CLOSE

    def some(self, *makers) -> str:
        return "".join(m() for m in makers if self.r.random() < 0.6)

    def misnamed(self, content: str) -> str:
        """Content in one or two wrappers of a name that is furniture's elsewhere."""
        name = self.r.choice(("widget", "banner overlay", "search", "modal", "promo", "sidebar-layout", "post", "story"))
        parts = [content] + ([self.content(0.2)] if self.r.random() < 0.6 else [])
        return "".join(f'<div class="{name}">{self.r.choice(("<div>{}</div>", "{}")).format(x)}</div>' for x in parts)

    def page(self) -> str:
        """Wrappers around content of one family; those named like furniture hold the page all the same."""
        f = self.family
        before = self.some(self.notice, self.head, self.menu, self.advert, self.form)
        after = self.some(self.shares, self.related, self.comments, self.pager, self.form, self.notice) + self.foot()
        c = self.content()
        for _ in range(self.r.choice((0, 0, 1, 2))):
            c = self.named(f"<div>{c}</div>")
        side = self.side() if self.r.random() < 0.5 else ""
        body = {
            1: lambda: f"{before}{self.r.choice(('', '', f'<p>{self.words(2, 9)}</p>'))}<main><article>{c}</article>{side}</main>{after}",
            2: lambda: f"{before}<article><header>{OPEN}<h1>{self.words(2, 6)}</h1>{CLOSE}</header><section>{c}</section></article>{side}{after}",
            3: lambda: f'<div id="wrapper">{before}<div class="content">{c}</div>{side}</div>{after}',
            4: lambda: f'<div class="container"><div class="row">{before}</div><div class="row"><div class="col">{side}</div><div class="col">{c}</div></div>{after}</div>',
            5: lambda: f"<table><tr><td colspan=2>{before}</td></tr><tr><td>{side}</td><td>{c}</td></tr><tr><td>{after}</td></tr></table>",
            6: lambda: f"<center>{before}</center><table><tr><td>{c}</td></tr></table>{after}",
            7: lambda: f"{before}{c}{after}",
            8: lambda: f"<div>{before}</div><div><div><div>{c}</div></div></div><div>{after}</div>",
            9: lambda: f'<form id="form1" method=post>{before}<div>{c}</div>{side}{after}</form>',
            10: lambda: f'<section class="{self.r.choice(("page", "search-page", "widget"))}">{before if self.r.random() < 0.5 else ""}<div>{c}</div></section>{self.foot()}',
            11: lambda: self.misnamed(c) + side + after,
            12: lambda: f'{before}<div role="main" class="entry">{c}</div>{after}',
        }[f]()
        return f"<html><head><title>{self.words(3, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def pages(families: tuple[int, ...], each: int = 30, seed: int = 1) -> list[str]:
    """``each`` pages of each family, the same for the same seed."""
    return [_Maker(seed * 1000 + i, f).page() for f in families for i in range(each)]
