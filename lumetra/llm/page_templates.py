"""Pages of independent site templates with known article text, for fitting and for judging html extraction.

Each family writes its own markup, as sites of one kind do: bare files, unmarked containers, blog and portal software,
table layouts, manuals, wikis. Article blocks start with the mark U+E000, which the caller takes out. Families that are
held out of a fit show how it does on templates it has never seen.
"""

from __future__ import annotations

import random
from collections.abc import Callable

MARK = "\ue000"
FAMILIES: dict[str, Callable[[Writer], str]] = {}
#: Families that no test of unseen templates may fit on.
HELD_OUT = ("blog", "portal", "wiki")


def family(f: Callable) -> Callable:
    FAMILIES[f.__name__] = f
    return f


class Writer:
    """Words, links and the parts that stand around articles."""

    def __init__(self, r: random.Random):
        self.r = r
        self.common = r.choice(["the of and to in is on for with as that was by at from", "le la de et que des un une pour dans", "der die und das den mit von zu auf ist", "el los que con para por una del las se"]).split()

    def word(self) -> str:
        r = self.r
        if r.random() < 0.4:
            return r.choice(self.common)
        return "".join(r.choice("an be co de el fa ga hi jo ka le mi no or pa ra sa ti un ve wi th st er on re ing tion nd é ß ñ ü".split()) for _ in range(r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 5, b: int = 22) -> str:
        s = self.words(a, b)
        return s[:1].upper() + s[1:] + self.r.choice("....!?")

    def text(self, a: int = 1, b: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def name(self) -> str:
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(self.r.randint(2, 8)))

    def link(self, a: int = 1, b: int = 4) -> str:
        return f'<a href="/{self.name()}">{self.words(a, b)}</a>'

    def maybe(self, p: float, part) -> str:
        return (part() if callable(part) else part) if self.r.random() < p else ""

    def paragraph(self) -> str:
        r = self.r
        if r.random() < 0.05:
            t = self.text(2, 2) * r.randint(2, 4)  # sentences that repeat
        else:
            t = self.text(1, 2) if r.random() < 0.3 else self.text()
        if r.random() < 0.25:
            t += f" {self.link()} {self.sentence(2, 8)}"
        if r.random() < 0.1:
            t += f" <button>{self.word()}</button> {self.word()}."
        if r.random() < 0.2:
            t += f" <em>{self.words(1, 3)}</em>, <strong>{self.word()}</strong> {self.word()}."
        return t

    def body(self, least: int = 1, most: int = 14, plain: bool = False) -> str:
        """Blocks of an article."""
        r, out = self.r, []
        for _ in range(r.randint(least, most)):
            p = r.random()
            if plain or p < 0.78:
                out.append(f"<p>{MARK}{self.paragraph()}{'' if r.random() < 0.08 else '</p>'}")
            elif p < 0.86:
                out.append(f"<h{(h := r.randint(2, 4))}>{MARK}{self.words(1, 8)}</h{h}>")
            elif p < 0.92:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{MARK}{self.text(1, 2)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>")
            elif p < 0.95:
                out.append(f"<blockquote>{r.choice(['<p>%s</p>', '%s']) % (MARK + self.text(1, 3))}</blockquote>")
            elif p < 0.97:
                out.append(f"<pre>{MARK}{self.words(3, 30)}</pre>")
            else:
                rows = "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4)))
                out.append(f"<table>{rows}</table>")
        return "\n".join(out)

    def links(self, n: tuple[int, int] = (3, 10)) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(*n))) + "</ul>"

    def remark(self) -> str:
        return self.text(1, 3)

    def notice(self) -> str:
        return f'<div {self.r.choice(["class", "id"])}="{self.r.choice(["cookie-bar", "gdpr-notice", "consent-popup", "newsletter-signup", "alert-box"])}"><p>{self.text(1, 2)}</p><button>{self.word()}</button></div>'

    def advert(self) -> str:
        return f'<div class="{self.r.choice(["ad-slot", "advert", "sponsored-box", "ads banner", "promo ad"])}">{self.r.choice(["<p>%s</p>", "%s"]) % self.text(1, 2)}</div>'


def _page(body: str, title: str = "", attributes: str = "") -> str:
    return f"<!DOCTYPE html>\n<html><head><meta charset=utf-8><title>{title}</title></head><body{attributes}>{body}</body></html>"


@family
def bare(w: Writer) -> str:
    """A file with nothing around its text."""
    head = w.maybe(0.5, lambda: f"<h1>{MARK}{w.words(1, 9)}</h1>")
    return w.r.choice([_page(head + w.body(plain=w.r.random() < 0.6)), head + w.body(), f"<html><body>{head}{w.body()}"])


@family
def container(w: Writer) -> str:
    """One unmarked container, alone or behind a menu and before a footer."""
    tag = w.r.choice(["div", "div", "div", "section", "main", "article"])
    own = w.r.choice(["", "", f" id={w.name()}", f' class="{w.name()}"'])
    inner = w.maybe(0.5, lambda: f"<h1>{MARK}{w.words(1, 9)}</h1>") + w.body(1, 14, w.r.random() < 0.5)
    before = w.maybe(0.5, lambda: w.r.choice([f"<nav>{w.links()}</nav>", f"<div id=m>{w.links()}</div>", f"<div>{' | '.join(w.link() for _ in range(5))}</div>", w.links()]))
    after = w.maybe(0.4, lambda: w.r.choice([f"<footer>&copy; {w.words(1, 4)}</footer>", f"<footer><p>{w.text(1, 2)}</p>{w.links((2, 5))}</footer>", f"<div id=footer>{w.words(2, 6)} {w.link()}</div>"]))
    return _page(f"{before}<{tag}{own}>{inner}</{tag}>{after}")


@family
def direct(w: Writer) -> str:
    """Text in the body or a cell of old markup, parted by breaks."""
    text = f"{MARK}{w.paragraph()}" + "".join(f"<br><br>{w.paragraph()}" for _ in range(w.r.randint(0, 6)))
    head = w.maybe(0.5, lambda: f"<center><h2>{MARK}{w.words(1, 8)}</h2></center>")
    return w.r.choice([_page(f"{head}{text}"), _page(f"{head}<font size=2>{text}</font><hr>"), _page(f"{head}<div>{text}</div>")])


@family
def press(w: Writer) -> str:
    """Blog software with telling class lists that name what the page may have."""
    r = w.r
    flags = " ".join(r.sample(["comments-open", "has-sidebar", "no-sidebar", "with-comments", "has-post-thumbnail", "ad-free", "share-enabled", "type-post", "status-publish", "format-standard", "category-news", "tag-promo", "featured", "newsletter-on", "header-image"], r.randint(1, 6)))
    comments = f'<div id="comments" class="comments-area"><h2>{w.words(2, 4)}</h2><ol class="comment-list">' + "".join(f'<li class="comment"><article class="comment-body"><footer>{w.word()}</footer><div class="comment-content"><p>{w.remark()}</p></div></article></li>' for _ in range(r.randint(1, 5))) + f'</ol><div id="respond" class="comment-respond"><form><p>{w.text(1, 1)}</p></form></div></div>'
    article = f'<article id="post-{r.randint(1, 999)}" class="post-{r.randint(1, 999)} post {flags}"><{(h := r.choice(["header", "div"]))} class="entry-header"><h1 class="entry-title">{MARK}{w.words(2, 9)}</h1></{h}><div class="entry-content">{w.body(1, 12)}</div></article>'
    if r.random() < 0.3:
        article = f'<article class="{flags}"><h1>{MARK}{w.words(2, 9)}</h1>{w.body(1, 12)}</article>'
    side = f'<aside id="secondary" class="widget-area">' + "".join(f'<section class="widget"><h2>{w.words(1, 3)}</h2>{r.choice([w.links((2, 6)), "<p>" + w.text(1, 2) + "</p>"])}</section>' for _ in range(r.randint(1, 4))) + "</aside>"
    top = f'<header id="masthead" class="site-header"><p>{w.words(1, 4)}</p><nav class="main-navigation">{w.links()}</nav></header>'
    return _page(f'<div id="page" class="site">{w.maybe(0.9, top)}<div id="content" class="site-content"><div id="primary" class="content-area"><main class="site-main">{article}{w.maybe(0.5, comments)}</main></div>{w.maybe(0.6, side)}</div><footer class="site-footer"><p>{w.text(1, 2)}</p></footer></div>{w.maybe(0.3, w.notice)}', "", f' class="single {flags}"')


@family
def flagged(w: Writer) -> str:
    """An article in a container whose class mixes groups of words."""
    r = w.r
    own = r.choice(["post has-sidebar with-comments", "content no-ads", "article featured comments-open", "main-column share-bar-on", "story related-on", "page-body header-large", "text sidebar-left", "post-body menu-open", "entry ads-enabled newsletter", "page comments footer-off"])
    tag = r.choice(["div", "article", "section", "main"])
    return _page(f'{w.maybe(0.4, lambda: f"<nav>{w.links()}</nav>")}<{tag} class="{own}">{w.maybe(0.6, lambda: f"<h1>{MARK}{w.words(1, 8)}</h1>")}{w.body(2, 14)}{w.maybe(0.1, w.advert)}</{tag}>{w.maybe(0.3, lambda: f"<aside>{w.links()}<p>{w.text(1, 1)}</p></aside>")}{w.maybe(0.4, lambda: f"<footer>{w.words(2, 9)}</footer>")}')


@family
def blog(w: Writer) -> str:
    """A hosted blog: post body with breaks in place of paragraphs, gadgets at the side."""
    r = w.r
    text = f"{MARK}{w.paragraph()}" + "".join(f"<br /><br />{w.paragraph()}" for _ in range(r.randint(0, 7))) if r.random() < 0.5 else w.body(1, 9)
    comments = f'<div class="comments" id="comments"><h4>{w.words(1, 3)}</h4>' + "".join(f'<div class="comment-block"><cite>{w.word()}</cite><p class="comment-content">{w.remark()}</p></div>' for _ in range(r.randint(1, 5))) + "</div>"
    gadgets = "".join(f'<div class="widget"><h2>{w.words(1, 3)}</h2><div class="widget-content">{r.choice([w.links(), w.text(1, 2)])}</div></div>' for _ in range(r.randint(1, 4)))
    return _page(f'<div class="header-outer"><h2>{w.words(1, 3)}</h2><p class="description">{w.words(2, 7)}</p></div><div class="tabs-outer">{w.links((2, 5))}</div><div class="main-outer"><div class="post-outer"><div class="post hentry"><h3 class="post-title entry-title">{MARK}{w.words(2, 8)}</h3><div class="post-body entry-content">{text}</div></div>{w.maybe(0.6, comments)}</div><div class="column-right-outer sidebar">{gadgets}</div></div><div class="footer-outer">{w.words(2, 8)}</div>')


@family
def cells(w: Writer) -> str:
    """A layout of table cells: links at the left, the text in the middle, a line at the bottom."""
    r = w.r
    left = f'<td {r.choice(["width=150", "class=left", "valign=top"])}>{"<br>".join(w.link() for _ in range(r.randint(3, 9)))}</td>'
    main = f'<td {r.choice(["", "class=main", "valign=top"])}>{w.maybe(0.6, lambda: f"<h1>{MARK}{w.words(1, 8)}</h1>")}{w.body(1, 10, plain=True)}</td>'
    right = w.maybe(0.3, lambda: f"<td class=right><b>{w.words(1, 2)}</b><br>{w.link()}<br>{w.link()}</td>")
    top = w.maybe(0.5, lambda: f"<tr><td colspan=3 class=header>{w.words(1, 5)}</td></tr>")
    return _page(f"<table width=100%>{top}<tr>{left}{main}{right}</tr><tr><td colspan=3 class=footer>{w.words(2, 6)} &copy;</td></tr></table>")


@family
def manual(w: Writer) -> str:
    """Documentation: a tree of links, headings, lists and code."""
    nav = f'<div class="{w.r.choice(["sidebar", "toctree", "menu"])}"><h3>{w.words(1, 2)}</h3>{w.links((4, 20))}</div>'
    main = f'<div class="{w.r.choice(["document", "body", "content", "markdown"])}"{w.maybe(0.5, " role=main")}><h1>{MARK}{w.words(1, 5)}</h1>' + "".join(f"<section id={w.name()}><h2>{MARK}{w.words(1, 5)}</h2>{w.body(1, 4)}{w.maybe(0.4, lambda: f'<div class=highlight><pre>{MARK}{w.words(5, 40)}</pre></div>')}</section>" for _ in range(w.r.randint(1, 5))) + "</div>"
    parts = [nav, main] if w.r.random() < 0.6 else [main, nav]
    return _page(f'{w.maybe(0.5, lambda: f"<header>{w.link()}</header>")}<div class="wrapper">{"".join(parts)}</div><footer>{w.words(2, 8)}</footer>')


@family
def semantic(w: Writer) -> str:
    """Elements that say what they are, without classes."""
    article = f'<article><h1>{MARK}{w.words(2, 8)}</h1>' + (w.body(2, 12) if w.r.random() < 0.6 else "".join(f"<section>{w.maybe(0.7, lambda: f'<h2>{MARK}{w.words(1, 5)}</h2>')}{w.body(1, 4)}</section>" for _ in range(w.r.randint(1, 4)))) + "</article>"
    return _page(f"{w.maybe(0.7, lambda: f'<header><h2>{w.words(1, 3)}</h2></header>')}{w.maybe(0.7, lambda: f'<nav>{w.links()}</nav>')}<main>{article}{w.maybe(0.3, lambda: f'<aside><h3>{w.words(1, 2)}</h3>{w.links()}<p>{w.text(1, 2)}</p></aside>')}</main>{w.maybe(0.3, lambda: f'<form><p>{w.text(1, 1)}</p><input></form>')}{w.maybe(0.8, lambda: f'<footer><p>{w.text(1, 2)}</p></footer>')}")


@family
def portal(w: Writer) -> str:
    """A news portal with made-up class names: paragraphs in blocks, lists of links between them."""
    c = lambda: f'class="{w.r.choice(["sc", "css", "x"])}-{w.name()}"'
    text = "".join(f"<div {c()}><p {c()}>{MARK}{w.paragraph()}</p></div>" for _ in range(w.r.randint(2, 12)))
    more = f'<div {c()}><h3>{w.words(1, 3)}</h3>{w.links((3, 8))}</div>'
    return _page(f'<div {c()}><header {c()}>{w.link()}<nav {c()}>{w.links()}</nav></header><div {c()}><div {c()}><h1 {c()}>{MARK}{w.words(3, 10)}</h1><div {c()}>{text}</div></div>{w.maybe(0.6, lambda: f"<aside {c()}>{more}</aside>")}{w.maybe(0.4, w.advert)}</div><footer {c()}><p>{w.text(1, 2)}</p>{w.links()}</footer></div>{w.maybe(0.4, w.notice)}')


@family
def regions(w: Writer) -> str:
    """Modular software: regions of blocks, the text as a field of a node."""
    side = "".join(f'<div class="block block-menu"><h2>{w.words(1, 2)}</h2><div class="content">{w.r.choice([w.links(), "<p>" + w.text(1, 2) + "</p>"])}</div></div>' for _ in range(w.r.randint(1, 3)))
    node = f'<div class="node node-article node-promoted"><h2 class="title">{MARK}{w.words(2, 7)}</h2><div class="content"><div class="field field-name-body"><div class="field-items"><div class="field-item even">{w.body(1, 12)}</div></div></div></div></div>'
    talk = f'<div id="comments" class="comment-wrapper">' + "".join(f'<div class="comment"><div class="content"><p>{w.remark()}</p></div></div>' for _ in range(w.r.randint(1, 4))) + "</div>"
    return _page(f'<div id="header"><div class="region region-header">{w.words(1, 4)}</div></div><div id="main"><div class="region region-content"><div id="block-system-main" class="block"><div class="content">{node}{w.maybe(0.4, talk)}</div></div></div>{w.maybe(0.6, lambda: f"<div class=\'region region-sidebar-first sidebar\'>{side}</div>")}</div><div id="footer"><div class="region region-footer">{w.text(1, 2)}</div></div>', "", ' class="html not-front one-sidebar page-node"')


@family
def wiki(w: Writer) -> str:
    """A wiki: contents box in the text, navigation after it."""
    toc = f'<div id="toc" class="toc"><h2>{w.word()}</h2>{w.links((3, 9))}</div>'
    text = w.body(1, 3, True) + w.maybe(0.6, toc) + "".join(f'<h2>{MARK}{w.words(1, 4)}</h2>{w.body(1, 4)}' for _ in range(w.r.randint(1, 4)))
    return _page(f'<div id="content" class="mw-body"><h1 id="firstHeading">{MARK}{w.words(1, 6)}</h1><div id="bodyContent"><div class="mw-parser-output">{text}</div></div></div><div id="mw-navigation"><h2>{w.words(1, 2)}</h2><div class="portal"><h3>{w.word()}</h3>{w.links()}</div></div><div id="footer"><ul><li>{w.text(1, 1)}</li><li>{w.link()}</li></ul></div>')


def pages(n: int, seed: int, families: tuple[str, ...] | None = None):
    """``n`` pages of the families in turn (all but the held-out ones by default)."""
    names = [f for f in FAMILIES if f not in HELD_OUT] if families is None else list(families)
    r = random.Random(seed)
    for i in range(n):
        yield FAMILIES[names[i % len(names)]](Writer(r))
