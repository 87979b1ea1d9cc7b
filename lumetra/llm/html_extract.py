"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A tolerant reader builds the tree of a page's block elements. Each block element gets features of itself and
of its surroundings (tag, attribute tokens, text and link density of its subtree, depth, place among its
siblings), and the trees give the log-odds that its subtree holds article text. Decoding chooses the labels of
all nodes at once: a node can only be kept under a kept parent, and a kept node brings its own log-odds and
those of the children that are worth keeping. So an ancestor and a descendant never contradict each other.

The trees are fitted on the driver on a bounded list of generated pages with known article text: ``TRAINING_PAGES``
of mixed layouts and ``TEMPLATE_PAGES`` of the site families of ``page_templates``, among them pages without any frame.

Defined results: null or empty html has an empty text; broken markup is read as far as it makes sense (an
unclosed comment, script or tag ends with the page, an end tag without a start is no tag); repeated rows repeat their
result; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, page_templates

TRAINING_PAGES, TEMPLATE_PAGES = 700, 600

# Fixed values of HTML: elements without content, with raw content, shown as blocks, and never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("head script style textarea title xmp iframe noembed noframes template svg noscript select option optgroup audio video".split())
HEADS = frozenset("base link meta title style script noscript template".split())
CELLS, TABLE_PARTS = frozenset("td th table".split()), frozenset("td th tr table tbody thead tfoot".split())
#: What a start tag closes if it is open, and the element beyond which it doesn't look.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
CLOSES_P = BLOCK - frozenset("caption body html legend option optgroup summary tbody td tfoot th thead tr li dd dt".split())
#: Words in class, id and role that speak for or against article text.
GROUPS = {
    "menu": "nav menu menubar navbar navigation breadcrumb breadcrumbs tabs toolbar topbar pagination pager toc skip sitemap categories",
    "frame": "header masthead footer banner bottom top colophon copyright legal logo brand site contentinfo",
    "side": "sidebar side aside widget widgets rail complementary related recommended recommendations more popular trending recent archive tags tagcloud teaser promo",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promoted promotion banner dfp outbrain taboola",
    "notice": "cookie cookies consent notice alert popup modal overlay dialog gdpr message warning paywall subscribe newsletter signup",
    "talk": "comment comments commentlist reply replies respond discussion disqus thread feedback reactions reader",
    "form": "form search login signin contact input field share social sharing follow",
    "text": "article content post entry story main body text page articlebody maintext copy prose richtext blog single hentry",
}
WORDS = {w: g for g, ws in GROUPS.items() for w in ws.split()}
GROUP_NAMES = list(GROUPS)
TAG_CLASSES = {"p": 1, "h1": 2, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "li": 4, "ul": 5, "ol": 5, "menu": 5, "dl": 5, "blockquote": 6, "pre": 6, "figure": 6, "figcaption": 6, "table": 7, "tbody": 7, "tr": 7, "td": 7, "th": 7, "article": 8, "main": 9, "nav": 10, "aside": 11, "header": 12, "footer": 13, "form": 14, "section": 15, "body": 16, "html": 17}
TAGS = re.compile(r"<(?:(!--.*?(?:-->|$))|(![^>]*>?|\?[^>]*>?)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>)", re.S)
OPEN_END = re.compile(r"<(?:(!--.*$)|(![^>]*|\?[^>]*)|(/?)(?!)()())", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile("[ \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
TOKEN = re.compile("[a-z]+")
#: Class names that say what a page has or allows, and not what the element is.
FLAG = re.compile(r"(?<![\w-])(?:(?:has|with|no|show|hide|is)[-_][\w-]+|[\w-]+[-_](?:open|closed|on|off|enabled|disabled|free))(?![\w-])")


class Node:
    """A block element of the page."""

    __slots__ = ("tag", "parent", "depth", "words", "children", "place", "chars", "links", "blocks", "paragraphs", "stops", "own", "first", "hidden")

    def __init__(self, tag: str, parent: int, depth: int, words: list[str], place: int, hidden: bool):
        self.tag, self.parent, self.depth, self.words, self.place, self.hidden = tag, parent, depth, words, place, hidden
        self.children = self.chars = self.links = self.blocks = self.paragraphs = self.stops = self.own = 0
        self.first = -1


class _Open:
    """The open elements as a stack that knows where each kind stands, so that no tag makes the reader walk down."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []  # (tag, its block element)
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.cells: list[int] = []

    def push(self, tag: str, node: int) -> None:
        k = len(self.stack)
        self.stack.append((tag, node))
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCK:
            self.blocks.append(k)
        if tag in CELLS:
            self.cells.append(k)

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        k = len(self.stack)
        for places in (self.at.get(tag), self.blocks, self.cells):
            if places and places[-1] == k:
                places.pop()
        return tag

    def forget(self, k: int) -> None:
        """The innermost element of its kind, an inline one at place ``k``, ends without what is open inside it."""
        tag, node = self.stack[k]
        self.at[tag].pop()
        self.stack[k] = ("", node)

    def last(self, *tags: str) -> int:
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, and the blocks of text as (element, text).

    Text of buttons stays where it is part of a sentence; a block that only buttons make is a control and is left out.
    """
    nodes = [Node("html", -1, 0, [], 0, False)]
    opened = _Open()
    opened.push("html", 0)
    stack = opened.stack
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    linked = pressed = 0  # characters of the piece inside links, and those that aren't blank inside and outside buttons
    plain = 0
    hidden = 0

    def flush() -> None:
        nonlocal linked, pressed, plain
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip(" ")
            if text and not (pressed and not plain):
                at = stack[-1][1]
                node = nodes[at]
                if node.first < 0:
                    node.first = len(blocks)
                node.own += len(text)
                blocks.append((at, text))
                node.chars += len(text)
                node.links += min(linked, len(text))
                node.blocks += 1
                node.stops += sum(map(text.count, ".!?,;"))
                node.paragraphs += node.tag == "p"
            pieces.clear()
        linked = pressed = plain = 0

    def close(k: int) -> None:
        nonlocal hidden
        flush()
        while len(stack) > k:
            hidden -= opened.pop() in HIDDEN

    def text_of(raw: str) -> None:
        nonlocal linked, pressed, plain
        if raw and not hidden:
            decoded = entities.unescape(raw) if "&" in raw else raw
            pieces.append(decoded)
            if opened.at.get("a"):
                linked += len(decoded)
            if opened.at.get("button"):
                pressed += not decoded.isspace()
            else:
                plain += not decoded.isspace()

    at, end, last = 0, len(page), page.rfind(">") + 1
    while at < end:
        # after the last bracket no tag ends, but a comment or declaration may start
        m = TAGS.search(page, at, last) if at < last else OPEN_END.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<(?:[a-zA-Z/!?])", rest)  # a tag that never ends
            text_of(rest[: cut.start()] if cut else rest)
            break
        text_of(page[at : m.start()])
        at = m.end()
        if m[4] is None:
            if m[1] and not m[1].endswith("-->"):
                break  # a comment that never ends
            continue  # a comment, a doctype or an instruction
        tag = m[4].lower()
        if m[3]:
            k = opened.last(tag)
            if tag == "br":
                pieces.append(" ")
            elif k < 1:
                if tag == "p":
                    flush()
            elif tag in TABLE_PARTS or not opened.cells or opened.cells[-1] <= k:
                if tag in BLOCK or tag in HIDDEN:
                    close(k)
                elif opened.blocks and opened.blocks[-1] > k:
                    opened.forget(k)  # an inline element closed across blocks
                else:
                    while len(stack) > k:
                        opened.pop()
            continue
        if tag in RAW and not m[5].rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag == "html":
            continue
        if stack[-1][0] == "head" and tag not in HEADS:
            close(len(stack) - 1)
        if tag in BLOCK:
            if (tag in CLOSES_P or tag in IMPLIED) and (k := opened.last("p")) > 0 and opened.blocks[-1] == k:
                close(k)
            if tag in IMPLIED:
                ends, beyond = IMPLIED[tag]
                while (k := opened.last(*ends)) > opened.last(*beyond):
                    close(k)
                    if tag != "tr":
                        break
            flush()
            parent = stack[-1][1]
            found = " ".join(x for t in ATTRIBUTE.findall(m[5]) for x in t).lower() if "=" in m[5] else ""
            up = nodes[parent]
            up.children += 1
            nodes.append(Node(tag, parent, up.depth + 1, TOKEN.findall(FLAG.sub(" ", found)), up.children, tag in HIDDEN))
            opened.push(tag, len(nodes) - 1)
        else:
            opened.push(tag, stack[-1][1])
        hidden += tag in HIDDEN
    flush()
    for n in reversed(nodes[1:]):  # a node stands after its parent, so its subtree is summed before it is passed on
        up = nodes[n.parent]
        up.chars, up.links, up.blocks, up.stops, up.paragraphs = up.chars + n.chars, up.links + n.links, up.blocks + n.blocks, up.stops + n.stops, up.paragraphs + n.paragraphs
    return nodes, blocks


FEATURES = 22 + 2 * len(GROUPS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node; subtree counts are those of the whole page's reader."""
    rows = []
    total = max(nodes[0].chars, 1)
    above: list[tuple[int, ...]] = []
    within: list[tuple[int, int]] = []  # how many ancestors frame the page, and how many hold articles
    subtree = [1] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        subtree[nodes[i].parent] += subtree[i]
    for i, n in enumerate(nodes):
        up = nodes[n.parent] if n.parent >= 0 else n
        own = [0] * len(GROUPS)
        for w in n.words:
            g = WORDS.get(w)
            if g is not None:
                own[GROUP_NAMES.index(g)] += 1
        outer = above[n.parent] if n.parent >= 0 else (0,) * len(GROUPS)
        above.append(tuple(min(a + b, 3) for a, b in zip(own, outer, strict=True)))
        kind = TAG_CLASSES.get(n.tag, 0)
        around, inside = within[n.parent] if n.parent >= 0 else (0, 0)
        if n.parent >= 0:
            around, inside = around + (up.tag in ("nav", "aside", "header", "footer", "form")), inside + (up.tag in ("article", "main"))
        within.append((around, inside))
        chars = max(n.chars, 1)
        rows.append((
            kind, TAG_CLASSES.get(up.tag, 0), min(n.depth, 20), n.place, up.children, n.children, np.log1p(n.chars), n.links / chars, n.blocks, n.paragraphs, n.chars / max(n.blocks, 1), n.stops / chars * 100,
            n.chars / total, n.chars / max(up.chars, 1), up.links / max(up.chars, 1), np.log1p(n.own), subtree[i] / chars * 100, around, inside, up.paragraphs, i / len(nodes), len(n.words), *own, *outer,
        ))
    return np.array(rows, dtype=np.float64)


def decode(nodes: list[Node], blocks: list[tuple[int, str]], odds: np.ndarray) -> str:
    """The kept blocks' text under the best labelling without contradictions."""
    gain = odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].hidden or not nodes[i].chars:
            gain[i] = -1e9
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = np.zeros(len(nodes), dtype=bool)
    for i, n in enumerate(nodes):
        kept[i] = gain[i] > 0 and (n.parent < 0 or kept[n.parent])
    return "\n".join(text for at, text in blocks if kept[at])


def training_pages(n: int = TRAINING_PAGES, seed: int = 3):
    """Generated pages: html in which every article block starts with the mark U+E000 and no other does."""
    r = random.Random(seed)
    letters = "the of and to in is on for with as that was by at from le la de et que des un une der die und das el los que con para mit von zu auf".split()
    parts = "an be co de el fa ga hi in jo ka le mi no or pa ra sa ti un ve wi th st er on re ou ing tion ble nd é ß ñ ü".split()
    word = lambda: r.choice(letters) if r.random() < 0.4 else "".join(r.choice(parts) for _ in range(r.randint(1, 4)))

    def sentence(a: int, b: int) -> str:
        s = " ".join(word() for _ in range(r.randint(a, b)))
        return s[:1].upper() + s[1:] + "."

    def text(least: int = 1, most: int = 6) -> str:
        return " ".join(sentence(1 if r.random() < 0.15 else 3, 18) for _ in range(r.randint(least, most)))

    attr = lambda *names: "" if r.random() < 0.25 else f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", "-" + word(), " " + word()])}"'
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 3)))}</a>'
    must = lambda *names: f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", "-" + word(), " " + word()])}"'

    def menu() -> str:
        items = [link() for _ in range(r.randint(2, 9))]
        body = r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"])
        return f"<nav{attr('menu', 'navbar')}>{body}</nav>" if r.random() < 0.7 else f"<div{must('nav', 'menu', 'navigation', 'breadcrumb')}>{body}</div>"

    def ad() -> str:
        return f"<div{must('ad', 'ads', 'advert', 'sponsored', 'banner-ad', 'promo')}>{r.choice([text(1, 2), '<p>' + text(1, 2) + '</p>', link()])}</div>"

    def notice() -> str:
        return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{must('cookie', 'cookie-banner', 'notice', 'consent', 'alert', 'newsletter', 'modal')}>{r.choice(['<p>%s</p>', '%s', '<p>%s</p><button>OK</button>']) % text(1, 3)}</{t}>"

    def form() -> str:
        return f"<form action='/s'{attr('search', 'login', 'contact-form')}><label>{sentence(1, 4)}</label><p>{text(1, 2)}</p><input name=q><button>{word()}</button></form>"

    def side() -> str:
        inner = "".join(r.choice([f"<h3>{sentence(1, 4)}</h3>", f"<p>{text(1, 2)}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{link()}</p>"]) for _ in range(r.randint(1, 4)))
        return f"<aside{attr('sidebar', 'widget', 'related')}>{inner}</aside>" if r.random() < 0.5 else f"<{(t := r.choice(['div', 'section']))}{must('sidebar', 'related', 'widget', 'recommended', 'side')}>{inner}</{t}>"

    def comments() -> str:
        one = lambda: r.choice([f"<div{must('comment', 'reply')}><b>{word()}</b><p>{text(1, 4)}</p></div>", f"<li{attr('comment')}><p>{text(1, 3)}</p></li>", f"<p>{text(1, 3)}</p>", f"<article{must('comment')}><p>{text(1, 3)}</p></article>"])
        return f"<{(t := r.choice(['div', 'section', 'section', 'ol', 'ul']))}{must('comments', 'comment-list', 'discussion', 'reader-comments', 'replies', 'respond')}>{r.choice(['', '<h2>' + sentence(1, 3) + '</h2>', '<h3>' + sentence(1, 2) + '</h3>'])}{''.join(one() for _ in range(r.randint(1, 5)))}</{t}>"

    def header() -> str:
        inner = r.choice([f"<p>{sentence(1, 6)}</p>", sentence(1, 4), f"<h2>{sentence(1, 4)}</h2>", f"<div>{link()}</div>"]) + (menu() if r.random() < 0.4 else "")
        return f"<header{attr('masthead', 'top')}>{inner}</header>" if r.random() < 0.65 else f"<div{must('header', 'masthead', 'topbar', 'site-header')}>{inner}</div>"

    def footer() -> str:
        inner = r.choice([f"&copy; {word()} &middot; {text(1, 2)}", f"<p>{text(1, 2)}</p>", f"<p>&copy; 2020 {word()}</p>{menu()}", "".join(f"<p>{link()}</p>" for _ in range(3))])
        return f"<footer>{inner}</footer>" if r.random() < 0.7 else f"<div{must('footer', 'site-footer', 'copyright', 'bottom')}>{inner}</div>"

    mark = "\ue000"

    def article() -> str:
        out = []
        if r.random() < 0.85:
            out.append(f"<h1{attr('title', 'entry-title')}>{mark}{sentence(1, 10)}</h1>")
        if r.random() < 0.1:
            out = [f"<header>{out[0]}</header>"] if out else out
        for k in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            p = r.random()
            body = text(1, 6)
            if k == 0 and r.random() < 0.4:
                out.append(f"<p><b>{mark}{body}<br><p>{mark}{text()}</p>")
            elif p < 0.72:
                out.append(f"<p{attr('lead') if r.random() < 0.1 else ''}>{mark}{body}{r.choice(['', '', ' ' + link() + ' ' + sentence(2, 6), ' <em>' + word() + '</em> &amp; ' + word()])}{r.choice(['</p>', '</p>', '</p>', ''])}")
            elif p < 0.78:
                out.append(f"<h{(h := r.randint(2, 4))}>{mark}{sentence(1, 6)}</h{h}>")
            elif p < 0.84:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}>{''.join(f'<li>{mark}{text(1, 2)}</li>' for _ in range(r.randint(1, 5)))}</{t}>")
            elif p < 0.88:
                out.append(f"<blockquote>{r.choice([f'<p>{mark}{body}</p>', mark + body])}</blockquote>")
            elif p < 0.92:
                out.append(f"<table><tr><th>{mark}{word()}</th><th>{mark}{word()}</th></tr><tr><td>{mark}{word()}</td><td>{mark}{sentence(1, 5)}</td></tr></table>")
            elif p < 0.95:
                out.append(f"<figure><img src=x><figcaption>{mark}{sentence(2, 8)}</figcaption></figure>")
            elif p < 0.97:
                out.append(f"<pre>{mark}{text(1, 2)}</pre>")
            else:
                out.append(f"<div>{mark}{body}</div>")
            if r.random() < 0.05:
                out.append(r.choice([ad, notice, side, form])())
        inner = "".join(out)
        if r.random() < 0.55:
            inner = f"<article{attr('post', 'entry', 'hentry')}>{inner}{comments() if r.random() < 0.06 else ''}</article>"
        elif r.random() < 0.5:
            inner = f"<main{attr('content', 'main')}>{inner}</main>"
        else:
            inner = f"<{(t := r.choice(['div', 'div', 'section']))}{must('content', 'post', 'entry-content', 'story', 'article-body', 'main', 'text', 'post-body')}>{inner}</{t}>"
        if r.random() < 0.2:
            inner = f"<{(t := r.choice(['main', 'div', 'section']))}{attr('main', 'content', 'page', 'wrapper')}>{inner}{side() if r.random() < 0.3 else ''}</{t}>"
        return inner

    for _ in range(n):
        before = [f() for f in (header, menu, notice, ad, form, side) if r.random() < (0.55 if f in (menu, ad) else 0.25)]
        r.shuffle(before)
        after = [f() for f in (comments, side, ad, form, notice, menu) if r.random() < 0.28]
        r.shuffle(after)
        body = "".join([*before, "<!-- ad 0 -->" if r.random() < 0.5 else "", article(), *after, footer() if r.random() < 0.85 else ""])
        if r.random() < 0.3:
            body = f"<div{attr('wrapper', 'container', 'page', 'site')}>{body}</div>"
        yield f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{body}</body></html>"


def marked_blocks(page: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, 1 where the subtree holds article text) of the nodes of a page with marks."""
    nodes, blocks = parse(page)
    wanted = np.zeros(len(nodes))
    for at, text in blocks:
        while "\ue000" in text and at >= 0:
            wanted[at] = 1
            at = nodes[at].parent
    return features(nodes), wanted


@functools.lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, templates: int = TEMPLATE_PAGES, families: tuple[str, ...] = tuple(page_templates.FAMILIES)) -> boosting.Trees:
    """Trees fitted on generated pages: does a node's subtree hold article text?"""
    known = [marked_blocks(p) for p in (*training_pages(pages), *page_templates.pages(templates, 3, families))]
    x, y = (np.concatenate(c) for c in zip(*known, strict=True))
    return boosting.fit(x, y, rounds=60, depth=5, rate=0.2, least=6)


def extract(pages: list[str], model: boosting.Trees) -> list[str]:
    """Main texts of a list of pages."""
    parsed = [parse(p or "") for p in pages]
    sizes = np.cumsum([0, *(len(n) for n, _ in parsed)])
    odds = model.raw(np.concatenate([features(n) for n, _ in parsed])) if parsed else np.empty(0)
    return [decode(n, b, odds[a:e]) for (n, b), a, e in zip(parsed, sizes[:-1], sizes[1:], strict=True)]


def extract_pages(pages: DataFrame, at_once: int = 400) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                texts = extract(part["html"].to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
