"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read once from front to back: tags, raw-text elements, comments and unclosed or stray tags are told apart, and
the text between block-level tags becomes the leaf blocks, each with its open elements, their class and id words, and the
share of its text in links. Features of a block are its ancestors' tags, what their names say (nearest first), and the
shape of its text. A two-label chain (boilerplate, main text) scores features per block and the step from block to block; it
is trained by maximum likelihood on labelled pages (``training_pages`` makes them from a seed: layouts, wrappers, names and
words vary, the label of each block is known) and decoded by Viterbi.

Defined cases: a null, empty or textless page has an empty text; a text without markup is its own main text; an unclosed comment, script or tag runs to the page's end;
unknown character references stay as they are; white space, non-breaking too, becomes one blank; null and repeated page ids
are carried through; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.store import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
HIDDEN = frozenset("script style noscript template title iframe svg math object head canvas noframes noembed".split())
RAW = frozenset("script style title iframe noframes noembed textarea xmp".split())
#: Tags whose start closes an open element of the second set, not looking past the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
PARAGRAPH = ({"p"}, {"button", "td", "th", "object", "table"})
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

#: What names of elements say: fixed words, compared with the parts of class, id and role.
NAMES = {
    "nav": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs"},
    "header": {"header", "masthead", "banner", "topbar", "branding", "logo"},
    "footer": {"footer", "copyright", "colophon", "bottom", "contentinfo", "legal"},
    "side": {"side", "sidebar", "aside", "widget", "related", "recommended", "recommend", "trending", "popular", "promo", "complementary", "rail", "more"},
    "ad": {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promoted", "banner", "dfp", "gpt"},
    "comment": {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "responses"},
    "notice": {"cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "privacy", "message"},
    "share": {"share", "sharing", "social", "tags", "meta", "byline", "author", "bio", "buttons", "toolbar", "search", "login", "form"},
    "main": {"content", "article", "post", "entry", "story", "body", "main", "text", "prose", "page"},
}
#: What notices of rights say: fixed words.
RIGHTS = ("©", "(c) ", "copyright", "all rights reserved", "derechos reservados", "tous droits réservés", "alle rechte vorbehalten")
_NAMED = {word: kind for kind, words in reversed(NAMES.items()) for word in words}
_ANCESTORS = frozenset("article main nav header footer aside form ul ol table section blockquote pre figure figcaption button label select dialog menu address details".split())


class Element(NamedTuple):
    """An open element and what it and those around it say; sets are shared with the element around where nothing is new."""

    name: str = ""
    tag: str = "none"  # the innermost that isn't inline
    up: frozenset[str] = frozenset()  # of _ANCESTORS
    near: str = "none"  # the kind of NAMES said last
    said: frozenset[str] = frozenset()

    def inner(self, name: str, kinds: tuple[str, ...]) -> Element:
        up = self.up if name not in _ANCESTORS or name in self.up else self.up | {name}
        said = self.said if self.said.issuperset(kinds) else self.said.union(kinds)
        return Element(name, self.tag if name in INLINE else name, up, kinds[-1] if kinds else self.near, said)


@dataclass
class Block:
    text: str
    at: Element
    links: float


#: Names that speak of looks, such as text-xs or col-md-4: they say nothing about the content.
_LOOKS = re.compile(
    r"(?:text|font|bg|border|content|body)-(?:\d*[a-z]{2}|base|left|right|center|justify|start|end|muted|white|black|light|dark|bold|normal|italic|primary|secondary|small|large|(?:[a-z]+-)?\d+|[a-z]+-(?:xs|sm|md|lg|xl))"
    r"|(?:col|row|grid|flex|container|order|offset|gap|space|rounded|shadow)(?:-.*)?|[mpwh][trblxy]?-.*"
)


def _kinds(attrs: str) -> tuple[str, ...]:
    """What an element's names say. A name is judged as a whole: one of looks says nothing, and one that speaks of something beside the main text,
    such as page-footer or post-comments, says only that."""
    found = []
    for m in _ATTR.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if _LOOKS.fullmatch(name):
                continue
            own = [_NAMED[word] for word in _SPLIT.split(name) if word in _NAMED]
            found += [k for k in own if k != "main" or not set(own) - {"main"}]
    return tuple(dict.fromkeys(found))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a whole page, in order, in time and memory proportional to its length: places of open elements
    are kept by name, so none is searched for, and each element is closed once."""
    page = page or ""
    out: list[Block] = []
    open_ = [Element()]
    where: dict[str, list[int]] = {}  # places of the open elements of a name, ascending
    parts: list[str] = []
    linked = hidden = 0
    links = 0
    quoted = True  # whether quotes protect a tag's ">"; not any more after one that never ends

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, open_[-1], min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def close_to(k: int) -> None:
        nonlocal hidden, links
        while len(open_) > k:
            name = open_.pop().name
            where[name].pop()
            hidden -= name in HIDDEN
            links -= name == "a"

    def last(names) -> int:
        found = 0
        for x in names:
            if (at_ := where.get(x)) and at_[-1] > found:
                found = at_[-1]
        return found

    def say(text: str) -> None:
        nonlocal linked
        if not hidden and text:
            parts.append(text)
            if links:
                linked += len(text)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 2 if page.startswith("<!-->", lt) else lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        closing = nxt == "/"
        if not (nxt.isascii() and nxt.isalpha()) and not (closing and page[lt + 2 : lt + 3].isalpha()):
            if nxt in ("!", "?") or closing:
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
            else:
                say("<")
                at = lt + 1
            continue
        m = _TAG.match(page, lt) if quoted else None
        if m:
            name, attrs, at = m[1].lower(), m[2], m.end()
        else:  # a quote that never ends
            quoted = False
            stop = page.find(">", lt)
            if stop < 0:
                break
            inner = page[lt + 1 + closing : stop].split(None, 1)
            name, attrs, at = inner[0].rstrip("/").lower(), inner[1] if len(inner) > 1 else "", stop + 1
        block = name not in INLINE
        if closing:
            if name == "br" or name == "p" and not where.get("p"):
                parts.append(" ")
            elif k := last((name,)):
                if block:
                    flush()
                close_to(k)
            continue
        if name in VOID:
            if block:
                flush()
            else:
                say(" ")
            continue
        if block:
            flush()
            own, stops = CLOSES.get(name, PARAGRAPH)
            if (k := last(own)) and k > last(stops):
                close_to(k)
            if name == "body" and where.get("head"):
                close_to(where["head"][0])
        if attrs.endswith("/") and name in ("svg", "math", "object", "iframe"):
            continue
        where.setdefault(name, []).append(len(open_))
        open_.append(open_[-1].inner(name, _kinds(attrs) if "=" in attrs else ()))
        hidden += name in HIDDEN
        links += name == "a"
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = found.start() if found else end
            if name == "textarea":
                say(page[at:stop])
            at = stop
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """The names of the features of each block."""
    rows = []
    n = len(found)
    heads = {"h1", "h2", "h3", "h4", "h5", "h6"}
    before = ""
    for k, b in enumerate(found):
        tag, near, up, said = b.at.tag, b.at.near, b.at.up, b.at.said
        words = b.text.count(" ") + 1
        size = next(s for s, most in (("1", 2), ("3", 6), ("7", 14), ("15", 30), ("31", 80), ("81", 1 << 60)) if words <= most)
        link = "0" if not b.links else "some" if b.links < 0.5 else "most"
        stop = b.text[-1] in ".!?:;\"'”»…"
        row = ["bias", f"tag={tag}", f"size={size}", f"link={link}", f"stop={stop}", f"near={near}", f"size+link={size}{link}", f"size+stop={size}{stop}", f"before={before}"]
        row += [f"in={t}" for t in up] + [f"name={x}" for x in said]
        if not up & {"nav", "header", "footer", "aside", "form", "button", "label", "select", "dialog", "menu"} and not said - {"main"}:
            row.append("plain")
            row.append(f"plain+tag={tag}")
        if up & {"article", "main"} or "main" in said:
            row.append("inside")
            if "plain" in row:
                row += ["inside+plain", f"inside+plain+tag={tag}"]
        if tag in heads:
            row.append("head")
            if "header" in up:
                row.append(f"head+header={'inside' in row}")
        if k < 0.1 * n:
            row.append(f"early={'inside' in row}{'plain' in row}")
        if k >= 0.9 * n:
            row.append(f"late={'inside' in row}{'plain' in row}")
        low = b.text.lower()
        if any(x in low for x in RIGHTS):
            row += ["rights", f"rights+size={size}"]
        if n == 1:
            row.append("only")
        follows = found[k + 1].at if k + 1 < n else None
        then = "end" if follows is None else "form" if follows.up & {"form", "label", "button", "select"} else "links" if found[k + 1].links > 0.5 else "text"
        row += [f"then={then}", f"then+tag={then}{tag}"]
        if "plain" in row and b.at.up & {"ul", "ol", "table"}:
            row.append(f"listed+link={link}")
        before = "head" if tag in heads else tag
        rows.append(row)
    return rows


@dataclass
class Chain:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None  # features x 2
    steps: np.ndarray | None = None  # 2 x 2

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        get = self.index.get
        out = np.zeros((len(rows), 2))
        for k, row in enumerate(rows):
            at = [i for f in row if (i := get(f)) is not None]
            out[k] = self.weights[at].sum(axis=0)
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not rows:
            return []
        e = self.emissions(rows).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            from0, from1 = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 >= b + s11 else 1)
            back.append((from0, from1))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        labels = [int(b > a)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Weights of greatest likelihood, less a penalty on their squares, by full gradients (forward-backward)."""
    names = sorted({f for rows, _ in pages for row in rows for f in row})
    chain = Chain({f: i for i, f in enumerate(names)})
    t, p = max(len(y) for _, y in pages), len(pages)
    x = np.zeros((p, t, len(names)), np.float32)
    y, mask = np.zeros((p, t), int), np.zeros((p, t), bool)
    for i, (rows, labels) in enumerate(pages):
        for k, row in enumerate(rows):
            x[i, k, [chain.index[f] for f in row]] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    gold = np.eye(2)[y] * mask[..., None]
    pair_gold = np.einsum("pka,pkb->ab", gold[:, :-1], gold[:, 1:])
    flat = x[mask]
    w, s = np.zeros((len(names), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(a) for a in (w, w, s, s)]
    for step in range(1, rounds + 1):
        e = x @ w
        fwd, bwd = np.zeros((p, t, 2)), np.zeros((p, t, 2))
        fwd[:, 0] = e[:, 0]
        for k in range(1, t):
            fwd[:, k] = np.where(mask[:, k, None], np.logaddexp(fwd[:, k - 1, :1] + s[0], fwd[:, k - 1, 1:] + s[1]) + e[:, k], fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            nxt = bwd[:, k + 1] + e[:, k + 1]
            bwd[:, k] = np.where(mask[:, k + 1, None], np.logaddexp(nxt[:, :1] + s[:, 0], nxt[:, 1:] + s[:, 1]), bwd[:, k + 1])
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])[:, None, None]
        own = np.exp(fwd + bwd - total) * mask[..., None]
        two = np.exp(fwd[:, :-1, :, None] + s + (bwd + e)[:, 1:, None, :] - total[..., None]) * mask[:, 1:, None, None]
        grads = ((flat.T @ (gold - own)[mask]) / p - decay * w, (pair_gold - two.sum(axis=(0, 1))) / p - decay * s)
        for i, (param, g) in enumerate(zip((w, s), grads, strict=True)):
            moments[2 * i] = 0.9 * moments[2 * i] + 0.1 * g
            moments[2 * i + 1] = 0.99 * moments[2 * i + 1] + 0.01 * g * g
            param += rate * (moments[2 * i] / (1 - 0.9**step)) / (np.sqrt(moments[2 * i + 1] / (1 - 0.99**step)) + 1e-8)
    chain.weights, chain.steps = w, s
    return chain


def training_page(rng: random.Random) -> list[tuple[str, int]]:
    """A page as pieces (markup or text, label); the label of markup is -1."""
    out: list[tuple[str, int]] = []
    words = lambda lo, hi: " ".join("".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi)))
    sentence = lambda lo, hi: words(lo, hi).capitalize() + rng.choice(["."] * 6 + ["", "!", "?"])
    tag = lambda m: out.append((m, -1))
    say = lambda t, y: out.append((t, y))
    named = lambda kind: rng.choice([f' class="{{}}{rng.choice(["", "-box", "-wrap", " x1", "__inner"])}"', ' id="{}"', ' class="c-{}"']).format(rng.choice(sorted(NAMES[kind])))

    def wrapped(kinds: list[tuple[str, str]], fill) -> None:
        name, kind = rng.choice(kinds)
        tag(f"<{name}{named(kind) if kind and (name in ('div', 'section', 'ul', 'p', 'span') or rng.random() < 0.4) else ''}>")
        fill()
        tag(f"</{name}>")

    def links(lo: int, hi: int) -> None:
        tag("<ul>")
        for _ in range(rng.randint(lo, hi)):
            tag('<li><a href="/x">')
            say(words(1, 4), 0)
            tag("</a></li>" if rng.random() < 0.8 else "</a>")
        tag("</ul>")

    def lines(lo: int, hi: int, least: int = 2, most: int = 25) -> None:
        for _ in range(rng.randint(lo, hi)):
            name = rng.choice(["p", "div", "span", ""])
            tag(f"<{name}>" if name else "")
            say(sentence(least, most), 0)
            tag(f"</{name}>" if name else "")

    nav = lambda: wrapped([("nav", ""), ("nav", "nav"), ("div", "nav"), ("header", "header"), ("header", "")], lambda: links(2, 8))
    ad = lambda: wrapped([("div", "ad"), ("aside", "ad"), ("section", "ad"), ("ins", "ad"), ("p", "ad")], lambda: say(sentence(2, 30), 0))
    side = lambda: wrapped([("aside", ""), ("aside", "side"), ("div", "side"), ("section", "side")], lambda: (links(1, 5), lines(0, 3)) if rng.random() < 0.7 else lines(1, 4, 4, 50))
    notice = lambda: wrapped([("div", "notice"), ("section", "notice"), ("dialog", ""), ("p", "notice")], lambda: say(sentence(4, 40), 0))
    share = lambda: wrapped([("div", "share"), ("p", "share"), ("ul", "share")], lambda: say(words(1, 6), 0))

    def head() -> None:
        tag("<header>")
        if rng.random() < 0.5:
            name = rng.choice(["h1", "h1", "h2"])
            tag(f"<{name}>")
            say(words(1, 5), 0)
            tag(f"</{name}>")
        lines(0, 3, 1, 8)
        if rng.random() < 0.5:
            links(2, 6)
        tag("</header>")

    def form() -> None:
        tag(rng.choice(["<form>", '<form class="search">', '<div class="form"><form>']))
        for _ in range(rng.randint(1, 3)):
            name = rng.choice(["label", "button", "p", "option"])
            tag(f"<{name}>")
            say(words(1, 6), 0)
            tag(f"</{name}>")
        tag("</form>")

    def comments() -> None:
        def fill() -> None:
            tag("<h3>")
            say(words(1, 3), 0)
            tag("</h3>")
            for _ in range(rng.randint(1, 5)):
                name = rng.choice(["div", "li", "article", "p", "section"])
                tag(f"<{name}{named('comment') if rng.random() < 0.7 else ''}>")
                if name != "p" and rng.random() < 0.7:
                    tag("<p>")
                say(sentence(3, 70), 0)
                tag(f"</{name}>")

        wrapped([("section", "comment"), ("div", "comment"), ("ul", "comment"), ("aside", "comment")], fill)

    looks = lambda: f' class="{rng.choice(["text-xs", "col-md-4", "mt-4 p-2", "text-muted small", "row", "col-3", "flex gap-2", "wrap", "x9"])}"'

    def rail() -> None:
        """A column beside the text, told by its heading and what follows alone."""
        tag(f"<div{looks()}>")
        for _ in range(rng.randint(1, 2)):
            name = rng.choice(["h3", "h4", "h4", "h5", "strong"])
            tag(f"<{name}>" if name != "strong" else "<p><strong>")
            say(words(1, 3), 0)
            tag(f"</{name}>" if name != "strong" else "</strong></p>")
            form() if rng.random() < 0.5 else links(2, 6)
        tag("</div>")

    def tail() -> None:
        """Short words after the text, without links or names."""
        for _ in range(rng.randint(1, 2)):
            name = rng.choice(["div", "div", "p", "small"])
            tag(f"<{name}{looks()}>")
            say(rng.choice([words(1, 5).title(), words(2, 4) + " | " + words(1, 3), words(1, 2) + " · " + words(1, 2)]), 0)
            tag(f"</{name}>")

    def rights() -> str:
        year = f"{rng.randint(1990, 2030)} "
        return rng.choice(["&copy; ", "© ", "(c) ", "Copyright ", "Copyright © "]) + year + words(1, 6) + rng.choice([". All rights reserved.", "", ". Alle Rechte vorbehalten.", " - Todos los derechos reservados", ". Tous droits réservés."])

    def footer() -> None:
        def fill() -> None:
            say(rights() if rng.random() < 0.5 else sentence(2, 25), 0)
            if rng.random() < 0.4:
                links(2, 6)

        wrapped([("footer", ""), ("footer", ""), ("footer", "footer"), ("div", "footer")], fill)

    def article() -> None:
        if rng.random() < 0.8:
            inner = rng.random() < 0.2
            tag("<header><h1>" if inner else "<h1>")
            say(words(2, 12), 1)
            tag("</h1></header>" if inner else "</h1>")
        if rng.random() < 0.15:
            share()
        plain = ["div"] if rng.random() < 0.2 else ["p"] * 8 + ["div", "blockquote", "section"]
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.7:
                name = rng.choice(plain)
                tag(f"<{name}>" + rng.choice(["", "", "", "<b>", "<span>"]))
                say(sentence(40, 120) + " " + rng.choice(["Copyright", "All rights reserved", "copyright"]) + " " + sentence(10, 30) if rng.random() < 0.02 else words(2, 8).capitalize() if rng.random() < 0.15 else sentence(1, 120), 1)
                if rng.random() < 0.2:
                    tag('<a href="/y">')
                    say(words(1, 3), 1)
                    tag("</a>")
                tag(f"</{name}>" if name != "p" or rng.random() < 0.7 else rng.choice(["", "<br>"]))
            elif r < 0.8:
                name = rng.choice(["h2", "h3", "h4"])
                tag(f"<{name}>")
                say(words(1, 8), 1)
                tag(f"</{name}>")
            elif r < 0.87:
                name = rng.choice(["ul", "ul", "ol"])
                tag(f"<{name}>")
                bare = rng.random() < 0.5
                for _ in range(rng.randint(1, 6)):
                    tag("<li>")
                    say(words(1, 12) if bare else sentence(1, 25), 1)
                    if rng.random() < 0.1:
                        tag('<a href="/z">')
                        say(words(1, 2), 1)
                        tag("</a>")
                    tag(rng.choice(["</li>", ""]))
                tag(f"</{name}>")
            elif r < 0.9:
                name = rng.choice(["<table>", "<pre>", "<figure><figcaption>"])
                tag(name)
                if name == "<table>":
                    for row in range(rng.randint(1, 4)):
                        tag("<tr>")
                        for _ in range(2):
                            tag("<th>" if row == 0 else "<td>")
                            say(words(1, 4) if rng.random() < 0.7 else sentence(1, 20), 1)
                else:
                    say(sentence(1, 20), 1)
                tag("</table>" if "table" in name else "</pre>" if "pre" in name else "</figcaption></figure>")
            else:
                rng.choice([ad, share, side, notice, form])()

    if rng.random() < 0.1:  # a text without layout
        tag(rng.choice(["", "", "<html><body>", "<body>"]))
        opens, ends = rng.choice([("", ""), ("", "\n"), ("", "<br>"), ("", "<br><br>"), ("", "<p>"), ("<p>", "</p>"), ("<p>", "</p>"), ("<div>", "</div>"), ("<b>", "</b>")])
        for _ in range(rng.choice([1, 1, 2, 6])):
            tag(opens)
            say(words(1, 8) if rng.random() < 0.4 else sentence(1, 120), 1)
            tag(ends)
        return out

    tag("<html><head><title>x</title><style>p{}</style><script>var a='</p>';</script></head><body>")
    if rng.random() < 0.08:  # laid out by a table
        tag(rng.choice(["<table><tr><td>", '<table width="100%"><tbody><tr><td colspan="2">', "<center><table><tr><td>"]))
        rng.choice([lambda: links(2, 6), lambda: say(words(1, 4), 0), nav])()
        tag("</td></tr><tr><td>")
        if rng.random() < 0.5:
            rng.choice([lambda: links(3, 8), rail])()
            tag("</td><td>")
        article()
        tag("</td></tr><tr><td>")
        say(rights(), 0) if rng.random() < 0.7 else tail()
        tag("</td></tr></table></body></html>")
        return out
    for part in (notice, head, nav, ad, side, form, lambda: links(2, 6)):
        if rng.random() < 0.4:
            part()
    kind = rng.random()
    if kind < 0.4:
        start, end = rng.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<article class="post">', "</article>")])
    elif kind < 0.55:
        start, end = rng.choice(["<main>", '<main id="content">']), "</main>"
    else:
        start, end = f"<div{named('main') if kind < 0.8 else looks() if rng.random() < 0.7 else ''}>", "</div>"
    tag(start)
    article()
    if rng.random() < 0.25:
        comments()
    tag(end)
    for part in (ad, side, share, form, comments, notice, nav, rail, tail):
        if rng.random() < 0.3:
            part()
    if rng.random() < 0.7:
        footer()
    elif rng.random() < 0.9:
        name = rng.choice(["div", "p", "small", "center", "address"])
        tag(f"<{name}>")
        say(rights(), 0)
        tag(f"</{name}>")
    tag("</body></html>")
    return out


def training_pages(n: int = 600, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the blocks of n labelled pages. A block's label is told by a mark put at each labelled text."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        pieces = training_page(rng)
        marked = "".join(t if y < 0 else f"{'⓪①'[y]}{t}" for t, y in pieces)
        found = blocks(marked)
        labels = ["①" in b.text for b in found]
        for b in found:
            b.text = b.text.translate({0x24EA: None, 0x2460: None}).strip() or "x"
        if found:
            pages.append((features(found), [int(y) for y in labels]))
    return pages


@functools.cache
def chain(pages: int = 600, seed: int = 11) -> Chain:
    return train(training_pages(pages, seed))


def main_text(page: str | None, model: Chain) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, model.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """page_id, url and the main text of every page."""
    bounded_batches(pages.sparkSession, 500)
    model = model or chain()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string")
