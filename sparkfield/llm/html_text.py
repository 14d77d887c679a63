"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks, runs of text that no block-level tag
interrupts, each with features of its ancestors (tags, class and id words) and of its text.
The field labels every block content or not; it is trained on pages of known labels by the
forward-backward algorithm and decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textgrid import tidy

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
QUOTE = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as part of a page.
SILENT = frozenset("script style head title noscript template svg math iframe object textarea select option datalist canvas audio video".split())
RAW = frozenset("script style textarea title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACE = re.compile(r"\s+")

#: Words in class, id or role names, by what they speak for.
HINTS = {
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adslot adbox",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
    "comment": "comment comments reply replies discussion disqus respond",
    "notice": "cookie cookies consent notice gdpr popup modal newsletter subscribe signup alert overlay paywall banner",
    "side": "sidebar side widget related recommended recommendations aside rail trending popular",
    "foot": "footer copyright legal colophon bottom",
    "head": "header masthead topbar logo brand site-header",
    "social": "share sharing social follow",
    "form": "form login search signin",
    "content": "content article post entry main body story text page prose",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
TAGS = "nav header footer aside form article main section ul ol table figure figcaption blockquote pre button label dialog details dl address".split()
OWN = "p h1 h2 h3 h4 h5 h6 li td th div blockquote pre article section main body figcaption dt dd a span address".split()


@dataclass
class Block:
    text: str
    own: str
    tags: frozenset
    hints: frozenset
    linked: int


def _hints(attributes: str) -> frozenset:
    out = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out.add("hidden")
        elif name != "style":
            for w in re.split(r"[^a-z]+", value):
                if w in HINT_OF:
                    out.add(HINT_OF[w])
    return frozenset(out)


class Scanner:
    """Markup of a page, in time linear in its size: what was once sought to the end in vain is not sought again."""

    def __init__(self, html: str):
        self.html = html
        self.missing: set[str] = set()  # strings of which there are no more
        self.quoted = True

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.missing.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1; quotes hide it."""
        first = self.find(">", at)
        if first < 0 or not self.quoted:
            return first
        k = at
        while m := QUOTE.search(self.html, k):
            if m[0] == ">":
                return m.start()
            k = self.find(m[0], m.end()) + 1
            if not k:  # a quote that never ends hides nothing
                return first
        self.quoted = False  # no tag ends outside of quotes any more
        return first

    def __iter__(self):
        """(kind, text or tag, attributes): kind is text, open or close."""
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            k = html.find("<", at)
            if k < 0:
                k = n
            if k > at:
                yield "text", html[at:k], ""
                at = k
                continue
            if html.startswith("<!--", at):
                end = self.find("-->", at + 4)
                at = end + 3 if end >= 0 else n
                continue
            if html.startswith("<![CDATA[", at) and (end := self.find("]]>", at + 9)) >= 0:
                yield "text", html[at + 9 : end], ""
                at = end + 3
                continue
            m = NAME.match(html, at + 1)
            if html[at + 1 : at + 2] in ("!", "?"):
                end = self.find(">", at)
            else:
                end = self.tag_end(m.end()) if m else -1
            if end < 0:
                yield "text", "<", ""
                at += 1
                continue
            at = end + 1
            if not m:
                continue
            tag = m[2].lower()
            yield "close" if m[1] else "open", tag, html[m.end() : end]
            if not m[1] and tag in RAW:  # its text is no markup
                close = re.compile(f"</{tag}", re.I).search(html, at)
                at = close.start() if close else n


def blocks(html: str) -> list[Block]:
    """The page's leaf blocks in order; scripts, styles and the head have none."""
    out: list[Block] = []
    # tag, nearest block-level tag, tags and hints around
    stack: list[tuple[str, str, frozenset, frozenset]] = [("body", "body", frozenset(), frozenset())]
    silent, linked, text, where = 0, 0, [], None
    opened: Counter = Counter()
    no = frozenset()

    def flush():
        nonlocal linked, text, where
        if text:
            s = SPACE.sub(" ", "".join(text)).strip()
            if s:
                out.append(Block(s, where[1], where[2], where[3], min(linked, len(s))))
        linked, text, where = 0, [], None

    def pop(k: int):
        nonlocal silent
        while len(stack) > k:
            tag = stack.pop()[0]
            opened[tag] -= 1
            silent -= tag in SILENT

    for kind, tag, attributes in Scanner(html):
        if kind == "text":
            if not silent:
                s = unescape(tag)
                if where is None and not s.isspace():
                    where = stack[-1]
                text.append(s)
                if opened["a"]:
                    linked += len(s)
            continue
        if tag in ("br", "hr") or (tag == "img" and text):
            if tag == "hr":
                flush()
            elif text:
                text.append(" ")
            continue
        if tag in VOID:
            continue
        if kind == "open":
            if tag not in INLINE:
                flush()
                for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends here, and so does a list item before the next
                    t = stack[k][0]
                    if t == "p" or t in CLOSES.get(tag, no):
                        pop(k)
                        break
                    if t not in INLINE:
                        break
            if attributes.endswith("/") and tag not in RAW:
                continue
            _, own, tags, hints = stack[-1]
            more = _hints(attributes) if attributes else no
            stack.append((tag, own if tag in INLINE else tag, tags | {tag} if tag in TAGS_SET else tags, hints | more if more else hints))
            opened[tag] += 1
            silent += tag in SILENT
        else:
            if tag not in INLINE:
                flush()
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
    flush()
    return out


TAGS_SET = frozenset(TAGS)


def features(page: list[Block]) -> list[list[str]]:
    """Active features of each block; outside of a container it matters whether the page has one."""
    out = []
    inside = ["article" in b.tags or "main" in b.tags or "content" in b.hints for b in page]
    outside = "outside" if any(inside) else "no container"
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        f = ["1", f"own={b.own}" if b.own in OWN else "own=?"]
        f += [f"in={t}" for t in b.tags]
        f += [f"hint={h}" for h in b.hints]
        f.append("words=" + ("1" if words < 2 else "2" if words < 5 else "5" if words < 10 else "10" if words < 25 else "25"))
        share = b.linked / len(b.text)
        f.append("linked=" + ("0" if not share else "1" if share < 0.4 else "2" if share < 0.8 else "3"))
        if b.text[-1] in ".!?:;\"'”’…":
            f.append("ends")
        if "©" in b.text:
            f.append("sign")
        if not b.hints and not b.tags:
            f.append(f"bare, {outside}")
        place = "inside" if inside[i] else outside
        f += [place, f"{place}, {f[1]}", f"{place}, {'long' if words >= 10 else 'short'}"]
        f.append("at=" + ("0" if i < 3 else "2" if i >= len(page) - 3 else "1"))
        out.append(f)
    return out


# --- labelled pages -------------------------------------------------------------------------


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, dict[str, int]]]:
    """Generated pages of many layouts with the label (1 content, 0 not) of each block's text; every fifth is short, often without a title, and a fifth more have no container."""
    rng = np.random.default_rng(seed)
    syllables = ["th", "er", "on", "an", "re", "ti", "en", "la", "de", "ung", "que", "mor", "vel", "sa", "ki", "no"]
    one = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: bool(rng.random() < p)
    out = []
    for page_number in range(n + n // 5):
        labels: dict[str, int] = {}

        def say(label, lo, hi, stop="."):
            while True:
                s = " ".join("".join(one(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(lo, hi + 1)))).capitalize() + stop  # noqa: B023
                if labels.get(s, label) == label:  # noqa: B023
                    labels[s] = label  # noqa: B023
                    return s

        def cls(*names):
            name = one(names)
            return one([f' class="{name}"', f' id="{name}"', f' class="{name} x1"', f' class="site-{name}"'])

        def links(k, label=0):
            return "".join(f'<li><a href="/{i}">{say(label, 1, 3, "")}</a></li>' for i in range(k))

        def ad():
            return f"<{(t := one(['div', 'section', 'aside']))}{cls('ad', 'ads', 'advert', 'sponsored', 'promo')}>{one(['', '<p>'])}{say(0, 2, 30)}</{t}>"

        def paragraphs(k):
            parts = []
            for _ in range(k):
                r = rng.random()
                if r < 0.7:
                    s = say(1, *one([(1, 4), (10, 80), (20, 120)]))
                    if chance(0.2):
                        w = s.split(" ")
                        w[0] = one(["<b>{}</b>", '<a href="/x">{}</a>', "<em>{}</em>", "<b>{}"]).format(w[0])
                        s = " ".join(w)
                    parts.append(f"<p>{s}</p>" if chance(0.8) else f"<p>{s}")
                elif r < 0.78:
                    parts.append(f"<h2>{say(1, 2, 8, '')}</h2>")
                elif r < 0.86:
                    parts.append("<ul>" + "".join(f"<li>{say(1, 2, 20)}</li>" for _ in range(3)) + "</ul>")
                elif r < 0.9:
                    parts.append(f"<blockquote><p>{say(1, 5, 40)}</p></blockquote>")
                elif r < 0.93:
                    parts.append(f"<pre>{say(1, 4, 20)}</pre>")
                elif r < 0.96:
                    parts.append(f"<div>{say(1, 8, 60)}</div>")
                else:
                    parts.append("<table>" + "".join(f"<tr><td>{say(1, 1, 3, '')}</td><td>{say(1, 1, 4, '')}</td></tr>" for _ in range(2)) + "</table>")
                if chance(0.05):
                    parts.append(ad())
            return "".join(parts)

        def comments():
            inner = "".join(f"<{(t := one(['p', 'div', 'li']))}>{say(0, 3, 50)}</{t}>" for _ in range(int(rng.integers(1, 6))))
            return f"<{(t := one(['div', 'section', 'ol']))}{cls('comments', 'comment', 'comment-list', 'discussion', 'replies')}>{one(['', f'<h3>{say(0, 1, 3, "")}</h3>'])}{inner}</{t}>"

        page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a='<p>';</script></head><body>"
        if page_number >= n:  # no container: the text lies in the body, or in elements without a name
            page = one([page, "<html><body>", "<body>", ""])
            page += f"<nav><ul>{links(int(rng.integers(2, 7)))}</ul></nav>" if chance(0.35) else ""
            page += f"<div{cls('cookie', 'consent', 'notice')}><p>{say(0, 4, 30)}</p></div>" if chance(0.15) else ""
            page += ad() if chance(0.2) else ""
            page += f"<form><label>{say(0, 1, 3, '')}</label><input><button>{say(0, 1, 2, '')}</button></form>" if chance(0.1) else ""
            tag = one(["", "", "", "<div>", "<section>", "<center>"])
            if chance(0.25):  # but where there is one, other text is not content
                tag = one(["<article>", "<main>", "<div class='content'>"])
                stray = lambda: one(["<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>", "<span>{}</span>"]).format(say(0, 1, 30))
                page += stray() if chance(0.4) else ""
                page += f"{tag}{paragraphs(int(rng.integers(1, 6)))}</{re.findall('<(.*?)[ >]', tag)[0]}>{stray()}"
                out.append((page + "</body></html>", labels))
                continue
            page += tag + (f"<h1>{say(1, 1, 9, '')}</h1>" if chance(0.6) else "")
            page += one([lambda: say(1, 1, 60), lambda: f"<p>{say(1, 1, 60)}</p>", lambda: paragraphs(int(rng.integers(1, 8))), lambda: paragraphs(int(rng.integers(1, 8)))])()
            page += f"</{tag[1:]}" if tag else ""
            page += comments() if chance(0.15) else ""
            page += f"<aside><h3>{say(0, 1, 3, '')}</h3><ul>{links(3)}</ul></aside>" if chance(0.15) else ""
            page += f"<footer>{one(['', '<p>'])}{one(['', '© '])}{say(0, 1, 12)}</footer>" if chance(0.35) else ""
            out.append((page + one(["", "</body></html>"]), labels))
            continue
        if page_number % 5 == 4:
            tag = one(["<article>", "<main>", "<main><article>", f"<div{cls('content', 'article', 'post', 'entry-content', 'story')}>", "<article>"])
            inner = one([lambda: say(1, 1, 40), lambda: f"<p>{say(1, 1, 60)}</p>", lambda: f"<p>{say(1, 5, 60)}", lambda: f"<h1>{say(1, 1, 8, '')}</h1>", lambda: f"<div>{say(1, 3, 40)}</div>", lambda: f"<p>{say(1, 1, 5, '')}</p><p>{say(1, 5, 30)}</p>"])()
            page += f"<nav><ul>{links(3)}</ul></nav>" if chance(0.3) else ""
            page += tag + inner + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", tag)))
            page += f"<footer>{one(['', '<p>', '© '])}{say(0, 1, 12)}</footer>" if chance(0.5) else ""
            out.append((page + "</body></html>", labels))
            continue
        if chance(0.35):
            page += f"<div{cls('cookie', 'consent', 'notice', 'cookie-banner', 'gdpr')}><p>{say(0, 4, 30)}</p><button>{say(0, 1, 2, '')}</button></div>"
        if chance(0.5):
            page += f"<header{one(['', cls('header', 'masthead')])}><h1>{say(0, 1, 4, '')}</h1><p>{say(0, 2, 9)}</p></header>"
        if chance(0.85):
            page += f"<nav><ul>{links(int(rng.integers(3, 9)))}</ul></nav>" if chance(0.7) else f"<div{cls('nav', 'menu', 'navbar')}><ul>{links(5)}</ul></div>"
        if chance(0.6):
            page += ad()
        if chance(0.25):
            page += f"<form><label>{say(0, 1, 3, '')}</label><input><button>{say(0, 1, 2, '')}</button><p>{say(0, 3, 15)}</p></form>"
        if chance(0.2):
            page += f"<aside>{one(['', '<h3>' + say(0, 1, 3, '') + '</h3>'])}<ul>{links(4)}</ul><p>{say(0, 4, 30)}</p></aside>"
        title = f"<h1>{say(1, 2, 12, one(['', '.']))}</h1>" if chance(0.9) else ""
        if chance(0.2):
            title = f"<header>{title}</header>" if chance(0.15) else title + f"<h2>{say(1, 3, 10, '')}</h2>"
        tag = one(["<article>", "<article>", "<article>", "<main>", f"<div{cls('content', 'article', 'post', 'entry-content', 'story')}>", "<main><article>"])
        body = title + paragraphs(int(rng.integers(1, 15)))
        if chance(0.15):
            body += comments()
        if chance(0.12):
            body += f"<div{cls('share', 'social')}><a href='#'>{say(0, 1, 2, '')}</a></div>"
        if chance(0.1):
            body += f"<form><p>{say(0, 3, 15)}</p><button>{say(0, 1, 2, '')}</button></form>"
        if chance(0.1):
            body += f"<aside><p>{say(0, 3, 30)}</p></aside>"
        if chance(0.1):
            body += f"<footer><p>{say(0, 2, 12)}</p></footer>"
        if chance(0.1):
            body += f"<nav><ul>{links(3)}</ul></nav>"
        page += tag + body + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", tag)))
        if chance(0.3):
            page += comments()
        if chance(0.35):
            page += f"<{(t := one(['aside', 'div']))}{cls('sidebar', 'related', 'widget')}><h3>{say(0, 1, 3, '')}</h3><ul>{links(4)}</ul><p>{say(0, 5, 30)}</p></{t}>"
        if chance(0.9):
            page += f"<footer>{one(['', '<p>'])}© {say(0, 1, 3, '')} · {say(0, 2, 20)}</footer>" if chance(0.8) else f"<div{cls('footer', 'copyright')}>{say(0, 2, 20)}</div>"
        out.append((page + "</body></html>", labels))
    return out


@dataclass
class Field:
    weights: dict[str, tuple[float, float]]
    start: tuple[float, float]
    move: tuple[tuple[float, float], tuple[float, float]]


def train(pages: list[tuple[str, dict[str, int]]], epochs: int = 300, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward over all pages at once; unlabelled blocks count as not content."""
    data = []
    for html, labels in pages:
        page = blocks(html)
        if page:
            data.append((features(page), [labels.get(b.text, 0) for b in page]))
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in data for row in fs for f in row}))}
    n, t, k = len(data), max(len(y) for _, y in data), len(names)
    x, y, real = np.zeros((n, t, k)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (rows, labels) in enumerate(data):
        for j, row in enumerate(rows):
            x[i, j, [names[f] for f in row]] = 1
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
    w, start, move = np.zeros((k, 2)), np.zeros(2), np.zeros((2, 2))
    sums = [np.full(p.shape, 1e-6) for p in (w, start, move)]
    hot = np.eye(2)[y] * real[:, :, None]
    flat, each = x.reshape(-1, k), np.arange(n)
    last = real.sum(1) - 1
    for _ in range(epochs):
        e = (flat @ w).reshape(n, t, 2)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = start + e[:, 0]
        for j in range(1, t):
            a[:, j] = np.logaddexp.reduce(a[:, j - 1, :, None] + move, axis=1) + e[:, j]
        for j in range(t - 2, -1, -1):
            b[:, j] = np.where(real[:, j + 1, None], np.logaddexp.reduce(move + (e[:, j + 1] + b[:, j + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(a[each, last], axis=1)
        p = np.exp(a + b - z[:, None, None]) * real[:, :, None]
        pair = np.exp(a[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        grads = [flat.T @ (hot - p).reshape(-1, 2) / n, (hot[:, 0] - p[:, 0]).mean(0), (np.einsum("ija,ijb->ab", hot[:, :-1], hot[:, 1:]) - pair.sum((0, 1))) / n]
        for q, s, g in zip((w, start, move), sums, grads, strict=True):
            g = g - decay * q
            s += g * g
            q += rate * g / np.sqrt(s)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, tuple(start.tolist()), tuple(map(tuple, move.tolist())))


@lru_cache(2)
def default_field(n: int = 400) -> Field:
    return train(labelled_pages(n))


def viterbi(field: Field, rows: list[list[str]]) -> list[int]:
    """The likeliest labels of a page."""
    none = (0.0, 0.0)
    (m00, m01), (m10, m11) = field.move
    back, s0, s1 = [], *field.start
    for i, row in enumerate(rows):
        e0 = e1 = 0.0
        for f in row:
            w = field.weights.get(f, none)
            e0 += w[0]
            e1 += w[1]
        if i:
            x0, x1 = s0 + m00, s1 + m10
            y0, y1 = s0 + m01, s1 + m11
            back.append((int(x1 > x0), int(y1 > y0)))
            s0, s1 = max(x0, x1) + e0, max(y0, y1) + e1
        else:
            s0, s1 = s0 + e0, s1 + e1
    if not rows:
        return []
    out = [int(s1 > s0)]
    for b in reversed(back):
        out.append(b[out[-1]])
    return out[::-1]


def main_text(field: Field, html: str | None) -> str:
    page = blocks(html or "")
    return "\n\n".join(b.text for b, y in zip(page, viterbi(field, features(page)), strict=True) if y)


@tidy
def _extract(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), 200):
            part = b.slice(lo, 200)
            texts = [main_text(field, h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """The main text of every row of ``pages(page_id, url, html)``.

    Blocks in page order joined by an empty line; white space inside a block is one space.
    A null or empty html gives an empty text, and so does a page without content; where no
    element is named as a container of content, what is neither menu, notice, advert nor the
    like counts. Very long pages are taken whole, in time linear in their size. Repeated rows
    get equal texts; null ids and urls are kept; further columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    field = field or default_field()
    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(lambda it: _extract(it, field), "page_id long, url string, text string, n_chars long")
