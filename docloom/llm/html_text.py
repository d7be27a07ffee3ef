"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: the text between two block-level tags, with the tags, class and id words of its
ancestors. Scripts, styles, comments and the head hold no blocks. Each block has ancestor features (tags; hashed class
and id words) and text features (length, share of text in links, punctuation, digits, place). The CRF has two labels,
main text and rest, a weight for each (feature, label) and each pair of neighbouring labels; it is trained by maximum
likelihood (forward-backward in numpy, all pages at once) on labelled pages, by default ones that `labelled_pages` writes
in many layouts from a seed, and decoded by Viterbi.

Defined results: null or empty html, and pages without main text, give the empty text. A line break tag is white space.
Unclosed and crossing tags close as far as needed; a tag without its `>` is text. White space is Unicode's, no-break spaces included. Very long pages
are read whole. Repeated rows give equal texts; other columns don't matter.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

SEED, PAGES, STEPS, WORD_BUCKETS = 11, 500, 160, 1024
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title svg math iframe object canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Where a tag begins. Its name can't share characters with what follows, so nothing is read twice.
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/><]*))")
_STOP = re.compile("""[>"']""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_DIGIT = re.compile(r"\d")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in HIDDEN}


@functools.lru_cache(maxsize=20_000)
def _words(attributes: str) -> tuple[str, ...]:
    """The words of a tag's class, id and role."""
    return tuple(sorted({w for n in _NAMES.findall(attributes) for x in n if x for w in _WORD.findall(_CAMEL.sub(r"\1 \2", x).lower())}))


class _Source:
    """A page and where its tags end. What a search has found, or that there is nothing left to find, is remembered, so
    that reading a page takes time in proportion to its length whatever it holds."""

    def __init__(self, page: str):
        self.page, self.ends, self.quotes = page, {}, True

    def _next(self, what: str, at: int, search) -> tuple[int, int] | None:
        """The first match from `at` on."""
        known = self.ends.get(what, (-1, -1))
        if known is not None and known[0] < at:
            known = self.ends[what] = search(at)
        return known

    def find(self, what: str, at: int) -> int:
        """Just behind the next `what`; -1 if there is none."""
        def search(at: int):
            k = self.page.find(what, at)
            return None if k < 0 else (k, k + len(what))

        found = self._next(what, at, search)
        return -1 if found is None else found[1]

    def hidden_end(self, tag: str, at: int) -> int:
        def search(at: int):
            m = _ENDS[tag].search(self.page, at)
            return m and m.span()

        found = self._next(f"/{tag}", at, search)
        return -1 if found is None else found[1]

    def tag_end(self, at: int) -> int:
        """Just behind a tag's `>`, which quoted values may hold; -1 if there is none. Where a quote would swallow the
        rest of the page, quotes are plain characters from there on."""
        if self.quotes:
            here = at
            while m := _STOP.search(self.page, here):
                if m[0] == ">":
                    return m.end()
                here = self.find(m[0], m.end())
                if here < 0:
                    break
            self.quotes = False
        return self.find(">", at)


class _Path:
    """The open block-level elements, and the features of them all: a score under a model, or the set of features."""

    def __init__(self, lead: list[float] | None):
        self.lead, self.count, self.score, self.open, self.places = lead, {}, 0.0, [], {}

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        found = _element(tag, words)
        for f in found:
            n = self.count[f] = self.count.get(f, 0) + 1
            if n == 1 and self.lead:
                self.score += self.lead[f]
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, found))

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            tag, found = self.open.pop()
            self.places[tag].pop()
            for f in found:
                n = self.count[f] = self.count[f] - 1
                if not n and self.lead:
                    self.score -= self.lead[f]

    def nearest(self, tags) -> int:
        """The place of the innermost open element of one of the tags; -1 if none is open."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def innermost(self) -> str:
        return self.open[-1][0] if self.open else ""

    def value(self):
        own = len(TAGS) + _TAG_AT[self.innermost()] if self.innermost() in _TAG_AT else None
        if self.lead:
            return self.score + (self.lead[own] if own is not None else 0.0)
        return tuple(sorted({f for f, n in self.count.items() if n} | ({own} if own is not None else set())))


def blocks(page: str, lead: list[float] | None = None) -> list[tuple[object, str, int, str]]:
    """(its ancestors' features, or their score under `lead`; text, its characters inside links, innermost tag) of each
    leaf block, in page order."""
    out: list[tuple[object, str, int, str]] = []
    path, source = _Path(lead), _Source(page)
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((path.value(), text, min(linked, len(text)), path.innermost()))
            parts.clear()
        linked = 0

    end, seen = len(page), 0  # text from `at` on, tags looked for from `seen` on
    while at < end:
        stop = page.find("<", seen)
        m = _OPEN.match(page, stop) if stop >= 0 else None
        if stop < 0:
            stop = closed = end
        elif not m:
            seen = stop + 1
            continue
        elif m[1]:
            closed = source.find("-->", m.end())
            closed = end if closed < 0 else closed
        else:
            closed = source.find(">", m.end()) if m[2] else source.tag_end(m.end())
            if closed < 0:  # no tag ends any more: the rest is text, but for comments
                seen = m.end()
                continue
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked += stop - at
        at = seen = closed
        if not m or m[1] or m[2]:
            continue
        tag, closing, names = m[4].lower(), m[3], page[m.end() : closed - 1]
        if tag in HIDDEN:
            if not closing and not names.endswith("/"):
                found = source.hidden_end(tag, at)
                if found >= 0:
                    at = seen = found
                elif tag in ("script", "style"):
                    at = seen = end
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if closing:
            k = path.nearest((tag,))
            if k >= 0:
                path.cut(k)
                in_link = False
            continue
        if tag in CLOSES_P and path.innermost() == "p":
            path.cut(len(path.open) - 1)
        if tag in SAME:
            k = path.nearest(SAME[tag])
            if k > path.nearest(SCOPE[tag] - SAME[tag]):
                path.cut(k)
        if tag in VOID:
            continue
        path.push(tag, (_words if len(names) < 200 else _words.__wrapped__)(names) if "=" in names else ())
    flush()
    return out


TAGS = "html body nav header footer aside article main section div form ul ol li table td figure figcaption blockquote pre p h1 h2 h3 h4 h5 h6 button select option textarea fieldset dl dialog menu address details summary".split()
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
BASE = 2 * len(TAGS)
TEXT_NAMES = ["bias", "len<=2", "len<=5", "len<=10", "len<=25", "len<=60", "len>60", "links>0.2", "links>0.8", "stop", "no stop", "comma", "digits", "copyright", "first", "last", "after heading", "bars"]
WIDTH = BASE + WORD_BUCKETS + len(TEXT_NAMES)


@functools.lru_cache(maxsize=50_000)
def _element(tag: str, words: tuple[str, ...]) -> tuple[int, ...]:
    """Features of an open element: its tag, and the words of its class, id and role."""
    return tuple({*([_TAG_AT[tag]] if tag in _TAG_AT else []), *(BASE + zlib.crc32(w.encode()) % WORD_BUCKETS for w in words)})


def _text_features(text: str, linked: int, first: bool, last: bool, headed: bool) -> list[int]:
    n, at = text.count(" ") + 1, BASE + WORD_BUCKETS
    found = [at, at + (1 if n <= 2 else 2 if n <= 5 else 3 if n <= 10 else 4 if n <= 25 else 5 if n <= 60 else 6)]
    if linked * 5 > len(text):
        found.append(at + 7)
        if linked * 5 > 4 * len(text):
            found.append(at + 8)
    found.append(at + (9 if text[-1] in ".!?…。\"”»" else 10))
    for k, on in ((11, "," in text), (12, bool(_DIGIT.search(text))), (13, "©" in text), (14, first), (15, last), (16, headed), (17, "|" in text or "»" in text)):
        if on:
            found.append(at + k)
    return found


def _rows(found: list[tuple[object, str, int, str]]) -> list[tuple[tuple[int, ...], list[int]]]:
    out, headed = [], False
    for k, (features, text, linked, tag) in enumerate(found):
        out.append((features, _text_features(text, linked, k == 0, k == len(found) - 1, headed)))
        headed = headed or tag == "h1"
    return out


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[list[tuple[str, bool]]]:
    """Pages as pieces of html, each with whether its text is main text. Layouts, names and lengths vary."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkéèüñß"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", "", "..."])
    prose = lambda: " ".join(sentence(1, 18) for _ in range(rng.choice([1, 1, 2, 4, 9, 20])))
    name = lambda *c: rng.choice(["class", "id", "class"]) + f'="{rng.choice(c)}"'

    def boiler(tag: str, attributes: str, *inner: str) -> list[tuple[str, bool]]:
        return [(f"<{tag} {attributes}>" + "".join(inner) + f"</{tag}>", False)]

    links = lambda k: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))
    short = lambda: rng.choice([sentence(3, 14), prose(), words(1, 5)])

    def ad(): return boiler(rng.choice(["div", "aside", "section", "p"]), name("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "google-ad"), short())
    def menu(): return boiler(*rng.choice([("nav", ""), ("div", name("nav", "menu", "navigation", "topnav", "main-menu", "breadcrumb", "breadcrumbs")), ("ul", name("menu", "nav", "navbar", "tabs"))]), f"<ul>{links(rng.randint(2, 8))}</ul>" if rng.random() < 0.8 else f"<a href=/>{words(1, 2)}</a> | <a href=/x>{words(1, 2)}</a>")
    def header(): return boiler(*rng.choice([("header", ""), ("div", name("header", "site-header", "masthead", "page-header", "top"))]), rng.choice(["<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "{}"]).format(short()))
    def footer(): return boiler(*rng.choice([("footer", ""), ("footer", ""), ("div", name("footer", "site-footer", "copyright", "bottom", "legal"))]), rng.choice(["&copy; ", "", "&copy; 2020 "]), short(), rng.choice(["", f"<ul>{links(3)}</ul>"]))
    def side(): return boiler(*rng.choice([("aside", ""), ("div", name("sidebar", "side", "related", "widget", "right-rail", "recommended", "trending", "popular"))]), rng.choice([f"<h3>{words(1, 3)}</h3>", ""]), rng.choice([f"<ul>{links(4)}</ul>", f"<p>{prose()}</p>", f"<p>{short()}</p>"]))
    def notice(): return boiler(rng.choice(["div", "section", "dialog", "p"]), name("cookie-notice", "cookie", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "paywall", "disclaimer", "popup", "modal"), short(), rng.choice(["", "<button>ok</button>"]))
    def form(): return boiler("form", rng.choice(["", name("search", "login", "signup", "subscribe", "contact")]), f"<label>{words(1, 3)}</label><input name=q>", rng.choice([f"<p>{short()}</p>", f"<select><option>{word()}<option>{word()}</select>", ""]), f"<button>{word()}</button>")
    def share(): return boiler(rng.choice(["div", "ul", "p"]), name("share", "social", "tags", "meta", "byline-share", "toolbar", "pagination", "pager"), f'<a href="#">{word()}</a> <a href="#">{word()}</a>')
    def comments():
        each = lambda: rng.choice(['<div class="comment"><b>{}</b><p>{}</p></div>', '<li class="comment"><p>{1}</p></li>', '<article class="comment"><p>{1}</p></article>', '<div class="reply"><p>{1}</p></div>']).format(word(), prose())
        return boiler(rng.choice(["section", "div", "ol", "aside"]), name("comments", "comment-list", "replies", "discussion", "responses", "disqus"), rng.choice([f"<h2>{words(1, 2)}</h2>", f"<h3>{words(1, 3)}</h3>", ""]), *[each() for _ in range(rng.randint(1, 4))])

    out = []
    for _ in range(n):
        top = [f() for f in rng.sample([menu, header, ad, notice, form, menu], rng.choice([0, 0, 1, 2, 3, 4, 5]))]
        box, mid, low = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div {name('content', 'post', 'entry', 'article-body', 'story', 'main-content', 'post-body', 'text', 'page')}>", "</div>"), ('<div id="main"><div>', "</div></div>"), ("<section>", "</section>"), ("<div>", "</div>"), ("", "")]), [], []
        if rng.random() < 0.85:
            title = f"<h1>{words(1, 12)}</h1>"
            mid.append([(f"<header>{title}</header>" if "article" in box[0] and rng.random() < 0.15 else title, True)])
        loose = rng.random() < 0.3
        for _ in range(rng.choice([1, 2, 3, 6, 12, 25])):
            r, t = rng.random(), prose()
            body = f"<p>{t}" if loose else f"<p>{t}</p>" if r < 0.75 else f"<h2>{words(1, 8)}</h2>" if r < 0.82 else f"<ul>{''.join(f'<li>{sentence(1, 14)}</li>' for _ in range(3))}</ul>" if r < 0.88 else f"<blockquote>{t}</blockquote>" if r < 0.92 else f"<div>{t}</div>" if r < 0.96 else f"<table><tr><td>{words(1, 3)}<td>{words(1, 3)}</table>" if r < 0.98 else f"<pre>{t}</pre>"
            if rng.random() < 0.15:
                body = body.replace(" ", ' <a href="/x">' + word() + "</a> ", 1)
            if rng.random() < 0.2:
                body = body.replace("<p>", "<p><b>", 1)
            mid.append([(body, True)])
            if rng.random() < 0.08:
                mid.append(rng.choice([ad, share, notice, form, side, menu])())
        if rng.random() < 0.25:
            (mid if rng.random() < 0.5 else low).append(comments())
        low += [f() for f in rng.sample([side, ad, share, footer, comments, form, menu, notice], rng.choice([0, 0, 1, 2, 3]))]
        low.append(footer() if rng.random() < 0.7 else [])
        flat = lambda x: [p for part in x for p in part]
        out.append([("<!DOCTYPE html><html><head><title>t</title></head><body>", False), *flat(top), (box[0], False), *flat(mid), (box[1], False), *flat(low), ("</body></html>", False)])
    return out


#: Put before the texts of labelled pages: main text or rest. Private characters, taken out before features are made.
_MAIN, _REST = "\ue000", "\ue001"


def examples(pages: list[list[tuple[str, bool]]]) -> list[tuple[list[tuple[tuple[int, ...], list[int]]], np.ndarray]]:
    """Feature rows and labels of each page's blocks: a block is main text if the piece that its text comes from is."""
    out = []
    for pieces in pages:
        marked = "".join(re.sub(r">([^<]*[^<\s][^<]*)(?=<|$)", lambda m, to=_MAIN if main else _REST: f">{to}{m[1]}", p) for p, main in pieces)
        found = blocks(marked)
        clean = [(features, t.replace(_MAIN, "").replace(_REST, "").strip() or "-", linked, tag) for features, t, linked, tag in found]
        out.append((_rows(clean), np.array([_MAIN in t for _, t, _, _ in found], np.int64)))
    return out


@functools.lru_cache(maxsize=2)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train(examples(labelled_pages()))


def train(data: list, steps: int = STEPS, rate: float = 0.15, ridge: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights: features x 2, transitions 2 x 2): maximum likelihood with a ridge, by Adam; pages side by side."""
    data = [d for d in data if len(d[1])]
    n, longest = len(data), max(len(d[1]) for d in data)
    live, y = np.zeros((longest, n), bool), np.zeros((longest, n), np.int64)
    rows, cols = [], []
    for k, (feats, labels) in enumerate(data):
        live[: len(labels), k], y[: len(labels), k] = True, labels
        for t, (a, b) in enumerate(feats):
            own = [*a, *b]
            rows += [t * n + k] * len(own)
            cols += own
    rows, cols = np.array(rows), np.array(cols)
    w, tr = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    each = np.arange(n)
    for step in range(1, steps + 1):
        emit = np.stack([np.bincount(rows, w[cols, c], longest * n) for c in (0, 1)], -1).reshape(longest, n, 2)
        fwd, bwd = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        fwd[0] = emit[0]
        for t in range(1, longest):
            fwd[t] = np.where(live[t, :, None], np.logaddexp.reduce(fwd[t - 1][:, :, None] + tr, 1) + emit[t], fwd[t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[t] = np.where(live[t + 1, :, None], np.logaddexp.reduce(tr + (emit[t + 1] + bwd[t + 1])[:, None, :], 2), 0)
        z = np.logaddexp.reduce(fwd[-1], 1)
        p = np.exp(fwd + bwd - z[None, :, None]) * live[:, :, None]
        pair = np.exp(fwd[:-1, :, :, None] + tr + (emit[1:] + bwd[1:])[:, :, None, :] - z[None, :, None, None]) * live[1:, :, None, None]
        g = -p
        t_at, k_at = np.nonzero(live)
        g[t_at, k_at, y[t_at, k_at]] += 1
        gw = np.stack([np.bincount(cols, g.reshape(-1, 2)[rows, c], WIDTH) for c in (0, 1)], -1) / n - ridge * w
        gt = -pair.sum((0, 1))
        for t in range(1, longest):
            on = each[live[t]]
            np.add.at(gt, (y[t - 1, on], y[t, on]), 1)
        gt = gt / n - ridge * tr
        for x, grad, k in ((w, gw, 0), (tr, gt, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * grad * grad
            x += rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 1] / (1 - 0.99**step)) + 1e-8)
    return w, tr


def viterbi(scores: list[float], tr: np.ndarray) -> list[bool]:
    """Labels of a page; scores: how far the features put `main` ahead of `rest` in each block."""
    (a, b), (c, d) = tr.tolist()
    rest, main, back = 0.0, scores[0] if scores else 0.0, []
    for s in scores[1:]:
        to_rest, to_main = main + c > rest + a, main + d >= rest + b
        back.append((to_rest, to_main))
        rest, main = (main + c if to_rest else rest + a), (main + d if to_main else rest + b) + s
    label, out = main > rest, []
    for to_rest, to_main in reversed(back):
        out.append(label)
        label = to_main if label else to_rest
    return [*([label] if scores else []), *reversed(out)]


class Extractor:
    """A model ready for pages."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]):
        self.lead, self.tr = (model[0][:, 1] - model[0][:, 0]).tolist(), model[1]

    def __call__(self, page: str | None) -> str:
        found = blocks(page or "", self.lead)
        scores, headed, last = [], False, len(found) - 1
        for k, (score, text, linked, tag) in enumerate(found):
            scores.append(score + sum([self.lead[i] for i in _text_features(text, linked, k == 0, k == last, headed)]))
            headed = headed or tag == "h1"
        return "\n".join(f[1] for f, main in zip(found, viterbi(scores, self.tr)) if main)


def extract(pages: DataFrame, html_col: str = "html", model=None) -> DataFrame:
    """pages with `text` in the place of the html (an earlier column `text` is replaced)."""
    columns = [c for c in pages.columns if c not in ("text", html_col)]
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Extractor(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([of(h) for h in part.column(part.num_columns - 1).to_pylist()], pa.string())], [*columns, "text"])

    return pages.select(*columns, html_col).transform(in_arrow, main_text, pages.select(columns).schema.add("text", "string"))


def op10_html_crf(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
