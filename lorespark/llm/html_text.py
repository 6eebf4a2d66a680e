"""Main text of web pages by a recurrent block labeller.

A page is cut in linear time into leaf blocks (runs of text between block-level tags;
scripts, styles, markup comments and the head give none).  Each block is a vector: hashed
elements of its tag path (names, classes, ids, roles), hashed words, and a few
measures (length, share of link text, of digits, of punctuation).  A
bidirectional LSTM reads the page's blocks in order, and its two states label
each block as article or not with the context of the whole document.

The network is in numpy and trained here, once a process, on generated pages
(``generated_page``) in which every block's label is known by construction.  In about
half of them the article's holder has an unknown name or none, or all names are made
up, or the page is a table, or has no tags at all, so that context and measures must
serve where names don't.

Defined results: a null or empty page, or one without article blocks, has the
empty text; a null page_id or url is carried; repeated rows each give a row; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, strings, table

PATH_DIMS, WORD_DIMS, MEASURES = 160, 16, 6
WIDTH = PATH_DIMS + WORD_DIMS + MEASURES
STATES = 12
PAGES, EPOCHS, SEED = 2_400, 12, 17
#: Characters that tags without an end may cost to read; then quotes aren't minded any more.
UNCLOSED_CHARS = 1 << 25

# Element names of the HTML standard by their role.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea noembed noframes svg math object canvas head".split())

# Words by which pages name their parts.
_ARTICLE = ["article", "main", "div class=post", "div class=entry-content", "div class=article-body", "div id=content", "section class=story", "div class=text", "div id=main-content class=post-content", "div class='blog-post body'"]
_MENU = ["nav", "div class=menu", "ul class=nav", "div id=navigation", "div class=breadcrumb", "div class=pagination", "div role=navigation", "div class=toolbar"]
_TOP = ["header", "div id=header", "div class=site-header", "div class=masthead", "div class=top-bar", "header class=page-header role=banner"]
_BOTTOM = ["footer", "div id=footer", "div class=site-footer", "div class=copyright", "footer class=page-footer role=contentinfo"]
_SIDE = ["aside", "div class=sidebar", "div class=widget", "div class=related", "section class='related-posts'", "div id=sidebar", "aside class=recommended", "div class='most-read'"]
_AD = ["div class=ad", "div class=ads", "div class=advert", "div class='ad-banner sponsored'", "div class=promo", "div id=advertisement", "ins class=adsbygoogle", "aside class=ad", "section class=sponsor"]
_NOTICE = ["div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div class=consent", "div class='alert message'", "div class=popup", "div class=gdpr", "dialog", "div role=alert", "div class='modal subscribe'"]
_FORM = ["form", "div class=newsletter", "form class=search", "form id=login", "div class='signup subscribe'", "form class=contact"]
_COMMENTS = ["section class=comments", "div id=comments", "div class=comment-list", "ol class=comments", "div class='discussion responses'", "section id=respond", "div class=reader-comments"]

_PART = re.compile(r"[^\W_]+")
#: The places in a vector of parts of tag paths that mean something; any other class, id or
#: role has the place 0, so that it looks like none of these.
_PARTS = BLOCK | set("a abbr b cite code em i ins q small span strong sub sup time u".split())
_PARTS |= {f".{part}" for names in (_ARTICLE, _MENU, _TOP, _BOTTOM, _SIDE, _AD, _NOTICE, _FORM, _COMMENTS, ["x logo author comment page wrapper container"]) for said in names for part in _PART.findall(re.sub(r"class=|id=|role=|^\w+", " ", said))}
_PLACES = {part: k for k, part in enumerate(sorted(_PARTS), 1)}

#: Comments, declarations, and tags: attributes as the HTML standard reads them (a
#: quote inside a name or a bare value is part of it).  A tag whose quote is never
#: closed ends at the next ``>``.
_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>|"""
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++|(?=>)))?+)*+)>|"""
    r"""<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


#: The same without a thought for quotes, groups numbered alike.
_SIMPLE_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>|()()()<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)


class Place:
    """An open element: its parts of a tag path, after its parent's, and all of them as
    bits, so that a block costs the same at any depth."""

    __slots__ = ("parent", "own", "bits")

    def __init__(self, parent: Place | None, own: list[str]):
        self.parent, self.own = parent, own
        self.bits = parent.bits if parent else 0
        for part in own:
            self.bits |= 1 << _PLACES.get(part, 0)

    def path(self) -> list[str]:
        """Names, and classes, ids and roles, from the top."""
        out, place = [], self
        while place:
            out.append(place.own)
            place = place.parent
        return [part for own in reversed(out) for part in own]


def blocks(page: str) -> list[tuple[Place, str, float]]:
    """(place, text, share of link text) of the leaf blocks, in page order."""
    out: list[tuple[Place, str, float]] = []
    top = Place(None, [])
    stack: list[tuple[str, Place]] = []
    is_open: Counter = Counter()
    unended: set[str] = set()
    parts: list[str] = []
    linked, at = 0, 0
    in_link = 0
    last, token, cost = page.rfind(">"), _TOKEN, 0

    def leave(k: int) -> None:
        for name, _ in stack[k:]:
            is_open[name] -= 1
        del stack[k:]

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((stack[-1][1] if stack else top, text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    while True:
        m = token.search(page, at) if at <= last else None
        start = m.start() if m else len(page) if (end := page.find("<!--", at)) < 0 else end
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        if not m:
            break
        at = m.end()
        ends, name, marked = (m.group(k) or m.group(k + 3) or "" for k in (1, 2, 3))
        name = name.lower()
        if m.group(5) and token is _TOKEN:  # its quotes may have been looked for to the page's end
            cost += len(page) - start
            if cost > UNCLOSED_CHARS:
                token = _SIMPLE_TAG
        if not name:
            continue
        if name in RAW and not ends:
            if not marked.endswith("/") and name not in unended:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at) if at <= last else None
                at = end.end() if end else len(page) if name != "head" else at
                if not end:
                    unended.add(name)
            continue
        block = name in BLOCK
        if block:
            close()
        elif name == "br":
            parts.append(" ")
        if ends:
            if name == "a":
                in_link = max(0, in_link - 1)
            for k in range(len(stack) - 1, -1, -1) if is_open[name] else ():
                if stack[k][0] == name:
                    leave(k)
                    break
                if not block and stack[k][0] in BLOCK:
                    break
            continue
        if name in VOID:
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # such an element ends an open one
            for k in range(len(stack) - 1, -1, -1) if is_open[name] else ():
                if stack[k][0] == name:
                    leave(k)
                    break
                if stack[k][0] in BLOCK and stack[k][0] != "p":
                    break
        elif block and name not in ("button", "label") and any(n == "p" for n, _ in stack[-3:]):
            leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
        if name == "a":
            in_link += 1
        marks = [p.lower() for g in _MARKS.findall(marked) for x in g for p in _PART.findall(x)]
        stack.append((name, Place(stack[-1][1] if stack else top, [name, *(f".{p}" for p in marks)])))
        is_open[name] += 1
    close()
    return out


_SLOTS: dict[tuple[str, int], int] = {}


def _slot(word: str, dims: int) -> int:
    key = word, dims
    k = _SLOTS.get(key)
    if k is None:
        if len(_SLOTS) > 200_000:
            _SLOTS.clear()
        k = _SLOTS[key] = zlib.crc32(word.encode()) % dims
    return k


def vectors(found: list[tuple[Place, str, float]]) -> np.ndarray:
    x = np.zeros((len(found), WIDTH), np.float32)
    for i, (place, text, linked) in enumerate(found):
        row = x[i]
        row[:PATH_DIMS] = np.unpackbits(np.frombuffer(place.bits.to_bytes(PATH_DIMS // 8, "little"), np.uint8), bitorder="little")
        words = text.split()
        for w in words:
            row[PATH_DIMS + _slot(w, WORD_DIMS)] += 1
        row[PATH_DIMS : PATH_DIMS + WORD_DIMS] /= len(words)
        n = len(text)
        ends = text.count(".") + text.count(",") + text.count("!") + text.count("?")
        digits = sum(map(text.count, "0123456789"))
        row[-MEASURES:] = min(1, np.log1p(len(words)) / 6), linked, digits / n, min(1, 10 * ends / n), text[-1] in ".!?", 1
    return x


# The network ----------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {}
    for d in ("f", "b"):
        w[f"x{d}"] = r.normal(0, 0.15, (WIDTH, 4 * STATES))
        w[f"h{d}"] = r.normal(0, 0.15, (STATES, 4 * STATES))
        w[f"c{d}"] = np.concatenate([np.zeros(STATES), np.ones(STATES), np.zeros(2 * STATES)])
    w["out"] = r.normal(0, 0.15, 2 * STATES)
    w["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(x: np.ndarray, live: np.ndarray, w: dict, d: str, tape: list | None = None) -> np.ndarray:
    """States of one direction; x is (pages, blocks, width), live marks blocks."""
    pages, steps, _ = x.shape
    gates = x.reshape(-1, x.shape[2]) @ w[f"x{d}"] + w[f"c{d}"]
    gates = gates.reshape(pages, steps, -1)
    h, c = np.zeros((pages, STATES), np.float32), np.zeros((pages, STATES), np.float32)
    out = np.zeros((pages, steps, STATES), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = gates[:, t] + h @ w[f"h{d}"]
        s = _sigmoid(z[:, : 3 * STATES])
        i, f, o = s[:, :STATES], s[:, STATES : 2 * STATES], s[:, 2 * STATES :]
        g = np.tanh(z[:, 3 * STATES :])
        on = live[:, t, None]
        new = (f * c + i * g) * on
        th = np.tanh(new)
        if tape is not None:
            tape.append((t, i, f, o, g, c, th, h))
        c, h = new, o * th * on
        out[:, t] = h
    return out


def probabilities(x: np.ndarray, live: np.ndarray, w: dict) -> np.ndarray:
    both = np.concatenate([_run(x, live, w, "f"), _run(x, live, w, "b")], axis=2)
    return _sigmoid(both @ w["out"] + w["bias"])


def _gradients(x: np.ndarray, live: np.ndarray, y: np.ndarray, w: dict) -> tuple[float, dict]:
    tapes: dict[str, list] = {"f": [], "b": []}
    states = {d: _run(x, live, w, d, tapes[d]) for d in tapes}
    both = np.concatenate([states["f"], states["b"]], axis=2)
    p = _sigmoid(both @ w["out"] + w["bias"])
    n = live.sum()
    loss = -float((live * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
    dz = (p - y) * live / n
    grads = {"out": np.einsum("pt,pts->s", dz, both), "bias": np.array([dz.sum()])}
    for k, d in enumerate(("f", "b")):
        dout = dz[:, :, None] * w["out"][k * STATES : (k + 1) * STATES]
        dgates = np.zeros((*x.shape[:2], 4 * STATES), np.float32)
        dh, dc = np.zeros(states[d][:, 0].shape, np.float32), np.zeros(states[d][:, 0].shape, np.float32)
        dhh = np.zeros_like(w[f"h{d}"])
        for t, i, f, o, g, c, th, h in reversed(tapes[d]):
            on = live[:, t, None]
            dh = (dh + dout[:, t]) * on
            dcell = (dc + dh * o * (1 - th * th)) * on
            dg = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dh * th * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
            dgates[:, t] = dg
            dhh += h.T @ dg
            dh, dc = dg @ w[f"h{d}"].T, dcell * f
        flat = dgates.reshape(-1, 4 * STATES)
        grads |= {f"x{d}": x.reshape(-1, x.shape[2]).T @ flat, f"h{d}": dhh, f"c{d}": flat.sum(0)}
    return loss, grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, live = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], live[i, : len(p)] = p, 1
    return x, live


# Training pages ---------------------------------------------------------------

#: How often pages are made with the names above; with an article in a holder of a made-up
#: name, in a bare one, in none; with made-up names all over; as a table; without tags.
_KINDS = {"named": 50, "unknown": 12, "bare": 10, "open": 10, "masked": 10, "table": 6, "text": 2}


def generated_page(r: random.Random, kind: str | None = None) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks."""
    kind = kind or r.choices(list(_KINDS), list(_KINDS.values()))[0]
    made_up: dict[str, str] = {}

    def name() -> str:
        letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(r.randint(2, 9)))
        return f"{r.choice(['class', 'class', 'id'])}={r.choice('cxjsq')}{letters}"

    syllables = ["th", "an", "er", "in", "on", "re", "st", "en", "ou", "le", "ch", "ung", "ción", "é", "au", "ment", "lich", "os"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    labels: list[int] = []

    def text(n: int, label: int, end: str = "") -> str:
        labels.append(label)
        words = [word() + ("," if r.random() < 0.05 else "." if r.random() < 0.08 else "") for _ in range(max(1, n))]
        return " ".join(words) + end

    def holder(said: str, *inner: str) -> str:
        if kind == "masked" and (" " in said or said in ("article", "main", "nav", "header", "footer", "aside", "dialog")):
            said = made_up.setdefault(said, r.choice(["div", f"div {name()}", f"div {name()}", f"section {name()}"]))
        return f"<{said}>" + "".join(inner) + f"</{said.split()[0]}>"

    def tag(name: str, inner: str) -> str:
        return f"<{name}>{inner}" + (f"</{name}>" if r.random() < 0.95 or name not in ("p", "li") else "")

    def links(n: int) -> list[str]:
        kind = r.choice(["li", "li", "div", "p"])
        return [f"<{kind}><a href='/x'>{text(r.randint(1, 4), 0)}</a></{kind}>" for _ in range(n)]

    def menu() -> str:
        inner = links(r.randint(2, 9))
        return holder(r.choice(_MENU), *(["<ul>", *inner, "</ul>"] if r.random() < 0.6 else inner))

    def prose(label: int, n: int) -> list[str]:
        return [tag("p", text(r.choice([2, 5, 12, 30, 60]), label, r.choice([".", ".", "!", ""]))) for _ in range(n)]

    def plain(kinds: list[str]) -> str:
        if r.random() < 0.4:
            return holder(r.choice(kinds), text(r.choice([3, 8, 15, 25]), 0, r.choice([".", ""])))
        some = [holder("h3", text(2, 0))] if r.random() < 0.4 else []
        return holder(r.choice(kinds), *some, *prose(0, r.randint(1, 3)))

    def form() -> str:
        return holder(r.choice(_FORM), *([holder("h3", text(3, 0))] if r.random() < 0.5 else []), "<label>", text(2, 0), "</label><input type=text>", "<button>", text(1, 0), "</button>")

    def comments() -> str:
        inner = [holder("h3", text(2, 0))]
        for _ in range(r.randint(1, 5)):
            inner.append(holder(r.choice(["div class=comment", "li class=comment", "article class=comment"]), holder("div class=author", text(2, 0)), *prose(0, r.randint(1, 2))))
        return holder(r.choice(_COMMENTS), *inner)

    def article() -> str:
        inner = [holder("h1", text(r.randint(3, 9), 1))] if r.random() < 0.8 else []
        if r.random() < 0.3:
            inner.append("<p><b>" + text(r.randint(4, 14), 1) + "<br>")
        for _ in range(r.choice([0, 1, 2, 3, 5, 9, 16])):
            k = r.random()
            if k < 0.74:
                inner += prose(1, 1)
            elif k < 0.80:
                inner.append(holder(r.choice(["h2", "h3"]), text(r.randint(1, 6), 1)))
            elif k < 0.86:
                inner.append(holder(r.choice(["ul", "ol"]), *(tag("li", text(r.randint(2, 14), 1)) for _ in range(r.randint(1, 4)))))
            elif k < 0.89:
                inner.append(holder("blockquote", *prose(1, 1)))
            elif k < 0.91:
                inner.append(holder("pre", text(6, 1)))
            elif k < 0.94:
                inner.append(holder("table", holder("tr", *(holder("td", text(2, 1)) for _ in range(3)))))
            else:
                inner.append(r.choice([lambda: plain(_AD), form, lambda: plain(_SIDE), lambda: plain(_NOTICE)])())
        if not any(labels):
            inner.append(holder("p", text(20, 1, ".")))
        if kind == "unknown":
            return holder(f"{r.choice(['div', 'div', 'section'])} {name()}", *inner)
        if kind == "bare":
            return holder("div", *([holder("div", *inner)] if r.random() < 0.3 else inner))
        if kind == "table":
            return "".join(inner)
        return "".join(inner) if kind == "open" else holder(r.choice(_ARTICLE), *inner)

    def heading() -> str:
        return holder(r.choice(_TOP), holder(r.choice(["div class=logo", "h2", "p", "a href='/'"]), text(2, 0)), menu() if r.random() < 0.6 else "")

    if kind == "text":
        said = text(r.choice([12, 30, 60, 200]), 1, ".")
        return r.choice([said, f"<html><body>{said}</body></html>"]), labels
    parts = []
    if r.random() < 0.4:
        parts.append(plain(_NOTICE))
    if r.random() < 0.5:
        parts.append(heading())
    if r.random() < 0.75:
        parts.append(menu())
    for _ in range(r.randint(0, 2)):
        parts.append(plain(r.choice([_AD, _SIDE, _NOTICE])))
    side = r.random() < 0.3
    if side:
        parts.append(holder(r.choice(_SIDE), *links(r.randint(2, 5))))
    if kind == "table":
        cells = [f"<td>{''.join(links(r.randint(2, 7)))}</td>"] if r.random() < 0.7 else []
        cells.append(f"<td>{article()}</td>")
        parts.append("<table><tr>" + "".join(cells) + "</tr></table>")
    else:
        parts.append(article())
    for make in (comments, form, lambda: plain(_SIDE), lambda: plain(_AD), lambda: holder(r.choice(_SIDE), *links(3))):
        if r.random() < 0.35:
            parts.append(make())
    if r.random() < 0.85:
        parts.append(plain(_BOTTOM) if r.random() < 0.7 else holder(r.choice(_BOTTOM), *links(r.randint(1, 5))))
    if r.random() < 0.15:
        parts.append(plain(_NOTICE))
    body = "".join(parts)
    if r.random() < 0.3:
        body = holder(r.choice(["div id=page", "div class=wrapper", "div class=container"]), body)
    return f"<html><head><title>{word()}</title><style>p{{}}</style></head><body>{body}</body></html>", labels


_TRAINED: dict[tuple, dict] = {}


def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The network's weights; the same in every process."""
    key = pages, epochs, seed
    if key in _TRAINED:
        return _TRAINED[key]
    r = random.Random(seed)
    made = []
    while len(made) < pages:
        page, labels = generated_page(r)
        found = blocks(page)
        if len(found) == len(labels):
            made.append((vectors(found), np.array(labels, np.float32)))
    made.sort(key=lambda m: len(m[0]))
    groups = [made[i : i + 32] for i in range(0, len(made), 32)]
    w = start_weights(seed)
    mean, square, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for group in r.sample(groups, len(groups)):
            x, live = padded([v for v, _ in group])
            y = np.zeros(live.shape, np.float32)
            for i, (_, own) in enumerate(group):
                y[i, : len(own)] = own
            _, grads = _gradients(x, live, y, w)
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -1, 1).astype(np.float32)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w[k] = w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    _TRAINED[key] = {k: v.astype(np.float32) for k, v in w.items()}
    return _TRAINED[key]


def label(pages: list[list], w: dict) -> list[np.ndarray]:
    """The probability of each block of each page to be article text."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # about 20,000 cells of pages of like length together
        longest, n = len(pages[order[at]]), 1
        while at + n < len(order) and (longest := len(pages[order[at + n]])) * (n + 1) <= 20_000:
            n += 1
        own = order[at : at + n]
        at += n
        p = probabilities(*padded([vectors(pages[i]) for i in own]), w)
        for i, row in zip(own, p, strict=True):
            out[i] = row[: len(pages[i])]
    return out


def extract_text(pages: DataFrame, blocks_too: bool = False) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; with ``blocks_too`` also
    its blocks with their probabilities."""
    spark = prepare(pages.sparkSession)
    weights = spark.sparkContext.broadcast(trained())
    rows = pages.select("page_id", "url", "html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                found = [blocks(p) for p in strings(part.column(2)).to_pylist()]
                odds = label(found, weights.value)
                texts = ["\n".join(t for (_, t, _), p in zip(f, o, strict=True) if p >= 0.5) for f, o in zip(found, odds, strict=True)]
                arrays, names = [part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                if blocks_too:
                    cells = [[{"path": "/".join(place.path()), "text": t, "article": float(p)} for (place, t, _), p in zip(f, o, strict=True)] for f, o in zip(found, odds, strict=True)]
                    arrays.append(pa.array(cells, pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("article", pa.float64())]))))
                    names.append("blocks")
                yield pa.RecordBatch.from_arrays(arrays, names)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    out = rows.mapInArrow(work, f"{kept}, text string" + ", blocks array<struct<path: string, text: string, article: double>>" * blocks_too)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
