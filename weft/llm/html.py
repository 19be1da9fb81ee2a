"""HTML extraction with a recurrent block labeller.

A page is cut into leaf blocks at block-level tags.  Every block is a vector: its path of tags, classes, ids
and roles, hashed; its words, hashed; and a few counts.  A bidirectional LSTM in numpy reads the whole
sequence of a page, so each block is labelled main text or not from the context of the document.  The
weights come from train() here, from a fixed seed, on pages drawn from a grammar of page parts (menus, headers,
footers, sidebars, notices, adverts, forms, comments and articles) under many names, made-up names and none,
nested in elements or laid out in tables; words are made up but for the usual phrases of such parts.  Nothing of
the pages to be read is used.  labeller.npz holds the weights that "python -m weft.llm.html" writes, so that no
process trains before it reads.

Scripts, styles, other raw elements, comments, the head and hidden elements (hidden, display: none, visibility:
hidden) are no blocks.  Character references are decoded, white space inside a block becomes one space, and main
blocks are joined in page order by line feeds.  Pages are scanned once from start to end; pages of over LONG
blocks are labelled piece by piece with the state carried over, so memory is bounded but for the page itself.

Defined cases: null, empty and text-free pages give an empty text; tags that never close or never opened are
read as browsers do for paragraphs, list items and table parts; a '<' that starts no tag is text; a tag without
an end makes quotes count for nothing behind it.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.words import Words, flat

# HTML's own element names.
INLINE = set("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label map mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe object textarea title select canvas audio video".split())
CLOSED_BY_SELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_PARAGRAPH = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
ATTRIBUTES = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PIECE = re.compile(r"[a-z]+")
OTHERS, WORD, COUNTS, HIDDEN, DEPTH = 24, 48, 10, 40, 24
LONG, CHUNK = 4000, 2000
WEIGHTS = Path(__file__).with_name("labeller.npz")


def _attributes(text: str) -> dict[str, str]:
    return {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(text)} if text else {}


def _unseen(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or bool(UNSEEN.search(attributes.get("style", "")))


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(path, text, characters inside links) of the leaf blocks of a page, in order; a path has the DEPTH innermost elements."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []
    opened: dict[str, int] = {}
    held: list[str] = []
    at, end, linked, links, quotes, head = 0, len(page), 0, 0, True, False
    unseen = -1  # depth of the outermost hidden element
    inline: list[str] = []  # hidden inline elements that are open

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((" ".join(s for _, s in stack[-DEPTH:]), text, linked))
        held, linked = [], 0

    def pop(depth: int) -> None:
        nonlocal unseen
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]
        unseen = unseen if unseen < depth else -1

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not head and unseen < 0 and not inline:
            held.append(piece)
            linked += len(piece) if links else 0

    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            say(page[at:])
            break
        say(page[at:tag])
        at = tag + 1
        if page.startswith("!--", at):
            close = page.find("-->", at + 3)
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith("![CDATA[", at) or page.startswith(("!", "?"), at):
            mark = "]]>" if page.startswith("![CDATA[", at) else ">"
            close = page.find(mark, at)
            if close < 0:
                say(page[tag:])
                break
            at = close + len(mark)
            continue
        closing = page.startswith("/", at)
        m = NAME.match(page, at + closing)
        if not m:
            say("<")
            continue
        stop = ATTRIBUTES.match(page, m.end()).end() if quotes else page.find(">", m.end())
        if quotes and (stop >= end or page[stop] != ">"):
            quotes, stop = False, page.find(">", m.end())
        if stop < 0:
            say(page[tag:])
            break
        name, attributes, at = m[0].lower(), page[m.end() : stop], stop + 1
        if name in ("head", "body", "html"):
            flush()
            head = name == "head" and not closing
            continue
        if name in RAW and not closing:
            if held and name in ("select", "textarea"):
                flush()
            if not attributes.rstrip().endswith("/"):
                close = _closing(name).search(page, at)
                at = close.end() if close else end
            continue
        if name in INLINE:
            if inline:
                if closing and name in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(name) :]
                elif not closing and name == inline[0] and name not in VOID:
                    inline.append(name)
            elif not closing and name not in VOID and attributes and _unseen(_attributes(attributes)):
                inline.append(name)
            if name == "a":
                links = 0 if closing else 1
            elif name == "br":
                say(" ")
            continue
        flush()
        links = 0
        inline.clear()
        if closing:
            if opened.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                pop(depth)
            continue
        if name in VOID:
            continue
        gone = CLOSED_BY_SELF.get(name, set()) | ({"p"} if name in NO_PARAGRAPH else set())
        while stack and stack[-1][0] in gone:
            pop(len(stack) - 1)
        own = _attributes(attributes)
        names = [x for k in ("class", "id", "role") for x in PIECE.findall(own.get(k, "").lower())]
        stack.append((name, "/".join([name, *names])))
        opened[name] = opened.get(name, 0) + 1
        if unseen < 0 and _unseen(own):
            unseen = len(stack) - 1
    flush()
    return out


@functools.lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def _slot(text: str, size: int) -> tuple[int, float]:
    h = int.from_bytes(text.encode(), "little") * 0x9E3779B97F4A7C15 % 0xFFFFFFFFFFFFFFC5
    return h % size, 1.0 if h >> 40 & 1 else -1.0


@functools.lru_cache(maxsize=1)
def known_names() -> dict[str, int]:
    """Places of element names and of the grammar's own class, id and role names; other names are hashed behind them."""
    names = {f"<{t}>" for t in NO_PARAGRAPH | {"tr", "td", "th", "li", "dt", "dd", "figcaption", "article", "header", "footer", "aside", "nav", "main", "section", "form", "div", "p"}}
    names |= {f"leaf {n[1:-1]}" for n in names}
    for opening in [*MAIN, *(o for os in OTHER.values() for o in os)]:
        for a in _attributes_of(opening):
            names |= {x for k in ("class", "id", "role") for x in PIECE.findall(a.get(k, ""))}
    return {n: k for k, n in enumerate(sorted(names))}


def _attributes_of(opening: str) -> list[dict[str, str]]:
    return [_attributes(t) for t in re.findall(r"<\w+([^>]*)>", opening)]


@functools.lru_cache(maxsize=20_000)
def _path(path: str) -> np.ndarray:
    known = known_names()
    v = np.zeros(len(known) + OTHERS)
    parts = path.split(" ") if path else []
    for k, part in enumerate(parts):
        tag, *own = part.split("/")
        for name in [f"<{tag}>", *own, *([f"leaf {tag}"] if k == len(parts) - 1 else [])]:
            if name in known:
                v[known[name]] += 1
            else:
                i, s = _slot(name, OTHERS)
                v[len(known) + i] += s
    return np.clip(v, -2, 2)


def inputs() -> int:
    return len(known_names()) + OTHERS + WORD + COUNTS


def vectors(pages: list[list[tuple[str, str, int]]], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row per block of all pages; first and total place a piece of a longer page."""
    every = [b for p in pages for b in p]
    if not every:
        return np.zeros((0, inputs()), np.float32)
    data, off = flat(pa.array([t for _, t, _ in every], pa.large_string()))
    words = Words(data, off, lower=True)
    bag = np.zeros((len(every), WORD))
    at = words.text_of(np.arange(len(words.hash)))
    np.add.at(bag, (at, (words.hash % np.uint64(WORD)).astype(np.int64)), np.where(words.hash >> np.uint64(40) & np.uint64(1), 1.0, -1.0))
    bag /= np.sqrt((bag * bag).sum(axis=1, keepdims=True)) + 1e-9
    n = np.diff(off)

    def share(marks: bytes) -> np.ndarray:
        return np.add.reduceat(np.isin(data, np.frombuffer(marks, np.uint8)), np.minimum(off[:-1], max(0, len(data) - 1)))

    # First and last bytes: sentences begin with capitals and end with stops.
    ends, starts = np.isin(data[off[1:] - 1], np.frombuffer(b".!?\"'\x9d", np.uint8)), np.isin(data[off[:-1]], np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\xc3", np.uint8))
    sizes = [len(p) if total is None else total for p in pages]
    place = np.concatenate([(first + np.arange(len(p))) / max(1, t - 1) for p, t in zip(pages, sizes, strict=True)])
    size = np.concatenate([np.full(len(p), np.log1p(t)) for p, t in zip(pages, sizes, strict=True)])
    link = np.minimum(1, np.array([k for _, _, k in every]) / np.maximum(1, n))
    counts = [np.log1p(n) / 4, np.log1p(words.n_words) / 3, link, share(b".,;!?") / np.maximum(1, words.n_words), place, size / 4, np.array([p.count(" ") for p, _, _ in every]) / 5, ends, starts, share(b"|\xa9\xbb\xb7") > 0]
    return np.c_[np.stack([_path(p) for p, _, _ in every]), bag, np.stack(counts, axis=1)].astype(np.float32)


class Labeller:
    """A bidirectional LSTM with one logistic output per step; steps x batch x inputs arrays."""

    def __init__(self, inputs: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.standard_normal((inputs, 4 * HIDDEN)) / np.sqrt(inputs)
            self.w[f"h{d}"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
            self.w[f"c{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        self.w["o"], self.w["i"], self.w["z"] = rng.standard_normal(2 * HIDDEN) / np.sqrt(HIDDEN), np.zeros(inputs), np.zeros(1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        steps, n, _ = x.shape
        z = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = state or (np.zeros((n, HIDDEN), z.dtype), np.zeros((n, HIDDEN), z.dtype))
        out = np.empty((steps, n, HIDDEN), z.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            new = f * c + i * g
            th, m = np.tanh(new), mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th, m))
            c, h = m * new + (1 - m) * c, m * o * th + (1 - m) * h
            out[t] = h
        return out, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, d, keep[d] if keep else None)[0] for d in "fb"], axis=2)
        if keep:
            keep["both"] = both
        return both @ self.w["o"] + x @ self.w["i"] + self.w["z"]

    def long_logits(self, page: list[tuple[str, str, int]], chunk: int = CHUNK) -> np.ndarray:
        """The logits of one page's blocks, chunk by chunk in either direction."""
        out, starts = np.zeros(len(page), np.float32), list(range(0, len(page), chunk))
        for k, d in enumerate("fb"):
            state = None
            for lo in starts if d == "f" else reversed(starts):
                x = vectors([page[lo : lo + chunk]], lo, len(page))[:, None]
                h, state = self._pass(x, np.ones(x.shape[:2], x.dtype), d, None, state)
                out[lo : lo + chunk] += h[:, 0] @ self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
                if d == "f":
                    out[lo : lo + chunk] += x[:, 0] @ self.w["i"] + self.w["z"]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {"f": [], "b": []}
        p = 1 / (1 + np.exp(-np.clip(self.logits(x, mask, keep), -30, 30)))
        e = (p - y) * mask / mask.sum()
        g = {"o": e.reshape(-1) @ keep["both"].reshape(e.size, -1), "i": e.reshape(-1) @ x.reshape(e.size, -1), "z": np.array([e.sum()])}
        for k, d in enumerate("fb"):
            wh = self.w[f"h{d}"]
            back = e[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros_like(back[0]), np.zeros_like(back[0])
            dz, gh = np.zeros((*x.shape[:2], 4 * HIDDEN), x.dtype), np.zeros_like(wh)
            for t, h, c, i, f, o, gg, th, m in reversed(keep[d]):
                dh = dh + back[t]
                inner = m * dh
                dn = m * dc + inner * o * (1 - th * th)
                da = np.concatenate([dn * gg * i * (1 - i), dn * c * f * (1 - f), inner * th * o * (1 - o), dn * i * (1 - gg * gg)], axis=1)
                dz[t] = da
                gh += h.T @ da
                dh = (1 - m) * dh + da @ wh.T
                dc = (1 - m) * dc + dn * f
            g[f"h{d}"], g[f"x{d}"], g[f"c{d}"] = gh, x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, dz.shape[2]), dz.sum(axis=(0, 1))
        return g


def padded(rows: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    steps, n = max(counts), len(counts)
    x, mask, at = np.zeros((steps, n, rows.shape[1]), rows.dtype), np.zeros((steps, n), rows.dtype), 0
    for k, c in enumerate(counts):
        x[:c, k], mask[:c, k] = rows[at : at + c], 1
        at += c
    return x, mask


# The grammar of training pages.
MAIN = ["<article>", "<article>", "<div>", "", "<main>", '<div class="content">', '<div id="content">', '<div class="post-body">', '<section class="entry-content">', '<div class="article-body">', '<div class="story">', '<div role="main">', '<div class="post">', '<div id="main-text">', "<main><article>", '<div class="page"><article>', '<div class="wrapper"><main>', '<div id="main"><div class="article">', '<div class="main-content">', '<article class="post">']
OTHER = {
    "menu": ["<nav>", '<nav class="menu">', '<div class="menu">', '<div id="navigation">', '<ul class="nav">', '<div class="navbar">', '<div class="breadcrumbs">', '<div class="breadcrumb">', '<div role="navigation">', '<div class="topbar">', '<nav class="pagination">', '<div class="tags">'],
    "header": ["<header>", '<div class="header">', '<div id="header">', '<div class="site-header">', '<div class="masthead">', '<div role="banner">', '<header class="site-header">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<footer class="site-footer">', '<div role="contentinfo">', '<div class="legal">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div class="related">', '<section class="related-posts">', '<div class="recommended">', '<aside class="sidebar">', '<div role="complementary">', '<div class="share">', '<div class="social">', '<div class="author-box">', '<div class="popular">'],
    "notice": ['<div class="notice">', '<div class="cookie-banner">', '<div id="cookie-consent">', '<div role="alert">', '<div class="alert">', '<div class="banner">', '<div class="popup">', '<div class="modal">', '<div class="newsletter">', '<div class="subscribe">', '<div class="gdpr">', '<div role="dialog">', '<div class="paywall">', '<div class="cookies">', '<section class="notice">', '<aside class="notice">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="promo">', '<div class="sponsored">', '<div id="ad-top">', '<ins class="ad"><div class="ad">', '<aside class="ad">', '<div class="sponsor">', '<section class="advert">', '<aside class="advert">', '<div class="promotion">'],
    "form": ["<form>", '<form class="search">', '<form id="login">', '<div class="search">', '<form class="contact">', '<form class="signup">', '<div class="login">', '<form action="/s">'],
    "comments": ['<div class="comments">', '<section id="comments">', '<div id="comments">', '<ol class="comment-list">', '<div class="comment">', '<section class="comments">', '<div class="responses">', '<div id="disqus">', '<div class="discussion">', '<ul class="comments">', '<div class="reader-comments">', '<div class="replies">'],
}
SYLLABLES = "an ba ci de er fo ga hi in jo ka le mi no or pa que re si ta un ve wa xi yo zu st th ing ion ä é ñ ó ü ç".split()
# Usual phrases of page parts.
PHRASES = {
    "menu": "Home|About|About us|Contact|News|Blog|Archive|Products|Services|Categories|Next|Previous|Menu|Sitemap|Startseite|Kontakt|Accueil|Inicio|Tags|Shop|FAQ|Skip to content|World|Sport".split("|"),
    "header": "Welcome to|Log in|Sign in|Register|My account|Menu|Toggle navigation|Breaking news|Today's edition".split("|"),
    "footer": "Copyright 2020|All rights reserved|Privacy policy|Terms of use|Imprint|Impressum|Mentions légales|Powered by|Terms and conditions|Contact us|Cookie settings|© 2021|© 2019|Datenschutz|Aviso legal|Back to top".split("|"),
    "side": "Related articles|Recent posts|Popular|Read more|You may also like|Share|Share on Facebook|Tweet|Follow us|About the author|Most read|Trending|Archives|Recommended|See also|Categories".split("|"),
    "notice": "We use cookies|Accept|Accept all|This site uses cookies|Subscribe to our newsletter|Please enable JavaScript|Sign up|Your browser is out of date|Decline|Got it|Become a member|Continue reading with a subscription|Close".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Ad|Anzeige|Publicité|Promoted|Special offer|Order today|Free shipping|Save 50%|Limited offer|Publicidad|Click here|Learn more".split("|"),
    "form": "Search|Email address|Your name|Password|Submit|Send|Subscribe|Login|Message|Enter your email|Remember me|Forgot password|Suche|Rechercher".split("|"),
    "comments": "Comments|Reply|Leave a comment|Leave a reply|says:|wrote:|3 comments|Log in to comment|Kommentare|Commentaires|Report|Like|Great post|Thanks for sharing|I agree|posted on|ago|Anonymous|Guest".split("|"),
}


def _close(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))


class _Page:
    """One page of the grammar: html and the label of each of its blocks."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.labels = rng, []
        self.named = rng.random() < 0.65  # whether parts carry names that tell what they are

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, xs):  # noqa: ANN001, ANN201
        return xs[int(self.rng.integers(len(xs)))]

    def number(self, lo: int, hi: int) -> int:
        return int(self.rng.integers(lo, hi))

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(self.number(1, 5)))

    def words(self, lo: int, hi: int, stop: bool = True) -> str:
        ws = [self.word() for _ in range(self.number(lo, hi))]
        if len(ws) > 12 and stop:
            for k in range(self.number(4, 9), len(ws) - 1, self.number(5, 14)):
                ws[k] += self.pick([",", ",", ".", ";", "."])
        return (" ".join(ws).capitalize() + (self.pick("....!?") if stop else "")) or "A"

    def phrase(self, kind: str, rest: bool = True) -> str:
        more = f" {self.words(1, 5, False).lower()}" if rest and self.chance(0.4) else ""
        return self.pick(PHRASES[kind]) + more

    def opening(self, kind: str) -> str:
        """An element for a page part; under made-up names or none on pages that do not tell."""
        o = self.pick(MAIN if kind == "main" else OTHER[kind])
        if self.named and self.chance(0.85) or self.chance(0.1):
            return o
        tag = self.pick(["div", "div", "div", "section", "div", "td"]) if kind == "main" or self.chance(0.7) else re.findall(r"<(\w+)", o or "<div")[0]
        if tag == "td":
            return "<table><tr><td>"
        if tag in ("article", "main", "body"):
            tag = "div"
        names = self.pick(["", f' class="{self.made_up()}"', f' class="{self.made_up()} {self.made_up()}"', f' id="{self.made_up()}"', f' class="{self.made_up()}-{self.made_up()}"'])
        return f"<{tag}{names}>"

    def made_up(self) -> str:
        return "".join(self.pick("abcdefghijklmnoprstuvwxyz") for _ in range(self.number(1, 6))) if self.chance(0.5) else self.pick(["box", "row", "col", "c", "inner", "wrap", "block", "left", "right", "top", "grid", "item", "x", "module", "cell"]) + self.pick(["", "1", "2", "-a"])

    def para(self, lo: int, hi: int, label: int, text: str | None = None) -> str:
        self.labels.append(label)
        form, t = self.rng.random(), text or self.words(lo, hi)
        if form < 0.1 and " " in t:
            t = t.replace(" ", ' <a href="/x">', 1) + "</a>"
        elif form < 0.25 and t.count(" ") > 6:
            a, b, c = t.split(" ", 2)
            t = f'{a} <a href="/y">{b}</a> <em>{c}</em>' if self.chance(0.5) else f"{a} <strong>{b}</strong> {c}"
        elif form < 0.28:
            t += '<span style="display:none">' + self.words(1, 5) + "</span>"
        return f"<p><b>{t}<br>" if form > 0.87 else f"<p>{t}" if form > 0.77 else f"<div>{t}</div>" if form > 0.7 and hi > 20 else f"<p>{t}</p>"

    def items(self, n: int, kind: str, label: int, link: bool, hi: int = 4) -> str:
        self.labels.extend([label] * n)
        own = kind in PHRASES and self.chance(0.6)
        text = [self.phrase(kind, False) if own and self.chance(0.6) else self.words(1, hi, False) if link else self.words(2, 12) for _ in range(n)]
        shape = self.pick(["li", "li", "li", "div", "td", "p"]) if label == 0 else "li"
        rows = [f'<{shape}><a href="/{self.word()}">{t}</a></{shape}>' if link else f"<{shape}>{t}</{shape}>" for t in text]
        return {"li": "<ul>{}</ul>", "td": "<table><tr>{}</tr></table>"}.get(shape, "{}").format("".join(rows))

    def link_line(self, kind: str) -> str:
        self.labels.append(0)
        links = [f'<a href="/{self.word()}">{self.phrase(kind, False) if self.chance(0.6) else self.words(1, 3, False)}</a>' for _ in range(self.number(2, 8))]
        return self.pick(["<p>{}</p>", "<div>{}</div>", "<span>{}</span><hr>"]).format(self.pick([" | ", " ", " - ", " &middot; "]).join(links))

    def inside(self, kind: str) -> str:
        if kind == "menu" or kind == "side" and self.chance(0.6):
            return self.link_line(kind) if self.chance(0.3) else self.items(self.number(1, 9), kind, 0, True)
        if kind == "comments":
            out = ""
            for _ in range(self.number(1, 6)):
                says = ""
                if self.chance(0.5):
                    says = self.para(1, 4, 0, f"{self.word().capitalize()} {self.pick(['says:', 'wrote:', '2 days ago', 'on May 3', ''])}".strip())
                says += self.para(3, 60, 0, None if self.chance(0.7) else self.phrase("comments") + ", " + self.words(3, 30).lower())
                if self.chance(0.3):
                    self.labels.append(0)
                    says += '<div><a href="#r">' + self.pick(["Reply", "Like", "Report", "Antworten", "Répondre"]) + "</a></div>"
                name = f' class="{self.pick(["comment", "reply", "comment-body"]) if self.named else self.made_up()}"'
                out += self.pick(["<div{}>{}</div>", "<li{}>{}</li>", "<div{}>{}</div>"]).format(name, says) if self.chance(0.7) else says
            return out
        if kind == "form":
            self.labels.append(0)
            text = self.phrase(kind) if self.chance(0.6) else self.words(1, 4, False)
            return f'<label>{text}</label> <input name="q"> <button>{self.phrase(kind, False) if self.chance(0.5) else self.words(1, 3, False)}</button>' if self.chance(0.5) else f"<p>{text} {self.words(1, 25)}</p>"
        if self.chance(0.4):
            self.labels.append(0)
            text = self.phrase(kind) if self.chance(0.5 if self.named else 0.85) else self.words(1, 25)
            if kind == "footer" and self.chance(0.6):
                text = f"&copy; {self.number(1995, 2025)}" if self.chance(0.3) else self.pick(["&copy; ", "&copy; 2021 ", "(c) 2010 "]) + text
            return f"<p>{text}</p>" if self.chance(0.2) else text
        out = ""
        for _ in range(self.number(1, 3)):
            text = self.phrase(kind) + self.pick([": ", ". ", " "]) + self.words(1, 25) if self.chance(0.3 if self.named else 0.9) else None
            out += self.para(1, 60 if self.chance(0.3) else 20, 0, text)
        return out

    def other(self, kind: str) -> str:
        o, head = self.opening(kind), ""
        if self.chance(0.3):
            self.labels.append(0)
            level = self.pick("1123" if kind == "header" else "2345")
            head = f"<h{level}>{self.phrase(kind, False) if self.chance(0.5) else self.words(1, 5, False)}</h{level}>"
        unseen = f'<div style="display: none"><p>{self.words(2, 20)}</p></div>' if self.chance(0.05) else ""
        return ("<!-- x -->" if self.chance(0.3) else "") + o + head + self.inside(kind) + unseen + _close(o)

    def main(self) -> str:
        o, out = self.opening("main"), ""
        while not self.named and self.chance(0.4):
            o += f'<div class="{self.made_up()}">' if self.chance(0.7) else "<div>"
        if self.chance(0.8):
            self.labels.append(1)
            level = self.pick("1112")
            h = f"<h{level}>{self.words(1, 14, self.chance(0.5))}</h{level}>"
            out += f"<header>{h}</header>" if self.chance(0.15) else h
        for _ in range(self.number(1, 14)):
            r = self.rng.random()
            if r < 0.72:
                out += self.para(1, 120 if self.chance(0.7) else 8, 1)
            elif r < 0.78:
                self.labels.append(1)
                out += f"<h2>{self.words(1, 8, False)}</h2>"
            elif r < 0.84:
                out += self.items(self.number(1, 6), "", 1, self.chance(0.1), 6)
            elif r < 0.87:
                self.labels.append(1)
                out += f"<blockquote>{self.words(4, 40)}</blockquote>"
            elif r < 0.89:
                self.labels.append(1)
                out += f"<pre>{self.words(2, 20)}</pre>"
            elif r < 0.91:
                self.labels.extend([1] * 4)
                out += "<table><tr>" + "".join(f"<td>{self.words(1, 4, False)}</td>" for _ in range(2)) + "</tr><tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(2)) + "</tr></table>"
            elif r < 0.93:
                self.labels.append(1)
                out += f"<figure><figcaption>{self.words(2, 12)}</figcaption></figure>"
            elif r < 0.95:
                self.labels.append(1)
                out += f"<div>{self.words(4, 60)}</div>"
            else:
                out += self.other(self.pick(["ad", "side", "notice", "form"]))
        if self.chance(0.1):
            out += self.other("comments")
        return o + out + _close(o)

    def build(self) -> str:
        if self.chance(0.04):
            return self.main() if self.chance(0.5) else self.para(6, 60, 1)
        before = [self.other(k) for k in ("notice", "header", "menu", "ad", "form") if self.chance(0.75 if k == "menu" else 0.35)]
        before += [self.other("side")] if self.chance(0.2) else []
        main = self.main()
        after = [self.other(k) for k in ("comments", "side", "form", "ad", "notice", "menu", "footer") if self.chance(0.75 if k == "footer" else 0.4 if k == "comments" else 0.3)]
        if self.chance(0.1):
            # A page laid out in a table: parts before, the article, parts after.
            page = "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in before) + f"<tr><td>{main}</td></tr>" + "".join(f"<tr><td>{x}</td></tr>" for x in after) + "</table>"
        else:
            page = "".join(before) + main + "".join(after)
        wrap = self.pick(["", "", '<div class="container">', '<div id="page">', "<div>", f'<div class="{self.made_up()}">', "<div><div>"])
        return f"<html><head><title>{self.words(1, 9)}</title></head><body>{wrap}{page}{_close(wrap)}</body></html>"


def training_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks."""
    p = _Page(rng)
    return p.build(), p.labels


def train(pages: int = 12_000, steps: int = 16_000, seed: int = 17) -> Labeller:
    """A labeller fitted to pages of the grammar."""
    rng = np.random.default_rng(seed)
    made = [(blocks(p), y) for p, y in (training_page(rng) for _ in range(pages))]
    made = sorted(((b, y) for b, y in made if len(b) == len(y)), key=lambda m: len(m[0]))
    groups = []
    for lo in range(0, len(made), 32):
        part = made[lo : lo + 32]
        x, mask = padded(vectors([b for b, _ in part]), [len(b) for b, _ in part])
        y = np.zeros(mask.shape, np.float32)
        for k, (_, ys) in enumerate(part):
            y[: len(ys), k] = ys
        groups.append((x, mask, y))
    net = Labeller(inputs())
    net.w = {k: w.astype(np.float32) for k, w in net.w.items()}
    m, v = {k: 0.0 for k in net.w}, {k: 0.0 for k in net.w}
    for step in range(1, steps + 1):
        x, mask, y = groups[int(rng.integers(len(groups)))]
        rate = 0.008 * min(1, 1.3 * (1 - step / (steps + 1)))
        for k, g in net.gradients(x * (rng.random(x.shape, np.float32) > 0.05), mask, y).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


@functools.lru_cache(maxsize=1)
def trained() -> Labeller:
    """The labeller whose weights train() has left in labeller.npz."""
    net = Labeller(inputs())
    with np.load(WEIGHTS) as stored:
        net.w = {k: stored[k] for k in net.w}
    return net


def main_blocks(pages: list[list[tuple[str, str, int]]], net: Labeller, most: int = 8000) -> list[str]:
    """The main text of every page, labelled in batches of pages of like length."""
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if 0 < len(pages[i]) <= LONG]
    out, lo = [""] * len(pages), 0
    for i, page in enumerate(pages):
        if len(page) > LONG:
            out[i] = "\n".join(b[1] for b, y in zip(page, net.long_logits(page) > 0, strict=True) if y)
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(pages[order[hi]]) <= most:
            hi += 1
        part = [pages[i] for i in order[lo:hi]]
        x, mask = padded(vectors(part), [len(p) for p in part])
        yes = net.logits(x, mask) > 0
        for k, i in enumerate(order[lo:hi]):
            out[i] = "\n".join(b[1] for b, y in zip(part[k], yes[:, k], strict=False) if y)
        lo = hi
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text and n_chars, per row of pages."""
    net = trained()
    rows = pages.select(*keep, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                t = b.slice(lo, 256)
                text = main_blocks([blocks(h or "") for h in t["__html"].to_pylist()], net)
                yield pa.RecordBatch.from_arrays([*(t[c] for c in keep), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in train().w.items()})
