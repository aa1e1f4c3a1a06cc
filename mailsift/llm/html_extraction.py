"""Main-text extraction by a recurrent block labeller.

A page is read as the sequence of its leaf blocks: the text between two block-level tags, with the path of
elements it lies in. A bidirectional LSTM reads a vector for the path (tags, class and id words), a hashed
vector for the words and a few measures of each block, and labels every block from the whole page's
context. It is trained in numpy by backpropagation through time on a bounded sample of pages: those whose
mark-up says what is the article, and pages composed from their texts in other layouts, with containers and
notices under the names that sites give them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import runs, seeded_share

PATH_BITS, WORD_BITS = 10, 11
PATH_SIZE, WORD_SIZE, UNITS = 16, 8, 16
MEASURES = 5
# Pages that are learnt from at most (each of at most so many characters), and layouts composed of them.
SAMPLE, SAMPLE_CHARS, COMPOSED = 240, 60_000, 1600
STEPS, BATCH, RATE = 500, 24, 0.01
# Blocks of the run of a page that one training step sees; runs are drawn anew in each step, ends of pages included.
TRAINED_RUN = 60
# Steps times pages that go through the network at once; a page of more blocks goes alone.
CELLS_AT_ONCE = 8_192
SEED = 8
PAGE_BYTES = 1 << 20

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol"
    " optgroup option p pre section select summary table tbody td tfoot th thead title tr ul video audio iframe"
    " object label template".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that are skipped, and those whose text is no mark-up but belongs to their block.
RAW_TAGS = frozenset("script style textarea".split())
PLAIN_TAGS = frozenset(("xmp",))
# What a drawing holds besides the words that it shows.
UNSEEN_IN_SVG = frozenset("title desc metadata".split())
# Elements that end when one of the same set begins within the same parent.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
# Elements that implied ends do not cross.
SCOPES = frozenset("html body div article section aside nav main header footer table ul ol dl form blockquote td".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>",
    re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float = 0.0  # share of characters inside links


def _hash(word: str, bits: int, salt: int) -> int:
    value = 2166136261 ^ salt
    for byte in word.encode():
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return (value ^ value >> 15) & ((1 << bits) - 1)


_path_cache: dict[str, tuple[str, ...]] = {}


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    key = f"{tag} {attributes}"
    if key not in _path_cache:
        if len(_path_cache) > 20_000:
            _path_cache.clear()
        words = [tag]
        for value in _NAMES.findall(attributes):
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value.strip("\"'"))
            words += [w.lower() for w in re.findall(r"[A-Za-z]+", value)]
        _path_cache[key] = tuple(words)
    return _path_cache[key]


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order; character references are decoded and white space in a block is one space."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[tuple[str, bool]] = []
    links = 0
    at = 0

    def flush():
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(p) for p, link in pieces if link) / max(sum(len(p) for p, _ in pieces), 1)
                path = tuple(name for tag, names in stack for name in (names if tag in BLOCK_TAGS else names[1:]))
                found.append(Block(path, text, linked))
            pieces.clear()

    end = len(page)
    while at < end:
        match = _TAG.search(page, at)
        if not match:
            pieces.append((page[at:], links > 0))
            break
        if match.start() > at:
            pieces.append((page[at : match.start()], links > 0))
        at = match.end()
        slash, tag, attributes = (match.group(1), match.group(2), match.group(3)) if match.group(2) else (
            match.group(4), match.group(5), match.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append((" ", False))
            continue
        if slash:
            if tag in BLOCK_TAGS:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
                links = sum(t == "a" for t, _ in stack)
            continue
        unseen = tag in UNSEEN_IN_SVG and not attributes.endswith("/") and any(t == "svg" for t, _ in stack)
        if tag in RAW_TAGS or tag in PLAIN_TAGS or unseen:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in PLAIN_TAGS:
                # Shown as it stands, so that it comes out of the decoding of references unchanged.
                pieces.append((page[at : close.start() if close else end].replace("&", "&amp;"), links > 0))
            at = close.end() if close else end
            continue
        if tag in BLOCK_TAGS:
            flush()
            ends = CLOSES.get(tag, {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    links = sum(t == "a" for t, _ in stack)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag not in VOID_TAGS and not attributes.endswith("/"):
            stack.append((tag, _names(tag, attributes)))
            links += tag == "a"
    flush()
    return found


@dataclass
class Labeller:
    path: np.ndarray
    word: np.ndarray
    inputs: np.ndarray  # (2, path + word + measures + 1, 4 units)
    inner: np.ndarray  # (2, units, 4 units)
    out: np.ndarray  # (2 units + 1,)

    def parameters(self):
        return [self.path, self.word, self.inputs, self.inner, self.out]


def fresh(seed: int = SEED) -> Labeller:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    width = PATH_SIZE + WORD_SIZE + MEASURES + 1
    return Labeller(
        draw(1 << PATH_BITS, PATH_SIZE, scale=0.3), draw(1 << WORD_BITS, WORD_SIZE, scale=0.1),
        draw(2, width, 4 * UNITS, scale=width**-0.5), draw(2, UNITS, 4 * UNITS, scale=UNITS**-0.5),
        draw(2 * UNITS + 1, scale=0.1))


_word_cache: dict[str, int] = {}
_path_hashes: dict[str, int] = {}


def _numbers(words, cache: dict[str, int], bits: int, salt: int) -> list[int]:
    out = []
    for word in words:
        number = cache.get(word)
        if number is None:
            if len(cache) > 200_000:
                cache.clear()
            number = cache[word] = _hash(word, bits, salt)
        out.append(number)
    return out


@dataclass
class Inputs:
    """Bags of path and word numbers of all blocks, with where each block's begin, and the measures."""

    path: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_at: np.ndarray
    measures: np.ndarray


def inputs_of(blocks: list[Block]) -> Inputs:
    paths, words, measures = [], [], []
    for block in blocks:
        paths.append(_numbers(block.path or ("html",), _path_hashes, PATH_BITS, 1))
        found = _WORD.findall(block.text.lower()) or ["-"]
        words.append(_numbers(found, _word_cache, WORD_BITS, 2))
        n = len(block.text)
        marks = sum(map(block.text.count, ".,;:!?"))
        measures.append((np.log1p(n) / 5, block.linked, marks / (len(found) + 1), min(len(found), 100) / 50,
                         sum(map(str.isdigit, block.text)) / n))
    lengths = lambda rows: np.concatenate([[0], np.cumsum([len(r) for r in rows])])[:-1].astype(np.int64)
    flat = lambda rows: np.fromiter((x for r in rows for x in r), np.int64)
    return Inputs(flat(paths), lengths(paths), flat(words), lengths(words), np.array(measures, np.float32))


def _vectors(net: Labeller, x: Inputs) -> np.ndarray:
    """Input vectors of all blocks: sum over the path, mean over the words, measures and a one."""
    n = len(x.path_at)
    words = np.diff(np.append(x.word_at, len(x.word)))
    return np.concatenate([
        np.add.reduceat(net.path[x.path], x.path_at, axis=0),
        np.add.reduceat(net.word[x.word], x.word_at, axis=0) / words[:, None].astype(np.float32),
        x.measures, np.ones((n, 1), np.float32)], axis=1)


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _forward(net: Labeller, vectors: np.ndarray, where: np.ndarray, keep: bool = False):
    """Logits (steps, pages) for ``where`` (steps, pages): the block at each step of a page, -1 after its last."""
    steps, pages = where.shape
    valid = (where >= 0).astype(np.float32)[:, :, None]
    x = vectors[np.maximum(where, 0)]
    projected = np.stack([x @ net.inputs[0], x @ net.inputs[1]])
    h = np.zeros((2, pages, UNITS), np.float32)
    c = np.zeros_like(h)
    out = np.zeros((steps, pages, 2 * UNITS + 1), np.float32)
    out[:, :, -1] = 1
    trace = []
    for t in range(steps):
        back = steps - 1 - t
        mask = np.stack([valid[t], valid[back]])
        a = np.stack([projected[0, t], projected[1, back]]) + h @ net.inner
        i, f, o = (_sigmoid(a[:, :, k * UNITS : (k + 1) * UNITS] + (1.0 if k == 1 else 0.0)) for k in range(3))
        g = np.tanh(a[:, :, 3 * UNITS :])
        new_c = mask * (f * c + i * g) + (1 - mask) * c
        tanh_c = np.tanh(new_c)
        new_h = mask * (o * tanh_c) + (1 - mask) * h
        if keep:
            trace.append((h, c, i, f, o, g, tanh_c, mask))
        h, c = new_h, new_c
        out[t, :, :UNITS], out[back, :, UNITS:-1] = h[0], h[1]
    logits = out @ net.out
    return (logits, out, x, trace) if keep else logits


def _gradients(net: Labeller, x: Inputs, where: np.ndarray, truth: np.ndarray):
    vectors = _vectors(net, x)
    logits, out, xs, trace = _forward(net, vectors, where, keep=True)
    valid = where >= 0
    d = np.where(valid, _sigmoid(logits) - truth[np.maximum(where, 0)], 0).astype(np.float32) / max(valid.sum(), 1)
    g_out = np.einsum("tp,tpk->k", d, out)
    d_out = d[:, :, None] * net.out
    steps = len(where)
    g_inner = np.zeros_like(net.inner)
    d_a = np.zeros((2, *where.shape, 4 * UNITS), np.float32)
    dh = np.zeros((2, where.shape[1], UNITS), np.float32)
    dc = np.zeros_like(dh)
    for t in range(steps - 1, -1, -1):
        back = steps - 1 - t
        h, c, i, f, o, g, tanh_c, mask = trace[t]
        dh = dh + np.stack([d_out[t, :, :UNITS], d_out[back, :, UNITS:-1]])
        here = dh * mask
        d_c = dc + here * o * (1 - tanh_c * tanh_c)
        live = d_c * mask
        da = np.concatenate([live * g * i * (1 - i), live * c * f * (1 - f), here * tanh_c * o * (1 - o),
                             live * i * (1 - g * g)], axis=2)
        g_inner += h.transpose(0, 2, 1) @ da
        d_a[0, t], d_a[1, back] = da[0], da[1]
        dc = live * f + d_c * (1 - mask)
        dh = da @ net.inner.transpose(0, 2, 1) + dh * (1 - mask)
    g_inputs = np.stack([np.tensordot(xs, d_a[s], ([0, 1], [0, 1])) for s in (0, 1)])
    d_x = d_a[0] @ net.inputs[0].T + d_a[1] @ net.inputs[1].T
    d_v = np.zeros_like(vectors)
    np.add.at(d_v, where[valid], d_x[valid])
    g_path, g_word = np.zeros_like(net.path), np.zeros_like(net.word)
    path_n = np.diff(np.append(x.path_at, len(x.path)))
    word_n = np.diff(np.append(x.word_at, len(x.word)))
    np.add.at(g_path, x.path, np.repeat(d_v[:, :PATH_SIZE], path_n, axis=0))
    per_word = d_v[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / word_n[:, None]
    np.add.at(g_word, x.word, np.repeat(per_word, word_n, axis=0))
    return [g_path, g_word, g_inputs, g_inner, g_out]


def _layout(sizes: list[int]) -> np.ndarray:
    where = np.full((max(sizes), len(sizes)), -1, np.int64)
    at = 0
    for page, size in enumerate(sizes):
        where[:size, page] = np.arange(at, at + size)
        at += size
    return where


def drawn_run(page: list, rng: np.random.Generator, most: int = TRAINED_RUN) -> list:
    """The whole page, or a run of ``most`` of its blocks; its first and last blocks are drawn as often as others."""
    start = int(rng.integers(1 - most, len(page))) if len(page) > most else 0
    start = min(max(start, 0), max(len(page) - most, 0))
    return page[start : start + most]


def train(pages: list[list[tuple[Block, bool]]], steps: int = STEPS, seed: int = SEED) -> Labeller:
    """Adam over drawn batches of labelled block sequences."""
    net = fresh(seed)
    rng = np.random.default_rng(seed)
    pages = [p for p in pages if p]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        chosen = [drawn_run(pages[i], rng) for i in rng.integers(0, len(pages), BATCH)]
        x = inputs_of([b for p in chosen for b, _ in p])
        truth = np.array([y for p in chosen for _, y in p], np.float32)
        gradients = _gradients(net, x, _layout([len(p) for p in chosen]), truth)
        rate = RATE * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), gradients, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


# Containers by what they hold, as (tag, class words); a plain tag has no class.
MAIN = ("article", "main", "div.content", "div.post.content", "div.entry.content", "div.article.body", "section.story",
        "div.story", "td.body", "div.main.text", "div.post", "section.content", "div.page.content", "div.body", "div",
        "main article.post div.entry.content", "div.main", "table tr td.text", "div.article.content", "article div.text",
        "div.center", "div.blog.post", "table tr td", "main section", "body.text")
OTHER = {
    "menu": ("nav", "ul.menu", "div.navbar", "div.navigation", "div.breadcrumbs", "ul.nav.links", "div.topnav", "menu",
             "div.menu", "table tr td.nav", "div.left", "div.toc", "div.pagination", "ul.pager", "div.links"),
    "header": ("header", "div.header", "div.masthead", "div.topbar", "div.logo", "div.site.title",
               "div.top", "header.site.header", "div.head", "td.top", "div.branding", "div.tagline"),
    "footer": ("footer", "div.footer", "div.copyright", "div.legal", "div.site.info", "div.bottom",
               "footer.site.footer", "div.foot", "td.bottom", "footer.entry.footer", "div.imprint", "div.colophon"),
    "sidebar": ("aside", "div.sidebar", "div.widget", "div.related", "div.recommended", "div.trending", "section.teaser",
                "div.right", "td.side", "aside.widget.area", "div.popular", "section.related", "div.more", "div.rail"),
    "notice": ("div.cookie.notice", "div.banner", "div.consent", "div.notice", "div.newsletter", "div.alert", "dialog",
               "div.popup", "div.modal", "div.paywall", "div.cookie.consent", "div.cookie.banner", "div.gdpr", "section.notice",
               "div.newsletter.signup", "div.message", "div.warning", "div.subscribe.box"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "ins.adsbygoogle",
               "table tr td.ads", "td.ads", "div.ad.slot", "div.ad.container", "aside.ad", "section.sponsor", "div.banner.ad", "div.commercial"),
    "form": ("form", "div.search.form", "form.subscribe", "form.login", "fieldset", "label", "button", "select option"),
    "comments": ("div.comments", "section.comments", "ol.commentlist", "div.comment", "div.reply", "div.disqus",
                 "article.comment", "ul.comment.list", "div.responses", "section.comments", "div.comments.area",
                 "ol.comment.list li.comment", "section.discussion", "div.comment.body", "div.reader.comments", "div.replies"),
    "share": ("div.share", "div.social", "ul.share.buttons", "div.tags", "div.byline", "div.meta"),
    "title": ("head title", "noscript"),
}
SAYINGS = {
    "menu": ("Home", "About", "Contact", "News", "Products", "Blog", "Sign in", "Startseite", "Accueil", "Inicio"),
    "header": ("Welcome to our site", "Log in", "Search", "Skip to content"),
    "footer": ("Copyright 2024", "All rights reserved", "Privacy policy", "Terms of use", "Impressum"),
    "sidebar": ("Related articles", "Most read", "Recent posts", "Read more", "Follow us"),
    "notice": ("We use cookies to improve your experience", "Accept all cookies", "Subscribe to our newsletter",
               "This site uses cookies", "Please enable JavaScript"),
    "advert": ("Advertisement", "Sponsored content", "Buy now", "Special offer", "Anzeige", "Publicité"),
    "form": ("Your email address", "Submit", "Search", "Password", "Name", "Subscribe"),
    "comments": ("Leave a comment", "Reply", "Great article, thanks for sharing", "says:", "I do not agree with this"),
    "share": ("Share this", "Tweet", "Posted by admin", "Tags", "Print"),
    "title": (),
}


def _marked(blocks: list[Block]) -> list[tuple[Block, bool]] | None:
    """Labels from the mark-up, for pages that mark their article; None for others."""
    away = {"nav", "footer", "aside", "form", "ad", "ads", "advert", "comment", "comments", "sidebar", "title", "button"}
    main = [bool({"article", "main"} & set(b.path)) and not away & set(b.path) for b in blocks]
    return [(b, y) for b, y in zip(blocks, main)] if any(main) else None


def _composed(texts: list[str], others: list[str], rng) -> list[tuple[Block, bool]]:
    """A page in another layout: the texts as its article, other blocks before, inside and after it."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    path = lambda name: tuple(name.replace(".", " ").split())
    wrap = ("html", "body") + (path(pick(("div.wrapper", "div.page", "div.container", "div"))) if rng.random() < 0.6 else ())

    def other(kind: str, outer: tuple[str, ...]) -> list[tuple[Block, bool]]:
        named = path(pick(OTHER[kind]))
        base = (("html",) if kind == "title" else outer) + named
        out = []
        for _ in range(int(rng.integers(1, 7 if kind in ("menu", "comments", "sidebar") else 3))):
            long = kind in ("comments", "sidebar", "notice", "advert", "footer") and rng.random() < 0.5
            words = pick(others).split()
            text = " ".join(words[: int(rng.integers(1, 5) if not long else rng.integers(5, 40))])
            if SAYINGS[kind] and rng.random() < 0.35:
                text = pick(SAYINGS[kind]) if rng.random() < 0.6 else f"{pick(SAYINGS[kind])} {text}"
            leaf = pick((("li",), ("p",), ("p",), ("div",), (), ("h3",), ("h2",), ("div", "p"), ("li", "p")))
            out.append((Block(base + leaf, text, float(kind in ("menu", "share") or rng.random() < 0.3)), False))
        return out

    inner = wrap + path(pick(MAIN))
    if rng.random() < 0.3:
        inner += path(pick(("div", "div.inner", "section", "div.text")))
    page = other("title", wrap)
    for kind in ("notice", "header", "menu", "advert", "sidebar", "form"):
        if rng.random() < 0.5:
            page += other(kind, wrap)
    body: list[tuple[Block, bool]] = []
    if rng.random() < 0.7:
        heading = pick((("h1",), ("h1",), ("h2",), ("header", "h1"), ("header", "entry", "header", "h1", "entry", "title")))
        body.append((Block(inner + heading, " ".join(texts[0].split()[:8]), 0.0), True))
    for text in texts:
        leaf = pick((("p",), ("p",), ("p",), ("p",), ("div",), ("blockquote", "p"), ("ul", "li"), ("h2",), ("pre",), ()))
        short = leaf in (("ul", "li"), ("h2",)) or rng.random() < 0.15
        body.append((Block(inner + leaf, " ".join(text.split()[:8]) if short else text,
                           0.1 * float(rng.random() < 0.2)), True))
        if rng.random() < 0.1:
            body += other(pick(("advert", "share", "sidebar", "notice", "form")), inner)
    page += body
    if rng.random() < 0.4:
        page += other("share", inner if rng.random() < 0.5 else wrap)
    if rng.random() < 0.5:
        page += other("comments", inner if rng.random() < 0.5 else wrap)
    for kind in ("sidebar", "form", "advert", "footer"):
        if rng.random() < 0.5:
            page += other(kind, wrap)
    return page


def learn(pages: DataFrame, sample: int = SAMPLE, composed: int = COMPOSED) -> Labeller:
    """Train on about ``sample`` pages of bounded size, drawn by a hash of their address; all if there are fewer."""
    pool = pages.filter(F.length("html").between(1, SAMPLE_CHARS))
    drawn = pool.filter(seeded_share(SEED, "url", "page_id") < min(1.0, sample / max(pool.count(), 1)))
    chosen = sorted(drawn.select("html").collect())
    real = [blocks_of(r["html"]) for r in chosen]
    marked = [m for m in map(_marked, real) if m]
    others = [b.text for m in marked for b, y in m if not y] or ["Home", "Contact"]
    rng = np.random.default_rng(SEED)
    articles = [[b.text for b, y in m if y and len(b.text) > 20] for m in marked]
    articles = [a for a in articles if a] or [["The text of a page that has some words, and then some more."] * 3]
    made = []
    for i in range(composed):
        texts = articles[i % len(articles)]
        start = int(rng.integers(0, len(texts)))
        made.append(_composed(texts[start : start + int(rng.integers(1, 12))], others + [t for a in articles[:50] for t in a[:2]], rng))
    return train(marked * max(1, composed // max(2 * len(marked), 1)) + made)


def batches_of(sizes: list[int], cells: int = CELLS_AT_ONCE) -> Iterator[list[int]]:
    """Pages with blocks, those of like length together, in batches that take at most so many cells when padded."""
    batch: list[int] = []
    for i in sorted((i for i, size in enumerate(sizes) if size), key=sizes.__getitem__):
        if batch and sizes[i] * (len(batch) + 1) > cells:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def _keep(net: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks are labelled as main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    for part in batches_of([len(p) for p in pages]):
        x = inputs_of([b for i in part for b in pages[i]])
        logits = _forward(net, _vectors(net, x), _layout([len(pages[i]) for i in part]))
        for column, i in enumerate(part):
            out[i] = logits[: len(pages[i]), column] > 0
    return out


def extract(pages: DataFrame, net: Labeller) -> DataFrame:
    """``page_id, url, text, n_chars``: the blocks labelled as main text, joined in page order by line feeds.

    A null or empty page, or one without any such block, gives an empty text. Rows that repeat are read
    again; null ids and addresses stay null. Pages are read whole, however long; a page in one task is
    what bounds memory. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "html", PAGE_BYTES):
                blocks = [blocks_of(h or "") for h in part.column("html").to_pylist()]
                kept = _keep(net, blocks)
                texts = ["\n".join(b.text for b, y in zip(bs, ys) if y) for bs, ys in zip(blocks, kept)]
                yield pa.record_batch(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")
