"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html as refs
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
#: A tag that the page ends within is no text.
UNFINISHED = re.compile(r"</?[a-zA-Z]")
NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements whose contents are not text of the page.
SKIPPED = ("script", "style", "title", "textarea", "template", "noscript", "iframe", "svg", "select", "object", "canvas")
#: Those that take the rest of the page where their end tag is missing; the others are then passed over as single tags.
RAW = ("script", "style", "title", "textarea")
SKIPPED_END = {name: re.compile(f"</{name}(?![^\\s/>])", re.I | re.A) for name in SKIPPED}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An element that opens ends these open ones.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Groups of parts of class, id and role names.
NAME_PARTS = {
    "advert": ("ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "dfp", "teaser"),
    "menu": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs"),
    "head": ("header", "masthead", "topbar", "logo", "branding"),
    "foot": ("footer", "foot", "copyright", "legal", "contentinfo", "colophon"),
    "side": ("sidebar", "side", "aside", "rail", "widget", "related", "recommended", "popular", "trending", "complementary"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "newsletter", "subscribe", "signup", "paywall"),
    "reader": ("comment", "comments", "respond", "reply", "replies", "disqus", "discussion", "thread"),
    "form": ("form", "search", "login", "contact", "searchbox"),
    "social": ("share", "social", "sharing", "follow", "tags", "meta", "byline", "author"),
    "main": ("content", "article", "post", "entry", "main", "body", "story", "text", "articlebody", "prose"),
}
PART_GROUP = {p: g for g, parts in NAME_PARTS.items() for p in parts}
SPACE = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: Tags whose presence above a block is a feature.
TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "p", "h1", "h2", "h3", "blockquote", "pre", "figure", "figcaption", "button", "dialog", "div", "dl", "address", "details", "fieldset", "body", "menu")
TAG_SET = frozenset(TAGS)


def groups_of(attributes: str) -> frozenset[str]:
    found = set()
    for value in NAMES.findall(attributes):
        found.update(PART_GROUP.get(p.lower(), "") for p in SPACE.split(value))
    return frozenset(found - {""})


class Leaf:
    """A run of text without a block element's start or end inside: its text, the names of the elements above it, the
    nearest block element, the groups of their names, and how many of its words are in links."""

    __slots__ = ("above", "groups", "linked", "parent", "text")

    def __init__(self, text: str, above: frozenset[str], parent: str, groups: frozenset[str], linked: int) -> None:
        self.text, self.above, self.parent, self.groups, self.linked = text, above, parent, groups, linked


class Stack:
    """The open elements. What holds for all elements above a block is kept for each of them, and so are the places of
    each name, so every step takes the same time however deep a page nests."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.above: list[frozenset[str]] = [frozenset()]
        self.groups: list[frozenset[str]] = [frozenset()]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, groups: frozenset[str]) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        last = self.above[-1]
        self.above.append(last if name in last or name not in TAG_SET else last | {name})
        self.groups.append(self.groups[-1] if groups <= self.groups[-1] else self.groups[-1] | groups)

    def cut(self, place: int) -> None:
        """Ends the element at a place and all above it."""
        while len(self.names) > place:
            name = self.names.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            self.above.pop()
            self.groups.pop()

    def close(self, name: str) -> None:
        """An end tag: ends the nearest element of the name; an inline one doesn't reach beyond a block."""
        if self.places.get(name):
            place = self.places[name][-1]
            if name not in INLINE or not self.blocks or self.blocks[-1] < place:
                self.cut(place)

    def make_room(self, name: str) -> None:
        """A block element opens: ends open paragraphs and the elements that it can't be in."""
        while self.blocks and (self.names[self.blocks[-1]] == "p" or self.names[self.blocks[-1]] in ENDS.get(name, ())):
            self.cut(self.blocks[-1])

    def parent(self) -> str:
        return self.names[self.blocks[-1]] if self.blocks else ""

    def links(self) -> bool:
        return bool(self.places.get("a"))


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks of a page in page order. Tags may be unclosed or wrongly nested, to any depth; white space is
    collapsed and character references are decoded."""
    out: list[Leaf] = []
    stack = Stack()
    text: list[str] = []
    linked = 0
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Leaf(whole, stack.above[-1], stack.parent(), stack.groups[-1], linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = refs.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if stack.links():
                linked += len(piece.split())

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if not m:
            cut = UNFINISHED.search(page, at)
            add(page[at : cut.start() if cut else len(page)])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in SKIPPED:
            if not closing and not attributes.endswith("/") and name not in endless:
                end = SKIPPED_END[name].search(page, at)
                if end:
                    at = end.start()
                elif name in RAW:
                    at = len(page)
                else:
                    endless.add(name)  # nor is there one further on
            continue
        inline = name in INLINE
        if not inline:
            flush()
        elif name == "br":
            text.append(" ")
        if closing:
            stack.close(name)
        elif name not in VOID:
            if not inline:
                stack.make_room(name)
            if not attributes.endswith("/"):
                stack.push(name, groups_of(attributes) if "=" in attributes else frozenset())
    flush()
    return out


def observations(leaf: Leaf, seen_heading: bool) -> list[str]:
    """Names of the binary features that a leaf has."""
    n = len(leaf.text.split())
    above = leaf.above
    inside = "article" in above or "main" in above or "main" in leaf.groups
    out = ["all", f"parent:{leaf.parent if leaf.parent in TAG_SET else '-'}"]
    out += [f"above:{t}" for t in TAGS if t in above]
    out += [f"name:{g}" for g in leaf.groups]
    out += [f"words:{sum(n > k for k in (2, 5, 10, 25, 60))}", f"links:{sum(leaf.linked > k * n for k in (0, 0.3, 0.7))}"]
    out.append("inside" if inside else "outside")
    apart = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"} & above
    shunned = leaf.groups - {"main", "social", "head"}
    out.append("apart" if apart else "joined")
    out.append("shunned" if shunned else "neutral")
    if inside and not apart and not shunned:
        out.append("inside:clean")
    if leaf.text[-1] in ".!?:;…":
        out.append("stopped")
    if leaf.text[0] in "©®":
        out.append("mark")
    out.append("after-heading" if seen_heading else "before-heading")
    return out


def observed(page: list[Leaf]) -> list[list[str]]:
    seen, out = False, []
    for leaf in page:
        seen = seen or "h1" in leaf.above
        out.append(observations(leaf, seen))
    return out


class Field:
    """A linear-chain conditional random field with two labels, other (0) and main (1)."""

    def __init__(self, pages: list[list[list[str]]], labels: list[list[int]], steps: int = 120, rate: float = 0.15, decay: float = 1e-4) -> None:
        names = sorted({f for p in pages for b in p for f in b})
        self.index = {f: k for k, f in enumerate(names)}
        longest = max(map(len, pages))
        mask = np.zeros((len(pages), longest), bool)
        for i, p in enumerate(pages):
            mask[i, : len(p)] = True
        x = np.zeros((int(mask.sum()), len(names)), np.float32)  # a row for each block, in the order of mask
        for k, b in enumerate(b for p in pages for b in p):
            x[k, [self.index[f] for f in b]] = 1
        gold = np.zeros((*mask.shape, 2))
        gold[mask] = np.eye(2)[np.concatenate(labels)]
        self.w = np.zeros((len(names), 2))
        self.t = np.zeros((2, 2))
        pairs = mask[:, 1:]
        gold_t = np.einsum("ija,ijb->ab", gold[:, :-1], gold[:, 1:])
        state = [[np.zeros_like(p) for _ in range(2)] for p in (self.w, self.t)]
        for k in range(1, steps + 1):
            unary = np.zeros((*mask.shape, 2))
            unary[mask] = x @ self.w.astype(np.float32)
            node, edge = self._marginals(unary, mask, pairs)
            grads = (
                x.T @ (node - gold)[mask].astype(np.float32) / len(pages) + decay * self.w,
                (edge - gold_t) / len(pages) + decay * self.t,
            )
            for (m, v), p, g in zip(state, (self.w, self.t), grads):
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.999 * v + 0.001 * g * g
                p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)

    def _marginals(self, unary: np.ndarray, mask: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels, and expected counts of label pairs, by the forward-backward algorithm."""
        n, length, _ = unary.shape
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = unary[:, 0]
        for j in range(1, length):
            step = np.logaddexp.reduce(forward[:, j - 1, :, None] + self.t[None], axis=1) + unary[:, j]
            forward[:, j] = np.where(mask[:, j, None], step, forward[:, j - 1])
        for j in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(self.t[None] + (unary[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(mask[:, j + 1, None], step, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        node = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        edge = forward[:, :-1, :, None] + self.t + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        return node, (np.exp(np.minimum(edge, 0)) * pairs[..., None, None]).sum(axis=(0, 1))

    def viterbi(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        if not page:
            return []
        score, back = None, []
        t, w, index = self.t.tolist(), self._weights(), self.index
        for b in page:
            u0 = u1 = 0.0
            for f in b:
                k = index.get(f)
                if k is not None:
                    u0 += w[k][0]
                    u1 += w[k][1]
            if score is None:
                score = (u0, u1)
                continue
            a0, b0 = score[0] + t[0][0], score[1] + t[1][0]
            a1, b1 = score[0] + t[0][1], score[1] + t[1][1]
            back.append((0 if a0 >= b0 else 1, 0 if a1 >= b1 else 1))
            score = (max(a0, b0) + u0, max(a1, b1) + u1)
        label = 0 if score[0] >= score[1] else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def _weights(self) -> list[list[float]]:
        if not hasattr(self, "_list"):
            self._list = self.w.tolist()
        return self._list


def labelled_pages(n: int = 300, seed: int = 3) -> list[tuple[str, list[int]]]:
    """Made pages of many layouts with the label of every leaf block: what the field is trained on."""
    rng = random.Random(seed)
    pick = rng.choice

    def words(a: int, b: int, stop: str = ".") -> str:
        syllables = ("ka", "lo", "mi", "ren", "tas", "vo", "shu", "el", "ond", "ri", "pe", "ag")
        return " ".join("".join(pick(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b))) + stop

    def links(k: int) -> list[tuple[str, int]]:
        return [(f"<li><a href='/x'>{words(1, 3, '')}</a></li>", 0) for _ in range(k)]

    def around(tag: str, name: str, inner: list[tuple[str, int]]) -> list[tuple[str, int]]:
        return [(f"<{tag}{name}>", -1), *inner, (f"</{tag}>", -1)]

    def named(*names: str) -> str:
        return f' {pick(("class", "id"))}="{pick(names)}"'

    def paragraphs(k: int, label: int = 1) -> list[tuple[str, int]]:
        out = []
        for _ in range(k):
            kind = rng.random()
            t = words(1, 4) if kind < 0.15 else words(5, 120)
            if kind > 0.98:
                out += around("dl", "", [x for _ in range(rng.randint(1, 3)) for x in ((f"<dt>{words(1, 3, '')}", label), (f"<dd>{words(2, 20)}", label))])
            elif kind > 0.96:
                out += [(f"<pre>{words(2, 30)}</pre>", label)]
            elif kind > 0.9:
                out += [(f"<h2>{words(2, 6, '')}</h2>", label)]
            if kind > 0.85:
                out += around("ul", "", [(f"<li>{words(2, 20)}</li>", label) for _ in range(rng.randint(1, 4))])
            elif kind > 0.8:
                out += [(f"<blockquote>{t}</blockquote>", label)]
            elif kind > 0.7:
                out += [(f"<p><b>{t}<br>", label)]
            elif kind > 0.6:
                out += [(f"<p>{words(3, 30, '')} <a href='/y'>{words(1, 3, '')}</a> {t}</p>", label)]
            else:
                out += [(f"<p>{t}</p>", label)]
        return out

    def clutter() -> list[tuple[str, int]]:
        return pick(
            (
                lambda: around("div", named("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner"), [(words(3, 25), 0)]),
                lambda: around("aside", pick(("", named("sidebar", "related", "widget"))), [(f"<h3>{words(1, 4, '')}</h3>", 0), *paragraphs(1, 0), *around("ul", "", links(rng.randint(2, 6)))]),
                lambda: around("aside", pick(("", named("pullout", "note"))), pick((paragraphs(1, 0), [(words(2, 9, ''), 0)], [(f"<p>{words(2, 9, '')}</p>", 0)]))),
                lambda: around("div", named("sidebar", "right-rail", "related-posts", "popular"), paragraphs(rng.randint(1, 3), 0)),
                lambda: around("div", named("cookie-notice", "consent", "gdpr-banner", "alert", "newsletter", "popup"), [(f"<p>{words(5, 40)}</p>", 0), (f"<button>{words(1, 2, '')}</button>", 0)]),
                lambda: around("form", named("search", "login", "contact-form"), [(f"<label>{words(1, 3, '')}</label>", 0), (f"<p>{words(3, 12)}</p>", 0), (f"<button>{words(1, 2, '')}</button>", 0)]),
                lambda: around("div", named("share", "social"), [*around("ul", "", links(rng.randint(2, 4)))]),
            )
        )()

    def reader() -> list[tuple[str, int]]:
        inner = [(f"<h3>{words(1, 3, '')}</h3>", 0)]
        for _ in range(rng.randint(1, 4)):
            inner += around("div", named("comment", "comment-body", "reply"), paragraphs(rng.randint(1, 2), 0))
        return around(pick(("section", "div")), named("comments", "comment-list", "respond", "discussion"), inner)

    made = []
    for _ in range(n):
        parts: list[tuple[str, int]] = [("<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body>", -1)]
        if rng.random() < 0.8:
            menu = around("ul", "", links(rng.randint(2, 8)))
            parts += around("nav", "", menu) if rng.random() < 0.7 else around("div", named("menu", "navbar", "main-nav", "breadcrumbs"), menu)
        if rng.random() < 0.5:
            parts += around("header", pick(("", named("site-header", "masthead"))), [(f"<div>{words(1, 5, '')}</div>", 0), *around("ul", "", links(rng.randint(0, 4)))])
        for _ in range(rng.randint(0, 2)):
            parts += clutter()
        body = [(f"<h1>{words(1, 14, pick(('', '.')))}</h1>", 1)] if rng.random() < 0.9 else []
        for chunk in range(rng.randint(1, 3)):
            body += paragraphs(rng.randint(0 if body else 1, 8))
            if rng.random() < 0.3:
                body += clutter()
        if rng.random() < 0.15:
            body += reader()
        shape = rng.random()
        if shape < 0.06:  # pages that are laid out by tables, or name nothing
            parts += around("table", "", around("tr", "", around("td", "", body)))
        elif shape < 0.12:
            parts += around(pick(("div", "section", "center")), "", body)
        elif shape < 0.5:
            parts += around("article", pick(("", named("post", "entry", "story"))), body)
        elif shape < 0.65:
            parts += around("main", "", body)
        elif shape < 0.75:
            parts += around("main", "", around("article", "", body))
        else:
            parts += around("div", named("content", "article-body", "post", "entry-content", "main", "story-text"), body)
        if rng.random() < 0.3:
            parts += reader()
        for _ in range(rng.randint(0, 2)):
            parts += clutter()
        if rng.random() < 0.85:
            foot = [(f"{pick(('&copy; ', '', ''))}{words(3, 20)}", 0)]
            parts += around("footer", "", foot) if rng.random() < 0.7 else around("div", named("footer", "copyright", "legal"), foot)
        if rng.random() < 0.9:
            parts.append(("</body></html>", -1))
        made.append(("".join(p for p, _ in parts), [label for _, label in parts if label >= 0]))
    return [(p, y) for p, ys in made for y in [labels_of(p, ys)] if y is not None]


def labels_of(page: str, by_part: list[int]) -> list[int] | None:
    """Labels of the leaves; None if they are not one for each labelled part."""
    found = leaves(page)
    if len(found) == len(by_part):
        return by_part
    return None


def train(pages: list[tuple[str, list[int]]]) -> Field:
    """A field from pages and the labels (1: main text) of their leaf blocks."""
    return Field([observed(leaves(p)) for p, _ in pages], [y for _, y in pages])


def main_text(page: str | None, field: Field) -> str:
    found = leaves(page or "")
    return "\n".join(b.text for b, y in zip(found, field.viterbi(observed(found))) if y)


def extract(df: DataFrame, field: Field, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all but html), text and n_chars (code points).

    Null or empty html, and pages without main text: an empty text. Equal pages, equal texts. Columns named text or
    n_chars are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (html, "text", "n_chars")]
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "__html"):
            out = [main_text(p, field) for p in block.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*block.columns[: len(keep)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*keep, "text", "n_chars"]
            )

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html}`").alias("__html")).mapInArrow(run, fields + "text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(labelled_pages()))
