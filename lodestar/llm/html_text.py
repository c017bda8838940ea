"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table

#: Elements that end a block of text, elements without an end tag, and elements whose text is never shown.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg iframe object textarea head".split())
#: What a head may hold; any other tag ends a head that is still open.
IN_HEAD = frozenset("title meta link base style script noscript template".split())
#: A new one of these ends an open one of the same row.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body article section div main aside nav form select".split())
_NAMES = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """A run of text, the different tags and names around it, the nearest block element and tag, and how much of it is linked."""

    text: str
    tags: list[str]
    names: list[str]
    parent: str
    last: str
    linked: int


class Blocks(HTMLParser):
    """Leaf blocks of a page: runs of text between the tags of block elements, with their ancestors. No page makes it fail."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str]]] = []
        self.tags: dict[str, int] = {}  # how often each is open, those that are not left out
        self.names: dict[str, int] = {}
        self.out: list[Block] = []
        self.run: list[str] = []
        self.linked = self.hidden = self.links = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            parent = next((t for t, _ in reversed(self.stack) if t in BLOCK), "none")
            self.out.append(Block(text, list(self.tags), list(self.names), parent, self.stack[-1][0] if self.stack else "", self.linked))
        self.run, self.linked = [], 0

    def pop(self) -> None:
        tag, names = self.stack.pop()
        for counts, gone in ((self.tags, (tag,)), (self.names, names)):
            for x in gone:
                if counts[x] == 1:
                    del counts[x]
                else:
                    counts[x] -= 1
        self.hidden -= tag in HIDDEN
        self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
        if tag == "body":  # even an unclosed head ends here
            while self.stack and self.stack[-1][0] != "html":
                self.pop()
        if "head" in self.tags and tag not in IN_HEAD and tag != "head":
            while "head" in self.tags:
                self.pop()
        closed = CLOSES.get(tag) or (("p",) if tag in BLOCK and tag not in ("br", "button", "label", "option") else ())
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in closed:
                while len(self.stack) > k:
                    self.pop()
            elif self.stack[k][0] in SCOPE:
                break
        if tag not in VOID:
            names = [n for k, v in attrs if k in ("class", "id", "role") and v for n in _NAMES.split(v.lower()) if n]
            self.stack.append((tag, names))
            self.tags[tag] = self.tags.get(tag, 0) + 1
            for x in names:
                self.names[x] = self.names.get(x, 0) + 1
            self.hidden += tag in HIDDEN
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN and self.stack and self.stack[-1][0] == tag:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag in self.tags:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.run.append(data)
            self.linked += len(data) if self.links else 0


def blocks_of(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def features_of(b: Block) -> list[str]:
    n, words = len(b.text), b.text.count(" ") + 1
    size = "1" if words == 1 else "4" if words <= 4 else "12" if words <= 12 else "40" if words <= 40 else "more"
    links = b.linked / n
    out = ["always", f"words:{size}", "links:" + ("none" if links < 0.05 else "some" if links < 0.5 else "most"), f"last:{b.text[-1] in '.!?:;,)'}", f"parent:{b.parent}"]
    if "©" in b.text or "(c)" in b.text.lower():
        out.append("copyright")
    if re.match(r"h[1-6]$", b.last):
        out.append("heading")
    return out + [f"in:{t}" for t in b.tags] + [f"named:{x}" for x in b.names]


@dataclass
class Model:
    """Weights of features for label 1 over 0; move[a, b] for label b after a."""

    weights: dict[str, float] = field(default_factory=dict)
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def labels(self, blocks: list[Block]) -> list[int]:
        """The likeliest sequence of labels, by Viterbi; features that training had not are left out."""
        if not blocks:
            return []
        w, ((m00, m01), (m10, m11)) = self.weights, self.move.tolist()
        a, b, back = 0.0, 0.0, []
        for i, x in enumerate(blocks):
            e = sum(w.get(f, 0.0) for f in features_of(x))
            if i:
                back.append((int(b + m10 > a + m00), int(b + m11 > a + m01)))
                a, b = max(a + m00, b + m10), max(a + m01, b + m11)
            b += e
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def text(self, html: str | None) -> str:
        blocks = blocks_of(html)
        return " ".join(b.text for b, y in zip(blocks, self.labels(blocks), strict=True) if y)


def train(pages: list[tuple[str, set[str]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """pages: html and the texts of the blocks that are main text. Maximum likelihood by Adam; all pages step together."""
    data = [(b, t) for b, t in ((blocks_of(h), t) for h, t in pages) if b]
    names = sorted({f for b, _ in data for x in b for f in features_of(x)})
    place, most = {f: i for i, f in enumerate(names)}, max(len(b) for b, _ in data)
    x = np.zeros((len(data), most, len(names)), np.float32)
    y, n = np.zeros((len(data), most), int), np.array([len(b) for b, _ in data])
    for i, (b, texts) in enumerate(data):
        for k, block in enumerate(b):
            x[i, k, [place[f] for f in features_of(block)]] = 1
            y[i, k] = block.text in texts
    inside = np.arange(most) < n[:, None]
    w, move = np.zeros(len(names)), np.zeros((2, 2))
    m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for step in range(1, rounds + 1):
        e = np.stack([np.zeros((len(data), most)), x @ w], axis=2)
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for k in range(1, most):
            s = ahead[:, k - 1, :, None] + move
            ahead[:, k] = np.where(inside[:, k, None], np.logaddexp(s[:, 0], s[:, 1]) + e[:, k], ahead[:, k - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for k in range(most - 2, -1, -1):
            s = move + (e[:, k + 1] + behind[:, k + 1])[:, None, :]
            behind[:, k] = np.where(inside[:, k + 1, None], np.logaddexp(s[:, :, 0], s[:, :, 1]), 0)
        p = np.exp(ahead + behind - total[:, None, None])[..., 1] * inside
        g_w = np.einsum("ik,ikf->f", (p - y) * inside, x) / len(data) + decay * w
        both = np.exp(ahead[:, :-1, :, None] + move + (e + behind)[:, 1:, None, :] - total[:, None, None, None]) * inside[:, 1:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
        g = np.append(g_w, ((both.sum(axis=(0, 1)) - seen) / len(data) + decay * move).ravel())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, move = w - change[:-4], move - change[-4:].reshape(2, 2)
    return Model(dict(zip(names, w.tolist(), strict=True)), move)


class LabelledPages:
    """Made pages whose main text is known: an article among menus, notices, adverts, forms, comments and so on, in many mark-ups."""

    def __init__(self, seed: int = 20240817):
        self.random = random.Random(seed)
        syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u an er is on".split()]
        self.words = ["".join(self.random.choices(syllables, k=self.random.randint(1, 4))) for _ in range(600)]

    def words_of(self, low: int, high: int, stop: str = "") -> str:
        return " ".join(self.random.choices(self.words, k=self.random.randint(low, high))).capitalize() + stop

    def wrap(self, kinds: list[str], body: str) -> str:
        kind = self.random.choice(kinds)
        tag, _, name = kind.partition(".")
        attribute = f' {self.random.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{body}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words_of(1, 3)}</a>' for i in range(self.random.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.random.random() < 0.7 else " | ".join(items)

    def paragraph(self) -> str:
        return self.words_of(3, 80, self.random.choice([".", ".", ".", "!", ""]))

    def extra(self) -> str:
        r = self.random
        return r.choice([
            lambda: self.wrap(["div.ad", "div.ads", "div.advert", "aside.sponsor", "div.banner", "div.promo", "div.advertisement", "ins.adsbygoogle", "section.sponsored"], self.paragraph()),
            lambda: self.wrap(["div.cookie", "div.notice", "div.consent", "div.alert", "section.newsletter", "div.gdpr", "div.cookie-notice", "div.popup", "dialog.modal"], f"<p>{self.paragraph()}</p>"),
            lambda: self.wrap(["aside", "div.sidebar", "aside.related", "div.widget", "div.related", "section.recommended", "div.share", "div.social"], f"<h3>{self.words_of(1, 4)}</h3>" + self.links(2, 6) + (f"<p>{self.paragraph()}</p>" if r.random() < 0.5 else "")),
            lambda: self.wrap(["form", "form.search", "form.login", "div.search"], f"<label>{self.words_of(1, 3)}</label><input name=q><button>{self.words_of(1, 2)}</button>"),
            lambda: self.wrap(["section.comments", "div.comments", "div.comment-list", "div.replies", "div.responses", "ol.comments", "div.discussion"], "".join(self.wrap(["div.comment", "li.comment", "article.comment", "p"], f"<p>{self.paragraph()}</p>") for _ in range(r.randint(1, 4)))),
            lambda: self.wrap(["nav", "nav.menu", "div.menu", "div.navbar", "ul.nav", "div.breadcrumb", "nav.toc", "div.pagination", "div.navigation"], self.links(3, 8)),
        ])()

    def page(self) -> tuple[str, set[str]]:
        r, texts, body = self.random, set(), []

        def own(tag: str, text: str) -> str:
            texts.add(text)
            return f"<{tag}>{text}</{tag}>" if r.random() < 0.85 or tag != "p" else f"<p>{text}"

        title = self.words_of(3, 12)
        if r.random() < 0.85:
            body.append(own(r.choice(["h1", "h1", "h2"]), title))
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.7:
                body.append(own("p", self.paragraph()) if r.random() < 0.85 else f"<p>{self._bold(texts)}</p>")
            elif x < 0.78:
                body.append(own(r.choice(["h2", "h3"]), self.words_of(1, 6)))
            elif x < 0.86:
                body.append("<ul>" + "".join(own("li", self.words_of(2, 14)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.92:
                body.append(f"<blockquote>{own('p', self.paragraph())}</blockquote>")
            elif x < 0.95:
                body.append("<table><tr>" + "".join(own("td", self.words_of(1, 5)) for _ in range(3)) + "</tr></table>")
            if r.random() < 0.15:
                body.append(self.extra())
        article = self.wrap(["article"] * 6 + ["main"] * 2 + ["div.content", "div.post", "div.entry-content", "div.article-body", "section.story", "div.main", "article.post", "div.text", "div"], "".join(body))
        if r.random() < 0.2:
            article = f"<main>{article}</main>"
        before = [self.wrap(["header", "div.header", "div.masthead", "header.site"], self.words_of(1, 5) + (f"<p>{self.paragraph()}</p>" if r.random() < 0.3 else ""))] if r.random() < 0.5 else []
        before += [self.wrap(["nav", "div.menu", "nav.main-nav", "div.nav", "ul.menu"], self.links(3, 8))] if r.random() < 0.8 else []
        before += [self.extra() for _ in range(r.randint(0, 2))]
        after = [self.extra() for _ in range(r.randint(0, 3))]
        after += [self.wrap(["footer", "footer", "div.footer", "footer.site-footer"], r.choice(["&copy; ", "", "Copyright "]) + self.words_of(2, 20, ".") + (self.links(1, 4) if r.random() < 0.4 else ""))] if r.random() < 0.85 else []
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>", texts

    def _bold(self, texts: set[str]) -> str:
        a, b, c = self.words_of(1, 20), self.words_of(1, 3), self.words_of(1, 20, ".")
        texts.add(f"{a} {b} {c}")
        return f"{a} <{(t := self.random.choice(['b', 'em', 'a', 'span']))}>{b}</{t}> {c}"


@lru_cache(4)
def trained(pages: int = 600, seed: int = 20240817) -> Model:
    made = LabelledPages(seed)
    return train([made.page() for _ in range(pages)])


def extract(pages: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """pages with text, in place of any such column: the blocks that the model calls main text, joined by spaces.

    Character references are decoded, white space inside a block becomes one space. Null and empty pages, and pages
    without main text, get an empty text. Pages are parsed as a whole, however long.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([sent.value.text(h.as_py()) for h in batch.column(batch.schema.get_field_index("html"))], pa.string())]

    return append_columns(pages, fn, [T.StructField("text", T.StringType())], drop)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, trained(), drop=("html",))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
