"""Main text of web pages: a bidirectional LSTM in numpy labels every block of a page.

A page becomes its sequence of leaf blocks. Each has hashed counts of the names,
classes and ids on its tag path, hashed counts of its words, and a few numbers.
Two LSTMs read the whole sequence, one from each end, so each block is judged by
what is around it. The model is trained here on SAMPLE pages with labels that
follow from what their markup says (article and main against navigation, adverts, forms, comments
and the like), and on variants of them whose containers are renamed and which
have more blocks of the latter kinds.

Script, style, template and head are never blocks, and comments of the markup are
none. A head without an end tag ends at the first thing it cannot hold; a self-closed element is empty. White space in a block becomes one space; blocks of the article are joined
by two line feeds. Null or empty html gives an empty text. Every row gives one
row, repeated ones too; nothing is cut off; other columns are not read; without pages to train on
the markup's own labels are used. Equal tables give equal models.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE, SAMPLE_CHARS = 300, 100_000
PATHS, WORDS, NUMBERS, HIDDEN = 96, 48, 6, 16
EPOCHS, BATCH, RATE = 12, 32, 0.01
#: Blocks of a batch of sequences that are computed together.
BATCH_BLOCKS = 20_000

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                    "s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("head iframe noscript script style svg template title".split())
#: What an open head can hold; anything else ends it.
_HEADED = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A start tag whose last slash is no part of an attribute's value.
_CLOSED = re.compile(r"""(?:^<[^\s/>]+|[\s"'/])/>\Z""")
#: What closes an open element of the same list when it starts.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",)}
_LIMITS = frozenset("article aside body div footer form header html main nav ol section table ul".split())
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z0-9]+")

#: Parts of a page that are not its article, by element and by a word of a class or an id.
ASIDE_TAGS = frozenset("aside button dialog fieldset footer form header input menu nav option select textarea".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
                        "footer header login menu modal nav navbar navigation newsletter notice notices pagination popup promo "
                        "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
MAIN_WORDS = frozenset("article content entry main post story body text".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.path: tuple[str, ...] = ()
        self.linked = self.links = self.unseen = 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append(Block(self.path, text, self.linked))
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.unseen:
            self._leave_head(tag)
        if tag not in _INLINE:
            self.flush()
            if tag not in _VOID:
                self._imply(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        marks = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        self.stack.append((tag, " ".join([tag, *(f".{t}" for t in _TOKEN.findall(marks.lower()))])))
        self.links += tag == "a"
        self.unseen += tag in _UNSEEN

    def _leave_head(self, tag: str = "") -> None:
        """The end of an open head, which need not be written: body, or whatever else it cannot hold, ends it."""
        names = [name for name, _ in self.stack]
        if "head" in names and (names[-1] == "head" and tag not in _HEADED or tag == "body" and "template" not in names):
            self._cut(names.index("head"))

    def _imply(self, tag: str) -> None:
        """Elements that the start of this block ends: an open p, or the list item before."""
        closing = _CLOSES.get(tag, ())
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == "p" or name in closing:
                self._cut(i)
                if name in closing:
                    return
            elif name in _LIMITS:
                return

    def _cut(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.links -= tag == "a"
            self.unseen -= tag in _UNSEEN
        del self.stack[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._cut(i)
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and _CLOSED.search(self.get_starttag_text() or ""):
            self._cut(len(self.stack) - 1)

    def handle_data(self, data: str) -> None:
        if self.unseen and not data.isspace():
            self._leave_head()
        if self.unseen:
            return
        if not self.parts:
            if data.isspace():
                return
            self.path = tuple(mark for _, mark in self.stack)
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def blocks_of(html: str | None) -> list[Block]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def marked(block: Block) -> bool:
    """What the markup says of a block: the last element that speaks decides, an aside part before all."""
    inside = False
    for element in block.path:
        tag, *names = element.split(" ")
        words = {x[1:] for x in names}
        if tag in ASIDE_TAGS or words & ASIDE_WORDS:
            return False
        inside |= tag in ("article", "main") or bool(words & MAIN_WORDS)
    return inside


@lru_cache(maxsize=4096)
def _path_counts(path: tuple[str, ...]) -> np.ndarray:
    marks = [zlib.crc32(mark.encode("utf-8", "replace")) % PATHS for element in path for mark in element.split(" ")]
    return np.bincount(marks, minlength=PATHS)


def features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), PATHS + WORDS + NUMBERS), dtype=np.float32)
    for i, block in enumerate(blocks):
        out[i, :PATHS] = _path_counts(block.path) if block.path else 0
        words = block.text.split(" ")
        hashed = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], dtype=np.uint32) % WORDS
        out[i, PATHS:PATHS + WORDS] = np.bincount(hashed, minlength=WORDS) / np.sqrt(len(words)) / 4
        size = len(block.text)
        out[i, PATHS + WORDS:] = (np.log1p(size) / 5, np.log1p(len(words)) / 5, block.linked / size, sum(map(block.text.count, ".,;!?")) / len(words),
                                  i / len(blocks), 1.0)
    np.minimum(out, 2, out=out)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of the two directions (input, recurrent, bias) and of the output."""

    w: list[np.ndarray]

    def _pass(self, x: np.ndarray, side: int) -> list[tuple]:
        """States of one direction over x (steps, sequences, features)."""
        wx, wh, b = self.w[3 * side: 3 * side + 3]
        n = x.shape[1]
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), []
        for step in x @ wx + b:
            gates = step + h @ wh
            i, f, o = _sigmoid(gates[:, :HIDDEN]), _sigmoid(gates[:, HIDDEN:2 * HIDDEN] + 1), _sigmoid(gates[:, 2 * HIDDEN:3 * HIDDEN])
            g = np.tanh(gates[:, 3 * HIDDEN:])
            before, h_before = c, h
            c = f * c + i * g
            t = np.tanh(c)
            h = o * t
            out.append((h, i, f, o, g, before, t, h_before))
        return out

    def states(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list, list, np.ndarray]:
        flip = _flip(x, lengths)
        forth, back = self._pass(x, 0), self._pass(flip, 1)
        ahead = np.stack([s[0] for s in forth])
        behind = _flip(np.stack([s[0] for s in back]), lengths)
        return np.concatenate((ahead, behind), axis=2), forth, back, flip

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, the chance of each block to be of the article."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            take = max(1, min(len(order), BATCH_BLOCKS // len(pages[order[-1]])))
            batch, order = order[-take:], order[:-take]
            x, lengths = _padded([pages[i] for i in batch])
            p = _sigmoid(self.states(x, lengths)[0] @ self.w[6] + self.w[7])[:, :, 0]
            for k, i in enumerate(batch):
                out[i] = p[: lengths[k], k]
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((lengths.max(), len(pages), pages[0].shape[1]), dtype=np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
    return x, lengths


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence backwards, its padding still at the end."""
    steps = np.arange(x.shape[0])[:, None]
    at = np.where(steps < lengths, lengths - 1 - steps, steps)
    return np.take_along_axis(x, at[:, :, None], axis=0)


def _back(model: Labeller, side: int, x: np.ndarray, tape: list, up: np.ndarray) -> list[np.ndarray]:
    """Gradients of one direction's weights; up: gradients of its states."""
    wx, wh, _ = model.w[3 * side: 3 * side + 3]
    dwx, dwh, db = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN, np.float32)
    dh, dc = np.zeros_like(up[0]), np.zeros_like(up[0])
    for s in range(len(tape) - 1, -1, -1):
        _, i, f, o, g, before, t, h_before = tape[s]
        dh = dh + up[s]
        dc = dc + dh * o * (1 - t * t)
        gates = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        dwx += x[s].T @ gates
        dwh += h_before.T @ gates
        db += gates.sum(axis=0)
        dh, dc = gates @ wh.T, dc * f
    return [dwx, dwh, db]


def learn(pages: list[np.ndarray], labels: list[np.ndarray]) -> Labeller:
    """Adam on the mean logistic loss of blocks; the same input gives the same model."""
    rng = np.random.default_rng(7)
    size = PATHS + WORDS + NUMBERS
    w = []
    for _ in range(2):
        w += [rng.normal(0, 0.1, (size, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)]
    model = Labeller([x.astype(np.float32) for x in [*w, rng.normal(0, 0.2, (2 * HIDDEN, 1)), np.zeros(1)]])
    first, second, turn = [np.zeros_like(x) for x in model.w], [np.zeros_like(x) for x in model.w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(pages))
        for k in range(0, len(order), BATCH):
            batch = order[k:k + BATCH]
            x, lengths = _padded([pages[i] for i in batch])
            y, _ = _padded([labels[i][:, None] for i in batch])
            real = (np.arange(x.shape[0])[:, None] < lengths)[:, :, None]
            states, forth, back, flip = model.states(x, lengths)
            gap = (_sigmoid(states @ model.w[6] + model.w[7]) - y) * real / real.sum()
            up = gap @ model.w[6].T
            behind = _flip(up[:, :, HIDDEN:], lengths)
            grads = [*_back(model, 0, x, forth, up[:, :, :HIDDEN]), *_back(model, 1, flip, back, behind),
                     np.tensordot(states, gap, ((0, 1), (0, 1))), gap.sum(axis=(0, 1))]
            turn += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.99 * second[i] + 0.01 * grad**2
                model.w[i] = (model.w[i] - RATE * (first[i] / (1 - 0.9**turn)) / (np.sqrt(second[i] / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
    return model


def _variant(blocks: list[Block], pool: list[str], rng: random.Random) -> list[tuple[Block, bool]]:
    """A page with its container renamed and with more parts that are no article."""
    box = rng.choice(("article", "main", "main .content", "div .content", "div .post .content", "div .article", "section .entry .content", "div .story"))
    rows: list[tuple[Block, bool]] = []
    for block in blocks:
        good = marked(block)
        path = tuple(box if e.split(" ")[0] == "article" else e for e in block.path)
        rows.append((Block(path, block.text, block.linked), good))
    first = next((i for i, (_, good) in enumerate(rows) if good), 0)
    last = max((i for i, (_, good) in enumerate(rows) if good), default=-1) + 1

    def text(low: int, high: int) -> str:
        own = rng.choice(pool).split(" ")
        return " ".join(own[: rng.randrange(low, high)])

    def part(path: tuple[str, ...], n: int, high: int, linked: bool) -> list[tuple[Block, bool]]:
        made = [text(1, high) for _ in range(n)]
        return [(Block(("html", "body", *path), t, len(t) if linked else 0), False) for t in made]

    inside = (box,) if rng.random() < 0.4 else ()
    tails = [part((*inside, f"{rng.choice(('div', 'section', 'ol'))} .{rng.choice(('comments', 'comment', 'replies', 'respond'))}",
                   *rng.choice([(), ("div .comment",), ("li .comment",), ("article .comment",)]), "p"), rng.randrange(1, 5), 60, False),
             part(("aside .sidebar", *rng.choice([("p",), ("ul", "li"), ("div .widget",)])), rng.randrange(1, 5), 25, rng.random() < 0.5),
             part((f"div .{rng.choice(('related', 'sidebar', 'newsletter', 'share', 'widget', 'promo'))}", rng.choice(("p", "h3", "li"))), 2, 25, rng.random() < 0.5),
             part(("footer", rng.choice(("p", "div", "ul"))), 1, 30, False)]
    heads = [part(("header", rng.choice(("h1", "p", "div .logo"))), 1, 12, False),
             part((f"div .{rng.choice(('cookie', 'notice', 'banner', 'consent', 'ad', 'advertisement', 'popup'))}", rng.choice(("p", "div", "span"))), 1, 40, False),
             part((rng.choice(("nav", "div .menu", "ul .navbar")), "ul", "li"), rng.randrange(2, 6), 3, True)]
    middle = [part((*inside, rng.choice(("form", "form .signup", "div .ad", "aside", "div .advert", "div .newsletter"))), 1, 30, False)]
    if first < last - 1 and rng.random() < 0.5:
        cut = rng.randrange(first + 1, last)
        rows[cut:cut] = rng.choice(middle)
        last += 1
    for extra in (x for x in tails if rng.random() < 0.5):
        rows[last:last] = extra
    for extra in (x for x in heads if rng.random() < 0.5):
        rows[first:first] = extra
    return rows


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Labeller | None:
    """A model from the SAMPLE pages with the least hashes of their id and html (of up to SAMPLE_CHARS, with an article)."""
    html = F.col(html_col)
    hashed = pages.select(F.xxhash64(F.col(id_col), html).alias("h"), html.alias("html")).where(F.length("html").between(1, SAMPLE_CHARS))
    # Only hashes meet first: a task sends SAMPLE numbers to the driver, not SAMPLE pages.
    least = [r["h"] for r in hashed.select("h").orderBy("h").limit(SAMPLE).collect()]
    chosen = hashed.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if least else []
    parsed = [b for b in (blocks_of(r["html"]) for r in chosen) if any(map(marked, b))]
    if not parsed:
        return None
    rng = random.Random(11)
    pool = sorted({b.text for page in parsed for b in page})
    rows = [[(b, marked(b)) for b in page] for page in parsed]
    rows += [_variant(page, pool, rng) for page in parsed for _ in range(2)]
    return learn([features([b for b, _ in page]) for page in rows], [np.array([y for _, y in page], dtype=np.float32) for page in rows])


def extract(pages: DataFrame, model: Labeller | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_blocks, n_kept."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [blocks_of(x.as_py()) for x in batch.column(2)]
            if model is None:
                keep = [np.array([marked(b) for b in page], dtype=bool) for page in parsed]
            else:
                keep = [p >= 0.5 for p in model.chances([features(page) for page in parsed])]
            good = [[b.text for b, k in zip(page, own, strict=True) if k] for page, own in zip(parsed, keep, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(["\n\n".join(x) for x in good], pa.string()),
                 pa.array([len(x) for x in parsed], pa.int64()), pa.array([len(x) for x in good], pa.int64())],
                ["id", "url", "text", "n_blocks", "n_kept"])

    out = rows.mapInArrow(run, f"{kinds}, text string, n_blocks bigint, n_kept bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
