"""Secret scans that unwrap encoded layers until nothing new comes out.

A worklist starts with the text itself. Every layer is scanned for secrets;
percent escapes, \\u and \\x escapes, base64 runs and, inside base64, zlib, gzip
or bzip2 data give further layers, each with a map from its characters to the
original ones, so that a find has a span in the original text. Base64 may begin anywhere in a
run (after a path or a name), so all four alignments are decoded, and runs that
line breaks part are taken joined and one by one; compressed data may begin at any byte of
these, and in compressed data itself. Bytes that are no UTF-8 are scanned as Latin-1. Compressed data is unpacked and scanned in
pieces, cut only where no secret or code can go on; what has no such place is one piece, however long, so nothing is left out
and n_skipped is 0. A layer whose content and place were seen is not taken again, so cycles end.

Null texts are empty. Every row gives one row, repeated ones too; other columns
are not read; an empty table gives an empty result. Spans are in code points,
end exclusive. Lone surrogates and texts of any length are fine.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_POINT = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\})+")
_ONE_POINT = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_BREAK = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
#: A run that line breaks may part, not joined with the dashes around PEM data.
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]++(?<!-----)[\x20\t]*\r?\n[\x20\t]*)?[A-Za-z0-9+/_-]{16,}"
                     r"(?:[\x20\t]*\r?\n[\x20\t]*(?!-----)[A-Za-z0-9+/_-]+)*={0,2}")
_PACKED = re.compile(rb"BZh[1-9]1AY&SY|\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_LONG_WORD = re.compile(r"[A-Za-z0-9+/_-]{16}")
_HINT = re.compile(r"passw|secret|token|api_?key", re.A | re.I)
#: Bytes that are unpacked at a time; the bytes of the longest mark of _PACKED.
PIECE, _LONGEST_MARK = 1 << 20, 10
#: Places in bytes that no secret, escape or base64 run crosses, in this layer or in one made of it: also a
#: space between letters, of which the first ends no escape.
_CUT = re.compile(rb"[,;()!?<>\[\]&#*|~@$^\x00]|[.:\"'`]\r?\n|\n\n|(?<=[G-Zg-z])\x20(?=[A-Za-z])")

Span = tuple[int, int, int]


@dataclass
class Layer:
    """Characters and, for each, where the original begins and ends, or one place of all; neither: the original itself."""

    text: str
    starts: list[int] | None = None
    ends: list[int] | None = None
    place: tuple[int, int] | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.place is not None:
            return self.place
        if self.starts is None:
            return start, end
        return min(self.starts[start:end]), max(self.ends[start:end])

    def edges(self, start: int, end: int) -> tuple[list[int], list[int]]:
        if self.place is not None:
            return [self.place[0]] * (end - start), [self.place[1]] * (end - start)
        if self.starts is None:
            return list(range(start, end)), list(range(start + 1, end + 1))
        return self.starts[start:end], self.ends[start:end]


@dataclass
class Found:
    base: list[Span] = field(default_factory=list)
    spans: list[Span] = field(default_factory=list)
    layers: int = 0
    skipped: int = 0


def secrets(text: str) -> list[Span]:
    """(start, kind, end) of the secrets of one layer, leftmost and non-overlapping by kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _decoded(raw: bytes, starts: list[int], ends: list[int]) -> Layer:
    """Bytes with their places as a layer of UTF-8 text, or else of Latin-1."""
    text = _text(raw)
    if len(text) == len(raw):
        return Layer(text, starts, ends)
    first, last, at = [], [], 0
    for c in text:
        size = len(c.encode("utf-8"))
        first.append(starts[at])
        last.append(ends[at + size - 1])
        at += size
    return Layer(text, first, last)


def _url(layer: Layer) -> Layer | None:
    """The whole layer with its percent escapes resolved."""
    text, first, last, at = [], [], [], 0
    for m in _ESCAPE.finditer(layer.text):
        s, e = layer.edges(m.start(), m.end())
        part = _decoded(bytes.fromhex(m[0].replace("%", "")), s[::3], e[2::3])
        for k, v in zip((text, first, last), (layer.text[at:m.start()], *layer.edges(at, m.start())), strict=True):
            k.extend(v)
        text.extend(part.text)
        first.extend(part.starts)
        last.extend(part.ends)
        at = m.end()
    if not at:
        return None
    rest = layer.edges(at, len(layer.text))
    return Layer("".join(text) + layer.text[at:], first + rest[0], last + rest[1])


def _unicode(layer: Layer) -> Layer | None:
    """The whole layer with \\u and \\x escapes resolved."""
    text, first, last, at = [], [], [], 0
    for run in _POINT.finditer(layer.text):
        s, e = layer.edges(at, run.start())
        text.extend(layer.text[at:run.start()])
        first.extend(s)
        last.extend(e)
        for m in _ONE_POINT.finditer(run[0]):
            code = int(next(g for g in m.groups() if g), 16)
            begin, end = layer.span(run.start() + m.start(), run.start() + m.end())
            if text and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(text[-1]) < 0xDC00:
                text[-1] = chr(0x10000 + ((ord(text[-1]) - 0xD800) << 10) + code - 0xDC00)
                last[-1] = end
            elif code <= 0x10FFFF:
                text.append(chr(code))
                first.append(begin)
                last.append(end)
        at = run.end()
    if not at:
        return None
    s, e = layer.edges(at, len(layer.text))
    return Layer("".join(text) + layer.text[at:], first + s, last + e)


class _Packed:
    """A compressed stream, fed in any parts: its content, and that of compressed bytes within it, as texts that no
    secret or code crosses. Content is read to its end or the first error; parts that follow on are one stream."""

    def __init__(self, mark: bytes, above: frozenset[bytes] = frozenset()):
        self.mark, self.above, self.box, self.fed = mark[:3], above, None, False
        self.dead, self.left, self.tail, self.within = False, b"", b"", []
        self.held, self.looked = bytearray(), 0

    def feed(self, raw: bytes) -> Iterator[str]:
        if not self.fed:
            # Bytes whose content begins with themselves would never end.
            self.fed, key = True, hashlib.sha256(raw).digest()
            self.dead, self.above = key in self.above, self.above | {key}
        for out in self._content(raw):
            yield from self._inner(out)
            yield from self._whole(out)

    def finish(self) -> Iterator[str]:
        for inner in self.within:
            yield from inner.finish()
        if self.held:
            yield _text(bytes(self.held))

    def _content(self, raw: bytes) -> Iterator[bytes]:
        """PIECE bytes at most at a time."""
        raw, self.left = self.left + raw, b""
        while raw and not self.dead:
            if self.box is None:
                if len(raw) < 2:
                    self.left = raw
                    return
                if raw[:2] != self.mark[:2]:
                    self.dead = True
                    return
                self.box = bz2.BZ2Decompressor() if self.mark == b"BZh" else zlib.decompressobj(47)
            yield from self._member(raw)
            if self.dead or not self.box.eof:
                return
            raw, self.box = self.box.unused_data, None

    def _member(self, raw: bytes) -> Iterator[bytes]:
        box, blocks = self.box, self.mark == b"BZh"
        while not box.eof:
            before = None if blocks else box.copy()
            try:
                out = box.decompress(raw, PIECE)
            except (OSError, ValueError, zlib.error):
                self.dead = True
                yield from () if blocks else _before_error(before, raw)
                return
            if out:
                yield out
            raw = b"" if blocks else box.unconsumed_tail
            if not box.eof and (box.needs_input if blocks else not raw and len(out) < PIECE):
                return

    def _inner(self, out: bytes) -> Iterator[str]:
        for inner in self.within:
            yield from inner.feed(out)
            if inner.dead:
                yield from inner.finish()
        self.within = [x for x in self.within if not x.dead]
        seen, window = len(self.tail), self.tail + out
        for m in _PACKED.finditer(window):
            if m.end() > seen:
                inner = _Packed(m[0], self.above)
                yield from inner.feed(window[m.start():])
                if inner.dead:
                    yield from inner.finish()
                else:
                    self.within.append(inner)
        self.tail = window[1 - _LONGEST_MARK:]

    def _whole(self, out: bytes) -> Iterator[str]:
        self.held += out
        if len(self.held) < PIECE:
            return
        cut = 0
        for m in _CUT.finditer(bytes(self.held[self.looked:])):
            cut = self.looked + m.end()
        if cut:
            yield _text(bytes(self.held[:cut]))
            del self.held[:cut]
        self.looked = 0 if cut else max(0, len(self.held) - 2)


def _before_error(box, raw: bytes) -> Iterator[bytes]:
    """What a stream holds before the byte that breaks it."""
    out = bytearray()
    try:
        for i in range(len(raw)):
            out += box.decompress(raw[i:i + 1])
            if len(out) >= PIECE:
                yield bytes(out)
                out.clear()
    except zlib.error:
        pass
    if out:
        yield bytes(out)


def _pieces(raw: bytes, found: Found) -> Iterator[str]:
    """Compressed bytes as texts that no secret or code crosses, those of compressed bytes within them too."""
    packed = _Packed(raw[:3])
    yield from packed.feed(raw)
    yield from packed.finish()


def _runs(text: str) -> Iterator[tuple[str, list[int] | range]]:
    """Base64 runs without their line breaks, and the place of each character; also the lines of a run of several."""
    for m in _BASE64.finditer(text):
        lines, at = [], m.start()
        for gap in _BREAK.finditer(text, m.start(), m.end()):
            lines.append(range(at, gap.start()))
            at = gap.end()
        lines.append(range(at, at + len(text[at:m.end()].rstrip("="))))
        yield from ((text[x.start:x.stop], x) for x in lines if len(x) >= 16)
        if len(lines) > 1:
            yield "".join(text[x.start:x.stop] for x in lines), [i for x in lines for i in x]


def _boxed(layer: Layer, found: Found) -> Iterator[Layer]:
    """The layers in a layer's base64 runs."""
    for run, places in _runs(layer.text):
        plain = run.translate(_PLAIN)
        for begin in range(4):
            end = len(plain) - ((len(plain) - begin) % 4 == 1)
            raw = binascii.a2b_base64(plain[begin:end] + "=" * (-(end - begin) % 4))
            for m in _PACKED.finditer(raw):
                place = layer.span(places[begin + m.start() // 3 * 4 + m.start() % 3], places[-1] + 1)
                yield from (Layer(x, place=place) for x in _pieces(raw[m.start():], found) if not _idle(x))
            if _idle(_text(raw)):
                continue
            s, e = layer.edges(places[0], places[-1] + 1)
            at = [places[begin + i // 3 * 4 + i % 3] - places[0] for i in range(len(raw))]
            ends = [places[begin + i // 3 * 4 + i % 3 + 1] - places[0] for i in range(len(raw))]
            yield _decoded(raw, [s[i] for i in at], [e[i] for i in ends])


_PLAIN = str.maketrans("-_", "+/")


def _idle(text: str) -> bool:
    """Neither a secret nor a further layer is in the text."""
    return not (_LONG_WORD.search(text) or _HINT.search(text) or _ESCAPE.search(text) or _POINT.search(text))


def _within(layer: Layer, found: Found) -> Iterator[Layer]:
    """The layers that a layer holds."""
    if "%" in layer.text:
        yield from filter(None, [_url(layer)])
    if "\\" in layer.text:
        yield from filter(None, [_unicode(layer)])
    if _LONG_WORD.search(layer.text):
        yield from _boxed(layer, found)


def scan(text: str) -> Found:
    """The secrets of a text and of everything encoded in it."""
    found = Found(base=secrets(text))
    spans, seen, work = set(found.base), set(), [iter([Layer(text)])]
    while work:
        # The last iterator goes first, so that only one piece of each depth is held.
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        own = layer.starts is None and layer.place is None
        mark = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass"))
        mark.update(repr(None if own else layer.span(0, len(layer.text))).encode())
        if mark.digest() in seen:
            continue
        seen.add(mark.digest())
        found.layers += 1
        if not own:
            for start, kind, end in secrets(layer.text):
                first, last = layer.span(start, end)
                spans.add((first, kind, last))
        work.append(_within(layer, found))
    found.spans = sorted(spans)
    found.base.sort()
    return found


def _plain(text: str) -> bool:
    """Nothing to find: no escapes, no long run, no key word."""
    return not ("%" in text or "\\" in text or _LONG_WORD.search(text) or _HINT.search(text))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_NOTHING = Found()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_NOTHING if not t or _plain(t) else scan(t) for t in (x.as_py() for x in batch.column(1))]
        lists = [pa.array([[dict(kind=KINDS[k], start=s, end=e) for s, k, e in spans] for spans in part], type=_SPANS)
                 for part in ([r.base for r in rows], [r.spans for r in rows])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *lists, pa.array([r.layers for r in rows], pa.int64()), pa.array([r.skipped for r in rows], pa.int64())],
            ["id", "base", "spans", "layers", "skipped"])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base and spans (arrays of kind, start, end), layers, skipped."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    found = texts.mapInArrow(_run, f"id {kind}, base {spans}, spans {spans}, layers bigint, skipped bigint")
    return found.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns kept, with every secret's span (overlapping ones joined) replaced by mark."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else t if _plain(t) else _masked(t, mark) for t in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, mark: str) -> str:
    out, at = [], 0
    for start, _, end in scan(text).spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]
