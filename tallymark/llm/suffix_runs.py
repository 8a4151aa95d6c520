"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

Suffixes start at anchors: of each window of LENGTH bytes, the GRAM bytes with the
least hash. Equal windows have equal anchors, so no repeat is missed, and about one
position in a hundred is one. An anchor carries all windows that chose it, which lie between the first
one's start and the last one's end. Hash counts leave the anchors whose gram occurs twice.

Their suffixes are sorted into runs where the texts are; a run is front-coded (the common
prefix with the suffix before, and the rest) and goes to the targets of its grams. A target
merges its runs with a loser tree that keeps, for every loser, the prefix it has in common
with the winner it lost to; a match compares from there on only. The merged
suffixes' common prefixes bound the groups of equal grams, byte by byte. In a group windows are
paired by hashes, aligned at the gram, and each pair of stretches is then compared byte by byte.

An entry is a suffix with what stands before it; equal entries are one, with a count. Owners, the places of an entry in
the texts, stay where they are: they meet the spans that were found by the entry's digest, in a join that splits hot
digests. A gram with HOT occurrences or more has its equal entries counted first and goes to several targets, by what surrounds it;
these send their windows, as packed arrays, to buckets by hash, which say what two targets or more have in common (by 128 bits).

Texts are UTF-8 bytes, null is empty. Texts that occur twice or more are compared once;
equal ones of LENGTH bytes or more lose all of their bytes, wherever they are. Rows without an id are treated
as others are. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import prefix_hash, settle, slice_hash, small, steps

LENGTH, GRAM = 400, 200
HOT = 256
#: Anchors that a target gets on average, and bytes of suffixes in a run.
TARGET_ANCHORS, RUN_BYTES = 4000, 16 << 20
#: Windows of a bucket of hot windows, on average.
BUCKET_WINDOWS = 500_000


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours: from block minima that run forth and back."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1: width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, gram hash, anchor, first and last window start (from the text's start) of each anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length or (np.diff(offsets) < length).all():
        return none, none.astype(np.uint64), none, none, none
    sums = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = slice_hash(sums, at, at + gram)
    keys = (hashes & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    chosen = (_window_minima(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(chosen) + 1, dtype=np.int64)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, np.minimum(offsets[1:][long] - length + 1, len(chosen)), -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    picked = chosen[starts]
    new = np.concatenate(([True], (picked[1:] != picked[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    anchor = picked[first]
    text = np.searchsorted(offsets, starts[first], "right") - 1
    base = offsets[text]
    return text, hashes[anchor], anchor - base, starts[first] - base, starts[last] - base


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in steps(batch.column(2)):
                text, grams, *places = anchors(data, offsets, length, gram)
                counts = np.bincount(text, minlength=last - first)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                raw = data.tobytes()
                cut = [raw[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (grams.view(np.int64), *places)]
                entries = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [x.values for x in lists], ["gram", "anchor", "lo", "hi"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                     pa.array([len(x) for x in cut], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in cut], pa.binary()), entries],
                    ["row", "id", "n_bytes", "digest", "entries"])
    return run


#: One front-coded run for one target, as parallel arrays; owners counts the places of an entry.
_RUN = "target bigint, prefix array<int>, rest array<binary>, context array<binary>, owners array<bigint>"
_RUN_SCHEMA = pa.schema([("target", pa.int64()), ("prefix", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())),
                         ("context", pa.list_(pa.binary())), ("owners", pa.list_(pa.int64()))])


def _common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(x), len(y))
    if x[known:n] == y[known:n]:
        return n
    low, high = known, n
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _write(entries: dict) -> Iterator[pa.RecordBatch]:
    """Front-coded runs of {target: {(suffix, context): owners}}."""
    rows = []
    for target, own in entries.items():
        prefix, rest, before, order = [], [], b"", sorted(own)
        for suffix, _ in order:
            prefix.append(_common(before, suffix, 0))
            rest.append(suffix[prefix[-1]:])
            before = suffix
        rows.append({"target": target, "prefix": prefix, "rest": rest, "context": [c for _, c in order], "owners": [own[e] for e in order]})
        if len(rows) == 256:
            yield pa.RecordBatch.from_pylist(rows, schema=_RUN_SCHEMA)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=_RUN_SCHEMA)


def _runs(found: Callable[[pa.RecordBatch], Iterator[tuple[int, bytes, bytes, int]]]):
    """Runs of what `found` gives of a batch: (target, suffix, context, owners)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict = {}
        held = 0
        for batch in batches:
            for target, suffix, context, owners in found(batch):
                own = entries.setdefault(target, {})
                if (suffix, context) not in own:
                    held += len(suffix) + len(context) + 100
                own[suffix, context] = own.get((suffix, context), 0) + owners
                if held > RUN_BYTES:
                    yield from _write(entries)
                    entries, held = {}, 0
        yield from _write(entries)
    return run


def _cold(length: int, targets: int):
    """Entries of grams that occur less than HOT times, from (text, found)."""
    def found(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, bytes, int]]:
        for text, own in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            for e in own.as_py():
                if e["n"] < HOT:
                    yield e["gram"] % targets, text[e["anchor"]:e["hi"] + length], text[e["lo"]:e["anchor"]], 1
    return found


def _hot(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, bytes, int]]:
    """Entries of hot grams, from (target, piece, at, owners)."""
    for target, piece, at, owners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield target, piece[at:], piece[:at], owners


def _entries(row) -> Iterator[tuple]:
    """(suffix, known prefix, context, owners) of a run, in order."""
    before = b""
    for prefix, rest, context, owners in zip(row.prefix, row.rest, row.context, row.owners, strict=True):
        before = before[:prefix] + rest
        yield before, int(prefix), context, int(owners)


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """All entries in order, each with its common prefix with the one before, by a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    head: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size

    def wins(a: int, b: int) -> bool:
        """Whether a is first; the loser's known prefix becomes the one it shares with the winner."""
        if head[a] is None or head[b] is None:
            return head[b] is None
        if known[a] != known[b]:
            return known[a] > known[b]
        x, y = head[a][0], head[b][0]
        same = _common(x, y, known[a])
        first = x[same:same + 1] <= y[same:same + 1]
        known[b if first else a] = same
        return first

    losers = [0] * size
    best = list(range(size))
    while len(best) > 1:
        level = []
        for k in range(0, len(best), 2):
            a, b = best[k], best[k + 1]
            first = wins(a, b)
            losers[(len(best) + k) // 2] = b if first else a
            level.append(a if first else b)
        best = level
    top = best[0]
    while head[top] is not None:
        suffix, _, context, owners = head[top]
        yield suffix, known[top], context, owners
        head[top] = next(runs[top], None)
        known[top] = head[top][1] if head[top] is not None else 0
        node = (size + top) // 2
        while node:
            if not wins(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


def _groups(rows: pd.DataFrame, gram: int) -> Iterator[dict[tuple[bytes, bytes], int]]:
    """Entries of equal grams: {(suffix, context): owners}."""
    group: dict = {}
    for suffix, common, context, owners in merged([_entries(r) for r in rows.itertuples()]):
        if common < gram and group:
            yield group
            group = {}
        group[suffix, context] = group.get((suffix, context), 0) + owners
    if group:
        yield group


class _Windows:
    """The windows of a group's entries: `entry` and `start` (in `text`) of each, and its hash."""

    def __init__(self, group: dict, length: int):
        self.length, self.pieces = length, [context + suffix for suffix, context in group]
        self.keys = [(hashlib.md5(p).digest(), len(context)) for p, (_, context) in zip(self.pieces, group, strict=True)]
        self.owners = np.array(list(group.values()))
        counts = np.array([len(p) - length + 1 for p in self.pieces])
        base = np.concatenate(([0], np.cumsum([len(p) for p in self.pieces])))[:-1]
        self.entry = np.repeat(np.arange(len(self.pieces)), counts)
        self.place = np.arange(len(self.entry)) - np.concatenate(([0], np.cumsum(counts)))[:-1][self.entry]
        self.start = base[self.entry] + self.place
        self.text = b"".join(self.pieces)
        self.hashes = slice_hash(prefix_hash(np.frombuffer(self.text, dtype=np.uint8)), self.start, self.start + length)

    def second(self) -> np.ndarray:
        """Another hash of each window, of its bytes in a different guise."""
        return slice_hash(prefix_hash(_GUISE[np.frombuffer(self.text, dtype=np.uint8)]), self.start, self.start + self.length)

    def repeated(self) -> np.ndarray:
        """Whether a window is in the group twice, all bytes compared."""
        _, first, which = np.unique(self.hashes, return_index=True, return_inverse=True)
        twice = np.bincount(which)[which] > 1
        partner = first[which]
        # The first of a class has the class's next one as its partner.
        order = np.argsort(which, kind="stable")
        after = np.append(order[1:], order[:1])
        own = partner == np.arange(len(which))
        partner[own] = after[np.argsort(order, kind="stable")[own]]
        whole = self.owners[self.entry] > 1
        at = np.flatnonzero(twice & ~whole)
        if len(at):
            shift = self.start[partner[at]] - self.start[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (np.diff(at) != 1) | (self.entry[at][1:] != self.entry[at][:-1]) | (np.diff(shift) != 0)
            firsts = np.flatnonzero(new)
            for f, e in zip(firsts.tolist(), np.append(firsts[1:], len(at)).tolist(), strict=True):
                s, n, d = int(self.start[at[f]]), e - f - 1 + self.length, int(shift[f])
                if self.text[s:s + n] != self.text[s + d:s + d + n]:
                    return self._compared() | whole
        return twice | whole

    def _compared(self) -> np.ndarray:
        """As `repeated`, from the windows themselves."""
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(self.text[s:s + self.length], len(seen)) for s in self.start.tolist()])
        return np.bincount(which)[which] > 1

    def spans(self, twice: np.ndarray) -> Iterator[tuple[bytes, int, list[dict]]]:
        """(digest, length of the context, spans) of the entries with repeated windows; spans count from the entry's first byte."""
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], self.entry))))
        for (digest, at), own in zip(self.keys, np.split(twice, edges[1:]), strict=True):
            if own.any():
                change = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                yield digest, at, [{"start": s, "stop": e - 1 + self.length} for s, e in zip(change[::2].tolist(), change[1::2].tolist(), strict=True)]


#: Bytes in another order, for a second hash.
_GUISE = np.random.default_rng(7).permutation(256).astype(np.uint8)
_SPANS = "entry binary, at int, spans array<struct<start: bigint, stop: bigint>>"


def _frame(spans: list) -> pd.DataFrame:
    return pd.DataFrame(spans, columns=["entry", "at", "spans"])


def _merge(length: int, gram: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        spans = []
        for group in _groups(rows, gram):
            if sum(group.values()) > 1:
                windows = _Windows(group, length)
                spans += windows.spans(windows.repeated())
        return _frame(spans)
    return run


def _count(length: int, gram: int, buckets: int):
    """The distinct windows of a hot target, by bucket, and how often it has them (2 stands for more)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one, two, often = [], [], []
        for group in _groups(rows, gram):
            windows = _Windows(group, length)
            hashes, first, which = np.unique(windows.hashes, return_index=True, return_inverse=True)
            one.append(hashes)
            two.append(windows.second()[first])
            often.append(np.minimum(np.bincount(which, windows.owners[windows.entry]), 2))
        one, two, often = np.concatenate(one), np.concatenate(two), np.concatenate(often).astype(np.int32)
        bucket = (one % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        return pd.DataFrame([(rows["target"].iloc[0], bucket[own[0]], one[own].view(np.int64), two[own].view(np.int64), often[own])
                             for own in np.split(order, cuts)], columns=["target", "bucket", "one", "two", "often"])
    return run


def _twice(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's windows, those that are there twice or more, for each target that has them."""
    one, two, often = (np.concatenate(rows[c].to_list()) for c in ("one", "two", "often"))
    target = np.repeat(rows["target"].to_numpy(), [len(x) for x in rows["one"]])
    order = np.lexsort((two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    which = np.cumsum(new) - 1
    held = order[np.bincount(which, often[order])[which] > 1]
    return pd.DataFrame([(t, one[held[own]], two[held[own]]) for t in np.unique(target[held]) for own in [target[held] == t]], columns=["target", "one", "two"])


def _settle_hot(length: int, gram: int):
    def run(rows: pd.DataFrame, repeated: pd.DataFrame) -> pd.DataFrame:
        spans = []
        if len(rows) and len(repeated):
            known = np.sort(_pairs(*(np.concatenate(repeated[c].to_list()).view(np.uint64) for c in ("one", "two"))))
            for group in _groups(rows, gram):
                windows = _Windows(group, length)
                own = _pairs(windows.hashes, windows.second())
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                spans += windows.spans(known[at] == own)
        return _frame(spans)
    return run


def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Two hashes as one sortable value."""
    both = np.empty(len(one), dtype=[("one", np.uint64), ("two", np.uint64)])
    both["one"], both["two"] = one, two
    return both


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept_text from (id, text, spans); spans are in order and apart."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            text, spans = text.as_py(), spans.as_py() or []
            edges = [0, *(x for s in spans for x in (s["start"], s["stop"])), len(text)]
            kept = b"".join([text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)])
            out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)]],
                                         ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def _islands(spans: DataFrame) -> DataFrame:
    """(digest, spans): overlapping and touching spans as one, in order."""
    order = Window.partitionBy("digest").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("new").over(order))
    each = marked.groupBy("digest", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return each.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    kept_text is what is left; where a cut goes through a character, the rest of it reads as U+FFFD (kept_sha256 is of the bytes).
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.xxhash64(F.col(id_col), raw).alias("row"), F.col(id_col).alias("id"), raw.cast("binary").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    entry = "array<struct<gram: bigint, anchor: bigint, lo: bigint, hi: bigint>>"
    rows = settle(docs.mapInArrow(_scan(length, gram), f"row bigint, id {kind}, n_bytes bigint, digest binary, entries {entry}"), "anchors")
    texts = settle(rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.first("entries").alias("entries"),
                                              F.first("n_bytes").alias("n_bytes")), "contents")

    spread = texts.select("digest", "row", "copies", F.explode("entries").alias("e"))
    counts = settle(spread.groupBy(F.col("e.gram").alias("gram")).agg(F.count("*").alias("n")).where("n > 1"), "grams")
    found = spread.join(small(counts), F.col("e.gram") == F.col("gram")).groupBy("digest", "row", "copies").agg(
        F.collect_list(F.struct("e.gram", "e.anchor", "e.lo", "e.hi", "n")).alias("found"))
    found = settle(found.withColumnRenamed("row", "row2"), "found")
    # Rows find their texts by a short name; the text's digest tells apart those that share one.
    own = F.unhex(F.sha2("text", 256))
    held = docs.join(small(found.select("row2", F.col("digest").alias("wanted"))), (F.col("row") == F.col("row2")) & (own == F.col("wanted")))
    held = held.select(F.col("wanted").alias("digest"), "text").dropDuplicates(["digest"])
    held = settle(held.join(found.select("digest", "copies", "found"), "digest"), "held")

    targets = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // TARGET_ANCHORS)
    runs = settle(held.select("text", "found").mapInArrow(_runs(_cold(length, targets)), _RUN), "runs")
    spans = settle(runs.groupBy("target").applyInPandas(_merge(length, gram), _SPANS), "spans")
    each = held.select("digest", "copies", "text", F.explode("found").alias("e"))
    piece = F.substring("text", (F.col("e.lo") + 1).cast("int"), (F.col("e.hi") + length - F.col("e.lo")).cast("int"))
    each = each.select("digest", "copies", F.col("e.gram").alias("gram"), F.col("e.n").alias("n"), F.col("e.lo").alias("lo"), piece.alias("piece"),
                       (F.col("e.anchor") - F.col("e.lo")).cast("int").alias("at"), F.unhex(F.md5(piece)).alias("entry"))
    hot = each.where(F.col("n") >= HOT).groupBy("gram", "n", "entry", "at").agg(F.first("piece").alias("piece"), F.count("*").alias("owners"))
    salt = F.pmod(F.xxhash64("entry"), F.ceil(F.col("n") / HOT))
    hot = settle(hot.select(F.xxhash64("gram", salt).alias("target"), "piece", "at", "owners"), "hot-entries")
    number = hot.count()
    if number:
        runs = settle(hot.mapInArrow(_runs(_hot), _RUN), "hot-runs")
        buckets = max(1, number * (length - gram + 1) // BUCKET_WINDOWS)
        packed = runs.groupBy("target").applyInPandas(
            _count(length, gram, buckets), "target bigint, bucket bigint, one array<bigint>, two array<bigint>, often array<int>")
        twice = settle(packed.groupBy("bucket").applyInPandas(_twice, "target bigint, one array<bigint>, two array<bigint>"), "twice")
        more = runs.groupBy("target").cogroup(twice.groupBy("target")).applyInPandas(_settle_hot(length, gram), _SPANS)
        spans = spans.union(settle(more, "hot-spans"))
    owners = settle(each.where("copies = 1").select("digest", "entry", "at", "lo"), "owners")
    met = owners.join(spans, ["entry", "at"]).select("digest", "lo", F.explode("spans").alias("s"))
    cut = _islands(met.select("digest", (F.col("lo") + F.col("s.start")).alias("start"), (F.col("lo") + F.col("s.stop")).alias("stop")))
    # Texts that are there twice lose all their bytes.
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select(
        "digest", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"))
    cut = settle(cut.union(whole).withColumnRenamed("digest", "wanted"), "cut")
    out = docs.join(small(cut), own == F.col("wanted"), "left").select("id", "text", "spans").mapInArrow(
        _cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("id", id_col)
