"""Periodic runs of words: maximal stretches that repeat a word sequence several times over.

A run is a stretch of words whose smallest period is q, of `least` words and `times` periods at least,
that no neighbouring word extends. Runs are found by uniting the suffixes of a text
in the order of descending longest common prefix (LCP), as Kruskal's algorithm unites nodes:

* suffixes are sorted by doubling, all texts of a step at once; neighbours in that order are
  the edges, their common prefixes the weights. Suffixes that share fewer words than any run
  needs have no edge;
* each class of united suffixes is an ordered set of positions. The smaller class goes into the
  larger; a position and its new neighbour there, q apart and with a common prefix of l words,
  are where words q apart agree for l words, so q + l words have period q;
* a run's first position and the one a period later become neighbours exactly once: one between
  them would give the run a smaller period. So a pair of new neighbours whose words just before differ
  is a run, with q as its smallest period, and no run is missed or found twice.

Texts never meet, so there is no shuffle: a step is some rows of a partition, or one long text.
Null texts and texts without words have no runs, and their collapsed text is empty. Repeated rows and ids are
judged by their text alone; other columns are passed on as they are, so names must not clash with
`into`; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Words of a run at least, and how often its period has to fit in it.
LEAST, TIMES = 6, 4
#: Words that one step sorts; a longer text is a step of its own.
STEP_WORDS = 1 << 17
BLOCK = 512


class Places:
    """Ordered positions in blocks, so that an insertion moves a block at most."""

    def __init__(self, first: int):
        self.size, self.heads, self.blocks = 1, [first], [[first]]

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The positions before and after x, which is not in the set."""
        k = max(0, bisect_right(self.heads, x) - 1)
        block = self.blocks[k]
        at = bisect_left(block, x)
        after = block[at] if at < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        return (block[at - 1] if at else None), after

    def add(self, x: int) -> None:
        k = max(0, bisect_right(self.heads, x) - 1)
        block = self.blocks[k]
        insort(block, x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k:k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads[k:k + 1] = [block[0], block[BLOCK]]


def _edges(codes: np.ndarray, ends: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, position, LCP) of neighbours in the order of suffixes, for LCPs of `floor` (2 or more) words at least.

    codes: words as numbers, which no two texts share; ends[i]: the end of the text that position i is in.
    """
    n = len(codes)
    none = np.zeros(0, dtype=np.int64)
    if n < 2:
        return none, none, none
    follows = np.arange(n) + 1 < ends
    second = np.where(follows, np.append(codes[1:], 0) + 1, 0)
    order = np.lexsort((second, codes))
    ranks = [codes]
    # A group is named by the place of its first member, so groups that split keep the order of all.
    new = np.ones(n, dtype=bool)
    new[1:] = (codes[order][1:] != codes[order][:-1]) | (second[order][1:] != second[order][:-1])
    width = 2
    rank = np.empty(n, dtype=np.int64)
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    # Only groups of several members, whose common words are `floor` or more in the end, are sorted on.
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    kept = none
    while len(slots):
        act = order[slots]
        ranks.append(rank.astype(np.int32))
        if width <= floor:
            kept = slots
        ahead = act + width
        # The end of a text comes first; two suffixes of one text never end at the same distance.
        key = np.where(ahead < ends[act], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((key, rank[act]))
        act, key, group = act[by], key[by], rank[act][by]
        order[slots] = act
        new = np.ones(len(act), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        rank[act] = np.repeat(slots[first], np.diff(np.append(first, len(act))))
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        width *= 2
    if not len(kept):
        return none, none, none
    together = np.flatnonzero(np.diff(kept) == 1)
    a, b = order[kept[together]], order[kept[together + 1]]
    one, two, lcp = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (one < ends[a]) & (two < ends[b])
        same = inside & (ranks[k][np.minimum(one, n - 1)] == ranks[k][np.minimum(two, n - 1)])
        # A shorter suffix is in a group with itself only, so equal groups are equal words throughout.
        step = np.where(same, 1 << k, 0)
        one, two, lcp = one + step, two + step, lcp + step
    near = (lcp >= floor) & (ends[a] == ends[b])
    return a[near], b[near], lcp[near]


def find(codes: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(position, length, period) of all runs of the texts that codes and ends hold (see _edges)."""
    if times < 2 or least < 3:
        raise ValueError("a run holds its period twice, and three words, at least")
    floor = min(max(least, times * q) - q for q in range(1, least + 1))
    a, b, lcp = _edges(codes, ends, floor)
    order = np.argsort(-lcp, kind="stable")
    word, limit = codes.tolist(), ends.tolist()
    parent: dict[int, int] = {}
    places: dict[int, Places] = {}
    found = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def seed(i: int, j: int, shared: int) -> None:
        q = j - i
        length = q + shared
        if length < least or length < times * q:
            return
        if i and limit[i - 1] == limit[i] and word[i - 1] == word[j - 1]:
            return
        found.append((i, length, q))

    for x, y, shared in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist(), strict=True):
        x, y = root(x), root(y)
        one, two = places.pop(x, None) or Places(x), places.pop(y, None) or Places(y)
        if one.size < two.size:
            x, y, one, two = y, x, two, one
        small = list(two)
        for k, place in enumerate(small):
            before, after = one.around(place)
            if before is not None and (k == 0 or small[k - 1] < before):
                seed(before, place, shared)
            if after is not None and (k + 1 == len(small) or small[k + 1] > after):
                seed(place, after, shared)
        for place in small:
            one.add(place)
        parent[y] = x
        places[x] = one
    return sorted(found)


def _step(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a step."""
    codes, ends, starts, base, at = [], [], [], 0, 0
    for words in texts:
        seen: dict[bytes, int] = {}
        codes += [base + seen.setdefault(w, len(seen)) for w in words]
        starts.append(at)
        at += len(words)
        ends.append(np.full(len(words), at, dtype=np.int64))
        base += len(seen)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if at:
        runs = find(np.array(codes, dtype=np.int64), np.concatenate(ends), least, times)
        owner = np.searchsorted(starts, [r[0] for r in runs], "right") - 1 if runs else []
        for (start, length, period), k in zip(runs, owner, strict=True):
            out[k].append((start - starts[k], length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return b" ".join([w for w, stays in zip(words, keep.tolist(), strict=True) if stays])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


_FOUND = pa.struct([("n_words", pa.int64()), ("found", _RUNS), ("collapsed", pa.string())])


def _scan(at: int, least: int, times: int, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).cast(pa.large_binary()).fill_null(b"")
            first = 0
            while first < len(raw):
                # bytes.split parts at ASCII white space, which is what parts words here.
                last, texts, held = first, [], 0
                while last < len(raw) and held < STEP_WORDS:
                    texts.append(raw[last].as_py().split())
                    held += len(texts[-1])
                    last += 1
                runs = _step(texts, least, times)
                found = pa.StructArray.from_arrays([
                    pa.array([len(w) for w in texts], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs], _RUNS),
                    pa.array([collapse(w, own) for w, own in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())],
                    fields=list(_FOUND))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns), found],
                                                 names=[*batch.schema.names, into])
                first = last
    return run


def find_runs(docs: DataFrame, text_col: str = "text", into: str = "runs", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with a column more: struct(n_words, found, collapsed).

    found lists the runs (start, length, period) by start, then period; start counts words from 0. collapsed is the text without
    the words that a run holds after its first period.
    """
    if into in docs.columns:
        raise ValueError(f"the table has a column {into}")
    kind = "struct<n_words: bigint, found: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
    out = T.StructType([*docs.schema.fields, T.StructField(into, T._parse_datatype_string(kind))])
    return docs.mapInArrow(_scan(docs.columns.index(text_col), least, times, into), out)


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which the text of each tenth id (by crc32) ends in a cycle of its own words.

    With h = crc32(id), g = floor(h / 10) and n words, if h % 10 = 0 and n > 0 each word i >= a becomes word a + (i - a) % p,
    where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); the words are then joined by one space. Other rows, and
    rows without an id, keep their text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cycled(w):
        n = F.greatest(F.size(w), F.lit(1)).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        head = F.slice(w, F.lit(1), a.cast("int"))
        period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(head, F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")

    changed = F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), cycled), 1))
    return docs.withColumn(text_col, F.coalesce(changed, F.col(text_col).cast("string")))
