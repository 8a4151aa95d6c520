"""Benchmark decontamination: passages of the corpus as queries to a BM25 index of test items.

The index is an inverted one with block maxima, and each passage retrieves every
item whose score reaches RATIO of the item's own score against itself. Impacts are
stored as shares of that, so one threshold serves all items. The bound of a block, the
sum of its maxima over a passage's words, is taken for whole batches of texts; blocks
below the threshold are skipped, and WAND pivots run in the others. A retrieved item of
one text counts when CONTAINED of its word shingles or more are found in the
passage; one of two texts when each of them is. A text of two that is so short that one edit could take
more than the rest of its shingles also counts when CONTAINED of its words stand
in order in a stretch of the passage as long as it, and as many words more as may differ.

Passages are twice as long as the longest item and start at every such length, so an
item lies whole in one. Statistics of terms cover all items. The index is split
into shards of at most about SHARD postings; the corpus passes each in turn, and
only one shard is on a worker at a time.

Words are runs of ASCII letters and digits or other characters, letters A-Z in
lower case. Null or wordless texts have no passage and match nothing; items without an id or
without words are not searched, equal rows of items count once, an empty part of an item is found
everywhere. Every row of docs gives one row with its columns as they were, repeated ones too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import letters, lower_ascii, settle, shingle_sets, steps, word_hashes, words

K1, B = 1.2, 0.75
RATIO = 0.6
SHINGLE, CONTAINED = 5, 0.8
#: Bound on the postings of a shard, and so on what is broadcast at a time.
SHARD = 2_000_000
#: Blocks of items that have maxima of their own.
BLOCKS = 32
SHORTEST = 32


def split_text(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Items of one text as (item_id, question, answer): it is verified whole, as the question; the answer is empty."""
    return items.select(F.col(id_col).alias("item_id"), F.array_join(words(F.col(text_col)), " ").alias("question"),
                        F.lit("").alias("answer"))


def _hashes(text: str) -> np.ndarray:
    data = lower_ascii(np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8))
    return word_hashes(data, np.array([0, len(data)]), letters)[0]


def _item(entry: list) -> int:
    return entry[0]


def _part(hashes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Shingle length, sorted shingles and words of a part of an item."""
    size = min(SHINGLE, len(hashes))
    return size, shingle_sets(hashes, np.zeros(len(hashes), dtype=np.int64), size)[0] if size else hashes, hashes


def _in_order(part: np.ndarray, hashes: np.ndarray) -> bool:
    """Whether CONTAINED of the words stand in order in a stretch as long as the part and what may differ."""
    need = math.ceil(CONTAINED * len(part) - 1e-9)
    stretch = 2 * len(part) - need
    same = part[:, None] == hashes[None, :]
    known = np.flatnonzero(same.any(axis=0))
    for at in known.tolist():
        cut = known[(known >= at) & (known < at + stretch)]
        if len(cut) < need:
            continue
        best = np.zeros(len(part) + 1, dtype=np.int64)
        for k in cut.tolist():
            best[1:] = np.maximum(best[1:], best[:-1] + same[:, k])
            best = np.maximum.accumulate(best)
        if best[-1] >= need:
            return True
    return False


@dataclass
class Index:
    """One shard: items by number, with postings of impacts by term."""

    ids: pa.Array
    parts: list[list[tuple[int, np.ndarray, np.ndarray]]]
    length: int
    terms: np.ndarray
    postings: list[dict[int, tuple[list[int], list[float], float]]]
    tops: np.ndarray

    def search(self, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """Items of these blocks that reach RATIO, by WAND with the block's maxima; other blocks are skipped whole."""
        out = []
        for block in blocks:
            found = [own[block] for own in map(self.postings.__getitem__, terms) if block in own]
            lists = [[items[0], 0, items, shares, top] for items, shares, top in found]
            while lists:
                lists.sort(key=_item)
                bound, pivot = 0.0, -1
                for i, entry in enumerate(lists):
                    bound += entry[4]
                    if bound >= RATIO:
                        pivot = i
                        break
                if pivot < 0:
                    break
                item = lists[pivot][0]
                if lists[0][0] == item:
                    moving = [x for x in lists if x[0] == item]
                    score = sum(x[3][x[1]] for x in moving)
                    if score >= RATIO:
                        out.append((item, score))
                    goal = item + 1
                else:
                    goal, moving = item, [x for x in lists[:pivot] if x[0] < item]
                for entry in moving:
                    at, items = entry[1], entry[2]
                    while at < len(items) and items[at] < goal:
                        at += 1
                    entry[1], entry[0] = at, items[at] if at < len(items) else -1
                lists = [x for x in lists if x[0] >= 0]
        return out

    def verified(self, item: int, hashes: np.ndarray) -> bool:
        grams: dict[int, np.ndarray] = {}
        several = sum(size > 0 for size, _, _ in self.parts[item]) > 1
        for size, part, own in self.parts[item]:
            if not size:
                continue
            if size not in grams:
                grams[size] = shingle_sets(hashes, np.zeros(len(hashes), dtype=np.int64), size)[0]
            if np.isin(part, grams[size], assume_unique=True).sum() >= CONTAINED * len(part):
                continue
            short = SHINGLE > (1 - CONTAINED) * len(part)
            if not (several and short and _in_order(own, hashes)):
                return False
        return True

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, float, list[int]]]:
        """For each text: passages, items retrieved, best score, items verified."""
        for first, last, data, offsets in steps(column):
            hashes, owner = word_hashes(lower_ascii(data), offsets, letters)
            count = np.bincount(owner, minlength=last - first) if len(owner) else np.zeros(last - first, dtype=np.int64)
            begin = np.concatenate(([0], np.cumsum(count)))
            chunks = -(-count // self.length)
            base = np.concatenate(([0], np.cumsum(chunks)))
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            known = np.flatnonzero(self.terms[at] == hashes)
            at, text = at[known], owner[known]
            chunk = base[text] + (known - begin[text]) // self.length
            sums = np.zeros((base[-1] + 1, self.tops.shape[1]), dtype=np.float32)
            if len(at):
                edge = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
                sums[chunk[edge]] = np.add.reduceat(self.tops[at], edge, axis=0)
            bound = (sums[:-1] + sums[1:]).max(axis=1) if base[-1] else np.zeros(0)
            hot = np.flatnonzero(bound >= RATIO - 1e-4)
            found: dict[int, tuple[set, set, float]] = {}
            for c in hot.tolist():
                row = int(np.searchsorted(base, c, "right")) - 1
                if c > base[row] and c + 1 == base[row + 1]:
                    continue  # the window before holds these words
                start = begin[row] + (c - base[row]) * self.length
                end = min(start + 2 * self.length, begin[row + 1])
                lo, hi = np.searchsorted(known, (start, end))
                own = np.unique(at[lo:hi])
                blocks = np.flatnonzero(self.tops[own].sum(axis=0) >= RATIO - 1e-4)
                hits = self.search(own.tolist(), blocks.tolist()) if len(blocks) else []
                if hits:
                    seen, sure, best = found.get(row, (set(), set(), 0.0))
                    for item, score in hits:
                        best = max(best, score)
                        if item not in sure and self.verified(item, hashes[start:end]):
                            sure.add(item)
                        seen.add(item)
                    found[row] = (seen, sure, best)
            passages = np.where(chunks > 1, chunks - 1, chunks)
            for row in range(last - first):
                seen, sure, best = found.get(row, ((), (), 0.0))
                yield int(passages[row]), len(seen), best, sorted(sure)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.unique(_hashes(t), return_counts=True) for t in (x.as_py() for x in batch.column(1))]
        sizes = [len(t) for t, _ in rows]
        if sum(sizes):
            take = pa.array(np.repeat(np.arange(len(rows)), sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(np.concatenate([t for t, _ in rows]).view(np.int64)),
                 pa.array(np.concatenate([c for _, c in rows]).astype(np.int64))], ["item", "term", "tf"])


def build(items: DataFrame, id_col: str = "item_id", question: str = "question", answer: str = "answer") -> Iterator[Index]:
    """The shards of the index; each is collected (it is bounded) when its turn comes."""
    q, a = F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(answer), F.lit(""))
    base = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), q.alias("q"), a.alias("a")).distinct()
    base = settle(base.withColumn("item", F.sha2(F.concat_ws("\x01", F.col("id").cast("string"), "q", "a"), 256)), "items")
    whole = base.select("item", F.concat_ws(" ", "q", "a").alias("text"))
    postings = settle(whole.mapInArrow(_terms, "item string, term bigint, tf bigint"), "terms")
    sizes = postings.groupBy("item").agg(F.sum("tf").alias("dl"))
    total = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    if not total["n"]:
        return
    common = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (total["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damped = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / total["avg"]))
    scored = postings.join(common, "term").join(sizes, "item").select("item", "term", "df", (idf * damped).alias("impact"))
    scored = settle(scored, "impacts")
    own = scored.groupBy("item").agg(F.sum("impact").alias("own"))
    shards = math.ceil(scored.count() / SHARD)
    for shard in range(shards):
        mine = F.pmod(F.xxhash64("item"), F.lit(shards)) == shard
        rows = scored.join(own, "item").where(mine).select("item", "term", "df", (F.col("impact") / F.col("own")).alias("share")).toPandas()
        texts = base.where(mine).toPandas()
        if len(rows):
            yield _shard(rows, texts[texts["item"].isin(set(rows["item"]))], T.StructType([base.schema["id"]]))


def _shard(rows, texts, schema: T.StructType) -> Index:
    # Items with the same most frequent word stand together, mostly those of a language: their blocks have tight maxima.
    usual = rows.sort_values(["df", "term"], ascending=False).groupby("item")["term"].first()
    texts = texts.assign(usual=texts["item"].map(usual)).sort_values(["usual", "item"]).reset_index(drop=True)
    number = {item: i for i, item in enumerate(texts["item"])}
    parts = [[_part(_hashes(q)), _part(_hashes(a))] for q, a in zip(texts["q"], texts["a"], strict=True)]
    length = max(SHORTEST, *(len(_hashes(f"{q} {a}")) for q, a in zip(texts["q"], texts["a"], strict=True)))
    rows = rows.assign(number=rows["item"].map(number), key=rows["term"].to_numpy().view(np.uint64)).sort_values(["key", "number"])
    terms, starts = np.unique(rows["key"].to_numpy(), return_index=True)
    numbers, shares = rows["number"].to_numpy(), rows["share"].to_numpy()
    width = -(-len(texts) // BLOCKS)
    tops = np.zeros((len(terms), -(-len(texts) // width)), dtype=np.float32)
    which = np.repeat(np.arange(len(terms)), np.diff(np.append(starts, len(rows))))
    np.maximum.at(tops, (which, numbers // width), shares)
    held: list[dict] = [{} for _ in terms]
    for term, number, share in zip(which.tolist(), numbers.tolist(), shares.tolist(), strict=True):
        own = held[term].setdefault(number // width, ([], []))
        own[0].append(number)
        own[1].append(share)
    postings = [{block: (*own, max(own[1])) for block, own in blocks.items()} for blocks in held]
    return Index(pa.array(texts["id"].tolist()), parts, length, terms, postings, tops)


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", into: str = "leaks") -> DataFrame:
    """docs with a struct column more: passages, retrieved, best, items (verified item ids, sorted)."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    kind = f"struct<passages: bigint, retrieved: bigint, best: double, items: array<{id_type}>>"
    empty = F.struct(F.lit(0).cast("bigint").alias("passages"), F.lit(0).cast("bigint").alias("retrieved"),
                     F.lit(0.0).alias("best"), F.array().cast(f"array<{id_type}>").alias("items"))
    out = docs.withColumn(into, empty)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType.fromDDL("x " + kind)["x"].dataType)])
    at = docs.columns.index(text_col)
    shard = None
    for index in build(items):
        if shard:
            # What the shards before found is written, so that one shard is held at a time.
            out = settle(out, "searched")
            shard.destroy()
        shard = spark.sparkContext.broadcast(index)
        del index

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, before = shard.value, batch.column(batch.num_columns - 1).to_pylist()
                rows = [(max(old["passages"], n), old["retrieved"] + k, max(old["best"], best),
                         sorted([*old["items"], *own.ids.take(pa.array(sure, pa.int64())).to_pylist()]))
                        for old, (n, k, best, sure) in zip(before, own.texts(batch.column(at)), strict=True)]
                found = pa.array([dict(zip(("passages", "retrieved", "best", "items"), r, strict=True)) for r in rows],
                                 type=batch.schema.field(into).type)
                yield batch.set_column(batch.num_columns - 1, batch.schema.field(into), found)

        out = out.mapInArrow(run, schema)
    return out
