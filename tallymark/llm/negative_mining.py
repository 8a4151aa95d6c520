"""Hard negatives by rotated one-bit codes, whose intervals leave few rows to score.

Vectors are rotated; a row x keeps the signs of its components as a code s of unit length, its
alignment a = <x, s>, and its norm. What the code misses, x - a s, is orthogonal to s. For a query q

    <q, x> = a <q, s> + <q - <q, s> s, x - a s>,

and by Cauchy-Schwarz the second term is at most sqrt(|q|^2 - <q, s>^2) sqrt(|x|^2 - a^2). So the
stored numbers bound each score from both sides, for certain and not just in probability. <q, s> comes from
popcounts: the query is rounded to PLANES bits a component, each bit plane meets the codes in an AND, and the
rounding's error widens the interval. Rows whose interval cannot matter are left; the others get their integer score.

Anchors are taken in blocks of ANCHORS, which a broadcast brings to the rows: the rows are not shuffled, tasks hold
a block and STEP rows, and each block's results are a written table. A block takes two passes, one for the positives
and one for the negatives below them; every task returns its own best rows only, and a ranked window keeps the best of all.
No row is capped or sampled: an interval only excludes what could not be among the best.

Components become floor(scale * x). Rows with a null id, label or vector, or any null or non-finite component take
no part. Of rows that share an id the least (label, vector) counts. Shorter vectors end in zeros. Scores must fit into 62 bits,
else a ValueError is raised. Other columns are not read; an empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle, small

#: Anchors of a block, rows of a step, and the bits of a rounded query component.
ANCHORS, STEP, PLANES = 8192, 2048, 6
#: Queries whose intervals with one step of rows are held at a time, and pairs that are scored at a time.
QUERIES_AT_ONCE, PAIRS = 128, 16_384
#: Rounding of doubles in the bounds, relative to the product of the norms.
SLACK = 1e-9
#: The score of a place that no row has taken.
NONE = -(2**63 - 1)


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20_260).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Codes of rotated rows: sign bits, alignments with them, norms and what the codes miss."""

    def __init__(self, rows: np.ndarray, turn: np.ndarray):
        turned = rows @ turn
        dim = turn.shape[0]
        bits = turned > 0
        self.words = _packed(bits)
        self.ones = bits.sum(axis=1)
        self.align = np.abs(turned).sum(axis=1) / np.sqrt(dim)
        self.square = np.einsum("ij,ij->i", rows, rows)
        self.missed = np.sqrt(np.maximum(self.square - self.align**2, 0)) + SLACK * np.sqrt(self.square)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, dim = bits.shape
    wide = np.zeros((n, -(-dim // 64) * 64), dtype=bool)
    wide[:, :dim] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


class Planes:
    """Rotated queries, rounded to PLANES bits a component, as bit planes."""

    def __init__(self, queries: np.ndarray, turn: np.ndarray):
        turned = queries @ turn
        low = turned.min(axis=1, keepdims=True)
        self.step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
        levels = np.rint((turned - low) / self.step).astype(np.int64)
        self.low, self.total = low, levels.sum(axis=1, keepdims=True)
        self.words = [_packed((levels >> k & 1).astype(bool)) for k in range(PLANES)]
        self.norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
        self.off = np.linalg.norm(turned - (low + self.step * levels), axis=1)[:, None] + SLACK * self.norm

    def bounds(self, codes: Codes, dim: int, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of some queries with all rows."""
        both = np.zeros((len(self.low[at]), len(codes.ones)))
        for k, plane in enumerate(self.words):
            hits = np.zeros(both.shape, dtype=np.uint16)
            for w in range(plane.shape[1]):
                hits += np.bitwise_count(plane[at, w][:, None] & codes.words[:, w][None, :])
            both += float(1 << k) * hits
        # <rounded query, s>: what is at the code's ones less what is at its zeros
        signed = self.step[at] * (2 * both - self.total[at]) + self.low[at] * (2 * codes.ones - dim)
        onto = signed / np.sqrt(dim)
        off, norm = self.off[at], self.norm[at]
        near = np.maximum(np.abs(onto) - off, 0)
        across = np.sqrt(np.maximum(norm**2 - near**2, 0)) * codes.missed + off * codes.align + SLACK * norm * np.sqrt(codes.square)
        middle = onto * codes.align
        return middle - across, middle + across


def _nth_largest(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row, or minus infinity."""
    if values.shape[1] < n:
        return np.full((len(values), 1), -np.inf)
    return np.partition(values, values.shape[1] - n, axis=1)[:, [-n]]


class Best:
    """The best n rows seen for each of some lists: higher scores first, then smaller ids."""

    def __init__(self, lists: int, n: int):
        self.n = n
        self.score, self.id = np.full((lists, n), NONE), np.full((lists, n), -NONE)

    def last(self) -> np.ndarray:
        """The score that a row must reach, for each list."""
        return np.where(self.score[:, -1] == NONE, -np.inf, self.score[:, -1].astype(float))

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(which):
            return
        lists = np.unique(which)
        which = np.concatenate((np.repeat(lists, self.n), which))
        score = np.concatenate((self.score[lists].ravel(), score))
        ids = np.concatenate((self.id[lists].ravel(), ids))
        order = np.lexsort((ids, -score, which))
        which, score, ids = which[order], score[order], ids[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which, "left")
        kept = rank < self.n
        self.score[which[kept], rank[kept]], self.id[which[kept], rank[kept]] = score[kept], ids[kept]

    def rows(self) -> list[np.ndarray]:
        """List, id and score of all that was found."""
        which, rank = np.nonzero(self.score != NONE)
        return [which, self.id[which, rank], self.score[which, rank]]


class Search:
    """One block of anchors against rows; positives: the scores that negatives stay at or under, or None."""

    def __init__(self, block: dict, n: int, percent: int, positives: np.ndarray | None = None):
        self.ids, self.labels, self.queries = block["ids"], block["labels"], block["queries"]
        self.n, self.percent, self.positives = n, percent, positives
        self.turn = rotation(self.queries.shape[1])
        self.planes = Planes(self.queries.astype(float), self.turn)
        self.best = Best(len(self.ids) * (1 if positives is None else positives.shape[1]), n)

    def add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        codes = Codes(rows.astype(float), self.turn)
        for first in range(0, len(self.ids), QUERIES_AT_ONCE):
            at = slice(first, min(first + QUERIES_AT_ONCE, len(self.ids)))
            low, high = self.planes.bounds(codes, rows.shape[1], at)
            same = self.labels[at][:, None] == labels[None, :]
            for lists, fits, ceiling in self._wanted(at, same, ids):
                floor = self.best.last()[lists][:, None]
                if ceiling is None:
                    sure = np.where(fits, low, -np.inf)
                else:
                    # Rows certainly at or under the positive, and certainly not too far under it, set the mark.
                    fits &= (low <= ceiling) & (high >= ceiling * self.percent / 100)
                    sure = np.where(fits & (high <= ceiling) & (low >= ceiling * self.percent / 100), low, -np.inf)
                mark = np.maximum(floor, _nth_largest(sure, self.n))
                q, r = np.nonzero(fits & (high >= mark))
                score = np.empty(len(q), dtype=np.int64)
                for k in range(0, len(q), PAIRS):
                    score[k:k + PAIRS] = np.einsum("ij,ij->i", self.queries[at][q[k:k + PAIRS]], rows[r[k:k + PAIRS]])
                if ceiling is not None:
                    top = self.positives.ravel()[lists[q]]
                    held = (score <= top) & (100 * score >= self.percent * top)
                    q, r, score = q[held], r[held], score[held]
                self.best.add(lists[q], score, ids[r])

    def _wanted(self, at: slice, same: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        """(lists, rows that may be in them, ceiling) of some anchors."""
        own = np.arange(at.start, at.stop)
        if self.positives is None:
            yield own, same & (self.ids[at][:, None] != ids[None, :]), None
            return
        per = self.positives.shape[1]
        for k in range(per):
            ceiling = self.positives[at, k]
            there = ceiling != NONE
            yield own * per + k, ~same & there[:, None], np.where(there, ceiling, 0)[:, None].astype(float)


def _run(make: Callable[[], Search]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = make()
        dim = search.queries.shape[1]
        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                part = batch.slice(first, STEP)
                rows = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.int64).reshape(-1, dim)
                search.add(part.column(0).to_numpy(), part.column(1).to_numpy(), rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in search.best.rows()], ["list", "id", "score"])
    return run


def _whole(scale: int, dim: int):
    """Vectors as little-endian 64-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            x = np.zeros((len(sizes), dim))
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * batch.column(2).flatten().to_numpy())
            if len(x) and np.einsum("ij,ij->i", x, x).max() >= 2.0**62 / 100:
                raise ValueError("the scores of these vectors do not fit into 62 bits")
            vectors = [v.tobytes() for v in x.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["id", "label", "v"])
    return run


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: int = 256) -> tuple[DataFrame, int]:
    """(id, label, v) of the rows that take part, settled, and the length of v; v holds integers as bytes."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), v.alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").where(finite)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = settle(rows.mapInArrow(_whole(scale, max(dim, 1)), "id bigint, label bigint, v binary"), "vectors")
    again = settle(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again")), "repeated")
    if not again.isEmpty():
        repeated = rows.join(small(again), F.col("id") == F.col("again"), "left_semi")
        one = repeated.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")
        rows = settle(rows.join(small(again), F.col("id") == F.col("again"), "left_anti").union(one), "vectors")
    return rows, max(dim, 1)


def _blocks(anchors: DataFrame) -> Iterator[dict]:
    """The anchors in blocks of at most ANCHORS, by id; only one block is on the driver at a time."""
    after = None
    while True:
        rest = anchors if after is None else anchors.where(F.col("id") > after)
        rows = rest.orderBy("id").limit(ANCHORS).collect()
        if not rows:
            return
        yield {"ids": np.array([r.id for r in rows]), "labels": np.array([r.label for r in rows]),
               "queries": np.stack([np.frombuffer(bytes(r.v), dtype=np.int64) for r in rows])}
        after = rows[-1].id


def _best(rows: DataFrame, search: Search, n: int, name: str) -> DataFrame:
    """(list, rank, id, score): the best n rows of each list of the search."""
    shared = rows.sparkSession.sparkContext.broadcast(
        {"block": {"ids": search.ids, "labels": search.labels, "queries": search.queries}, "positives": search.positives})
    percent = search.percent

    def make() -> Search:
        return Search(shared.value["block"], n, percent, shared.value["positives"])

    found = rows.mapInArrow(_run(make), "list bigint, id bigint, score bigint")
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    done = settle(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n), name)
    shared.destroy()
    return done


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: which ids are anchors, a condition on the column `id`. An anchor's positives are its best other rows of the same label,
    a positive's negatives the best rows of other labels with a score of at most the positive's and at least `percent` of it.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows, _ = usable(vectors, id_col, label, vector_col, scale)
    done = []
    for block in _blocks(rows.where(anchor)):
        ids, scores = (np.full((len(block["ids"]), positives), NONE) for _ in range(2))
        near = _best(rows, Search(block, positives, percent), positives, "positives").collect()
        for r in near:
            ids[r["list"], r["rank"] - 1], scores[r["list"], r["rank"] - 1] = r["id"], r["score"]
        found = _best(rows, Search(block, negatives, percent, scores), negatives, "negatives")
        k, j = np.nonzero(scores != NONE)
        pairs = np.stack([k * positives + j, block["ids"][k], ids[k, j], scores[k, j]], axis=1).tolist()
        # At most ANCHORS * positives rows of four numbers.
        named = rows.sparkSession.createDataFrame(pairs, "pair bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        done.append(settle(found.join(F.broadcast(named), F.col("list") == F.col("pair")).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")), "mined"))
    if not done:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                                     "positive_score bigint, negative_score bigint")
    return reduce(DataFrame.union, done)
