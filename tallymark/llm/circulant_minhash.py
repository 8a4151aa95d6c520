"""MinHash near-dedup with two permutations, one of them circularly shifted.

A shingle is moved by a first permutation of the 32-bit universe; coordinate k
of the signature is the least value of a second permutation after its index is
shifted by k positions around the circle. Bands of coordinates name candidates;
every link is confirmed on the full shingle sets.

Equal sets are one node, so copies cost one comparison at most. A bucket's nodes
are compared with a centre, the one that meets most others, instead of with each
other. What is then still apart meets by what it differs in from the centre: two nodes, one of
them not linked to the centre, can only link if they share enough differences (see _rest). So near copies whose
edits have nothing in common never meet, however many they are. Nothing is capped; the pairs left out cannot link.

Nulls and texts without words have no shingles and link with nothing; fewer
words than a shingle's are one shingle. Repeated rows and ids are judged by
their text; rows without an id stand alone (component null, kept). Other columns of the
input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import lower_ascii, mix64, settle, shingle_sets, small, steps, word_hashes
from .components import components

BANDS, WIDTH = 30, 5


def _permute32(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of the 32-bit universe."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def band_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band hashes, one row for each set; a set is shingles[starts[i]:starts[i + 1]], none is empty."""
    moved = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(starts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, dtype=np.uint64)
        for k in range(band * WIDTH, (band + 1) * WIDTH):
            low = np.minimum.reduceat(_permute32(moved - np.uint32(k)), starts)
            key = mix64(key * np.uint64(0x9FB21C651E98DF25) + low)
        keys[:, band] = key
    return keys


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of rows: first, last, shingles, counts by row, 16-byte digests of the non-empty sets."""
    for first, last, data, offsets in steps(column):
        shingles, texts = shingle_sets(*word_hashes(lower_ascii(data), offsets), words)
        counts = np.bincount(texts, minlength=last - first) if len(texts) else np.zeros(last - first, dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(counts[counts > 0])))[:-1].astype(np.int64)
        digest = np.zeros((len(starts), 2), dtype=np.uint64)
        if len(starts):
            digest[:, 0] = np.add.reduceat(shingles, starts)
            digest[:, 1] = np.add.reduceat(mix64(shingles + np.uint64(0xA0761D6478BD642F)), starts)
        yield first, last, shingles, counts, digest


def _binary(digest: np.ndarray, counts: np.ndarray) -> pa.Array:
    rows = iter(np.ascontiguousarray(digest).view("V16").ravel().tolist())
    return pa.array([bytes(next(rows)) if n else None for n in counts.tolist()], type=pa.binary())


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, shingles, counts, digest in _sets(batch.column(1), words):
                starts = np.concatenate(([0], np.cumsum(counts[counts > 0])))[:-1].astype(np.int64)
                keys = band_keys(shingles, starts) if len(starts) else np.zeros((0, BANDS), dtype=np.uint64)
                offsets = np.concatenate(([0], np.cumsum(np.where(counts > 0, BANDS, 0)))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(counts.astype(np.int64)),
                     _binary(digest, counts), bands], ["id", "n", "node", "bands"])
    return run


def _grams(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, shingles, counts, digest in _sets(batch.column(1), words):
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(first, last - first), _binary(digest, counts), grams],
                    ["node", "found", "grams"])
    return run


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets reach the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    joint = F.size(F.array_intersect("x", "y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", joint.alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return both.where(1000 * F.col("i") >= round(1000 * threshold) * (F.col("s") - F.col("i"))).select("a", "b")


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("label", F.col("node"))
    return entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _apart(entries: DataFrame) -> DataFrame:
    """The centre, the node that meets most others, of each bucket whose nodes have several labels."""
    pick = F.min(F.struct((-F.col("met")).alias("h"), "node", "label", "n"))
    found = entries.groupBy("key").agg(pick.alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return found.where("lo != hi").select("key", F.col("c.node").alias("b"), F.col("c.label").alias("c_label"),
                                          F.col("c.n").alias("c_n"))


def _rest(entries: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with different labels that may link: a and b meet in a bucket, whose centre is c.

    A node lacks r of c's shingles and has p that c has not; these are its differences. With s of them in common, the
    nodes share |c| - r_a - r_b + s of |c| + p_a + p_b - s shingles. One of the two, a, is not linked to c, so
    g = 1000 r_a + T p_a - (1000 - T) |c| > 0 for the threshold T in thousandths, and a link needs
    (1000 + T) s >= g + 1000 r_b + T p_b. That bounds s from below for a and for b alone, before they meet; differences
    that only one node has don't count, and a node with too few of the others is left out. The rest meets by its rarest
    differences: sets that share s elements share one among all but the s - 1 most frequent of each.
    """
    t = round(1000 * threshold)
    centres = _apart(entries).select("key", "b")
    members = entries.join(centres, "key").where("node != b").select("node", "b", "label").distinct()
    one = sets.select("node", F.col("grams").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = members.join(one, "node").join(two, "b")
    both = both.select("node", "b", "label", F.size("y").alias("c"), F.array_except("y", "x").alias("lacks"), F.array_except("x", "y").alias("adds"))
    r, p = F.size("lacks"), F.size("adds")
    apart = 1000 * r + t * p - (1000 - t) * F.col("c")
    tokens = both.select("node", "b", "label", apart.alias("gap"), (1000 * r + t * p).alias("own"),
                         F.explode(F.concat(F.transform("lacks", lambda g: F.struct(F.lit(0).alias("kind"), g.alias("gram"))),
                                            F.transform("adds", lambda g: F.struct(F.lit(1).alias("kind"), g.alias("gram"))))).alias("d"))
    tokens = settle(tokens.select("node", "b", "label", "gap", "own", "d.kind", "d.gram"), "differences")
    token = ["b", "kind", "gram"]
    useful = tokens.groupBy(*token).agg(F.count("*").alias("k"), F.max("gap").alias("far"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    useful = useful.where("k > 1 and far > 0 and lo != hi").select(*token, "k")
    held = settle(tokens.join(useful, token), "shared")
    count = held.groupBy("node", "b").agg(F.count("*").alias("m"))
    # The differences that a node must share: as one that is not linked to the centre, and as the other one.
    first = F.when(F.col("gap") > 0, F.ceil(F.col("gap") / (1000 + t)))
    other = F.floor(F.col("own") / (1000 + t)) + 1
    held = held.join(count.where("m > 0"), ["node", "b"]).withColumns({"first": first, "other": other})
    held = held.where("m >= least(first, other)")
    rank = F.row_number().over(Window.partitionBy("node", "b").orderBy("k", "kind", "gram"))
    held = settle(held.withColumn("rank", rank).where("rank <= m - least(first, other) + 1"), "prefixes")
    a = held.where("rank <= m - first + 1").select(*token, *[F.col(c).alias(f"a_{c}") for c in ("node", "label", "gap", "m")])
    b = held.where("rank <= m - other + 1").select(*token, *[F.col(c).alias(f"b_{c}") for c in ("node", "label", "own", "m")])
    room = (1000 + t) * F.least("a_m", "b_m") >= F.col("a_gap") + F.col("b_own")
    met = a.join(b, token).where((F.col("a_label") != F.col("b_label")) & room)
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    threshold: float = 0.85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable by links), kept.

    kept marks the row whose id names its component.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    signed = settle(docs.mapInArrow(_sign(words), f"id {kind}, n bigint, node binary, bands array<bigint>"), "signed")
    nodes = settle(signed.where("n > 0 and id is not null").groupBy("node").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    entries = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    entries = settle(entries.join(shared, "key"), "shared")
    # Edits change a node's keys to rare ones, so a family's least edited member meets most nodes in its buckets.
    met = entries.groupBy("node").agg(F.sum("k").alias("met"))
    entries = settle(entries.join(met, "node").select("key", "node", "n", "met"), "buckets")
    wanted = settle(entries.select("node").distinct().join(nodes.select("node", "id"), "node"), "wanted")
    texts = docs.join(small(wanted), "id").select("id", "text", "node")
    grams = texts.mapInArrow(_grams(words), "node binary, found binary, grams array<bigint>")
    sets = settle(grams.where("node = found").dropDuplicates(["node"]).select("node", "grams"), "sets")

    now = _labelled(entries, None)
    near = (F.col("n") >= F.col("c_n") * threshold - 1e-6) & (F.col("c_n") >= F.col("n") * threshold - 1e-6)
    pairs = now.join(_apart(now), "key").where((F.col("label") != F.col("c_label")) & near)
    pairs = pairs.select(F.col("node").alias("a"), "b").distinct()
    labels = settle(components(settle(_linked(pairs, sets, threshold), "links")), "labels")
    more = settle(_linked(_rest(_labelled(entries, labels), sets, threshold), sets, threshold), "links")
    if not more.isEmpty():
        stars = labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = settle(components(stars.union(more)), "labels")

    member = _labelled(nodes.select("node", "id"), labels)
    least = member.groupBy("label").agg(F.min("id").alias("component"))
    member = settle(member.join(least, "label").select("node", "component"), "members")
    out = signed.select("id", "n", "node").join(member, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
