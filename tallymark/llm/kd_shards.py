"""Shards of near equal bytes as the leaves of a k-d tree over the documents' metadata.

A document is a point: its source and language (hashed, so equal ones stay together), the logarithm of its size and its id.
A node that holds several shards is cut along its widest dimension, measured against the whole table's extent, at
the weighted quantile that leaves each side the bytes of its share of the shards. All nodes of a level are cut together.

A cut is found by histograms: per node, the bytes of equal slices of the coordinate, added up before the shuffle, so a few
thousand sums come back. The slice that holds the quantile is cut again until it is one value; if that value is shared, the cut goes
on through a hash of the text, a hash of the id and at last the row's number. So copies of a text part only where a cut
passes through them, and any number of documents may share a source, a language or a text. The tree, one cut per inner
node, becomes a column expression; the rows are never sorted, moved or gathered to be assigned.

Slots number a shard's rows from 0: rows are numbered inside small buckets of the shard, and the buckets' row counts are summed up.

Null sources, languages and ids are values like others, null texts have no bytes; columns that the table lacks are one
value for all. Rows that agree in id and text differ by their place in the input only. Other columns are not read; an empty table
gives an empty result; with fewer documents than shards some shards are empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import settle, small

#: Bytes that a document has besides its text.
OVERHEAD = 16
#: Slices of one histogram, and the rows that a bucket of slots has on average.
SLICES, BUCKET_ROWS = 512, 2_000
#: Bytes of a file that write() makes.
FILE_BYTES = 512 << 20
#: What a cut goes through after its dimension.
TIES = ("by_text", "by_id", "row")

Key = tuple[int, int, int, int]


@dataclass
class Node:
    """A part of the tree: shards first to last, and once cut the dimension and the least key of its right side."""

    first: int
    last: int
    dim: str | None = None
    cut: Key | None = None
    left: Node | None = None
    right: Node | None = None

    def leaf(self) -> Column:
        """The number of the deepest part that a row is in: its shard once all parts are single."""
        if self.cut is None:
            return F.lit(self.first)
        return F.when(_before([self.dim, *TIES], self.cut), self.left.leaf()).otherwise(self.right.leaf())

    def ends(self) -> list[Node]:
        return [self] if self.cut is None else [*self.left.ends(), *self.right.ends()]


def _before(names: Sequence[str], key: Key) -> Column:
    """Whether a row's key is less than `key`."""
    less, same = F.lit(False), F.lit(True)
    for name, value in zip(names, key, strict=True):
        less = less | (same & (F.col(name) < value))
        same = same & (F.col(name) == value)
    return less


def points(docs: DataFrame, id_col: str, text_col: str, dims: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(id, size, crc, coordinates, ties) of every document, settled, and the coordinates' names."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    numeric = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    # Halved, so that the distance of two places fits a long.
    place = F.shiftright(F.col(id_col).cast("bigint") if numeric else F.xxhash64(F.col(id_col)), 1)

    def even(*columns: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*columns), 2)

    coordinates = {f"d{k}": F.shiftrightunsigned(F.xxhash64(F.col(c)), 33) for k, c in enumerate(dims) if c in docs.columns}
    size = F.octet_length(raw).cast("bigint") + OVERHEAD
    coordinates |= {"d_size": F.floor(F.log2(size.cast("double")) * 2**20), "d_id": F.coalesce(place, F.lit(-1))}
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(raw).alias("crc"),
                       *[c.cast("bigint").alias(k) for k, c in coordinates.items()], even(raw).alias("by_text"),
                       even(F.lit("id"), F.col(id_col).cast("string")).alias("by_id"), F.monotonically_increasing_id().alias("row"))
    return settle(rows, "points"), list(coordinates)


@dataclass
class _Search:
    """Where the cut of a node is known to be: rows in `low` to `high` of one part of the key, equal to `fixed` in those before."""

    node: int
    names: list[str]
    goal: float
    fixed: tuple[int, ...] = ()
    low: int = 0
    high: int = 0
    below: float = 0.0

    def narrow(self, slices: list) -> Key | None:
        """slices: (weight, least, greatest, rows) in order. The cut's key once it is known."""
        total = self.below
        for k, (weight, least, greatest, rows) in enumerate(slices):
            if total + weight < self.goal and k + 1 < len(slices):
                total += weight
                continue
            if least < greatest:
                self.low, self.high, self.below = least, greatest, total
                return None
            if rows > 1 and len(self.fixed) < len(TIES):
                self.fixed, self.low, self.high, self.below = (*self.fixed, least), 0, 2**63 - 1, total
                return None
            # One row: it goes to the side where it leaves the smaller error.
            right = self.goal - total < total + weight - self.goal
            key = (*self.fixed, least if right else least + 1)
            return (*key, *[0] * (len(TIES) + 1 - len(key)))
        raise AssertionError("a node to cut has rows")


def _extents(rows: DataFrame, dims: Sequence[str]) -> dict[int, dict]:
    """Bytes and each coordinate's least and greatest value, by leaf."""
    sides = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return {r["leaf"]: r.asDict() for r in rows.groupBy("leaf").agg(F.sum("size").alias("bytes"), *sides).collect()}


def _rows(spark: SparkSession, names: Sequence[str], values: Sequence[tuple[int, ...]]) -> DataFrame:
    """A handful of whole numbers as a broadcast table, so that plans are alike whatever the numbers are:
    a plan that holds them as literals is compiled anew for each round, and stays in the driver."""
    laid = ", ".join(f"({', '.join(f'{v}L' for v in r)})" for r in values)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {laid} AS t({', '.join(names)})"))


def _key(dims: Sequence[str]) -> list[Column]:
    """What a cut goes through: the coordinate whose place is in `dim`, then the ties."""
    return [F.element_at(F.array(*dims), F.col("dim").cast("int")), *[F.col(t) for t in TIES]]


def _cuts(rows: DataFrame, dims: Sequence[str], searches: list[_Search]) -> dict[int, Key]:
    """The key of each search's cut, by histograms of the parts (column leaf) that are cut."""
    found: dict[int, Key] = {}
    fixed = [f"fixed_{k}" for k in range(len(TIES))]
    names = ["leaf", "s", "dim", "depth", *fixed, "low", "high", "width"]
    while searches:
        asked = _rows(rows.sparkSession, names, [
            (s.node, k, dims.index(s.names[0]) + 1, len(s.fixed), *(*s.fixed, *[0] * len(TIES))[: len(TIES)], s.low, s.high,
             (s.high - s.low) // SLICES + 1) for k, s in enumerate(searches)])
        key = _key(dims)
        value = F.element_at(F.array(*key), F.col("depth").cast("int") + 1)
        same = [(F.col("depth") <= k) | (key[k] == F.col(name)) for k, name in enumerate(fixed)]
        held = rows.join(asked, "leaf").select("s", "size", "low", "high", "width", value.alias("value"),
                                               reduce(lambda a, b: a & b, same).alias("same"))
        part = F.expr("(value - low) div width")
        sums = held.where("same AND value BETWEEN low AND high").groupBy("s", part.alias("part")).agg(
            F.sum("size").alias("w"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
        # At most SLICES + 1 rows for each node of a level.
        slices: dict[int, list] = {}
        for r in sorted(sums.collect(), key=lambda r: (r["s"], r["part"])):
            slices.setdefault(r["s"], []).append((r["w"], r["lo"], r["hi"], r["n"]))
        rest = []
        for k, s in enumerate(searches):
            key = s.narrow(slices[k])
            if key is None:
                rest.append(s)
            else:
                found[s.node] = key
        searches = rest
    return found


def _descend(rows: DataFrame, dims: Sequence[str], cut: Sequence[Node]) -> DataFrame:
    """rows, each in that side of its part (column leaf) that it is in; parts that are not cut stay."""
    bounds = [f"cut_{k}" for k in range(len(TIES) + 1)]
    sides = _rows(rows.sparkSession, ["leaf", "dim", *bounds, "right"],
                  [(n.first, dims.index(n.dim) + 1, *n.cut, n.right.first) for n in cut])
    less, same = F.lit(False), F.lit(True)
    for value, bound in zip(_key(dims), bounds, strict=True):
        less, same = less | (same & (value < F.col(bound))), same & (value == F.col(bound))
    at = F.when(F.col("right").isNull() | less, F.col("leaf")).otherwise(F.col("right"))
    return rows.join(sides, "leaf", "left").select(at.alias("leaf"), *[c for c in rows.columns if c != "leaf"])


def grow(rows: DataFrame, dims: Sequence[str], shards: int) -> Node:
    """The tree whose leaves are the shards."""
    root = Node(0, shards - 1)
    whole: dict = {}
    at = rows.select(F.lit(0).cast("bigint").alias("leaf"), "size", *dims, *TIES)
    while open_ := [n for n in root.ends() if n.first < n.last]:
        sides = _extents(at, dims)
        whole = whole or sides.get(0, {})
        searches, wanted = [], {}
        for n in open_:
            own, count = sides.get(n.first), n.last - n.first + 1
            middle = n.first + count // 2
            n.left, n.right = Node(n.first, middle - 1), Node(middle, n.last)
            if own is None:
                n.dim, n.cut = dims[0], (0, 0, 0, 0)
                continue
            share = {d: (own[f"max_{d}"] - own[f"min_{d}"]) / max(1, whole[f"max_{d}"] - whole[f"min_{d}"]) for d in dims}
            n.dim = max(dims, key=lambda d: share[d])
            searches.append(_Search(n.first, [n.dim, *TIES], own["bytes"] * (count // 2) / count,
                                    low=own[f"min_{n.dim}"], high=own[f"max_{n.dim}"]))
            wanted[n.first] = n
        for first, key in _cuts(at, dims, searches).items():
            wanted[first].cut = key
        if any(n.first < n.last for n in root.ends()):
            # The narrow columns are written once a level: the next level reads its parts instead of the tree.
            at = settle(_descend(at, dims, open_), "parts")
    return root


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    """rows with slot: the number of a row in its shard, from 0, without gaps."""
    total = rows.count()
    buckets = max(1, total // (shards * BUCKET_ROWS))
    # Rows without an id are told apart by their place.
    bucket = F.pmod(F.xxhash64("by_id", F.when(F.col("id").isNull(), F.col("row"))), F.lit(buckets))
    order = Window.partitionBy("shard", "bucket").orderBy("by_id", "by_text", "row")
    placed = settle(rows.withColumn("bucket", bucket).withColumn("place", F.row_number().over(order) - 1), "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # One row for each bucket, BUCKET_ROWS times fewer than documents; a shard's are numbered on their own.
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket"))
    starts = settle(counts.select("shard", "bucket", (upto - F.col("n")).alias("start")), "starts")
    return placed.join(small(starts), ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("place"))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
          dims: Sequence[str] = ("source", "lang")) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    shards: how many; or target_bytes: as many as give a shard about that size. Which shard a document is in follows from the
    bytes of all, so growing the number of shards moves documents anywhere, and grown_shard is null.
    """
    rows, found = points(docs, id_col, text_col, dims)
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    root = Node(0, shards - 1) if rows.isEmpty() else grow(rows, found, shards)
    placed = _slots(rows.withColumn("shard", root.leaf().cast("int")), shards)
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                         "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, plan: DataFrame, id_col: str = "doc_id") -> None:
    """The documents as Parquet with one folder for each shard, by a plan of ``shard``, in files of about FILE_BYTES.

    Raises where ids are null or repeated, as a plan then does not say which document is where.
    """
    ids = plan.agg(F.count_if(F.col(id_col).isNull()).alias("nulls")).first()["nulls"]
    if ids or not plan.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{id_col} must be unique and not null")
    files = plan.groupBy("shard").agg(F.ceil(F.sum("size") / FILE_BYTES).alias("files"))
    # One row for each shard.
    placed = plan.join(F.broadcast(files), "shard").select(F.col(id_col).alias("__id"), F.col("shard").alias("shard"),
                                                           F.pmod("slot", "files").alias("__file"))
    joined = docs.drop("shard").join(placed, F.col(id_col) == F.col("__id")).drop("__id")
    joined.repartition("shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)
