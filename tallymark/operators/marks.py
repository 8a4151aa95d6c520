"""Yes/no marks of single rows, brought from a narrow table to the wide rows.

What marks a row is found on narrow copies of the rows. Their marks reach the wide rows by the
order key, in the smaller of two forms:

* the marked keys themselves, while they are few;
* bitmaps, where the key numbers rows: a whole number, or a file with a row number. One bitmap tells of
  32,768 neighbouring rows in 4 KB, so 64 MB of them reach hundreds of millions of rows.

Either is broadcast by its measured size, and the wide rows are not shuffled. Where neither fits, the keys meet the
rows in a join on the unique key, which no group can skew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import quoted
from . import staging
from .staging import Settled, discard, settle

#: Bytes of one bitmap, as bitmap_construct_agg makes them.
BITMAP_BYTES = 4096
#: Bytes that a broadcast row of a key takes besides its texts.
ROW_BYTES = 48


def numbered(df: DataFrame, order_by: str) -> tuple[Column, Column] | None:
    """(file, row number) of an order key that numbers rows; None for other keys."""
    kind, key = df.schema[order_by].dataType, quoted(order_by)
    if isinstance(kind, T.IntegralType):
        return F.lit(""), key.cast("bigint")
    if isinstance(kind, T.StructType) and kind.simpleString() == "struct<file:string,row:bigint>":
        return key["file"], key["row"]
    return None


@dataclass(frozen=True)
class Marks:
    """Settled marks of single rows. ``counts`` has the marked rows of each
    name, ``nulls`` the rows without a key."""

    names: tuple[str, ...]
    table: Settled
    counts: dict[str, int]
    nulls: int
    bitmaps: bool

    def bring(self, df: DataFrame, order_by: str) -> DataFrame:
        """``df`` with its marks as boolean columns."""
        if not any(self.counts.values()):
            return df.withColumns({n: F.lit(False) for n in self.names})
        if not self.bitmaps:
            side = F.broadcast(self.table.df) if self.table.broadcastable else self.table.df
            out = df.join(side, quoted(order_by) == F.col("_row"), "left").drop("_row")
            return out.withColumns({n: F.coalesce(n, F.lit(False)) for n in self.names})
        file, row = numbered(df, order_by)
        same = (F.bitmap_bucket_number(row) == F.col("_bucket")) & (file == F.col("_file"))
        out = df.join(F.broadcast(self.table.df), same, "left")
        at = F.bitmap_bit_position(row)
        byte = F.floor(at / 8).cast("int") + 1

        def bit(name: str) -> Column:
            held = F.conv(F.hex(F.substring(F.col(name), byte, F.lit(1))), 16, 10).cast("int")
            return F.when(F.col(name).isNull(), False).otherwise(
                F.coalesce(F.bit_get(held, (at % 8).cast("int")) == 1, F.lit(False)))

        return out.withColumns({n: bit(n) for n in self.names}).drop("_file", "_bucket")


def settle_marks(marked: DataFrame, names: list[str], order_by: str) -> Marks:
    """The marks of the rows for which one of the boolean columns ``names`` holds."""
    key = quoted(order_by)
    some = reduce(lambda a, b: a | b, [F.col(n) for n in names])
    rows = settle(marked.filter(some | key.isNull()).select(key.alias("_row"), *names))
    place = numbered(rows.df, "_row")
    seen = [F.count_if(F.col("_row").isNull()).alias("nulls"),
            *[F.count_if(n).alias(n) for n in names]]
    if place:
        file, row = place
        seen.append(F.count_distinct(file, F.bitmap_bucket_number(row)).alias("buckets"))
    found = rows.df.agg(*seen).first()
    counts = {n: found[n] for n in names}
    weight = found["buckets"] * BITMAP_BYTES * len(names) if place else None
    light = rows.broadcastable and (weight is None or rows.bytes + ROW_BYTES * rows.rows <= weight)
    if light or weight is None or weight > staging.BROADCAST_BYTES:
        return Marks(tuple(names), rows, counts, found["nulls"], False)
    bits = rows.df.filter("_row IS NOT NULL").select(
        file.alias("_file"), F.bitmap_bucket_number(row).alias("_bucket"),
        F.bitmap_bit_position(row).alias("_bit"), *names)
    made = bits.groupBy("_file", "_bucket").agg(*[
        F.when(F.count_if(n) > 0, F.bitmap_construct_agg(F.when(F.col(n), F.col("_bit")))).alias(n)
        for n in names])
    table = settle(made)
    set_bits = table.df.agg(*[F.coalesce(F.sum(F.bitmap_count(n)), F.lit(0)).alias(n)
                              for n in names]).first()
    # A key that two marked rows share sets one bit.
    counts = {n: min(counts[n], set_bits[n]) for n in names}
    discard(marked.sparkSession, [rows.path])
    return Marks(tuple(names), table, counts, found["nulls"], True)
