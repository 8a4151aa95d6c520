"""Exact quantiles of a weighted value table, without gathering a column.

The values are range-partitioned once, so a place in the order is the sum of
the partitions before plus a running sum within one. Partition totals are one
row per column and partition; of the rows themselves only those whose partition holds a
wanted rank are looked at, each partition by one task, and one value per rank
comes back. Infinities are values like others, and nothing iterates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .staging import settle


def _pick(low: float, high: float, position: float) -> float:
    part = position - math.floor(position)
    return low if part == 0 or low == high else (1 - part) * low + part * high


def exact_quantiles(freq: DataFrame, counts: dict[str, int],
                    probs: list[float]) -> dict[str, dict[float, float]]:
    """Linear-interpolated quantiles per column of ``freq`` (column, num, n).
    ``counts`` gives each column's total weight."""
    ranks = {(c, p): p * (total - 1) for c, total in counts.items() for p in probs}
    wanted = sorted({(c, k) for (c, _), at in ranks.items()
                     for k in (math.floor(at), math.ceil(at))})
    found = _select_ranks(freq.filter(F.col("column").isin(list(counts))), wanted)
    out: dict[str, dict[float, float]] = {}
    for (c, p), at in ranks.items():
        out.setdefault(c, {})[p] = _pick(found[c, math.floor(at)], found[c, math.ceil(at)], at)
    return out


def _select_ranks(freq: DataFrame, wanted: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The value at each (column, rank)."""
    if not wanted:
        return {}
    spark = freq.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = settle(freq.repartitionByRange(parts, "column", "num")
                     .select("column", "num", "n", F.spark_partition_id().alias("part"))).df
    totals = ordered.groupBy("column", "part").agg(F.sum("n").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("column").orderBy("part"))
    places = totals.select("column", "part", (upto - F.col("w")).alias("below"), upto.alias("end"))
    # two ranks per column and probability
    ranks = spark.createDataFrame(wanted, "column string, rank bigint")
    held = places.join(F.broadcast(ranks), "column").filter("rank >= below AND rank < end")
    inside = ordered.join(F.broadcast(held.select("column", "part", "below").distinct()),
                          ["column", "part"])
    run = F.sum("n").over(Window.partitionBy("column", "part").orderBy("num")
                          .rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    hit = (inside.select("column", "num", "n", run.alias("end"))
           .join(F.broadcast(ranks), "column").filter("rank >= end - n AND rank < end"))
    return {(r["column"], r["rank"]): r["num"] for r in hit.collect()}
