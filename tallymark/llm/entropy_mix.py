"""Mixing of sources to token targets by entropy balancing, in DataFrame functions only.

Rates r of a source's documents minimise sum(r log r - r + 1) under
sum(size * r) = target and r <= most. The solution is r = min(most, exp(lambda
* size / mean size), with one multiplier per source: the root of the convex dual's
gradient. Newton steps, kept inside a bracket that shrinks, find all
multipliers together; each step is one grouped sum over the sizes' histogram.
Sums are decimals, so reruns agree.

Rates become copies: whole ones, and for the fraction extras laid out along the
sizes of a source, so that its words miss the target by about one document at most.
A size that many documents share is split into buckets by a hash, each of
bounded rows, and the extras go to the least hashes of a bucket.

Null texts have size 0, null sources are one source, ranked last. Sources
without words have target 0. Repeated rows count each; rows of equal id and
text are interchangeable. Other columns are not read; empty input, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rows that a bucket of equal sizes holds on average, at most.
BUCKET = 512
#: A source's tilt is found when its words miss the target by this share.
CLOSE = 1e-8
STEPS = 200
UNIT = 1_000_000


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources: (source, source_size). Adds target: share of all sizes by weight, filled up to most times the size."""
    # One row per source from here on, so a window over all of them is small.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    ranked = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # Below the first source that stays under its cap, all are at theirs.
    levelled = ranked.withColumn("level", level)
    fill = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    target = F.least("cap", F.coalesce(fill * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_size", target.alias("target"))


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,9)"))


def tilts(cells: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """The multiplier of each source. cells: (source, size, n); aims: (source, source_size, target)."""
    used = cells.where("size > 0").withColumnRenamed("source", "cell_source")
    base = aims.where(f"source_size > 0 and target < {most} * source_size")
    shape = (used.join(base, F.col("cell_source").eqNullSafe(F.col("source"))).groupBy("source", "source_size", "target")
             .agg((F.col("source_size") / F.sum("n")).alias("mean"), F.min("size").alias("least")))
    zmin = F.col("least") / F.col("mean")
    low = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) / zmin
    state = settle(shape.select("source", "target", "mean", F.lit(0.0).alias("tilt"), low.alias("lo"),
                                (F.log(F.lit(float(most))) / zmin).alias("hi"), F.lit(1.0).alias("miss")), "tilts")
    used = settle(used, "sizes")
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * z, F.lit(50.0))))
        mass = F.col("n") * F.col("size") * rate
        slope = F.when(F.col("tilt") * z < F.log(F.lit(float(most))), mass * z).otherwise(F.lit(0.0))
        sums = (used.join(state, F.col("cell_source").eqNullSafe(F.col("source")))
                .groupBy("source", "target", "mean", "tilt", "lo", "hi")
                .agg((_exact(mass).cast("double") - F.col("target")).alias("gap"), _exact(slope).cast("double").alias("slope")))
        lo, hi = F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("hi"))
        moved = sums.withColumn("newton", F.col("tilt") - F.col("gap") / F.when(F.col("slope") > 0, F.col("slope"))) \
            .withColumn("lo", lo).withColumn("hi", hi)
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        miss = F.abs(F.col("gap")) / F.col("target")
        tilt = F.when(miss <= CLOSE, F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = settle(moved.select("source", "target", "mean", tilt.alias("tilt"), "lo", "hi", miss.alias("miss")), "tilts")
        if state.where((F.col("miss") > CLOSE) & (F.col("hi") - F.col("lo") > 1e-13)).isEmpty():
            return state.select("source", "mean", "tilt")
    raise RuntimeError("the tilts of some sources were not found")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, rate, copies, taken."""
    text = F.col(text_col)
    sized = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               F.size(words(text)).cast("bigint").alias("size"),
                               F.xxhash64(F.col(id_col), text).alias("h")), "sized")
    cells = settle(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = settle(targets(sources, weights, share, most), "targets")
    found = tilts(cells, aims, most).withColumnRenamed("source", "tilt_source")
    aims = aims.join(found, F.col("source").eqNullSafe(F.col("tilt_source")), "left").drop("tilt_source")

    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("tilt").isNull(), F.lit(float(most))) \
        .otherwise(F.least(F.lit(float(most)), tilted))
    aims = aims.withColumnRenamed("source", "aim_source")
    planned = cells.join(aims, F.col("source").eqNullSafe(F.col("aim_source"))).withColumn("rate", rate)
    units = F.round(F.col("rate") * UNIT).cast("bigint")
    planned = planned.withColumn("whole", F.floor(units / UNIT)).withColumn("part", F.col("n") * F.pmod(units, F.lit(UNIT)))
    upto = F.sum("part").over(Window.partitionBy("source").orderBy("size")) + UNIT // 2
    extras = F.floor(upto / UNIT) - F.floor((upto - F.col("part")) / UNIT)
    planned = planned.select(F.col("source").alias("cell_source"), F.col("size").alias("cell_size"), "n", "source_size", "target",
                             "rate", "whole", extras.alias("extras"))

    rows = sized.join(planned, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("size") == F.col("cell_size")))
    rows = rows.withColumn("buckets", F.ceil(F.col("n") / BUCKET)).withColumn("bucket", F.pmod("h", "buckets"))
    cell = Window.partitionBy("source", "size", "bucket")
    chance = F.pmod(F.xxhash64("source", "size", "bucket"), F.lit(UNIT)) / UNIT
    own = F.floor(F.col("extras") * F.col("in_bucket") / F.col("n") + F.when(F.col("buckets") > 1, chance).otherwise(1e-9))
    rows = (rows.withColumn("in_bucket", F.count("*").over(cell)).withColumn("place", F.row_number().over(cell.orderBy("h", "id")))
            .withColumn("copies", F.col("whole") + F.when(F.col("place") <= own, 1).otherwise(0)))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate",
                       "copies", (F.col("copies") * F.col("size")).alias("taken"))
