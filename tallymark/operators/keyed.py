"""Per-group facts brought back to the rows, safe against hot groups.

A window over the key would send a whole group to one task. Instead the group
is reduced first (partial aggregation before the shuffle, so a hot group costs
one row per map task), the reduced table is filtered to the groups that matter
and settled, and only then joined back:

* measured small: broadcast, the wide rows are not shuffled at all;
* otherwise: groups above a row threshold go into a broadcast of bounded size,
  and their rows are spread over all partitions of the shuffle that serves the
  remaining groups. Every row keeps its exact answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import as_text, quoted
from .staging import BROADCAST_ROWS, Settled, settle

HOT_ROWS = 1_000_000
SALTS = 4096
GROUP_ROWS = "_rows"


def attach(df: DataFrame, facts: Settled, keys: list[str], values: list[str],
           spread: Column) -> DataFrame:
    """Left join of ``facts`` (unique on ``keys``, which may be null) to ``df``.
    ``spread`` tells rows of one hot group apart; facts carry ``_rows``."""
    if facts.rows == 0:
        types = {f.name: f.dataType for f in facts.df.schema.fields}
        return df.withColumns({v: F.lit(None).cast(types[v]) for v in values})

    def join(left, right, suffix, extra=None):
        side = right.select(*[quoted(k).alias(f"_k{i}{suffix}") for i, k in enumerate(keys)],
                            *[quoted(v).alias(v + suffix) for v in values],
                            *([F.lit(0).alias("_salt" + suffix)] if extra is not None else []))
        same = [quoted(k).eqNullSafe(F.col(f"_k{i}{suffix}")) for i, k in enumerate(keys)]
        if extra is not None:
            same.append(extra == F.col("_salt" + suffix))
        side = F.broadcast(side) if extra is None else side
        gone = [f"_k{i}{suffix}" for i in range(len(keys))]
        gone += ["_salt" + suffix] if extra is not None else []
        return left.join(side, reduce(lambda a, b: a & b, same), "left").drop(*gone)

    if facts.broadcastable:
        out = join(df, facts.df, "_b")
        return out.withColumnsRenamed({v + "_b": v for v in values})

    # The threshold grows with the data, so at most BROADCAST_ROWS groups pass.
    hot_rows = max(HOT_ROWS, facts.weight // BROADCAST_ROWS + 1)
    hot = facts.df.filter(F.col(GROUP_ROWS) >= hot_rows)
    cold = facts.df.filter(F.col(GROUP_ROWS) < hot_rows)
    marker = values[0] + "_h"
    out = join(df, hot, "_h")
    salt = F.when(F.col(marker).isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    out = out.withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int"))
    out = join(out, cold, "_c", extra=F.col("_salt"))
    merged = {v: F.coalesce(F.col(v + "_h"), F.col(v + "_c")) for v in values}
    dropped = [v + s for v in values for s in ("_h", "_c")] + ["_salt"]
    return out.withColumns(merged).drop(*dropped)


def repeat_facts(df: DataFrame, keys: list[str], order_by: str) -> Settled:
    """First row and size of every group of two or more equal keys."""
    groups = (df.groupBy(*[quoted(k) for k in keys])
              .agg(F.min(quoted(order_by)).alias("_first"),
                   F.count(F.lit(1)).alias(GROUP_ROWS))
              .filter(F.col(GROUP_ROWS) > 1))
    return settle(groups, weight=GROUP_ROWS)


def rolled_facts(groups: DataFrame, keys: list[str]) -> Settled:
    """``repeat_facts`` of coarser keys from groups (keys, _first, _rows)."""
    coarse = groups.groupBy(*[quoted(k) for k in keys]).agg(
        F.min("_first").alias("_first"), F.sum(GROUP_ROWS).alias(GROUP_ROWS))
    return settle(coarse.filter(F.col(GROUP_ROWS) > 1), weight=GROUP_ROWS)


def check_order(found: dict[str, int], facts: dict[str, Settled], nulls: int) -> None:
    """Each group has one first row. Fewer marked rows than that leaves mean
    that order keys repeat; a null key orders nothing."""
    expected = {name: f.weight - f.rows for name, f in facts.items()}
    if nulls or found != expected:
        raise ValueError(f"Options.order_by must be unique and not null: {nulls} null keys, "
                         f"{found} later copies where there must be {expected}")


def mark_repeats(df: DataFrame, keys: list[str], order_by: str, name: str,
                 facts: Settled | None = None) -> DataFrame:
    """Boolean ``name``: an equal row (null equals null) stands earlier in
    ``order_by``, which must be unique and not null."""
    facts = facts or repeat_facts(df, keys, order_by)
    out = attach(df, facts, keys, ["_first"], quoted(order_by))
    repeat = F.coalesce(quoted(order_by) != F.col("_first"), F.lit(False))
    return out.withColumn(name, repeat).drop("_first")


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the whole row, so wide rows are compared by 32 bytes."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = [as_text(quoted(c), types[c]) for c in columns]
    sized = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("null"))
             for c in cells]
    return F.unhex(F.sha2(F.concat_ws("|", *sized), 256))


def mark_repeated_rows(df: DataFrame, columns: list[str], order_by: str,
                       name: str) -> DataFrame:
    """As ``mark_repeats`` over whole rows."""
    keyed = df.withColumn("_digest", row_digest(df, columns))
    return mark_repeats(keyed, ["_digest"], order_by, name).drop("_digest")


def drop_or_flag_duplicates(df: DataFrame, keys: list[str], order_by: str, drop: bool,
                            name: str = "is_duplicate") -> DataFrame:
    marked = mark_repeats(df, keys, order_by, name)
    return marked.filter(~F.col(name)).drop(name) if drop else marked


def exposure_facts(groups: DataFrame, key: str, amount: str, least: str, name: str) -> Settled:
    """Total of ``amount`` (whole cents) per key over groups of equal rows, for
    the keys where it passes their ``least`` positive limit; elsewhere no row
    can be in breach."""
    each = F.rint(quoted(amount) * 100).try_cast("decimal(20,0)") * F.col(GROUP_ROWS)
    totals = (groups.groupBy(quoted(key))
              .agg((F.sum(each).cast("double") / 100).alias(name), F.min(least).alias("_least"),
                   F.sum(GROUP_ROWS).alias(GROUP_ROWS))
              .filter(F.col(name) > F.col("_least")).drop("_least"))
    return settle(totals, weight=GROUP_ROWS)
